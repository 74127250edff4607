"""Histogram packing: validity of every piece against the library, zero padding, and the plan by itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from batchlens.llm import histogram_packing as hp
from batchlens.llm.common import materialize
from batchlens.llm.tokens import PieceEncoder, vocabulary

from .cases import documents, empty, key, rows
from .test_tokens import BYTES, WORDS, fuzz

import pyarrow as pa


def check(pieces, texts, capacity, end=2):
    """Every id of every document lies in one piece; sequences are gapless; returns the padding."""
    library = Tokenizer.from_file(WORDS)
    docs = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [end], "<u4")) for i, t in texts]
    want, got, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, ids in docs:
        want[i, len(ids)].append(ids)
    for doc, start, length, crc, n, sequence, offset in pieces:
        assert any(zlib.crc32(ids[start : start + length].tobytes()) == crc for ids in want[doc, n])
        got[doc, n].append((start, length))
        sequences[sequence].append((offset, length))
    assert {k for k, v in want.items() if v} == set(got)
    for name, parts in got.items():
        cover = np.zeros(name[1], int)
        for start, length in parts:
            cover[start : start + length] += 1
        assert (cover == len(want[name])).all()
    padding = 0
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding


def test_rows(spark):
    got = [tuple(r) for r in hp.pack_documents(documents(spark), WORDS, capacity=64).collect()]
    assert check(got, [r[:2] for r in rows()], 64) == 0
    got = [tuple(r) for r in hp.pack_documents(documents(spark), WORDS).collect()]
    assert check(got, [r[:2] for r in rows()], hp.CAPACITY) == 0
    assert hp.pack_documents(empty(spark), WORDS).count() == 0


def test_hot_length_over_partitions(spark):
    """A third of the documents share one length; the result doesn't depend on the partitions but by names."""
    rnd = random.Random(4)
    texts = [(k, "same words again" if k % 3 == 0 else " ".join(["the"] * rnd.randint(0, 90))) for k in range(600)]
    sizes = []
    for parts in (1, 7):
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        out = hp.pack(materialize(hp.encoded(df, WORDS, 64)), 64)
        got = [tuple(r) for r in out.collect()]
        assert check(got, texts, 64) == 0
        sizes.append(sorted(r.n for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()))
    assert sizes[0] == sizes[1]


def test_shortest_pack_first_by_single_documents():
    """The histogram gives the packs of the rule applied document by document."""
    rng = np.random.default_rng(2)
    for n in (1, 30, 400):
        sizes = rng.integers(1, 100, n)
        plain = []
        for s in sorted(sizes.tolist(), reverse=True):
            most = min(plain, default=100, key=lambda f: f)
            if plain and 100 - most >= s:
                plain[plain.index(most)] += s
            else:
                plain.append(s)
        counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
        placed, closed = hp.shortest_pack_first(counts, 100, 10**9)
        assert sorted(100 - room for room, _, k in closed for _ in range(k)) == sorted(plain)
        assert sum(length * k for length, k, *_ in placed) == sizes.sum()


def test_plan_bounds():
    rng = np.random.default_rng(3)
    counts = {k: int(n) for k, n in enumerate(rng.integers(1, 10**9, 511), 1)}
    plan = hp.Plan(counts, 512, depth=16)
    assert len(plan.table) <= 2 * (2 * 512 * 16) and plan.rest < 512  # each row is cut at most once more per dissolved interval
    assert sum(t for t in plan.tails) == plan.rest
    for length, n in list(counts.items())[::50]:  # every rank has a place
        ranks = np.unique(rng.integers(0, n, 200))
        pack, offset, stream = plan.place(np.full(len(ranks), length), ranks)
        assert (offset + length <= 512).all() and (pack >= 0).all() and (stream >= -1).all()
    assert hp.Plan({}, 512).table.shape == (0, 7)
    assert hp.Plan({1: 20 * 256}, 512, depth=256).free == 0  # 256 is a power of two
    odd = hp.Plan({1: 20 * 256 + 136}, 512, depth=256)  # the last pack is dissolved into powers of two
    assert odd.space == 0 and odd.tails == [128, 8]


def test_piece_encoder_equals_library():
    texts = fuzz(3000, 6) + [r[1] or "" for r in rows()] + ["aİ.x", "xİ., İ.", ""]
    for path, lead in ((WORDS, False), (BYTES, True)):
        library = Tokenizer.from_file(path)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for most in (10**6, 0):
            tool = PieceEncoder(path, lead, most)
            parts = [texts] if most else [texts[k : k + 7] for k in range(0, len(texts), 7)]
            got = [ids[a:b].tolist() for some in parts for _, ids, ends in tool.slices(pa.array(some, pa.string())) for a, b in zip(ends[:-1], ends[1:])]
            assert got == want
    assert vocabulary("word_bpe_49k.json") == WORDS and key((None,))
