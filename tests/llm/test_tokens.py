"""Token operators against the tokenizers library and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from batchlens.llm import bpe, packing, token_store
from batchlens.llm.tokens import ByteLevelEncoder, vocabulary

from .cases import documents, empty, key, rows

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ATOMS = [" ", "  ", "\n", "\t", "a", "'s", "é", "é", "　", "x1", ".,", "<|endoftext|>", "<|startoftext|>", "\x85", "​", " a", "don't", "日本", "😀", "\x1c", "\xa0", "᠎", "Σ", "İ", "ß", "aaa", "the", "12", "½", "ǅ", "각", "\x00"]


def fuzz(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def test_byte_level_memo_equals_library():
    texts = fuzz(3000) + [r[1] for r in rows()]
    library = Tokenizer.from_file(BYTES)
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert ByteLevelEncoder(BYTES).encode(texts) == want
    forgetful = ByteLevelEncoder(BYTES, most=0)
    assert [x for t in texts for x in forgetful.encode([t])] == want


def test_word_bpe_equals_library():
    texts = fuzz(3000, 2) + ["a" * 300, "ab" * 1500, "".join(random.Random(3).choices("abcdefghij", k=5000))] + [r[1] or "" for r in rows()]
    library, own = Tokenizer.from_file(WORDS), bpe.WordBPE(WORDS)
    got = own.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [own.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_rows(spark):
    library = Tokenizer.from_file(WORDS)
    got = sorted(((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(documents(spark), WORDS).collect()), key=key)
    ids = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows()]
    assert got == sorted(((i, tuple(x), library.decode(x, skip_special_tokens=False)) for i, x in ids), key=key)
    assert bpe.encode(empty(spark), WORDS).count() == 0


@pytest.mark.parametrize("top", [1, 256, 50_000, 2**31])
def test_directly_addressable_codes(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 511, 512, 513, 9000):
        ids = rng.integers(0, top, n).astype(np.uint32)
        starts = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 5)]))
        segment = token_store.Segment(token_store.pack_segment(ids, starts))
        at = rng.integers(0, max(n, 1), 300 if n else 0)
        assert (segment.access(at) == ids[at]).all() and (segment.all() == ids).all()
        assert all((segment.document(k) == ids[a:b]).all() for k, (a, b) in enumerate(zip(starts, starts[1:])))
    with pytest.raises(IndexError):
        segment.access(np.array([9000]))


def expected_ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_token_store_rows(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 500)
    library = Tokenizer.from_file(BYTES)
    got = [tuple(r) for r in token_store.read_tokens(token_store.write_tokens(documents(spark), BYTES)).collect()]
    at, want = 0, []
    for i, t in sorted(((r[0], r[1] or "") for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = expected_ids(library, t)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert token_store.read_tokens(token_store.write_tokens(empty(spark), BYTES)).count() == 0


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 100, 400)
    bins, offsets, fills = packing.best_fit(sizes, 100)
    open_, want = [], np.zeros(400, int)
    for k in np.argsort(-sizes, kind="stable"):  # plain search for the tightest bin
        fit = [b for b in range(len(open_)) if open_[b] >= sizes[k]]
        room = min((open_[b] for b in fit), default=None)
        if room is None:
            open_.append(100 - sizes[k])
            want[k] = 100
        else:
            b = next(b for b in fit if open_[b] == room)
            want[k] = room
            open_[b] -= sizes[k]
    assert len(fills) == len(open_) and sorted(fills) == sorted(100 - x for x in open_)
    order = np.lexsort((offsets, bins))
    assert all((offsets[order][1:] == offsets[order][:-1] + sizes[order][:-1]) | (np.diff(bins[order]) > 0))


def check_packing(rows_, capacity):
    by = {}
    for sequence, offset, length in rows_:
        by.setdefault(sequence, []).append((offset, length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_documents(spark):
    library = Tokenizer.from_file(BYTES)
    got = packing.pack_documents(documents(spark), BYTES, capacity=64).collect()
    assert check_packing([(r.sequence_id, r.offset, r.length) for r in got], 64) >= 1
    pieces = []
    for r in rows():
        ids = expected_ids(library, r[1])
        stops = list(range(len(ids) % 64 or 64, len(ids) + 1, 64))
        for k, (a, b) in enumerate(zip([0, *stops], stops)):
            pieces.append((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(pieces, key=key)
    assert packing.pack_documents(empty(spark), BYTES).count() == 0


def test_packing_over_rounds(spark):
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 2048, 3000)
    df = spark.createDataFrame([(k, int(n)) for k, n in enumerate(sizes)], "uid long, length long")
    got = packing.pack(df, per_task=300).join(df, "uid").collect()
    n = check_packing([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert len(got) == 3000 and n <= 1.03 * len(packing.best_fit(sizes, 2048)[2])
    halves = spark.createDataFrame([(k, 1100) for k in range(2000)], "uid long, length long")  # nothing ever joins
    assert packing.pack(halves, per_task=100).select("sequence_id").distinct().count() == 2000
