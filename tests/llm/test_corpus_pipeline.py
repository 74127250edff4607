"""The pipeline on documents whose outcome is known by construction."""

import random
import zlib

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from batchlens.llm.tokens import vocabulary

from .cases import key


def prose(seed, n):
    rnd = random.Random(seed)
    return [f"{rnd.choice('bcdfgklmnprst')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{rnd.randint(0, 999)}" for _ in range(n)]


def test_stages(spark):
    one, two, three, four = (prose(k, 120) for k in range(4))
    near = [*one[:60], "changed", *one[61:]]
    passage = prose(9, 40)
    noise = "home | about | contact | news |"
    data = [
        (1, " ".join(one) + "."), (2, " ".join(one) + "."), (3, " ".join(near) + "."),  # a copy and a near copy of 1
        (4, " ".join(two + passage) + " fourth end."), (5, " ".join(three + passage) + " fifth end."),  # share a passage
        (6, noise + "\n" + " ".join(four) + '\ntoken = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" stays secret, they say.'),
        (7, "too short."), (8, None), (9, "\n".join(["BUY!! NOW!! CHEAP!! SHOES!! " * 8] * 3)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""))
        assert docs.columns == names, name
    want = {
        1: " ".join(one) + ".",
        4: " ".join(two) + " fourth end.",
        5: " ".join(three) + " fifth end.",
        6: " ".join(four) + '\n[SECRET]" stays secret, they say.',
    }
    assert {r.doc_id: r.text for r in docs.collect()} == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in want.items()}
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed), key=key) == sorted(((i, 0, len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()), key=key)
    assert len({r.sequence_id for r in packed}) == -(-sum(map(len, ids.values())) // 2048)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "secrets", "packing"]
