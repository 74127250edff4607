"""Blocks that are only searched for fingerprints."""

import numpy as np
import pyarrow as pa

from batchlens.llm import collocations as C


def test_a_search_does_without_word_ids(monkeypatch):
    texts = ["New york, new  york\tcity.", "", "é 日本 city! new york city"]
    batch = pa.record_batch([pa.array(range(3), pa.int64()), pa.array(["en", "und", "en"]), pa.array(texts)], names=["row", "lang", "text"])
    ((whole, _rows, _langs),) = C.blocks(batch)
    checks = C.word_hashes(["new".encode(), "日本".encode()])
    for word, check in zip(("new", "日本"), checks, strict=True):
        (k,) = [i for i in range(whole.n_ids) if whole.text(int(whole.first[i]), 1) == word]
        assert whole.word_check[k] == C.mix64(check + C.word_hashes([b"en"]))[0]

    def fail(*_args):
        raise AssertionError("a search groups no words")

    monkeypatch.setattr(C.Block, "_exact", fail)
    monkeypatch.setattr(C, "word_hashes", lambda words, real=C.word_hashes: real(words) if len(words) <= 2 else fail())
    ((places, _rows, _langs),) = C.blocks(batch, grouped=False)
    for n in (1, 2, 3):
        for a, b in zip(whole.grams(n), places.grams(n), strict=True):
            assert np.array_equal(a, b)
