"""What a task of the collocation count holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from batchlens.llm import collocations as C


def test_a_block_is_compared_in_parts():
    rng = np.random.Generator(np.random.PCG64(3))
    words = np.array([f"w{k}" for k in range(5000)])
    texts = [" ".join(words[rng.integers(0, len(words), 2000)]) for _ in range(400)]  # 4.5 MB
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(["en"] * len(texts)), pa.array(texts)], names=["row", "lang", "text"])
    C._powers.clear()
    tracemalloc.start()
    n = sum(len(block.ids) for block, _rows, _langs in C.blocks(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 400 * 2000
    assert peak < 100e6


def test_words_of_one_hash_are_told_apart_in_every_part(monkeypatch):
    monkeypatch.setattr(C, "COMPARED", 7)
    words = [f"w{k % 23}" for k in range(300)]
    batch = pa.record_batch([pa.array([0], pa.int64()), pa.array(["en"]), pa.array([" ".join(words)])], names=["row", "lang", "text"])
    ((block, _rows, _langs),) = C.blocks(batch, bits=2)
    assert block.n_ids == 23
    assert [block.text(int(block.first[i]), 1) for i in block.ids] == words
