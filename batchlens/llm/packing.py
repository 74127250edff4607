"""Best-fit packing of token sequences by hierarchical residual packing.

Texts longer than ``capacity`` are cut into pieces (the first takes the remainder); whole-capacity pieces
are sequences of their own. All other pieces are packed in rounds: each task packs its items best-fit,
largest first, and emits bins that are nearly full; what is left underfull is an *item* of the next round, on
fewer tasks (a tree), until one task packs the last residue. A round keeps as many tasks as its items need
(``per_task``), and the tree ends early where a round can no longer join anything (bins over half full cannot
meet), so no task ever holds an unbounded share. Rounds only write (child, bin, place) rows; the final place
of a piece is found by following at most as many joins as there were rounds.

Null texts are empty documents (one end id); rows with equal ids are packed as separate documents; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, emit, materialize
from .tokens import MEMO, piece_encoder

CAPACITY = 2048
#: A bin with no more free places than this is emitted at once.
NEARLY_FULL = 16
FAN_IN = 8
#: Items of one task; the number of tasks grows with the items.
PER_TASK = 30_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing. Bin and offset of each item, and the fill of each bin. The open bins are
    kept by free room; a bit mask of the rooms in use finds the tightest bin that fits."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, memo: int = MEMO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid (unique), doc_id, piece, start, length, ids_crc32 of every piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        tool, end = piece_encoder(path, True, memo), struct.pack("<I", end_id)

        def rows():
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for at, ids, ends in tool.slices(batch.column(1)):
                    for k in range(len(ends) - 1):
                        view = memoryview(ids[ends[k] : ends[k + 1]].tobytes() + end)
                        n = len(view) // 4
                        stop = n % capacity or capacity
                        start, piece = 0, 0
                        while start < n:
                            yield keys[at + k], piece, start, stop - start, zlib.crc32(view[4 * start : 4 * stop])
                            start, stop, piece = stop, stop + capacity, piece + 1

        return batches_of(schema, rows())

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("uid", F.monotonically_increasing_id())


PLACED = pa.schema([("item", pa.int64()), ("bin", pa.int64()), ("at", pa.int64()), ("fill", pa.int64())])


def _round(items: DataFrame, tasks: int, capacity: int) -> DataFrame:
    """item, bin, at, fill: one best-fit pass in each of ``tasks`` partitions. A bin is named by its
    smallest item, so names stay unique over tasks and rounds."""

    def pack(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            names, sizes = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.argsort(names)  # the same result whatever order the shuffle delivers
            names, sizes = names[order], sizes[order]
            bins, offsets, fills = best_fit(sizes, capacity)
            label = np.full(len(fills), np.iinfo(np.int64).max)
            np.minimum.at(label, bins, names)
            for at in range(0, len(names), 20_000):
                part = slice(at, at + 20_000)
                yield emit(PLACED, [names[part], label[bins[part]], offsets[part], fills[bins[part]]])

    spread = items.select("item", "size").repartition(tasks, F.xxhash64("item"))
    return spread.mapInArrow(pack, "item long, bin long, at long, fill long")


def pack(lengths: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL, per_task: int = PER_TASK) -> DataFrame:
    """(uid, length) rows, each length at most ``capacity``, to (uid, sequence_id, offset)."""
    whole = lengths.filter(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = lengths.filter(F.col("length") < capacity).select(F.col("uid").alias("item"), F.col("length").alias("size"))
    count = items.count()
    tasks, rounds = max(1, -(-count // per_task)), []
    while True:
        done = materialize(_round(items, tasks, capacity))
        rounds.append(done)
        left = done.filter(F.col("fill") < capacity - nearly_full).select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
        if tasks == 1:
            break
        now = left.count()
        if now == 0 or (now > 0.95 * count and now > per_task):
            break
        tasks, count, items = min(max(-(-now // per_task), tasks // FAN_IN, 1), tasks - 1), now, left
    placed = rounds[0].select(F.col("item").alias("uid"), "bin", "at")
    for later in rounds[1:]:
        up = later.select(F.col("item").alias("bin"), F.col("bin").alias("over"), F.col("at").alias("shift"))
        placed = placed.join(up, "bin", "left").select(
            "uid", F.coalesce("over", "bin").alias("bin"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at")
        )
    return whole.unionByName(placed.select("uid", F.col("bin").alias("sequence_id"), F.col("at").alias("offset")))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, memo: int = MEMO) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    cut = materialize(pieces(docs, path, capacity, end_id, memo))
    return cut.join(pack(cut.select("uid", "length"), capacity), "uid").drop("uid")
