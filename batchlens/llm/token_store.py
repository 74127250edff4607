"""Token ids in directly addressable codes: random access to any token without decoding a block.

A segment holds the ids of whole consecutive documents. Ids are split into 8-bit chunk levels: level 0 has
the low chunk of every id, level k the next chunk of those ids that go on. For each level but the last one a
continuation bitmap tells which ids go on, and a rank directory holds the number of set bits before each
512-bit block, so the place of an id's next chunk is one directory entry plus a popcount within a block.

Layout of a segment (little-endian): ``MAGIC``, u32 levels, u64 ids, u64 documents; the document starts
(u64 each, one more than documents); per level: u64 chunks, the chunks; and, if a level follows, the bitmap
(64-bit words) and the directory (u32 per block).

Segments are written as rows of a table, in ascending order of the document id (range partitions, sorted
within), so a 100 TB corpus is as many independent files as partitions. Rows with equal ids keep all their
copies, null ids come first, a null text is empty and still has its end id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_columns, emit, materialize, shard_count
from .tokens import piece_encoder

MAGIC = b"DACIDS01"
BLOCK = 512
SEGMENT_IDS = 2_000_000


def pack_segment(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """Bytes of one segment. ``starts``: first id of each document, then the number of ids."""
    rest = ids.astype(np.uint32)
    levels, parts = 0, []
    while True:
        parts.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes())
        levels += 1
        goes_on = rest > 0xFF
        if not goes_on.any():
            break
        bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK, np.bool_)
        bits[: len(rest)] = goes_on
        counts = bits.reshape(-1, BLOCK).sum(1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)[:-1]])
        parts.append(np.packbits(bits, bitorder="little").tobytes() + ranks.tobytes())
        rest = rest[goes_on] >> 8
    return b"".join([MAGIC, struct.pack("<IQQ", levels, len(ids), len(starts) - 1), starts.astype("<u8").tobytes(), *parts])


class Segment:
    """Reader of one segment; nothing is decoded until it is asked for."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token segment")
        levels, self.n, docs = struct.unpack_from("<IQQ", raw, 8)
        at = 28
        self.starts = np.frombuffer(raw, "<u8", docs + 1, at)
        at += 8 * (docs + 1)
        self.chunks, self.words, self.ranks = [], [], []
        for k in range(levels):
            (m,) = struct.unpack_from("<Q", raw, at)
            self.chunks.append(np.frombuffer(raw, np.uint8, m, at + 8))
            at += 8 + m
            if k + 1 < levels:
                blocks = -(-m // BLOCK)
                self.words.append(np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at).view("<u8"))
                self.ranks.append(np.frombuffer(raw, "<u4", blocks, at + blocks * BLOCK // 8))
                at += blocks * (BLOCK // 8 + 4)

    def access(self, positions: np.ndarray) -> np.ndarray:
        """Ids at any positions, by rank directories only."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the segment")
        out = np.zeros(len(at), np.uint32)
        open_ = np.arange(len(at))
        for k, chunks in enumerate(self.chunks):
            out[open_] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            if k == len(self.words) or not len(open_):
                break
            words, place = self.words[k], at >> 6
            goes_on = (words[place] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            open_, at, place = open_[goes_on], at[goes_on], place[goes_on]
            rank = self.ranks[k][at // BLOCK].astype(np.int64)
            first = at // BLOCK * (BLOCK // 64)
            for step in range(BLOCK // 64 - 1):  # whole words of the block before the position
                rank += np.where(first + step < place, np.bitwise_count(words[np.minimum(first + step, place)]), 0)
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            at = rank + np.bitwise_count(words[place] & below)
        return out

    def all(self) -> np.ndarray:
        """All ids in order: each level is laid over the ids that go on."""
        value = np.zeros(0, np.uint32)
        for k in range(len(self.chunks) - 1, -1, -1):
            low = self.chunks[k].astype(np.uint32)
            if k < len(self.words):
                goes_on = np.unpackbits(self.words[k].view(np.uint8), count=len(low), bitorder="little").astype(bool)
                low[goes_on] |= value << np.uint32(8)
            value = low
        return value

    def document(self, k: int) -> np.ndarray:
        return self.access(np.arange(int(self.starts[k]), int(self.starts[k + 1])))


WRITTEN = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("number", pa.int64()), ("before", pa.int64()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text with the vocabulary file ``path``, append ``end_id`` and write segments in ascending
    id order. Returns the table: part (order of the files), number (order within), before (ids before it within
    the part), doc_ids, n_ids, payload."""

    def segments(batches):
        end, tool = struct.pack("<I", end_id), piece_encoder(path, True)
        ids: list[int | None] = []
        held: list[bytes] = []
        size, number, before = 0, 0, 0

        def flush():
            nonlocal ids, held, size, number, before
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])])
            raw = pack_segment(np.frombuffer(b"".join(held), "<u4"), starts)
            out = emit(WRITTEN, [[ids], [int(starts[-1])], [number], [before], [raw]])
            ids, held, size, number, before = [], [], 0, number + 1, before + int(starts[-1])
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, found, ends in tool.slices(batch.column(1)):
                for k in range(len(ends) - 1):
                    ids.append(keys[at + k])
                    held.append(found[ends[k] : ends[k + 1]].tobytes() + end)
                    size += int(ends[k + 1] - ends[k]) + 1
                    if size >= SEGMENT_IDS:
                        yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shard_count(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(segments, "doc_ids array<long>, n_ids long, number long, before long, payload binary")
    return materialize(written.withColumn("part", F.spark_partition_id()))


def read_tokens(table: DataFrame) -> DataFrame:
    """Documents of a written table: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    totals = sorted(table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row per partition written
    base, at = [], 0
    for part, n in totals:
        base.append((part, at))
        at += n
    offsets = table.sparkSession.createDataFrame(base or [(0, 0)], "part int, base long")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(batches):
        for batch in batches:
            for raw, keys, first in zip(*batch_columns(batch, "payload", "doc_ids", "first"), strict=True):
                segment = Segment(raw)
                ids = segment.all().astype("<u4")
                view, starts = memoryview(ids).cast("B"), segment.starts.astype(np.int64)
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield emit(out, [keys, starts[:-1] + first, np.diff(starts), crc])

    joined = table.join(F.broadcast(offsets), "part").select("payload", "doc_ids", (F.col("base") + F.col("before")).alias("first"))
    return joined.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
