"""Shortest-pack-first packing over the histogram of lengths.

Every document becomes pieces: whole-capacity ones, which are sequences of their own, and a last shorter one. Only the
histogram of the short pieces' lengths (at most ``capacity`` counts) reaches the driver. Lengths are placed longest first,
each into the pack with the most room; packs with equal contents are one pattern with a count, so a step moves counts
between patterns. Documents of a length are interchangeable; they get their places back by rank: ranks within a task, shifted
by the counts of earlier tasks, looked up among the patterns' placements (a table whose size ``capacity`` and ``depth`` bound).

Room that is left is filled by cutting: with W free places in all underfull packs, the ceil(W / capacity) emptiest ones are
dissolved, and their documents, laid end to end, are cut to fill the others; what remains after the last room (less
than one capacity) becomes sequences whose lengths are powers of two, which need no padding. So nothing is padded but packs
whose room is at most ``spare``.

Null texts are empty documents (one end id); rows with equal ids are packed as separate documents; an empty table
gives no rows; texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_columns, emit, materialize
from .tokens import piece_encoder

CAPACITY = 4096
END_ID = 2
#: Documents in one pack; bounds the placement table to 2 * capacity * depth rows.
DEPTH = 256
#: Rooms up to this size are padded: filling them would cut a document into scraps.
SPARE = 0


def shortest_pack_first(counts: dict[int, int], capacity: int, depth: int) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """Placements [length, packs, first pack, offset] (one document of that length in each of the packs) and the final
    (room, first pack, packs). A length opens new packs only where it fits none."""
    rooms: dict[int, list[tuple[int, int, int]]] = {}
    heap: list[int] = []
    placed, closed, packs = [], [], 0

    def put(room: int, first: int, n: int, items: int) -> None:
        if not room or items >= depth:
            closed.append((room, first, n))
            return
        if not rooms.get(room):
            rooms[room] = []
            heapq.heappush(heap, -room)
        rooms[room].append((first, n, items))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while heap and not rooms[-heap[0]]:
                heapq.heappop(heap)
            room = -heap[0] if heap else 0
            if room < length:  # a new pack has the most room until no document of this length fits it any more
                each = min(capacity // length, depth, left)
                n = left // each
                placed += [[length, n, packs, k * length] for k in range(each)]
                put(capacity - each * length, packs, n, each)
                packs, left = packs + n, left - n * each
                continue
            first, n, items = rooms[room].pop()
            take = min(n, left)
            placed.append([length, take, first, capacity - room])
            if n > take:
                rooms[room].append((first + take, n - take, items))
            put(room - length, first, take, items + 1)
            left -= take
    closed += [(room, first, n) for room, some in rooms.items() for first, n, _ in some]
    return placed, closed


class Plan:
    """Where the documents of every length and rank go, as arrays that tasks search."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, depth: int = DEPTH, spare: int = SPARE):
        self.capacity = capacity
        placed, closed = shortest_pack_first(counts, capacity, depth)
        open_ = sorted((c for c in closed if c[0] > spare and (capacity - c[0]) & (capacity - c[0] - 1)), key=lambda c: -c[0])
        self.free = sum(room * n for room, _, n in open_)
        gone = -(-self.free // capacity)
        self.dissolved, fill = [], []  # (first pack, packs, fill, start in the stream); (start among the rooms, first pack, packs, room)
        stream = space = 0
        for room, first, n in open_:
            take = min(n, gone)
            if take:
                self.dissolved.append((first, take, capacity - room, stream))
                stream, gone = stream + take * (capacity - room), gone - take
            if n > take:
                fill.append((space, first + take, n - take, room))
                space += (n - take) * room
        self.space, self.rest = space, stream - space
        self.fill = np.array(fill, np.int64).reshape(-1, 4)
        self.next_pack = max((first + n for _, first, n in closed), default=0)
        self.tails = [1 << k for k in reversed(range(capacity.bit_length())) if self.rest >> k & 1]
        rows = []  # length, dissolved first, packs, first pack, offset, start in the stream, fill
        bounds = sorted(self.dissolved)
        firsts = [b[0] for b in bounds]
        for length, n, first, offset in placed:
            at = first
            while at < first + n:
                k = int(np.searchsorted(firsts, at, "right")) - 1
                if k >= 0 and at < bounds[k][0] + bounds[k][1]:
                    stop = min(first + n, bounds[k][0] + bounds[k][1])
                    rows.append((length, 0, stop - at, at, offset, bounds[k][3] + (at - bounds[k][0]) * bounds[k][2] + offset, bounds[k][2]))
                else:
                    stop = min(first + n, firsts[k + 1] if k + 1 < len(firsts) else first + n)
                    rows.append((length, 1, stop - at, at, offset, -1, 0))
                at = stop
        rows.sort()  # documents that will be cut have the lowest ranks, and so lie in few tasks
        table = np.array(rows, np.int64).reshape(-1, 7)
        before = np.cumsum(table[:, 2]) - table[:, 2]
        new = np.append(True, table[1:, 0] != table[:-1, 0]) if len(table) else np.zeros(0, bool)
        self.table = table
        self.rank = before - np.maximum.accumulate(np.where(new, before, 0)) if len(table) else before
        self.key = (table[:, 0] << 44) + self.rank

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pack, offset and place in the stream of cut documents (-1: not cut) for lengths and ranks."""
        k = np.searchsorted(self.key, (lengths << 44) + ranks, "right") - 1
        nth, row = ranks - self.rank[k], self.table[k]
        return row[:, 3] + nth, row[:, 4], np.where(row[:, 5] < 0, -1, row[:, 5] + nth * row[:, 6])

    def cuts(self, at: int, length: int):
        """(start, length, sequence, offset) of the parts of a document that lies at ``at`` in the stream."""
        done = 0
        while done < length:
            now = at + done
            if now < self.space:
                space, first, _, room = self.fill[int(np.searchsorted(self.fill[:, 0], now, "right")) - 1].tolist()
                pack, inside = divmod(now - space, room)
                sequence, offset, size = first + pack, self.capacity - room + inside, room - inside
            else:
                inside, sequence = now - self.space, self.next_pack
                for tail in self.tails:
                    if inside < tail:
                        break
                    inside, sequence = inside - tail, sequence + 1
                offset, size = inside, tail - inside
            size = min(size, length - done)
            yield done, size, sequence, offset
            done += size


ENCODED = pa.schema([("part", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())])


def encoded(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: whole-capacity ones, and a last shorter one with its ids (16 bits each where the vocabulary
    allows) and its rank ``nth`` among the pieces of its length in this task."""

    def run(batches):
        from pyspark import TaskContext

        part, uid, seen = TaskContext.get().partitionId(), 0, {}
        tool, end = piece_encoder(path, lead=False), struct.pack("<I", end_id)
        narrow = np.uint16 if max(tool.library.get_vocab_size(), end_id) < 1 << 16 else np.uint32
        out, weight = [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, ids, ends in tool.slices(texts):
                for k in range(len(ends) - 1):
                    own = ids[ends[k] : ends[k + 1]]
                    raw, n = own.tobytes() + end, len(own) + 1
                    for start in range(0, n, capacity):
                        size = min(capacity, n - start)
                        kept = nth = None
                        if size < capacity:
                            nth = seen.get(size, 0)
                            seen[size] = nth + 1
                            kept = np.frombuffer(raw, np.uint32)[start:].astype(narrow).tobytes()
                            weight += len(kept)
                        out.append(((part << 40) + uid, keys[at + k], start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n, nth, kept))
                        uid += 1
                    if len(out) >= 5000 or weight > 8 << 20:
                        yield emit(ENCODED, [[part] * len(out), *zip(*out, strict=True)])
                        out, weight = [], 0
        if out:
            yield emit(ENCODED, [[part] * len(out), *zip(*out, strict=True)])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "part long, uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long, ids binary")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(pieces: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH, spare: int = SPARE) -> DataFrame:
    """Pieces as ``encoded`` gives them (a written table) to their sequences and offsets; some are cut once more."""
    whole = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = pieces.filter(F.col("length") < capacity)
    per = materialize(short.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity - 1 rows
    plan = Plan(counts, capacity, depth, spare)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    shift = per.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("shift"))
    schema = pa.schema([(c, pa.int64()) for c in ("part", "uid", *COLUMNS, "stream")])

    def place(batches):
        for batch in batches:
            t = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(batch.schema.names) if c != "doc_id"}
            if batch.num_rows:
                pack_id, offset, stream = shared.value.place(t["length"], t["nth"] + t["shift"])
                yield emit(schema, [t["part"], t["uid"], batch.column("doc_id"), t["start"], t["length"], t["ids_crc32"], t["doc_tokens"], pack_id, offset, stream])

    ranked = short.select("part", "uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth").join(shift, ["part", "length"])
    ranked = ranked.select("part", "uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "shift")
    placed = materialize(ranked.mapInArrow(place, f"part long, uid long, {PIECE}, stream long"))
    kept = placed.filter("stream < 0").select(*COLUMNS)
    cut = placed.filter("stream >= 0")
    last = cut.agg(F.max("part")).first()[0]
    if last is None:
        return whole.unionByName(kept)
    out_schema = pa.schema([(c, pa.int64()) for c in COLUMNS])

    def again(batches):
        for batch in batches:
            out = []
            for doc, start, length, n, stream, raw in zip(*batch_columns(batch, "doc_id", "start", "length", "doc_tokens", "stream", "ids"), strict=True):
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * length else np.uint32).astype("<u4")
                for at, size, sequence, offset in shared.value.cuts(stream, length):
                    out.append((doc, start + at, size, zlib.crc32(ids[at : at + size].tobytes()), n, sequence, offset))
            if out:
                yield emit(out_schema, list(zip(*out, strict=True)))

    ids = pieces.filter((F.col("part") <= last) & (F.col("length") < capacity)).select("uid", "ids")  # files of later tasks are skipped
    more = cut.select("uid", "doc_id", "start", "length", "doc_tokens", "stream").join(ids, "uid").mapInArrow(again, PIECE)
    return whole.unionByName(kept).unionByName(more)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    return pack(materialize(encoded(docs, path, capacity, end_id)), capacity)
