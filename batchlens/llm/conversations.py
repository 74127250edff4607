"""Repair of conversation structure by rank-convergence parallel Viterbi.

A repaired conversation has the roles ``(s?(ua)+)?`` (system, user, assistant). Edits: Keep a row (0), Rerole
it to user or assistant (2), Delete it (3; required of blank and repeated rows), Insert an empty user or assistant
row (2); a truncated row that isn't deleted costs 1 more. Four states describe what may follow: 0 nothing yet,
1 after the system row, 2 after a user row, 3 after an assistant row. The least cost of the rest of a conversation
is a vector over these states.

Rows are sorted in range partitions and cut into chunks. A conversation that lies in one chunk is solved at
once. A longer one (or one on a partition border) is solved in parallel: each chunk computes backwards from a
speculative vector at its end; fix-up passes give each chunk its successor's vector and rerun those chunks
whose end vector changed by more than a constant, until none did. Min-plus products of a few rows have rank one,
so one or two passes do. The vectors, stitched by their constants, then drive the trace: every chunk traces all four
entry states, the maps of entry to exit are joined in log2(chunks) rounds, and the chunk writes the trace of its
true entry. No task holds more than a chunk of a conversation, whatever its length.

Results: ``Repair.segments`` has the repaired rows and the audit of every chunk, ``Repair.report`` the counts and
cost of every conversation. ``digests`` folds SHA-256 over the chunks of a conversation in order (a stream with
one running state; SHA-256 has no parallel form).

Null roles and texts are one blank, a null conversation id is a conversation of its own; rows are ordered by turn
(nulls first), ties by role and a hash of the text; equal rows count as often as they occur; texts of any
length pass whole; an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, batch_columns, drop_materialized, emit, materialize, shard_count

CHUNK_ROWS = 1000
CHUNK_BYTES = 1 << 20
#: Bytes of text in one batch that a task hands back.
BATCH_BYTES = 4 << 20

ROLES = {"u": "user", "a": "assistant"}
#: State after a user or assistant row that may follow, and its initial; after a system row only from 0.
NEXT = (2, 2, 3, 2)
MADE = ("u", "u", "a", "u")
ENDS = (0, 4, 2, 0)
END_EDITS = ("", "II", "I", "")
DELETE, REROLE, INSERT, CUT_OFF = 3, 2, 2, 1
MUST, TRUNCATED = 4, 8
INITIALS = "sua"
NEVER = 1 << 30


def keep_state(state: int, initial: int) -> int | None:
    """State after keeping a row whose role starts with INITIALS[initial] (3: another letter)."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial < 3 and MADE[state] == INITIALS[initial]:
        return NEXT[state]
    return None


def closed(base: list[int]) -> list[int]:
    """Costs where empty rows may be inserted first."""
    two, three = min(base[2], INSERT + base[3]), min(base[3], INSERT + base[2])
    return [min(base[0], INSERT + two), min(base[1], INSERT + two), two, three]


class Automaton:
    """Costs and traces of single rows, remembered by (row code, vector behind the row)."""

    def __init__(self):
        self.back: dict[tuple, tuple] = {}
        self.steps: dict[tuple, tuple] = {}

    def _costs(self, code: int, after: tuple) -> tuple[list[int], list[int]]:
        late, base = CUT_OFF if code & TRUNCATED else 0, []
        for state in range(4):
            best = DELETE + after[state]
            if not code & MUST:
                kept = keep_state(state, code & 3)
                best = min(best, REROLE + late + after[NEXT[state]], NEVER if kept is None else late + after[kept])
            base.append(best)
        return base, closed(base)

    def before(self, code: int, after: tuple) -> tuple[tuple, int]:
        """Vector before the row, least entry 0, and the constant taken off."""
        got = self.back.get((code, after))
        if got is None:
            costs = self._costs(code, after)[1]
            got = self.back[code, after] = (tuple(c - min(costs) for c in costs), min(costs))
        return got

    def step(self, code: int, after: tuple) -> tuple:
        """For each state before the row: the least edits in ASCII order among the cheapest, state behind the row."""
        got = self.steps.get((code, after))
        if got is None:
            _, best = self._costs(code, after)
            late, out = CUT_OFF if code & TRUNCATED else 0, []
            for state in range(4):
                edits = ""
                while True:
                    kept = keep_state(state, code & 3)
                    if best[state] == DELETE + after[state]:
                        edits, new = edits + "D", state
                    elif best[state] == INSERT + best[NEXT[state]]:
                        edits, state = edits + "I", NEXT[state]
                        continue
                    elif kept is not None and not code & MUST and best[state] == late + after[kept]:
                        edits, new = edits + "K", kept
                    else:
                        edits, new = edits + "R", NEXT[state]
                    break
                out.append((edits, new))
            got = self.steps[code, after] = tuple(out)
        return got

    def vectors(self, codes: bytes, end: tuple) -> tuple[list[tuple], int]:
        """The vector before every row and behind the last one; the sum of the constants."""
        out, total = [end], 0
        for code in reversed(codes):
            vector, constant = self.before(code, out[-1])
            out.append(vector)
            total += constant
        out.reverse()
        return out, total

    def trace(self, codes: bytes, vectors: list[tuple], state: int) -> tuple[list[str], int]:
        out = []
        for k, code in enumerate(codes):
            edits, state = self.step(code, vectors[k + 1])[state]
            out.append(edits)
        return out, state


def apply(edits: list[str], state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Repaired roles and texts; edits beyond the rows are inserts."""
    new_roles, new_texts = [], []
    for k, some in enumerate(edits):
        for edit in some:
            if edit == "D":
                continue
            if edit == "K":
                new_roles.append(roles[k])
                new_texts.append(texts[k])
                state = 1 if roles[k][0] == "s" else NEXT[state]
                continue
            new_roles.append(ROLES[MADE[state]])
            new_texts.append(texts[k] if edit == "R" else "")
            state = NEXT[state]
    return new_roles, new_texts


class Chunk:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.roles, self.texts, self.codes, self.bytes = conv_id, [], [], bytearray(), 0
        self.seen: dict[tuple, int] = {}
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None

    def add(self, turn, role: str, text: str) -> None:
        initial = INITIALS.find(role[:1]) if role else 3
        initial = 3 if initial < 0 else initial
        stripped = text.rstrip(SPACES)
        code = initial
        if not stripped:
            self.blank += 1
            code |= MUST
        elif self.seen.setdefault((role, text), len(self.codes)) != len(self.codes):
            self.duplicate += 1
            code |= MUST
        elif stripped[-1] not in ".!?":
            self.truncated += 1
            code |= TRUNCATED
        if self.codes and not legal(self.roles[-1], role):
            self.illegal += 1
        if turn is not None and (self.high is None or turn != self.high):
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.codes.append(code)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text) + 8

    def digests(self) -> list[bytes]:
        """A digest of every row that may repeat one of an earlier chunk, empty for all others."""
        out = [b""] * len(self.codes)
        for (role, text), k in self.seen.items():
            out[k] = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return out


def legal(a: str, b: str) -> bool:
    return (a[:1] + b[:1]) in ("su", "ua", "au")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
STORED = pa.schema(
    [("conv_id", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("done", pa.bool_()), ("codes", pa.binary()), ("digests", pa.list_(pa.binary())),
     ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()),
     ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
STORED_DDL = (
    "conv_id string, part long, seq long, done boolean, codes binary, digests array<binary>, low long, high long, distinct long, "
    + ", ".join(f"{c} long" for c in COUNTS)
    + ", audit string, roles array<string>, texts array<string>"
)


def _batches(schema: pa.Schema, rows):
    """Record batches of at most 2000 rows or, beyond one row, BATCH_BYTES; rows come with their bytes."""
    held, weight = [], 0
    for row, size in rows:
        if held and (len(held) >= 2000 or weight + size > BATCH_BYTES):
            yield emit(schema, list(zip(*held, strict=True)))
            held, weight = [], 0
        held.append(row)
        weight += size
    if held:
        yield emit(schema, list(zip(*held, strict=True)))


def _solved(tool: Automaton, c: Chunk) -> tuple:
    vectors, total = tool.vectors(bytes(c.codes), ENDS)
    edits, state = tool.trace(bytes(c.codes), vectors, 0)
    edits.append(END_EDITS[state])
    roles, texts = apply(edits, 0, c.roles, c.texts)
    gaps = 0 if c.low is None else c.high - c.low + 1 - c.distinct
    return gaps, c.blank, c.duplicate, c.truncated, c.illegal, total + vectors[0][0], "".join(edits), roles, texts


def _cut(rows_per: int, bytes_per: int):
    """Sorted rows to solved conversations and to chunks of those that may go on in another partition."""

    def run(batches):
        from pyspark import TaskContext

        part, tool = TaskContext.get().partitionId(), Automaton()

        def rows():
            now, seq, inner = None, 0, False

            def chunk():
                d = now.digests()
                return (now.conv_id, part, seq, False, bytes(now.codes), d, now.low, now.high, now.distinct, None, now.blank, now.duplicate,
                        now.truncated, now.illegal, None, None, now.roles, now.texts), now.bytes

            for batch in batches:
                for conv, there, turn, role, text in zip(*batch_columns(batch, "conv_id", "there", "turn", "role", "text"), strict=True):
                    if now is None or conv != now.conv_id:
                        if now is not None:
                            if inner:  # neither the first of this partition nor cut so far
                                yield (now.conv_id, part, 0, True, None, None, None, None, None, *_solved(tool, now)), now.bytes
                            else:
                                yield chunk()
                            inner = True
                        now, seq = Chunk(conv), 0
                    elif len(now.codes) >= rows_per or now.bytes >= bytes_per:
                        yield chunk()
                        now, seq, inner = Chunk(conv), seq + 1, False
                    if there:
                        now.add(turn, role, text)
            if now is not None:
                yield chunk()

        return _batches(STORED, rows())

    return run


class Repair(NamedTuple):
    """``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost; ``segments``: conv_id, idx, of (chunks of
    the conversation), audit, roles, texts. conv_id is a string with a leading mark, see ``named``."""

    report: DataFrame
    segments: DataFrame


def named(conv_id: str) -> F.Column:
    """Text key of a conversation id: null is a conversation of its own."""
    return F.when(F.col(conv_id).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(conv_id).cast("string")))


def _numbered(chunks: DataFrame) -> DataFrame:
    """idx of every chunk in its conversation, and their number. Chunks of a partition are numbered already, so
    only one row per conversation and partition is summed up."""
    per = chunks.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("seq").alias("s0"))
    w = Window.partitionBy("conv_id").orderBy("part")
    per = per.select(
        "conv_id", "part", (F.sum("n").over(w) - F.col("n") - F.col("s0")).alias("shift"), F.sum("n").over(Window.partitionBy("conv_id")).alias("of")
    )
    return chunks.join(per, ["conv_id", "part"]).withColumn("idx", F.col("seq") + F.col("shift")).drop("shift")


MARKED = pa.schema([("conv_id", pa.string()), ("idx", pa.int64()), ("of", pa.int64()), ("codes", pa.binary()), ("duplicate", pa.int64()), ("truncated", pa.int64())])


def _mark(batches):
    """Codes with the rows that an earlier chunk has already."""
    for batch in batches:
        out = []
        for conv, idx, of, codes, dup, trunc, again in zip(*batch_columns(batch, "conv_id", "idx", "of", "codes", "duplicate", "truncated", "again"), strict=True):
            codes = bytearray(codes)
            for k in again or ():
                dup, trunc = dup + 1, trunc - bool(codes[k] & TRUNCATED)
                codes[k] = codes[k] & 3 | MUST
            out.append((conv, idx, of, bytes(codes), dup, trunc))
        yield emit(MARKED, list(zip(*out, strict=True)) if out else [[]] * len(MARKED))


PASSED = pa.schema([("conv_id", pa.string()), ("idx", pa.int64()), ("of", pa.int64()), ("codes", pa.binary()), ("end", pa.list_(pa.int32())), ("start", pa.list_(pa.int32())), ("cost", pa.int64()), ("exits", pa.list_(pa.int32())), ("changed", pa.bool_())])
PASSED_DDL = "conv_id string, idx long, of long, codes binary, end array<int>, start array<int>, cost long, exits array<int>, changed boolean"


def _pass(batches):
    """Rerun the chunks whose end vector isn't the one used before."""
    tool = Automaton()
    for batch in batches:
        out = []
        for conv, idx, of, codes, end, start, cost, exits, new in zip(*batch_columns(batch, "conv_id", "idx", "of", "codes", "end", "start", "cost", "exits", "new"), strict=True):
            changed = end != new
            if changed:
                vectors, cost = tool.vectors(codes, tuple(new))
                start, exits = list(vectors[0]), [tool.trace(codes, vectors, s)[1] for s in range(4)]
            out.append((conv, idx, of, codes, new, start, cost, exits, changed))
        yield emit(PASSED, list(zip(*out, strict=True)) if out else [[]] * len(PASSED))


def converge(marked: DataFrame) -> tuple[DataFrame, int]:
    """Vectors, constants and exits of all chunks, and the number of fix-up passes."""
    last = F.col("idx") == F.col("of") - 1
    vector = lambda v: F.array(*[F.lit(x) for x in v])
    none = F.lit(None).cast("array<int>")
    first = marked.select("conv_id", "idx", "of", "codes", none.alias("end"), none.alias("start"), F.lit(None).cast("long").alias("cost"), none.alias("exits"),
                          F.when(last, vector(ENDS)).otherwise(vector((0, 0, 0, 0))).alias("new"))
    now, passes = materialize(first.mapInArrow(_pass, PASSED_DDL)), 0
    while True:
        behind = now.select("conv_id", (F.col("idx") - 1).alias("idx"), F.col("start").alias("theirs"))
        again = now.drop("changed").join(behind, ["conv_id", "idx"], "left").withColumn("new", F.when(last, F.col("end")).otherwise(F.col("theirs"))).drop("theirs")
        after = materialize(again.mapInArrow(_pass, PASSED_DDL))
        drop_materialized(now)
        now = after
        if after.filter("changed").isEmpty():
            return now, passes
        passes += 1


def entries(passed: DataFrame) -> DataFrame:
    """conv_id, idx, entry: the state in which the trace enters each chunk; maps are joined over 1, 2, 4, ... chunks."""
    maps, step = passed.select("conv_id", "idx", "exits"), 1
    longest = passed.agg(F.max("idx")).first()[0] or 0
    while step <= longest:
        before = maps.select("conv_id", (F.col("idx") + step).alias("idx"), F.col("exits").alias("earlier"))
        joined = F.when(F.col("earlier").isNull(), F.col("exits")).otherwise(F.expr("transform(earlier, x -> exits[x])"))
        maps = materialize(maps.join(before, ["conv_id", "idx"], "left").select("conv_id", "idx", joined.alias("exits")))
        step *= 2
    come = maps.select("conv_id", (F.col("idx") + 1).alias("idx"), F.expr("exits[0]").alias("entry"))
    return passed.select("conv_id", "idx").join(come, ["conv_id", "idx"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))


SEGMENT = pa.schema([("conv_id", pa.string()), ("idx", pa.int64()), ("of", pa.int64()), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
SEGMENT_DDL = "conv_id string, idx long, of long, audit string, roles array<string>, texts array<string>"


def _trace(batches):
    tool = Automaton()

    def rows():
        for batch in batches:
            for conv, idx, of, codes, end, entry, roles, texts in zip(*batch_columns(batch, "conv_id", "idx", "of", "codes", "end", "entry", "roles", "texts"), strict=True):
                vectors, _ = tool.vectors(codes, tuple(end))
                edits, state = tool.trace(codes, vectors, entry)
                if idx == of - 1:
                    edits.append(END_EDITS[state])
                new_roles, new_texts = apply(edits, entry, roles, texts)
                yield (conv, idx, of, "".join(edits), new_roles, new_texts), sum(map(len, new_texts))

    return _batches(SEGMENT, rows())


def repair(rows: DataFrame, rows_per: int = CHUNK_ROWS, bytes_per: int = CHUNK_BYTES, parts: int | None = None) -> Repair:
    """Rows (conv_id, turn, role, text and, if it has one, ``there``: false for rows that only name their
    conversation) to repaired conversations."""
    there = F.coalesce(F.col("there"), F.lit(True)) if "there" in rows.columns else F.lit(True)
    clean = rows.select(
        named("conv_id").alias("conv_id"), there.alias("there"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    )
    clean = clean.withColumns({"tie": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "tie", "uid"]  # uid: a range border may also lie between equal rows
    spread = clean.repartitionByRange(parts or shard_count(rows.sparkSession), *order).sortWithinPartitions(*order)
    stored = materialize(spread.mapInArrow(_cut(rows_per, bytes_per), STORED_DDL))
    whole = stored.filter("done")
    open_ = stored.filter("NOT done")
    empty = open_.groupBy("conv_id").agg(F.max(F.length("codes")).alias("n")).filter("n = 0").select("conv_id")
    chunks = materialize(_numbered(open_.filter(F.length("codes") > 0).withColumn("seq", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("seq")).cast("long"))))
    seen = chunks.select("conv_id", "idx", F.posexplode("digests").alias("place", "digest")).filter(F.length("digest") > 0)
    first = seen.groupBy("conv_id", "digest").agg(F.min("idx").alias("first"))
    again = seen.join(first, ["conv_id", "digest"]).filter("idx > first").groupBy("conv_id", "idx").agg(F.collect_list("place").alias("again"))
    codes = chunks.select("conv_id", "idx", "of", "codes", "duplicate", "truncated").join(again, ["conv_id", "idx"], "left")
    marked = materialize(codes.mapInArrow(_mark, "conv_id string, idx long, of long, codes binary, duplicate long, truncated long"))
    passed, _ = converge(marked.select("conv_id", "idx", "of", "codes"))
    ready = passed.select("conv_id", "idx", "of", "codes", "end").join(entries(passed), ["conv_id", "idx"]).join(chunks.select("conv_id", "idx", "roles", "texts"), ["conv_id", "idx"])
    segments = materialize(ready.mapInArrow(_trace, SEGMENT_DDL))

    late = chunks.select("conv_id", (F.col("idx") + 1).alias("idx"), F.element_at("roles", -1).alias("role"), F.col("high").alias("turn"))
    edge = chunks.select("conv_id", "idx", "low", "high", "distinct", "blank", "illegal", F.element_at("roles", 1).alias("own")).join(late, ["conv_id", "idx"], "left")
    pair = F.concat(F.substring("role", 1, 1), F.substring("own", 1, 1))
    edge = edge.select(
        "conv_id", "idx", "low", "high", "blank", (F.col("distinct") - F.coalesce((F.col("low") == F.col("turn")).cast("int"), F.lit(0))).alias("distinct"),
        (F.col("illegal") + F.when(F.col("role").isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0)).alias("illegal"),
    ).join(marked.select("conv_id", "idx", "duplicate", "truncated"), ["conv_id", "idx"])
    total = F.col("cost") + F.when(F.col("idx") == 0, F.expr("start[0]")).otherwise(0)
    edge = edge.join(passed.select("conv_id", "idx", total.alias("cost")), ["conv_id", "idx"])
    long = edge.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("distinct"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in COUNTS[1:]],
    )
    none = empty.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    report = whole.select("conv_id", *COUNTS).unionByName(long).unionByName(none)
    blank = empty.select("conv_id", F.lit(0).cast("long").alias("idx"), F.lit(1).cast("long").alias("of"), F.lit("").alias("audit"),
                         *[F.array().cast("array<string>").alias(c) for c in ("roles", "texts")])
    simple = whole.select("conv_id", F.col("seq").alias("idx"), F.lit(1).cast("long").alias("of"), "audit", "roles", "texts")
    return Repair(report, simple.unionByName(segments).unionByName(blank))


def digests(segments: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256: the SHA-256 of the lines ``role:text`` of every conversation. Conversations of
    several segments are sorted and folded as a stream with one running hash."""
    lines = F.expr("transform(arrays_zip(roles, texts), x -> concat(x.roles, ':', x.texts))")
    body = segments.withColumn("body", F.concat_ws("\n", lines)).withColumn("n", F.size("roles"))
    one = body.filter("of = 1").select("conv_id", "audit", F.sha2("body", 256).alias("repaired_sha256"))

    def fold(batches):
        def rows():
            conv, state, some, audit = None, None, False, []
            for batch in batches:
                for key, text, n, edits in zip(*batch_columns(batch, "conv_id", "body", "n", "audit"), strict=True):
                    if key != conv:
                        if conv is not None:
                            yield (conv, "".join(audit), state.hexdigest()), len(audit)
                        conv, state, some, audit = key, hashlib.sha256(), False, []
                    audit.append(edits)
                    if n:
                        state.update((("\n" if some else "") + text).encode("utf-8", "surrogatepass"))
                        some = True
            if conv is not None:
                yield (conv, "".join(audit), state.hexdigest()), len(audit)

        return _batches(pa.schema([("conv_id", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())]), rows())

    many = body.filter("of > 1").select("conv_id", "idx", "body", "n", "audit")
    spread = many.repartition(shard_count(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "idx")
    return one.unionByName(spread.mapInArrow(fold, "conv_id string, audit string, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that their ids decide (crc32 of ``conv_id:turn`` modulo 20): 0 drops a row (it stays as a
    row that only names its conversation), 1 empties the text, 2 takes out ``.!?``, 3 repeats the row, 4 makes it a user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_report(conversations: DataFrame, **sizes) -> DataFrame:
    """Damage, repair and digest of all conversations, under their own ids."""
    fixed = repair(damaged(conversations), **sizes)
    out = fixed.report.join(digests(fixed.segments), "conv_id")
    kind = dict(conversations.dtypes)["conv_id"]
    own = F.when(F.col("conv_id") == "n", F.lit(None)).otherwise(F.expr(f"cast(substring(conv_id, 2) AS {kind})"))
    return out.select(own.alias("conv_id"), *COUNTS, "audit", "repaired_sha256")
