"""Conversation repair against a uniform-cost search over all edit strings."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from batchlens.llm import conversations as cv

from .cases import key

SCHEMA = "conv_id long, turn long, role string, text string, audit string, idx int"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20, say(role), say(text)
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(cv.SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows):
    """Cheapest edits, ties by the string: states are expanded by (cost, string)."""
    kinds, done, heap = faults(rows), set(), [(0, "", 0, "", ())]
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    while heap:
        cost, audit, k, last, out = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(rows) and last in ("", "a"):
            return cost, audit, out
        made = follow[last][-1]
        full = {"u": "user", "a": "assistant"}[made]
        heapq.heappush(heap, (cost + 2, audit + "I", k, made, (*out, (full, ""))))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, last, out))
            if kinds[k] in ("", "truncated"):
                more = cost + (kinds[k] == "truncated")
                heapq.heappush(heap, (more + 2, audit + "R", k + 1, made, (*out, (full, text))))
                if role[:1] and role[:1] in follow[last]:
                    heapq.heappush(heap, (more, audit + "K", k + 1, role[:1], (*out, (role, text))))


def expected(rows):
    per = {}
    for r in rows:
        per.setdefault(r[0], []).append(r)
    out = []
    for conv, own in per.items():
        d = sorted(damage(own), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = [r[0] for r in d if r[0] is not None]
        kinds = faults(d)
        cost, audit, fixed = search(d)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(d, d[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(),
        ))
    return sorted(out, key=key)


def made(seed):
    """Conversations of 1 to 250 rows, one with a null id, null turns, odd roles, blanks and repeats; of rows with
    equal turn and role one stays, so their order is defined by the contract alone."""
    rnd, seen, out = random.Random(seed), set(), []
    for conv, n in [(None, 60), (0, 250), (1, 1), (2, 2), (3, 40), (4, 5), (7, 1)]:
        for k in range(n):
            turn = rnd.choice([None, k, k, k, k + 50])
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "ursula"])
            text = rnd.choice([None, "", " \t", "Yes.", "Go on", f"So {k}!", f"A {k}", f"Q {k}? \n", f"{k} é😀."])
            if turn not in seen and (conv, turn) not in seen:
                seen.add((conv, turn))
                out.append((conv, turn, role, text, "clash", 3))
    return out


@pytest.mark.parametrize("per,parts", [(1000, 1), (7, 5), (2, 8)])
def test_repair_equals_search(spark, per, parts):
    for seed in (1, 2):
        rows = made(seed)
        got = cv.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(3), rows_per=per, parts=parts)
        assert sorted((tuple(r) for r in got.collect()), key=key) == expected([r[:4] for r in rows])


def test_dropped_and_empty(spark):
    gone = next(k for k in range(999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "", 0)], SCHEMA)
    assert [tuple(r) for r in cv.repair_report(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.repair_report(df.limit(0)).count() == 0


def test_one_hot_conversation(spark):
    """One conversation of 5000 equal rows without turns, and repeated rows all over: no chunk holds more than 100."""
    df = spark.range(5000).select(F.lit(1).alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"),
                                  F.when(F.col("id") < 4990, "Same.").otherwise(F.concat(F.lit("Other "), F.col("id").cast("string"))).alias("text"))
    fixed = cv.repair(df, rows_per=100, parts=8)
    row = fixed.report.first()
    assert (row.blank, row.duplicate, row.truncated, row.gaps, row.illegal) == (0, 4989, 10, 0, 4999)
    assert fixed.segments.agg(F.max(F.length("audit"))).first()[0] <= 2 * 100 + 2
    rows = [(None, r.role, r.text) for r in sorted(df.collect(), key=lambda r: r.text)]  # any order within the tie costs the same
    assert row.cost == search(rows)[0]


def test_fix_up_passes_end_with_true_vectors(spark):
    """Vectors of chunks, normalised, are those of one pass over the whole conversation."""
    rnd, tool = random.Random(5), cv.Automaton()
    codes = bytes(rnd.choice([0, 1, 2, 3, 4, 9, 10]) for _ in range(400))
    whole, total = tool.vectors(codes, cv.ENDS)
    cuts = [0, 1, 2, 50, 51, 180, 400]
    df = spark.createDataFrame([("v", k, 6, bytearray(codes[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], "conv_id string, idx long, of long, codes binary")
    passed, passes = cv.converge(df)
    got = {r.idx: r for r in passed.collect()}
    assert passes >= 1 and sum(r.cost for r in got.values()) == total
    for k, a in enumerate(cuts[:-1]):
        assert tuple(got[k].start) == whole[a]
    state, edits = 0, []
    entry = {r.idx: r.entry for r in cv.entries(passed).collect()}
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        assert entry[k] == state
        some, state = tool.trace(codes[a:b], tool.vectors(codes[a:b], tuple(got[k].end))[0], state)
        edits += some
    assert edits == tool.trace(codes, whole, 0)[0]
