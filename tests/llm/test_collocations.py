"""Collocations against plain counting, with planted fingerprint collisions."""

import random
import re
from collections import Counter

from batchlens.llm import collocations as co

from .cases import documents, empty, key

SCHEMA = "doc_id long, lang string, text string, rank string, n int, phrase string"


def plain(docs, least, top):
    counts, total = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for n in (1, 2, 3):
                for k in range(len(words) - n + 1):
                    counts[lang, " ".join(words[k : k + n])] += 1
    rows = {}
    for (lang, phrase), a in counts.items():
        words = phrase.split(" ")
        if len(words) == 1 or a < least:
            continue
        if len(words) == 2 and any(
            c >= least and 100 * c >= 50 * a for (l2, p2), c in counts.items() if l2 == lang and p2.count(" ") == 2 and phrase in (p2.rsplit(" ", 1)[0], p2.split(" ", 1)[1])
        ):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, left, right, total[lang], score))
    return sorted((lang, k, *r[3:]) for lang, some in rows.items() for k, r in enumerate(sorted(some)[:top], 1))


def sample(seed, n=150):
    rnd = random.Random(seed)
    words = ["a", "B", "b", "the", "New", "york", "new", "City", "é", "日本", "x" * 40, "san", "jose", "x-y"]
    out = [(k, rnd.choice(["en", "en", "de", None]), rnd.choice(["", " "]).join([]) + "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", ".\n", " !", "\x0b", "　"]) for _ in range(rnd.randint(0, 60)))) for k in range(n)]
    return out + [(None, None, None), (1, "en", ""), (2, "fr", " .,; "), (2, "en", "new york city " * 30), (3, "en", out[3][2]), (3, "en", out[3][2])]


def test_equals_plain_counts(spark):
    docs = sample(1)
    df = spark.createDataFrame([(*d, "clash", 7, "p") for d in docs], SCHEMA).repartition(4)
    for least, top in ((10, 2000), (3, 5)):
        got = sorted(tuple(r) for r in co.collocations(df, least, top).collect())
        assert got == plain([d[1:] for d in docs], least, top)


def test_blocks_and_collisions(spark):
    """Tiny blocks cut long texts at piece ends; few fingerprint bits make different phrases collide, in one
    block and across blocks: the counts stay exact."""
    docs = sample(2, 60)
    df = spark.createDataFrame([(*d, "clash", 7, "p") for d in docs], SCHEMA).repartition(3)
    want = plain([d[1:] for d in docs], 3, 10**6)
    for bits, size in ((64, 50), (5, 10**6), (9, 200)):
        assert sorted(tuple(r) for r in co.collocations(df, 3, None, bits=bits, size=size).collect()) == want


def test_hot_phrase_and_edge_rows(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'en' AS lang", "'tick tock goes the clock. ' || repeat('la ', 50) AS text")
    got = {r.phrase: r for r in co.collocations(df).collect()}
    assert got["tick tock goes"].a == 3000 and got["tick tock goes"].score == 10**6 and "tick tock" not in got
    assert got["la la la"].a == 3000 * 48 and got["la la la"].n == 3000 * 55 and "la la" not in got
    docs = documents(spark).selectExpr("*", "CASE WHEN doc_id > 5 THEN 'en' END AS lang")
    want = plain([(r.lang, r.text) for r in docs.collect()], 2, 2000)
    assert sorted((tuple(r) for r in co.collocations(docs, 2).collect()), key=key) == sorted(want, key=key)
    assert co.collocations(empty(spark).selectExpr("*", "'x' AS lang")).count() == 0
