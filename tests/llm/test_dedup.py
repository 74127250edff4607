"""Near-duplicate, substring and embedding operators against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchlens.llm import embed_dedup, graph, near_dedup, substring
from batchlens.llm.common import word_hashes

from .cases import documents, empty, key, rows


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def top(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        self.up[self.top(x)] = self.top(y)


def least_ids(ids, sets):
    groups = defaultdict(list)
    for k, i in enumerate(ids):
        groups[sets.top(k)].append(i)
    return [min((x for x in groups[sets.top(k)] if x is not None), default=None) for k in range(len(ids))]


def brute_near(data, percent):
    shingles = []
    for _, t in data:
        w = (t or "").encode().lower().split()
        shingles.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    holders = defaultdict(list)
    sets = Sets(len(data))
    for k, s in enumerate(shingles):
        for other, n in Counter(x for g in s for x in holders[g]).items():
            if 100 * n >= percent * (len(s) + len(shingles[other]) - n):
                sets.join(k, other)
        for g in s:
            holders[g].append(k)
    return sorted(((i, len(s), c) for (i, _), s, c in zip(data, shingles, least_ids([i for i, _ in data], sets))), key=key)


@pytest.fixture(scope="module")
def near_data():
    rnd = random.Random(3)
    out = [(r[0], r[1]) for r in rows()]
    for k in range(240):
        base = random.Random(k % 6)
        w = [base.choice("abcdefghijklmnop") + str(base.randint(0, 99)) for _ in range(80)]
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(80)] = f"z{rnd.randint(0, 9)}"
        out.append((1000 + k, " ".join(w)))
    return out


def test_near_duplicates(spark, near_data, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    df = spark.createDataFrame(near_data, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == brute_near(near_data, 85)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_one_document_of_each_group_stays(spark):
    df = documents(spark)
    out = near_dedup.deduplicated(df, 80)
    kept = out.collect()
    assert out.columns == df.columns
    bare = sum(not (r[1] or "").split() for r in rows())
    groups = Counter(c for i, n, c in brute_near([(r[0], r[1]) for r in rows()], 80) if n)
    assert len(kept) == bare + len(groups)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0 and near_dedup.deduplicated(empty(spark)).count() == 0


def test_likelihood_estimate_and_bands():
    rng = np.random.default_rng(1)
    m = 512
    for j in (0.3, 0.6, 0.85):
        common, own = int(3000 * j / (1 + j) * 2 / 2), 0
        own = 1500 - common // 1 if common < 1500 else 0
        pool = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
        a, b = pool[:1500], np.concatenate([pool[:common][:1500], pool[2000 : 2000 + own]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = near_dedup.registers(a, m)[None], near_dedup.registers(b, m)[None]
        assert near_dedup.estimate(ra, rb, np.array([1500.0]), np.array([float(len(b))]))[0] == pytest.approx(true, abs=0.09)
        assert (np.maximum(ra, rb)[0] == near_dedup.registers(np.union1d(a, b), m)).all()  # registers merge
    for t in (0.8, 0.85):
        assert (1 - near_dedup.agree(t) ** near_dedup.ROWS) ** near_dedup.bands_for(t) <= near_dedup.MISS


def test_components(spark):
    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rnd.randint(1000, 1200), rnd.randint(1000, 1200)) for _ in range(120)] + [(7, 7)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    sets = Sets(max(nodes) + 1)
    for a, b in edges:
        sets.join(a, b)
    want = {n: min(x for x in nodes if sets.top(x) == sets.top(n)) for n in nodes}
    assert {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(data, window):
    seen = defaultdict(list)
    for r, (_, t) in enumerate(data):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])].append((r, k))
    gone = defaultdict(set)
    for at in seen.values():
        if len(at) > 1:
            for r, k in at:
                gone[r].update(range(k, k + window))
    out = []
    for r, (i, t) in enumerate(data):
        w = (t or "").encode().split()
        left = b" ".join(x for k, x in enumerate(w) if k not in gone[r])
        out.append((i, len(w), len(gone[r]), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=key)


def test_substrings(spark):
    rnd = random.Random(3)
    base = [[rnd.choice("abcd") for _ in range(200)] for _ in range(3)]
    data = [(r[0], r[1]) for r in rows()]
    for k in range(60):
        p = rnd.choice(base)
        a, n = rnd.randint(0, 150), rnd.randint(20, 60)
        data.append((k, " ".join([f"z{rnd.randint(0, 10**6)}", *p[a : a + n], f"y{k}", *p[: rnd.randint(0, 50)]])))
    data += [(5, "x " * 300), (8, " ".join(["q", "r"] * 40)), (9, " ".join(["q", "r"] * 40))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = substring.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=key) == brute_repeats(data, 35)


def test_substring_rows(spark):
    df = documents(spark)
    out = substring.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert {r.text for r in out.collect() if r.doc_id in (3, 4, 5, 12)} == {None, "", rows()[5][1], rows()[14][1]}
    assert substring.remove_repeats(empty(spark)).count() == 0 and substring.without_repeats(empty(spark)).count() == 0


def test_leftmost_least_and_automaton():
    rnd = np.random.default_rng(2)
    for k in (1, 2, 5, 28):
        v = rnd.integers(0, 6, 200)
        want = [j + int(np.argmin(v[j : j + k])) for j in range(200 - k + 1)]
        assert substring.leftmost_least(v, k).tolist() == want
    words = [b"w%d" % k for k in range(700)]
    tree = substring.PhraseAutomaton([words[:5], words[3:9], words[690:]])
    text = [b"x", *words[:9], b"y", *words[689:], *words[:4]]
    want = np.zeros(len(text), bool)
    want[1:10] = want[12:22] = True
    assert (tree.covered(text) == want).all() and tree.covered([b"x"] * 9) is None
    assert len(set(word_hashes(words).tolist())) == 700


def brute_vectors(data, least):
    good = [k for k, (_, v, lab) in enumerate(data) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    sets, links = Sets(len(data)), [0] * len(data)
    for p, a in enumerate(good):
        for b in good[:p]:
            x, y = (np.array(np.array(data[k][1], np.float32), float) for k in (a, b))
            if data[a][2] == data[b][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links[a] += 1
                links[b] += 1
                sets.join(a, b)
    return sorted(((r[0], n, c) for r, n, c in zip(data, links, least_ids([r[0] for r in data], sets))), key=key)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    data = []
    for k in range(250):
        v = np.random.default_rng(k % 40).standard_normal(24) + rng.standard_normal(24) * 0.12
        data.append((k, np.float32(v).tolist(), int(k % 3)))
    data += [(300, data[0][1], 0), (300, data[0][1], 0), (301, None, 0), (302, [], 0), (303, [0.0] * 24, 0), (304, [float("nan")] * 24, 0), (305, [None, *[1.0] * 23], 0), (306, data[0][1], None), (307, [1.0, 0.0], 0), (308, [2.0, 0.01], 0), (None, data[1][1], 1), (309, [float("inf")] * 24, 0), (310, [1e38] * 24, 0), (311, [1e38] * 24, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = embed_dedup.near_vectors(df.withColumn("node", F.lit("clash"))).collect()
    want = brute_vectors(data, 0.93)
    found = sum(r.n_links for r in got)
    assert found >= 0.99 * sum(n for _, n, _ in want) and all(g <= w for g, w in zip(sorted((r.vec_id or -1, r.n_links) for r in got), sorted((i or -1, n) for i, n, _ in want)))
    assert sorted((tuple(r)[:3] for r in got), key=key)[-14:] == want[-14:]
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_lattice_points():
    rng = np.random.default_rng(6)
    near = embed_dedup.neighbours()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(1), 2)
    y = rng.standard_normal((200, 8)) * 2
    p = embed_dedup.nearest(y)
    doubled = np.rint(2 * p)
    assert np.allclose(2 * p, doubled) and ((doubled.astype(int) % 2).sum(1) % 8 == 0).all() and (p.sum(1) % 2 < 1e-9).all()
    distance = ((y - p) ** 2).sum(1)
    assert all((distance <= ((y - (p + v)) ** 2).sum(1) + 1e-9).all() for v in near)  # no neighbour is nearer
