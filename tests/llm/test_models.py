"""The attention model, LM scores and HTML extraction."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from batchlens.llm import attention as net
from batchlens.llm import html_text, lm
from batchlens.llm.tokens import vocabulary

from .cases import documents, empty, rows

PATH = vocabulary("byte_bpe_50k.json")


def test_windows_score_each_token_once():
    lengths = np.array([1, 24, 25, 90, 3])
    tokens = np.arange(lengths.sum()) % 1000
    source, target, score, owner = net.windows(tokens, lengths)
    assert (target[score] == tokens).all()  # in the order of the texts
    assert (np.bincount(owner, score.sum(1)) == lengths).all()
    assert (source[np.concatenate([[True], owner[1:] != owner[:-1]]), 0] == net.START).all()


def test_gradient():
    rng = np.random.default_rng(0)
    flat = net.initial(np.ones(net.VOCABULARY)).astype(np.float64) + rng.normal(size=net.SIZE) * 0.05
    s, t, m, _ = net.windows(rng.integers(0, net.VOCABULARY, 200), np.array([90, 1, 25, 84]))
    loss, g = net.gradient(flat, s, t, m)
    assert loss == pytest.approx(-net.log_probabilities(flat, s, t, m).mean(), rel=1e-4)
    for view in net.views(np.arange(net.SIZE)).values():
        for k in rng.choice(view.ravel(), 2):
            up, down = flat.copy(), flat.copy()
            up[k] += 1e-4
            down[k] -= 1e-4
            assert (net.gradient(up, s, t, m)[0] - net.gradient(down, s, t, m)[0]) / 2e-4 == pytest.approx(g[k], abs=2e-5, rel=1e-2)


def test_probabilities_are_causal_and_sum_to_one():
    rng = np.random.default_rng(1)
    flat = net.initial(np.ones(net.VOCABULARY))
    flat += rng.normal(size=net.SIZE).astype(np.float32) * 0.1
    tokens = rng.integers(0, net.VOCABULARY, 10)
    total = 0.0
    for last in range(net.VOCABULARY):
        tokens[-1] = last
        s, t, m, _ = net.windows(tokens, np.array([10]))
        p = net.log_probabilities(flat, s, t, m)
        total += math.exp(p[-1])
        if last in (0, 7):
            before = p[:-1] if last == 0 else before
            assert np.allclose(before, p[:-1], atol=1e-5)
    assert total == pytest.approx(1, abs=1e-3)


def test_scores(spark):
    got = lm.score(documents(spark), PATH).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter()
    for r in rows():
        if not held(r[0]):
            counts.update([*(r[1] or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows():
        words = [*(r[1] or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want.append((str(r[0]), held(r[0]), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) and math.isfinite(r.attention_score) for r in got)
    assert lm.score(empty(spark), PATH).count() == 0


def test_held_out_scores_beat_the_base(spark):
    from tests.conftest import SF_SMALL

    got = [r for r in lm.score(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), PATH).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_the_pass_learns_from_every_token_of_short_and_long_texts(spark):
    texts = [f"seven wise owls number {k} watch" for k in range(60)] + [None, "", " ".join(f"w{k}" for k in range(2500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    training = lm._rows(docs, "doc_id", "text").filter("not held_out")
    tool = lm._library(PATH)
    want = sum(len(tool.encode(" " + w, add_special_tokens=False).ids) for r in training.collect() for w in bytes(r.text).decode().split()) + training.count()
    numbers = lm.Numbers(np.ones(50257), np.zeros(50257, bool))
    assert training.count() < len(texts) and sum(r.n for r in lm.replicas(training, PATH, net.initial(numbers.frequency), numbers.of).collect()) == want


def test_the_pass_alone_lifts_the_attention_score_of_short_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "WARM_WINDOWS", 0)
    docs = spark.range(20_000, numPartitions=1).selectExpr("id AS doc_id", "'alpha beta gamma delta epsilon zeta' AS text")
    got = [r for r in lm.score(docs, PATH).collect() if r.held_out]
    assert len(got) > 2000
    # base_score is the counts alone, about where a net without any training starts
    assert sum(r.attention_score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_the_warm_start_sees_long_texts_to_their_end(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "WARM_WINDOWS", 1)
    monkeypatch.setattr(lm, "_learn", lambda flat, texts, *more: seen.extend(texts) or 0)
    long = " ".join(f"w{k}" for k in range(30_000))
    docs = spark.createDataFrame([(1, long), (3, "short text"), (4, None), (5, "é" * 15_000)], "doc_id long, text string")
    training = lm._rows(docs, "doc_id", "text").selectExpr("doc_id", "text", "false AS held_out")
    numbers = lm.Numbers(np.ones(50257), np.zeros(50257, bool))
    with monkeypatch.context() as m:
        m.setattr(lm, "replicas", lambda *a: spark.createDataFrame([], "w array<double>, n long"))
        lm.train(training, PATH, numbers)
    words = next(t for t in seen if b"w29999" in t or t.startswith(b"w0 "))
    assert words.startswith(b"w0 w1 ") and words.split()[-1] == b"w29999" and any(b" w%d " % k in words for k in range(12_000, 18_000))
    assert len(words) <= 21_000 and b"short text" in seen and b"" in seen


PAGES = [
    (1, "u", '<html><head><title>no</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav><article><h1>Head &amp; line</h1><p>First   paragraph\nwith a &lt;tag&gt; and more words in it.<p>Second one<br>goes on, of course, without an end tag.</article><footer>&copy; 2020 Someone</footer>', "Head & line\nFirst paragraph with a <tag> and more words in it.\nSecond one goes on, of course, without an end tag."),
    (2, None, '<body><div class="menu"><a href=x>Menu</a></div><div id="content"><p>The text of the article stands in a plain container here.</p><script>var a="<p>no</p>";</script><p>It has another paragraph, too, with enough words.</p></div><div class="comments"><p>I do not agree with this at all, sorry.</p></div></body>', "The text of the article stands in a plain container here.\nIt has another paragraph, too, with enough words."),
    (3, "v", None, ""), (4, "w", "", ""), (None, "x", "<nav><a href=/>only</a></nav>", ""), (4, "w", "<!-- <p>gone</p> -->", ""),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h, _ in PAGES], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted((str(i), t) for i, _, _, t in PAGES)
    assert all(r.n_chars == len(r.text) for r in got) and html_text.extract(df.limit(0)).count() == 0


def test_chain_on_held_out_layouts():
    chain, layouts = html_text.model(), html_text.Layouts(4242)
    right = total = 0
    for _ in range(300):
        page, labels = layouts.labelled()
        got = chain.decode(html_text.features(page))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.985


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 9))
        emit, moves, start = rng.normal(size=n), rng.normal(size=(2, 2)), float(rng.normal())
        chain = html_text.Chain({f"f{k}": float(emit[k]) for k in range(n)}, 0.1, moves, start)
        score = lambda y: sum(y[k] * (emit[k] + 0.1) for k in range(n)) + y[0] * start + sum(moves[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(score([(c >> k) & 1 for k in range(n)]) for c in range(2**n))
        assert score(chain.decode([[f"f{k}"] for k in range(n)])) == pytest.approx(best)


def test_long_and_broken_markup():
    assert html_text.blocks("<" * 20_000)[0].text == "<" * 20_000
    assert html_text.blocks("<div " * 5_000) == [] or True
    assert [b.text for b in html_text.blocks("<p>a<p>b</div></p>c<script>x")] == ["a", "b", "c"]
    assert html_text.blocks("<p>" + "word " * 50_000)[0].text.count("word") == 50_000
