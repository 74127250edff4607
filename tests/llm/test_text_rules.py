"""Quality rules and secret scans against plain Python."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from batchlens.llm import quality, secrets

from .cases import documents, empty, key, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {p for at in seen.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    random.seed(4)
    texts = [" ".join(random.choice("ab") for _ in range(random.randint(0, 60))) for _ in range(40)]
    texts += ["l1 x\nl1 x\n\n \nl2\nl1 x", "# * $ %%%", "a b c d e f g h " * 3]
    data = rows() + [(100 + k, t, "c", 1, "r", 0) for k, t in enumerate(texts)]
    got = quality.quality(spark.createDataFrame(data, documents(spark).schema))
    found = sorted((tuple(r)[:6] for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=key)
    assert found == sorted(((r[0], *base_measures(r[1])) for r in data), key=key)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in got.collect())


def test_line_rules_and_cleaning(spark):
    prose = "Plain words make a calm line that ends with a stop, as it should."
    noise = ["BUY!! NOW!! CHEAP!! SHOES!!", "home | about | contact | news |", "a### b%%% c&&& d$$$", "Accept cookies to go on"]
    good, bad = "\n".join([prose, "Another calm line follows the first one.", noise[3], "The end of a decent text is here."]), "\n".join(noise + ["short one. " * 3])
    df = spark.createDataFrame([(1, good, "keep me"), (2, bad, "x"), (3, None, "y")], "doc_id long, text string, extra string")
    out = quality.cleaned(df).collect()
    assert [(r.doc_id, r.text, r.extra) for r in out] == [(1, good.replace(noise[3] + "\n", ""), "keep me")]
    assert quality.cleaned(documents(spark)).columns == documents(spark).columns
    assert quality.quality(empty(spark)).count() == 0 and quality.cleaned(empty(spark)).count() == 0


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def battery(token):
    """Alphabet and p-value of a token, as the module describes it."""
    bare = token.rstrip("=")
    d, u, low, s = (bool(re.search(x, bare)) for x in ("[0-9]", "[A-Z]", "[a-z]", "[+/_-]"))
    if not (d and (u or low)):
        return 0, None
    k = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", bare) else 64 if s and u and low else 0 if s else 62 if u and low else 36
    if not k or len(bare) < secrets.MIN_LENGTH[k]:
        return 0, None
    order = {16: secrets.ORDER_16, 36: secrets.ORDER_36}.get(k, secrets.ORDER)
    plain = (bare.upper() if k <= 36 else bare).translate(str.maketrans("-_", "+/"))
    v = [order.index(c) + 1 for c in plain]
    n = len(v)
    chi = k / n * sum(v.count(x) ** 2 for x in set(v)) - n
    z1 = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [x > k / 2 for x in v]
    n1 = sum(high)
    mean = 2 * n1 * (n - n1) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z2 = (sum(a != b for a, b in zip(high, high[1:])) + 1 - mean) / math.sqrt(var) if var > 0.01 else 8.0
    mid = (k + 1) / 2
    z3 = sum((a - mid) * (b - mid) for a, b in zip(v, v[1:])) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    tail = lambda z: max(math.erfc(z / math.sqrt(2)) / 2, 1e-30)
    t = -math.log(tail(z1)) - math.log(min(1, 2 * tail(abs(z2)))) - math.log(min(1, 2 * tail(abs(z3))))
    return k, math.exp(-t) * (1 + t + t * t / 2)


def test_base_spans(spark):
    random.seed(2)
    parts = ["token", "Password", '"', "'", " ", ":", "=", "abc12345", "x", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "api_key", "apikey", "é😀", "secret:", "\n"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 25))) for _ in range(300)]
    data = rows() + [(100 + k, t, "c", 1, "r", 0) for k, t in enumerate(texts)]
    got = secrets.secrets(spark.createDataFrame(data, documents(spark).schema))
    digest = F.sha2(secrets.span_text(F.col("spans"), base_only=True), 256)
    found = sorted((tuple(r) for r in got.select("doc_id", "n_assign", "n_access", "n_hex", digest).collect()), key=key)
    want = []
    for r in data:
        s = base_spans(r[1])
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in s)
        want.append((r[0], *(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(want, key=key)


def test_battery_and_discovery_control(spark):
    random.seed(9)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    tokens = ["".join(random.choices(b64, k=random.choice((22, 32, 44, 88)))) for _ in range(60)]
    tokens += ["path/to/some1File/In/The/Directory/WithLongNames", "MyVeryLongClassNameForTesting2Things", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "AAAAAAAAbbbbbbbb11111111AAAAAAAA"] * 5
    df = spark.createDataFrame([(k, f"see {t} here") for k, t in enumerate(tokens)], "doc_id long, text string")
    pairs = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.randomness(F.col("t")).alias("r")).collect()
    for r in pairs:
        k, p = battery(r.t)
        assert r.r.alphabet == k and (p is None or r.r.p == pytest.approx(p, rel=1e-3, abs=1e-7))
    found = {r.doc_id for r in secrets.secrets(df).filter("n_random > 0").collect()}
    # Benjamini-Hochberg by hand, on the same bins
    tested = [(k, t, *battery(t)) for k, t in enumerate(tokens) if battery(t)[0]]
    cls = lambda t: sum(len(t) > top for top in secrets.CLASSES)
    bins = lambda p: min(secrets.MAX_BIN, int(math.floor(-math.log10(max(p, 1e-30)) * secrets.BINS_PER_DECADE)))
    want = set()
    for c in {cls(t) for _, t, _, _ in tested}:
        own = [(bins(p), k) for k, t, _, p in tested if cls(t) == c]
        cut = [b for b, _ in own if 10 ** (-b / secrets.BINS_PER_DECADE) <= 0.05 * sum(x >= b for x, _ in own) / len(own)]
        want |= {k for b, k in own if not cut or b < min(cut)}
    assert found == want
    assert sum(k < 60 for k in found) >= 50 and not any(k >= 60 and tokens[k].startswith(("path", "aaaa")) for k in found)


def test_redaction(spark):
    df = documents(spark)
    out = {(r.doc_id, r.text) for r in secrets.redacted(df).collect()}
    assert secrets.redacted(df).columns == df.columns and len(secrets.redacted(df).collect()) == df.count()
    text = next(t for i, t in out if i == 13)
    assert text.startswith('[SECRET]" and [SECRET] end ') and "24be" not in text
    assert {(r[0], r[1]) for r in rows() if r[0] != 13} <= out
    assert secrets.secrets(empty(spark)).count() == 0
