"""Secret scans with DataFrame functions only: fixed patterns, and a randomness test battery.

Base kinds (``assign``, ``access``, ``hex``) are leftmost, non-overlapping matches per kind, failing
matches dropped. The battery adds spans of kind ``random``: runs of 20 or more characters
``[A-Za-z0-9+/_=-]`` that mix digits and letters and do not overlap a base span. For each, an encoding is inferred
(hex 16, base-36 36, base-62 62, base-64 64 symbols) and three statistics are tested against "every symbol
is drawn uniformly and independently":

* chi-squared uniformity over the alphabet (normal form with the exact multinomial variance),
* the number of runs above and below the middle of the alphabet,
* lag-one serial correlation of the symbol values.

Fisher's method joins the three p-values. A token that is *not* random (a path, an identifier, a long
compound) gets a small p. Discoveries are tokens shown to be structured; Benjamini-Hochberg at level ``q``
within each length class over the whole corpus bounds the share of real keys that are thrown away, and only
what it does not reject is reported. A length class joins in only where the battery has power
(``MIN_LENGTH`` by alphabet), so short strings, which always look random, are left alone.

The text is scanned once per pattern; no shuffle but for the table of p-value bins (at most
4 classes x 400 bins). A null text is empty; rows keep their multiplicity; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# FIXED VALUES: base patterns. Group 2 (assign) or group 0 must have the given length.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LENGTHS = {"assign": 8, "access": 16, "hex": 32}

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ORDER_16, ORDER_36 = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
ORDER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Shortest token of an alphabet that the battery can tell from ordinary text.
MIN_LENGTH = {16: 24, 36: 28, 62: 20, 64: 20}
#: Upper ends of the length classes; the last one is open.
CLASSES = (24, 40, 80)
BINS_PER_DECADE, MAX_BIN = 20, 400
SPAN = "array<struct<s:int,e:int,k:int>>"


def _located(text: Column, pattern: str, gate: Column, kind: int, group: int, least: int) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters. Position = lengths of the pieces
    between the matches plus lengths of the matches before."""
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if group else value
    spans = F.aggregate(
        F.arrays_zip(F.split(text, pattern, -1).alias("p"), whole.alias("m"), value.alias("v")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(
                F.length(x["v"]) >= least,
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["p"])).alias("s"),
                            (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("e"),
                            F.lit(kind).alias("k"),
                        )
                    ),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(gate, spans).otherwise(F.array().cast(SPAN))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal (a rational polynomial times the density, error below 1e-7)."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + a * 0.2316419)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * 1.330274429))))
    tail = F.exp(-a * a / 2.0) * 0.3989422804014327 * poly
    return F.greatest(F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail), F.lit(1e-30))


def randomness(token: Column) -> Column:
    """struct(size of the inferred alphabet or 0, p) of one token."""
    bare = F.rtrim(token, F.lit("="))
    has = {k: bare.rlike(v) for k, v in {"d": "[0-9]", "u": "[A-Z]", "l": "[a-z]", "s": "[+/_-]"}.items()}
    hexed = bare.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    letters = has["u"] | has["l"]
    size = (
        F.when(~(has["d"] & letters), 0)
        .when(hexed, 16)
        .when(has["s"] & has["u"] & has["l"], 64)
        .when(has["s"], 0)
        .when(has["u"] & has["l"], 62)
        .otherwise(36)
    )
    one_case = F.translate(F.upper(bare), "-_", "+/")
    plain = F.translate(bare, "-_", "+/")

    def by_alphabet(k: Column) -> Column:
        def value(c: Column) -> Column:
            return F.when(k == 16, F.instr(F.lit(ORDER_16), c)).when(k == 36, F.instr(F.lit(ORDER_36), c)).otherwise(F.instr(F.lit(ORDER), c)).cast("double")

        chars = F.filter(F.split(F.when(k <= 36, one_case).otherwise(plain), ""), lambda c: c != "")
        return _bind(F.transform(chars, value), lambda v: _bind(F.size(v).cast("double"), lambda n: battery(v, n, k.cast("double"))))

    def battery(v: Column, n: Column, k: Column) -> Column:
        counts = F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y == x)).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        chi = k / n * squares - n
        z_chi = (chi - (k - 1.0)) / F.sqrt(2.0 * (k - 1.0) * (n - 1.0) / n)
        high = F.transform(v, lambda x: F.when(x > k / 2.0, 1).otherwise(0))

        def runs_z(h: Column) -> Column:
            n1 = F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
            changes = F.size(F.filter(F.sequence(F.lit(1), F.size(h) - 1), lambda i: h[i] != h[i - 1]))
            mean = 2.0 * n1 * (n - n1) / n + 1.0
            var = (mean - 1.0) * (mean - 2.0) / (n - 1.0)
            return F.when(var > 0.01, (changes + 1.0 - mean) / F.sqrt(var)).otherwise(F.lit(8.0))

        mid = (k + 1.0) / 2.0
        spread = (k * k - 1.0) / 12.0
        lagged = F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), F.lit(0.0), lambda a, i: a + (v[i] - mid) * (v[i - 1] - mid))
        z_serial = lagged / (spread * F.sqrt(n - 1.0))
        p1, p2 = normal_tail(z_chi), F.least(F.lit(1.0), 2.0 * normal_tail(F.abs(_bind(high, runs_z))))
        p3 = F.least(F.lit(1.0), 2.0 * normal_tail(F.abs(z_serial)))
        half = -(F.log(p1) + F.log(p2) + F.log(p3))
        return _bind(half, lambda t: F.exp(-t) * (1.0 + t + t * t / 2.0))

    def judged(k: Column) -> Column:
        least = reduce(lambda acc, kv: acc.when(k == kv[0], kv[1]), list(MIN_LENGTH.items())[1:], F.when(k == 16, MIN_LENGTH[16]))
        usable = (k > 0) & (F.length(bare) >= least)
        return F.struct(F.when(usable, k).otherwise(0).alias("alphabet"), F.when(usable, by_alphabet(k)).alias("p"))

    return _bind(size, judged)


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _length_class(n: Column) -> Column:
    return sum(((n > top).cast("int") for top in CLASSES), F.lit(0))


def _bin(p: Column) -> Column:
    return F.least(F.lit(MAX_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_PER_DECADE)).cast("int")


def scan(text: Column) -> Column:
    """array<struct<s,e,k>> of base spans, unsorted."""
    return F.concat(
        _located(text, ASSIGN, F.lower(text).rlike("pass|secret|token|api"), 0, 2, LENGTHS["assign"]),
        _located(text, ACCESS, F.contains(text, F.lit("AKIA")), 1, 0, LENGTHS["access"]),
        _located(text, HEX, text.rlike("[0-9a-f]{32}"), 2, 0, LENGTHS["hex"]),
    )


def thresholds(candidates: DataFrame, q: float) -> dict[int, int]:
    """Highest p-value bin that is *not* rejected, by length class (Benjamini-Hochberg over bins; a bin
    counts as its upper end, so no more is rejected than with exact p-values)."""
    from pyspark.sql import Window

    bins = candidates.groupBy("cls", "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cls").orderBy(F.desc("bin"))
    total = Window.partitionBy("cls")
    below = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))  # p at most that of this bin
    upper = F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(BINS_PER_DECADE)))
    rejected = bins.select("cls", "bin", below.alias("below"), F.sum("n").over(total).alias("m")).filter(upper <= F.lit(q) * F.col("below") / F.col("m"))
    return {r["cls"]: r["b"] for r in rejected.groupBy("cls").agg(F.min("bin").alias("b")).collect()}  # at most 4 rows


def secrets(docs: DataFrame, q: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, spans (array of struct(s, k, e), sorted by start then
    kind; code points, end exclusive)."""
    out = _found(docs, q, id_col, text_col, ())
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], "spans")


def _found(docs: DataFrame, q: float, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, spans and, in the struct ``_kept``, the columns named in ``keep``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), F.struct(F.lit(0), *[F.col(f"`{c}`") for c in keep]).alias("_kept"))
    tokens = F.regexp_extract_all("_t", F.lit(TOKEN), F.lit(0))
    found = _located(F.col("_t"), TOKEN, F.col("_t").rlike(TOKEN), 3, 0, 20)
    rows = rows.select("doc_id", "_kept", scan(F.col("_t")).alias("base"), found.alias("at"), F.when(F.size(found) > 0, tokens).alias("tok"))
    tested = F.transform(
        F.filter(F.arrays_zip("at", "tok"), lambda x: ~F.exists("base", lambda b: (b["s"] < x["at"]["e"]) & (x["at"]["s"] < b["e"]))),
        lambda x: F.struct(x["at"].alias("at"), _length_class(F.length(x["tok"])).alias("cls"), randomness(x["tok"]).alias("r")),
    )
    tested = F.transform(
        F.filter(tested, lambda x: x["r"]["alphabet"] > 0),
        lambda x: F.struct(x["at"].alias("at"), x["cls"].alias("cls"), _bin(x["r"]["p"]).alias("bin")),
    )
    rows = materialize(rows.select("doc_id", "_kept", "base", F.coalesce(F.when(F.size("at") > 0, tested), F.array().cast("array<struct<at:struct<s:int,e:int,k:int>,cls:int,bin:int>>")).alias("cand")))
    limits = thresholds(rows.filter(F.size("cand") > 0).select(F.explode("cand").alias("c")).select("c.cls", "c.bin"), q)
    passes = lambda x: reduce(lambda acc, kv: acc & ((x["cls"] != kv[0]) | (x["bin"] < kv[1])), limits.items(), F.lit(True))
    random = F.transform(F.filter("cand", passes), lambda x: x["at"])
    spans = F.array_sort(F.transform(F.concat("base", random), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return rows.select("doc_id", "_kept", spans.alias("spans"))


def span_text(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` joined by commas."""
    if base_only:
        spans = F.filter(spans, lambda x: x["k"] < 3)
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, q: float = 0.05, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents, each secret span (overlaps merged) replaced by ``mark``; other columns as they were,
    n_chars, if there, is the new length."""
    names = docs.columns
    found = _found(docs, q, id_col, text_col, tuple(names))

    def cut(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )
        return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))

    text = F.col("_kept").getField(text_col)
    changed = found.withColumn("_new", F.when(F.size("spans") > 0, cut(text, F.col("spans"))).otherwise(text))
    new = {text_col: F.col("_new"), "n_chars": F.length(F.coalesce("_new", F.lit(""))).cast("long")}
    return changed.select(*[new.get(c, F.col("_kept").getField(c)).alias(c) for c in names])
