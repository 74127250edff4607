"""Quality rules by line-first cleaning, in DataFrame functions only.

Each line that holds a word is judged by itself (punctuation, symbols, navigation, boilerplate);
failing lines are removed; a document that loses more than ``max_lost`` of its word characters, or
that fails the base rules, is rejected. One row in, one row out, no shuffle: a long text costs
n log n in its own row.

Edge cases: a null text is an empty one (no words: rejected by the base rule); lines without words
never fail and never count as repeated; repeated rows each get their own result; a null doc_id stays;
extra columns of any name are ignored by ``quality`` and passed through by ``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[ \t-\r]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# FIXED VALUES: phrases of page furniture, matched in short lines, letters a-z in either case.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "click here", "sign up", "log in", "subscribe to", "skip to content", "back to top", "javascript is disabled",
    "enable javascript", "share this", "read more", "lorem ipsum",
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def _without(col: Column, chars: str) -> Column:
    return F.translate(col, chars, "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


def repeat_words(words: Column, k: int = REPEAT_WINDOW) -> Column:
    """Number of words inside k-word windows that occur at least twice in the array."""

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            marked = F.transform(
                s, lambda e, k_: F.when((F.get(s, k_ - 1)["h"] == e["h"]) | (F.get(s, k_ + 1)["h"] == e["h"]), e["i"])
            )
            return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

        def width(at: Column) -> Column:
            gaps = F.transform(at, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(at, j + 1) - p, F.lit(k))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

        return _let(ordered, lambda s: _let(starts(s), width))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))

    def judged(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(_let(hashes, lambda h: _let(windows(h), judged)))


def line_fails(line: Column) -> Column:
    """True for a line with words that looks like shouting, symbol noise, navigation or page furniture."""
    words = words_of(line)
    chars = F.length(_without(line, WHITE))
    symbols = F.length(line) - F.length(_without(line, SYMBOLS))
    bars = F.length(line) - F.length(_without(line, "|>»·"))
    shouts = F.length(line) - F.length(_without(line, "!"))
    n = F.size(words)
    punctuation = (shouts > n * 0.5) & (shouts >= 2)
    noise = (symbols > n * 0.5) & (symbols >= 3)
    navigation = (bars >= 3) & (bars > n * 0.2)
    furniture = (n <= 15) & F.lower(line).rlike("|".join(BOILERPLATE))
    return (chars > 0) & (punctuation | noise | navigation | furniture)


def _judged(docs: DataFrame, max_lost: float, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_lines", F.split(F.col("_text"), "\n", -1))
    has_word = F.filter(F.col("_lines"), lambda x: F.length(_without(x, WHITE)) > 0)
    lost = F.aggregate(
        F.filter(F.col("_lines"), line_fails),
        F.lit(0).cast("long"),
        lambda acc, x: acc + F.length(_without(x, WHITE)),
    )
    df = df.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(F.col("_text"), WHITE)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        _let(has_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        lost.alias("lost_chars"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(max_lost) * F.col("word_chars"))
    )


def quality(docs: DataFrame, max_lost: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, lost_chars (word characters of removed lines), base_failed, kept."""
    return _judged(docs, max_lost, id_col, text_col)


def cleaned(docs: DataFrame, max_lost: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Kept documents with failing lines removed and all other columns as they were; n_chars, if
    there, is the new length. The verdict is computed in the same row, so nothing is joined."""
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = lambda t: F.length(_without(t, WHITE))

    def verdict(words: Column, new: Column) -> Column:
        n = F.size(words)
        lost = size(text) - size(new) <= F.lit(max_lost) * size(text)
        ok = (n >= MIN_WORDS) & lost & (100 * repeat_words(words) <= MAX_REPEAT_PERCENT * n)
        return F.when(ok, F.array(new)).otherwise(F.array().cast("array<string>"))

    good = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~line_fails(x)), "\n")
    kept = _let(words_of(text), lambda words: _let(good, lambda new: verdict(words, new)))  # each part computed once
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.explode(kept).alias("_new"))
    new = {text_col: F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in names])
