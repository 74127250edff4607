"""Exact removal of long repeated passages by repeated-phrase automata.

A window is ``window`` consecutive words; a word goes if a window over it has the same words as a window
that starts anywhere else. The work is linear in the text:

1. *Anchors.* Every window takes the phrase of ``phrase`` words with the smallest hash inside it, so equal
   windows take the same phrase at the same place. Neighbouring windows share their phrase: about one anchor
   per fifteen words, with the *span* of words that its windows cover.
2. *Confirmed passages.* Phrases seen once drop out. A span seen twice or more repeats as a whole. Where one
   phrase lies in different spans, one copy of each span lists its windows, and those that meet again are
   confirmed. What is confirmed is kept as a bit mask of windows per span.
3. *Automata.* Documents are dealt into shards by a hash of the row. Each shard compiles one Aho-Corasick
   automaton from the confirmed passages whose spans occur in it (one copy each, as sequences of word numbers)
   and streams all its documents through it, which finds every occurrence. An automaton is never larger
   than its shard's own text, whatever the size of the corpus.

Counts are pre-aggregated before each shuffle and hot phrases meet only in joins that Spark can split.
Hashes are 64 bits within a 64-bit phrase; the last step compares words.

Edge cases: null texts have no words; texts shorter than a window keep all; repeated rows are repeated
passages, every copy goes; null ids are kept; very long texts are one row of their shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_columns, emit, gram_hashes, materialize, mix64, odd_multipliers, shard_count, word_hashes

WINDOW = 35
PHRASE = 8
_GRAM = odd_multipliers(61, 64)
_ROOT = odd_multipliers(67, 1)[0]


def _powers(root: int, n: int) -> np.ndarray:
    out = np.full(n, root, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Ranges:
    """Hashes of any ranges of a text's words, by running sums of hash times power of an odd root modulo
    2**64; the inverse power takes the start out again, so a hash is the same wherever the words stand."""

    power, inverse = _powers(int(_ROOT), 4096), _powers(pow(int(_ROOT), -1, 2**64), 4096)

    def __init__(self, words: np.ndarray):
        if len(words) >= len(Ranges.power):
            n = 2 * len(words) + 1
            Ranges.power, Ranges.inverse = _powers(int(_ROOT), n), _powers(pow(int(_ROOT), -1, 2**64), n)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * Ranges.power[: len(words)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[stop] - self.sums[start]) * Ranges.inverse[start] + (stop - start).astype(np.uint64))


def leftmost_least(values: np.ndarray, k: int) -> np.ndarray:
    """Index of the smallest value, the leftmost of equals, in every run of k neighbours (by doubling)."""
    at, width = np.arange(len(values)), 1
    while width < k:
        step = min(width, k - width)
        left, right = values[: len(values) - step], values[step:]
        later = right < left
        values, at = np.where(later, right, left), np.where(later, at[step:], at[: len(at) - step])
        width += step
    return at


def anchors(words: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, ...]:
    """Per anchor: phrase hash, span hash, first window, number of windows."""
    inside = window - phrase + 1
    grams = gram_hashes(words, phrase, _GRAM)
    chosen = leftmost_least(grams, inside)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    count = np.diff(np.append(first, len(chosen)))
    span = Ranges(words)(first, first + count + window - 1)
    with np.errstate(over="ignore"):
        span = mix64(span + (chosen[first] - first).astype(np.uint64))  # the phrase's place belongs to the span
    return grams[chosen[first]], span, first, count


def _keyed(docs: DataFrame, shards: int, id_col: str, text_col: str, keep: list) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        text.cast("binary").alias("text"),
        F.xxhash64(text).alias("tkey"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(shards)).cast("int").alias("shard"),
        *keep,
    )


def _spans(keyed: DataFrame, window: int, phrase: int) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("span", pa.int64()), ("shard", pa.int32()), ("tkey", pa.int64()), ("at", pa.int32()), ("wins", pa.int32())])

    def run(batches):
        for batch in batches:
            found: list[tuple] = []
            size = 0
            for text, tkey, shard in zip(*batch_columns(batch, "text", "tkey", "shard"), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                got = anchors(word_hashes(words), window, phrase)
                n = len(got[0])
                found.append((got[0].view(np.int64), got[1].view(np.int64), np.full(n, shard, np.int32), np.full(n, tkey, np.int64), got[2].astype(np.int32), got[3].astype(np.int32)))
                size += n
                if size > 100_000:
                    yield emit(schema, [np.concatenate(x) for x in zip(*found, strict=True)])
                    found, size = [], 0
            if found:
                yield emit(schema, [np.concatenate(x) for x in zip(*found, strict=True)])

    return keyed.select("text", "tkey", "shard").mapInArrow(run, "anchor long, span long, shard int, tkey long, at int, wins int")


def _windows(keyed: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """anchor, span, n, place, hash of each window of the asked spans (shard, tkey, at, wins, anchor, span, n)."""
    schema = pa.schema([("anchor", pa.int64()), ("span", pa.int64()), ("n", pa.int64()), ("place", pa.int32()), ("hash", pa.int64())])

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        by_text: dict[int, list] = {}
        for tkey, *rest in zip(*(spans[c].to_pylist() for c in ("tkey", "at", "wins", "anchor", "span", "n")), strict=True):
            by_text.setdefault(tkey, []).append(rest)
        out = []
        if by_text:
            for chunk in texts.select(["tkey", "text"]).to_batches(max_chunksize=200):
                for tkey, text in zip(*batch_columns(chunk, "tkey", "text"), strict=True):
                    wanted = by_text.pop(tkey, None)
                    if wanted is None:
                        continue
                    words = word_hashes(text.split())
                    at, wins, anchor, span, n = (np.array(x, np.int64) for x in zip(*wanted, strict=True))
                    start = np.repeat(at, wins) + (place := np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins))
                    got = Ranges(words)(start, start + window).view(np.int64)
                    out.append((*(np.repeat(x, wins) for x in (anchor, span, n)), place.astype(np.int32), got))
        return pa.Table.from_batches([emit(schema, [np.concatenate(x) for x in zip(*out, strict=True)])] if out else [], schema)

    pair = keyed.select("shard", "tkey", "text").groupBy("shard").cogroup(asked.groupBy("shard"))
    return pair.applyInArrow(run, "anchor long, span long, n long, place int, hash long")


def repeated(keyed: DataFrame, window: int, phrase: int) -> DataFrame:
    """For each shard, one copy of every span with a repeated window: shard, tkey, at, mask (bit k: window
    at + k); and a row with mask 0 for each text that holds such a span."""
    spans = materialize(_spans(keyed, window, phrase))
    hot = spans.groupBy("anchor").count().filter("count > 1").select("anchor")
    some = materialize(spans.join(hot, "anchor", "left_semi"))
    kinds = materialize(
        some.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("shard", "tkey", "at", "wins")).alias("one"))
    )
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
    asked = kinds.join(several, "anchor", "left_semi").select("one.*", "anchor", "span", "n")
    windows = materialize(_windows(keyed, asked, window))
    # the place of a window relative to its phrase is in its hash: equal windows hold the phrase at one place
    again = windows.groupBy("anchor", "hash").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "hash")
    parts = windows.join(again, ["anchor", "hash"], "left_semi").groupBy("anchor", "span").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    whole = kinds.filter("n > 1").select("anchor", "span", F.expr("shiftleft(1L, one.wins) - 1").alias("mask"))
    masks = whole.unionByName(parts).groupBy("anchor", "span").agg(F.bit_or("mask").alias("mask"))
    hits = materialize(some.select("anchor", "span", "shard", "tkey", "at").join(masks, ["anchor", "span"]))
    copies = hits.groupBy("anchor", "span", "shard").agg(F.min(F.struct("tkey", "at", "mask")).alias("c")).select("shard", "c.*")
    touched = hits.select("shard", "tkey").distinct().select("shard", "tkey", F.lit(0).alias("at"), F.lit(0).cast("long").alias("mask"))
    return copies.unionByName(touched)


def passages(at: int, mask: int, window: int):
    """Word ranges of the runs of set bits: the confirmed passages of a span."""
    k = 0
    while mask >> k:
        if mask >> k & 1:
            stop = k
            while mask >> stop & 1:
                stop += 1
            yield at + k, at + stop + window - 1
            k = stop
        else:
            k += 1


class PhraseAutomaton:
    """Aho-Corasick automaton over word numbers. A number is written as two digits of different ranges, so
    no state has more than ``DIGIT`` successors (they are searched one by one) and a match starts and ends
    between words. Words of no passage have number -1; a passage only lies in runs without them."""

    DIGIT = 512

    def __init__(self, phrases: list[list[bytes]]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.shortest = min(map(len, phrases), default=0)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words in phrases:
            for w in words:
                self.numbers.setdefault(w, len(self.numbers))
        if len(self.numbers) >= self.DIGIT**2:  # more distinct words: wider digits
            self.DIGIT = int(len(self.numbers) ** 0.5) + 1
        for words in phrases:
            self.tree.add_word(self._digits(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))), len(words))
        if phrases:
            self.tree.make_automaton()

    def _digits(self, numbers: np.ndarray) -> tuple[int, ...]:
        out = np.empty(2 * len(numbers), np.int64)
        out[0::2] = numbers // self.DIGIT
        out[1::2] = numbers % self.DIGIT + self.DIGIT
        return tuple(out.tolist())

    def covered(self, words: list[bytes]) -> np.ndarray | None:
        """True for each word inside an occurrence of a passage; None if there is none."""
        if not self.numbers or len(words) < self.shortest:
            return None
        get = self.numbers.get
        numbers = np.array([get(w, -1) for w in words], np.int64)
        gaps = np.concatenate([[-1], np.flatnonzero(numbers < 0), [len(words)]])
        edges = None
        for k in np.flatnonzero(np.diff(gaps) > self.shortest).tolist():
            start = int(gaps[k]) + 1
            for end, n in self.tree.iter(self._digits(numbers[start : gaps[k + 1]])):
                if edges is None:
                    edges = np.zeros(len(words) + 1, np.int32)
                stop = start + end // 2 + 1
                edges[stop - n] += 1
                edges[stop] -= 1
        return None if edges is None else np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a blank) and a struct ``row`` of the
    columns in ``keep`` (with ``keep``)."""
    if not phrase < window < phrase + 62:
        raise ValueError("a span's windows must fit a 64-bit mask")
    shards = shard_count(docs.sparkSession)
    with_rows = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    keyed = _keyed(docs, shards, id_col, text_col, with_rows)
    found = materialize(repeated(keyed.select("doc_id", "text", "tkey", "shard"), window, phrase))
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    row_type = f", row {keyed.schema['row'].dataType.simpleString()}" if keep else ""

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        by_text: dict[int, list] = {}
        touched = set()
        for tkey, at, mask in zip(*(spans[c].to_pylist() for c in ("tkey", "at", "mask")), strict=True):
            if mask:
                by_text.setdefault(tkey, []).append((at, mask))
            else:
                touched.add(tkey)
        phrases: list[list[bytes]] = []
        if by_text:
            for chunk in texts.select(["tkey", "text"]).to_batches(max_chunksize=200):
                for tkey, text in zip(*batch_columns(chunk, "tkey", "text"), strict=True):
                    if wanted := by_text.pop(tkey, None):
                        words = text.split()
                        phrases += [words[a:b] for at, mask in wanted for a, b in passages(at, mask, window)]
        automaton = PhraseAutomaton(phrases)
        del phrases
        n_words, n_removed, kept = [], [], []
        for chunk in texts.select(["text", "tkey"]).to_batches(max_chunksize=200):
            for text, tkey in zip(*batch_columns(chunk, "text", "tkey"), strict=True):
                words = text.split()
                gone = automaton.covered(words) if tkey in touched else None  # other texts hold no confirmed span
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                left = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept.append(b" ".join(left))
        columns = [texts["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept"]
        if keep:
            columns.append(texts["row"])
            names.append("row")
        return pa.table(columns, names=names)

    pair = keyed.groupBy("shard").cogroup(found.groupBy("shard"))
    return pair.applyInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept string{row_type}")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with repeated passages cut out of the text (texts that lose nothing stay as they
    are, white space included); other columns as they were, n_chars, if there, is the new length."""
    names = docs.columns
    out = remove_repeats(docs, window, id_col=id_col, text_col=text_col, keep=tuple(names))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row").getField(text_col))
    new = {text_col: text, "n_chars": F.length(F.coalesce(text, F.lit(""))).cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])
