"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are read as flat byte arrays: prefix polynomials over the bytes hash every word, prefix polynomials over
the word hashes hash every n-gram, and a block of texts is grouped exactly (words compared byte by byte with
the first one of their hash). Only (fingerprint, check, document, count) rows are shuffled, after grouping in
the block; the shuffle sums them and keeps two occurrence pointers, the least and the greatest document row.
A longer phrase can only be frequent if its shorter parts are, so each length is filtered by the fingerprints
that were frequent one length below: a bit table of bounded size (``MOST_BITS``), which may let too much
through and never too little. Frequent phrases alone are materialised: the documents that their pointers name
are searched for the fingerprint again and give the text. A fingerprint whose checks or texts disagree is a
collision; its occurrences are counted again by their text over all documents. Scores are decimals.

Null texts are empty, a null language is ``und``; repeated rows and ties count as often as they occur; texts of
any length are read whole (in blocks cut at piece ends); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_materialized, emit, materialize, mix64, odd_multipliers, word_hashes

#: Bytes of text handled at once.
BLOCK = 1_000_000
#: Words of a block compared byte by byte at once.
COMPARED = 20_000
#: Bits of the table that filters the next length (16 MB), whatever the number of frequent phrases.
MOST_BITS = 1 << 27
LONGEST = 3

WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = BLANK
KIND[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BYTE_BASE, GRAM_BASE = (int(x) for x in odd_multipliers(13, 2))
CHECKS = odd_multipliers(131, LONGEST)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; kept up to the size of a block."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(n, 1), b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        held = tuple(out)
        if n <= 2 * BLOCK:
            _powers[base] = held
    return held


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base^i, with a leading 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, powers(base, len(values))[0][: len(values)], out=out[1:])
    np.cumsum(out[1:], out=out[1:])
    return out


class Block:
    """Words of a run of documents: hashes and places and, if ``grouped``, ids exact within the block (per language)."""

    def __init__(self, data: np.ndarray, doc_starts: np.ndarray, langs: np.ndarray, lang_hash: np.ndarray, bits: int, grouped: bool = True):
        self.bytes = b = LOWER[data]
        kind = KIND[b]
        first = np.zeros(len(b) + 1, bool)
        first[doc_starts] = True
        word = np.append(kind == WORD, False)
        join = word[1:] & word[:-1] & ~first[1:]  # byte i + 1 goes on with the word of byte i
        inside = np.concatenate([[False], join])
        self.start = s = np.flatnonzero(word & ~inside)
        self.end = e = np.flatnonzero(word[:-1] & ~join) + 1
        self.doc = np.searchsorted(doc_starts, s, "right") - 1
        cuts = np.cumsum((kind == BREAK) | first[:-1], dtype=np.int32) if len(b) else np.zeros(0, np.int32)
        self.piece = cuts[s]
        lang = langs[self.doc]
        del kind, first, word, join, inside, cuts
        digits = b.astype(np.uint64)
        digits += np.uint64(1)
        total = prefix(digits, BYTE_BASE)
        size = (e - s).astype(np.uint64)
        h = (total[e] - total[s]) * powers(BYTE_BASE, len(b) + 1)[1][s]
        del digits, total
        h = mix64(h + size * np.uint64(0x9E3779B97F4A7C15)) + lang_hash[lang]
        if bits < 64:  # only for tests of collisions
            h &= np.uint64((1 << bits) - 1)
        self.hash = h
        if grouped:
            self._group(lang, lang_hash)

    def _group(self, lang: np.ndarray, lang_hash: np.ndarray) -> None:
        """Ids of the words, and the first place, hash and check of each id."""
        s, e, h = self.start, self.end, self.hash
        _, rep, ids = np.unique(h, return_index=True, return_inverse=True)
        rep = rep.tolist()
        self._exact(ids, np.array(rep, np.int64), lang, rep)
        at = np.array(rep, np.int64)
        self.ids, self.n_ids, self.first = ids, len(rep), at
        self.word_hash = h[at]
        raw = self.bytes.tobytes()  # cutting bytes is far cheaper than cutting an array for every word
        self.word_check = mix64(word_hashes([raw[i:j] for i, j in zip(s[at].tolist(), e[at].tolist(), strict=True)]) + lang_hash[lang[at]])

    def _exact(self, ids: np.ndarray, rep: np.ndarray, lang: np.ndarray, reps: list[int]) -> None:
        """Words that differ from the first word of their hash get ids of their own."""
        s, e, b = self.start, self.end, self.bytes
        mine = rep[ids]
        odd = ((e - s) != (e - s)[mine]) | (lang != lang[mine])
        size = np.where(odd, 0, e - s)
        for at in range(0, len(s), COMPARED):
            part = slice(at, at + COMPARED)
            n, here, there = size[part], s[part], s[mine[part]]
            owner = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            differ = b[here[owner] + within] != b[there[owner] + within]
            if differ.any():
                odd[part] |= np.bincount(owner, differ, len(n)) > 0
        names: dict[tuple, int] = {}
        for k in np.flatnonzero(odd).tolist():
            name = (int(lang[k]), bytes(b[s[k] : e[k]]))
            if name not in names:
                names[name] = len(reps)
                reps.append(k)
            ids[k] = names[name]

    def grams(self, n: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Places whose n words lie in one piece, and the fingerprint of every such n-gram."""
        at = np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]) if len(self.piece) >= n else np.zeros(0, np.int64)
        if n == 1:
            return at, self.hash
        total = prefix(self.hash, GRAM_BASE)
        h = mix64((total[at + n] - total[at]) * powers(GRAM_BASE, len(self.hash) + 1)[1][at] + np.uint64(n))
        if bits < 64:
            h &= np.uint64((1 << bits) - 1)
        return at, h

    def text(self, at: int, n: int) -> str:
        return b" ".join(bytes(self.bytes[self.start[k] : self.end[k]]) for k in range(at, at + n)).decode("utf-8", "replace")


def blocks(batch: pa.RecordBatch, bits: int = 64, size: int = BLOCK, grouped: bool = True):
    """(block, row of each document, language of each document) over the texts of a batch (row, lang, text)."""
    texts = batch.column(2)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    rows = batch.column(0).to_numpy()
    coded = batch.column(1).dictionary_encode()
    langs, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    lang_hash = word_hashes([x.encode() for x in langs])
    at, stop, doc = int(offsets[0]), int(offsets[-1]), 0
    while at < stop:
        last = int(np.searchsorted(offsets, at + size, "right")) - 1
        end = int(offsets[last])
        if end <= at:  # one document is longer than a block: cut behind a piece
            last = int(np.searchsorted(offsets, at, "right"))
            end, whole = int(offsets[last]), data[at : int(offsets[last])]
            for near in range(size, len(whole), size):
                mark = np.flatnonzero(KIND[whole[near - size // 2 : near]] == BREAK)
                if len(mark):
                    end = at + near - size // 2 + int(mark[-1]) + 1
                    break
        doc = int(np.searchsorted(offsets, at, "right")) - 1
        inside = np.maximum(offsets[doc : int(np.searchsorted(offsets, end, "left"))], at)
        keep = np.arange(doc, doc + len(inside))
        yield Block(data[at:end], inside - at, codes[keep], lang_hash, bits, grouped), rows[keep], [langs[c] for c in codes[keep]]
        at = end


def _in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each fingerprint are set in the table (64-bit words)."""
    mask = np.uint64(len(table) * 64 - 1)
    out = np.ones(len(h), bool)
    for p in (h & mask, (h >> np.uint64(29)) & mask):
        out &= (table[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) != 0
    return out


def bit_table(found: DataFrame) -> np.ndarray:
    """Two bits for every fingerprint of ``found``, in a table of at most MOST_BITS bits, built in Spark."""
    size = 1 << 12
    while size < 16 * found.count() and size < MOST_BITS:
        size *= 2
    place = F.explode(F.array(F.col("fp").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("fp", 29).bitwiseAND(F.lit(size - 1))))
    words = found.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("v")
    )
    got, table = words.toArrow(), np.zeros(size // 64, np.uint64)
    table[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return table


COUNTED = pa.schema([("lang", pa.string()), ("fp", pa.int64()), ("chk", pa.int64()), ("row", pa.int64()), ("c", pa.int64())])


def _grouped(block: Block, n: int, tables: dict[int, np.ndarray], bits: int):
    """Distinct n-grams of a block: first place, fingerprint, check and count."""
    if n == 1:
        return block.first, block.word_hash, block.word_check, np.bincount(block.ids, minlength=block.n_ids)
    ok = _in(tables[1], block.word_hash)[block.ids]
    at, h = block.grams(n, bits)
    keep = np.logical_and.reduce([ok[at + k] for k in range(n)])
    if n > 2:
        below, fp = block.grams(2, bits)
        pair = np.zeros(len(block.ids), bool)
        pair[below] = _in(tables[2], fp)
        keep &= pair[at] & pair[at + 1]
    at, h = at[keep], h[keep]
    key = block.ids[at].astype(np.int64)
    for k in range(1, n):
        if k > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * block.n_ids + block.ids[at + k]
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    at, h = at[first], h[first]
    check = np.zeros(len(at), np.uint64)
    for k in range(n):
        check += block.word_check[block.ids[at + k]] * CHECKS[k]
    return at, h, mix64(check), count


def count_level(base: DataFrame, n: int, tables: dict, least: int, bits: int, size: int) -> DataFrame:
    """fp, c, first, last, exact of the n-grams that occur ``least`` times; for n = 1 also one row for each
    language with all its words."""
    shared = {k: base.sparkSession.sparkContext.broadcast(t) for k, t in tables.items()}  # at most MOST_BITS each

    def run(batches):
        held = {k: t.value for k, t in shared.items()}
        for batch in batches:
            for block, rows, langs in blocks(batch, bits, size):
                at, fp, check, count = _grouped(block, n, held, bits)
                docs = rows[block.doc[at]]
                for k in range(0, len(at), 50_000):
                    part = slice(k, k + 50_000)
                    yield emit(COUNTED, [pa.nulls(len(at[part]), pa.string()), fp[part].view(np.int64), check[part].view(np.int64), docs[part], count[part]])
                if n == 1:
                    per: dict[str, int] = {}
                    for lang, words in zip(langs, np.bincount(block.doc, minlength=len(langs)).tolist(), strict=True):
                        per[lang] = per.get(lang, 0) + words
                    yield emit(COUNTED, [list(per), [0] * len(per), [0] * len(per), [0] * len(per), list(per.values())])

    rows = base.mapInArrow(run, "lang string, fp long, chk long, row long, c long")
    keys = ["lang", "fp"] if n == 1 else ["fp"]
    out = rows.groupBy(*keys).agg(
        F.sum("c").alias("c"), F.min("row").alias("first"), F.max("row").alias("last"), F.min("chk").alias("low"), F.max("chk").alias("high")
    )
    wanted = (F.col("lang").isNotNull() | (F.col("c") >= least)) if n == 1 else F.col("c") >= least
    return materialize(out.filter(wanted).select(*keys, "c", "first", "last", (F.col("low") == F.col("high")).alias("exact")))


LOCATED = pa.schema([("n", pa.int32()), ("fp", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())])


def _texts(block: Block, langs: list[str], n: int, bits: int, wanted) -> list[tuple]:
    """(n, fingerprint, language, text, count) of the n-grams whose place and fingerprint ``wanted`` picks."""
    at, h = block.grams(n, bits)
    keep = wanted(block.doc[at], h)
    at, h = at[keep], h[keep]
    got: dict[tuple, int] = {}
    for k, fp in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
        name = (n, fp, langs[block.doc[k]], block.text(k, n))
        got[name] = got.get(name, 0) + 1
    return [(*name, c) for name, c in got.items()]


def locate(base: DataFrame, pointers: DataFrame, bits: int, size: int) -> DataFrame:
    """Text behind (n, fp, row) pointers: the named documents are searched for the fingerprint."""
    wanted = pointers.groupBy("row").agg(*[F.collect_set(F.when(F.col("n") == n, F.col("fp"))).alias(f"f{n}") for n in range(1, LONGEST + 1)])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = [batch.column(2 + n) for n in range(1, LONGEST + 1)]
                place = {int(r): k for k, r in enumerate(batch.column(0).to_numpy())}
                for block, rows, langs in blocks(batch, bits, size, grouped=False):
                    spots = np.array([place[int(r)] for r in rows], np.int64)
                    out = []
                    for n, names in enumerate(lists, 1):
                        owner = np.repeat(np.arange(len(names)), names.value_lengths().to_numpy())
                        asked = mix64(names.flatten().to_numpy().view(np.uint64) + mix64(owner.astype(np.uint64)))
                        asked.sort()

                        def pick(doc, h, asked=asked):
                            if not len(asked):
                                return np.zeros(len(h), bool)
                            q = mix64(h + mix64(spots[doc].astype(np.uint64)))
                            return asked[np.minimum(np.searchsorted(asked, q), len(asked) - 1)] == q

                        out += _texts(block, langs, n, bits, pick)
                    if out:
                        yield emit(LOCATED, list(zip(*out, strict=True)))

    return base.join(wanted, "row").select("row", "lang", "text", *[f"f{n}" for n in range(1, LONGEST + 1)]).mapInArrow(
        run, "n int, fp long, lang string, phrase string, c long"
    )


def recount(base: DataFrame, bad: DataFrame, bits: int, size: int) -> DataFrame:
    """lang, n, phrase, a of all phrases behind the collided fingerprints, counted by their text."""
    tables = {n: base.sparkSession.sparkContext.broadcast(bit_table(bad.filter(F.col("n") == n))) for n in range(1, LONGEST + 1)}

    def run(batches):
        for batch in batches:
            for block, _, langs in blocks(batch, bits, size, grouped=False):
                out = [x for n, t in tables.items() for x in _texts(block, langs, n, bits, lambda doc, h, t=t: _in(t.value, h))]
                if out:
                    yield emit(LOCATED, list(zip(*out, strict=True)))

    every = base.mapInArrow(run, "n int, fp long, lang string, phrase string, c long")
    return every.join(bad, ["n", "fp"], "left_semi").groupBy("lang", "n", "phrase").agg(F.sum("c").alias("a"))


def phrase_counts(docs: DataFrame, least: int = 10, bits: int = 64, size: int = BLOCK, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, n, phrase, a) of all phrases of 1 to 3 words with a >= ``least``, and the number
    of words (lang, words) of every language with words."""
    base = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
    )
    tables, levels, words = {}, [], None
    for n in range(1, LONGEST + 1):
        level = count_level(base, n, tables, least, bits, size)
        if n == 1:
            words = level.filter("lang IS NOT NULL").select("lang", F.col("c").alias("words"))
            level = level.filter("lang IS NULL").drop("lang")
        if n < LONGEST:
            tables[n] = bit_table(level)
        levels.append(level.withColumn("n", F.lit(n)))
    found = levels[0].unionByName(levels[1]).unionByName(levels[2])
    pointers = found.select("n", "fp", F.explode(F.array_distinct(F.array("first", "last"))).alias("row"))
    named = locate(base, pointers, bits, size).groupBy("n", "fp").agg(
        F.min("phrase").alias("phrase"), F.max("phrase").alias("p2"), F.min("lang").alias("lang"), F.max("lang").alias("l2")
    )
    seen = materialize(found.join(named, ["n", "fp"], "left"))
    one = F.col("exact") & F.col("phrase").eqNullSafe(F.col("p2")) & F.col("lang").eqNullSafe(F.col("l2")) & F.col("phrase").isNotNull()
    counts = seen.filter(one).select("lang", "n", "phrase", F.col("c").alias("a"))
    bad = seen.filter(~one).select("n", "fp")
    if not bad.isEmpty():
        counts = counts.unionByName(recount(base, materialize(bad), bits, size).filter(F.col("a") >= least))
    counts = materialize(counts)
    drop_materialized(base)
    return counts, words


def collocations(docs: DataFrame, least: int = 10, top: int | None = 2000, bits: int = 64, size: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 and 3 words, the best ``top`` of every language
    (None: all). The weakest cut of a phrase counts: score = floor(10^6 a^2 / (l r)), ties to the earlier cut. A
    phrase inside a longer candidate with at least half its count is dropped."""
    counts, words = phrase_counts(docs, least, bits, size)
    phrases = counts.filter("n >= 2")
    w = F.split("phrase", " ")
    part = lambda a, b: F.array_join(F.slice(w, a, b), " ")
    inner = phrases.filter("n = 3").select("lang", F.explode(F.array(part(1, 2), part(2, 2))).alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inner, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 50 * a").drop("longer")
    cuts = kept.select("lang", "phrase", "a", F.col("n").alias("len"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(w, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(w, F.col("k") + 1, F.col("len") - F.col("k")), " ")})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    exact = "cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)) * 1000000BD div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))"
    best = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    out = best.join(words, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", F.col("words").alias("n"), "cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    out = out.withColumn("rank", F.row_number().over(order))
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
