"""Near-duplicate documents by SetSketch registers, banded, estimated and verified.

A document's set has its distinct 5-word shingles (64-bit hashes of lower-cased words). Each of m registers
holds floor(1 - log_b E) of the smallest of the set's exponential variates E, cut off at both ends: registers
merge by maximum, and two documents agree in a register more often the more alike they are. Steps:

1. Documents with equal sets are one *class* (a group of copies costs one row from here on).
2. Eight registers are one band; classes that agree in a band share a bucket.
3. In every bucket all members are compared with its lead, first by the joint likelihood of both sketches (set
   sizes are known), which drops pairs far below the threshold, then on the full sets. Links are joined to components.
4. Buckets whose members now lie in one component are done, which are nearly all of a large group's. In the
   others every two members of different components are compared on their full sets, in blocks of bounded size:
   a member is sent once per block, pairs are never written out, and only links come back.

A link at the threshold misses every band with probability below 1e-6 (see ``bands_for``).

Edge cases: null or word-less texts have empty sets, linked with nothing; shorter texts are one shingle;
repeated rows are linked; a component whose ids are all null has a null id; extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_columns, emit, gram_hashes, materialize, mix64, odd_multipliers, shard_count, word_hashes
from .graph import components

SHINGLE = 5
BASE = 1.2
#: Rate of the exponential variates; keeps the registers of small sets above the lower cut.
RATE = 20.0
ROWS = 8  # registers of a band: eight bytes, one integer
MISS = 1e-6
BLOCK = 256
_GRAM = odd_multipliers(31, SHINGLE)


def agree(j: float) -> float:
    """Probability that two sets of one size agree in a register at similarity j."""
    p = -math.log1p(-(0.5 - 0.5 * j) * (BASE - 1) / BASE) / math.log(BASE)
    return 1 - 2 * p


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(agree(threshold) ** ROWS)))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text given by its word hashes."""
    if len(words) >= SHINGLE:
        return np.unique(gram_hashes(words, SHINGLE, _GRAM))
    if not len(words):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        whole = (words * _GRAM[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
    return mix64(np.array([whole]) ^ np.uint64(0x5BD1E995))


_SLOPES: dict[int, np.ndarray] = {}


def registers(grams: np.ndarray, m: int) -> np.ndarray:
    """m truncated, exponentially spaced minima of a set, one byte each."""
    if m not in _SLOPES:
        _SLOPES[m] = (odd_multipliers(41, m) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    slopes, x = _SLOPES[m], (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(m, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * slopes).min(0), out=least)
    variate = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / math.log(BASE)), 0, 255).astype(np.uint8)


def sketch(docs: DataFrame, bands: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tkey (hash of the text), n_shingles, h1, h2 (identity of the set), bands (registers)."""
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, tkeys, texts = batch_columns(batch.slice(at, 500), "doc_id", "tkey", "text")
                sizes, h1, h2, rows = [], [], [], []
                for text in texts:
                    grams = shingles(word_hashes(text.lower().split()))
                    sizes.append(len(grams))
                    with np.errstate(over="ignore"):
                        h1.append(int(mix64(grams).sum(dtype=np.uint64).astype(np.int64)))
                        h2.append(int(np.bitwise_xor.reduce(mix64(grams * _GRAM[0]), initial=np.uint64(len(grams))).astype(np.int64)))
                    rows.append(registers(grams, bands * ROWS) if len(grams) else np.zeros(bands * ROWS, np.uint8))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows) + 1) * bands, bands, dtype=np.int32)), pa.array(np.concatenate(rows).view(np.int64)))
                yield emit(schema, [keys, tkeys, sizes, h1, h2, lists])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("tkey"))
    return rows.mapInArrow(run, "doc_id long, tkey long, n_shingles long, h1 long, h2 long, bands array<long>")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows of register bytes) of known set sizes."""
    more, fewer = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - fewer
    u = n_a / (n_a + n_b)
    v = 1 - u
    log_b = math.log(BASE)
    chance = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b, 1e-12)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    top = np.minimum(u / v, v / u)
    for share in np.linspace(0, 1, 101):
        j = share * top
        p, q = chance(u - v * j), chance(v - u * j)
        value = more * np.log(p) + fewer * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))
        better = value > best
        best, at = np.where(better, value, best), np.where(better, j, at)
    return at


def _plausible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose likelihood estimate is not below ``least``."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("bands").alias(f"{s}_bands"), F.col("n_shingles").alias(f"{s}_n"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            col = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            regs = [col[c].flatten().to_numpy(zero_copy_only=False).view(np.uint8).reshape(batch.num_rows, -1) for c in ("a_bands", "b_bands")]
            sizes = [col[c].to_numpy().astype(float) for c in ("a_n", "b_n")]
            keep = estimate(*regs, *sizes) >= least
            yield emit(schema, [col["a"].to_numpy()[keep], col["b"].to_numpy()[keep]])

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, grams) of the wanted (node, tkey): full sets, from the text of one copy."""
    schema = pa.schema([("node", pa.int64()), ("grams", pa.binary())])
    text = F.coalesce(F.col(text_col), F.lit(""))
    # exact copies of a text meet here; partial minima keep one of them before the shuffle of the answer
    found = docs.select(F.xxhash64(text).alias("tkey"), text.cast("binary").alias("text")).join(nodes, "tkey")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                seen: dict[int, bytes] = {}
                for node, text in zip(*batch_columns(batch.slice(at, 100), "node", "text"), strict=True):
                    if node not in seen:
                        seen[node] = shingles(word_hashes(text.lower().split())).tobytes()
                yield emit(schema, [list(seen), list(seen.values())])

    return found.select("node", "text").mapInArrow(run, "node long, grams binary").groupBy("node").agg(F.min("grams").alias("grams"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common and total (sizes of intersection and union) on the full sets."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("grams").alias(f"{s}_grams"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("total", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                a, b, x, y = batch_columns(batch.slice(at, 100), "a", "b", "a_grams", "b_grams")
                common = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)]
                yield emit(schema, [a, b, common, [len(p) // 8 + len(q) // 8 - c for p, q, c in zip(x, y, common, strict=True)]])

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.mapInArrow(run, "a long, b long, common long, total long")


def _common(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets ``left`` with sets ``right`` (indices), as a matrix: products of
    slices of the incidence matrix of the shingles."""
    sizes = np.array([len(g) for g in grams])
    values, column = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(len(grams)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(values), 4096):
        some = slice(*np.searchsorted(column, [at, at + 4096]))
        part = np.zeros((len(grams), min(4096, len(values) - at)), np.float32)
        part[row[some], column[some] - at] = 1
        out += part[left] @ part[right].T
    return np.rint(out).astype(np.int64)


def _links_inside(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket (bucket, node, label) that have different labels. Buckets are
    compared in blocks of about ``BLOCK`` members: a member is sent once for each block of its bucket, and only
    links come back, so nothing grows with the square of a bucket but comparisons."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = placed.join(sizes, "bucket").select("bucket", "node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(cell.alias("cell"), "node", "label", "own", F.col("other").alias("against"))

    def compare(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        _, node, label, own_, against, raw = zip(*group, strict=True)
        node, label, own_, against = (np.array(x) for x in (node, label, own_, against))
        low = np.minimum(own_, against)
        left = np.flatnonzero(own_ == low)
        right = np.flatnonzero(own_ == np.maximum(own_, against))
        grams = [np.frombuffer(g, np.uint64) for g in raw]
        n = np.array([len(g) for g in grams])
        common = _common(grams, left, right)
        link = common * 100 >= (n[left][:, None] + n[right] - common) * percent
        link &= (label[left][:, None] != label[right]) & (node[left][:, None] != node[right])
        x, y = np.nonzero(link)
        return node[left[x]], node[right[y]]

    def run(batches):
        stream = (r for batch in batches for at in range(0, batch.num_rows, 200) for r in zip(*batch_columns(batch.slice(at, 200), "cell", "node", "label", "own", "against", "grams"), strict=True))
        for _, group in groupby(stream, key=lambda r: r[0]):
            group = list(group)
            if len(group) > 1:
                a, b = compare(group)
                if len(a):
                    yield emit(schema, [np.minimum(a, b), np.maximum(a, b)])

    whole = rows.join(sets, "node").select("cell", "node", "label", "own", "against", "grams")
    dealt = whole.repartition(shard_count(placed.sparkSession), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and the label (smallest node) of the component of each distinct set, by h1 and h2."""
    threshold = percent / 100
    rows = materialize(sketch(docs, bands_for(threshold), id_col, text_col))
    classes = rows.filter("n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("tkey", "n_shingles", "bands")).alias("one")
    )
    classes = materialize(classes.select("h1", "h2", "least_id", "one.*").withColumn("node", F.monotonically_increasing_id()))
    exploded = classes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1").select("bucket", "lead")
    members = materialize(exploded.join(shared, "bucket"))
    wanted = members.select("node").distinct().join(classes.select("node", "tkey"), "node")
    sets = materialize(_sets(docs, wanted, id_col, text_col))
    stars = members.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    stars = _verified(_plausible(stars, classes, 2 * threshold - 1.12), sets)
    stars = materialize(stars.filter(F.col("common") * 100 >= F.col("total") * percent).select("a", "b"))
    placed = _labelled(members.select("bucket", "node"), components(stars))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    placed = placed.join(mixed, "bucket", "left_semi")
    links = stars.unionByName(_links_inside(materialize(placed), sets, percent))
    labels = materialize(components(links))
    return rows, _labelled(classes.select("node", "h1", "h2", "least_id"), labels).drop("node")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links at 100 * common >= percent * total."""
    rows, sets = _linked(docs, percent, id_col, text_col)
    least = sets.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_set = sets.join(least, "label").select("h1", "h2", "component_id")
    full = rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "h1", "h2").join(by_set, ["h1", "h2"])
    empty = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "component_id").unionByName(empty)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    names = [c for c in nodes.columns]
    return nodes.join(labels, "node", "left").select(*names, F.coalesce("label", "node").alias("label"))


def deduplicated(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they were: that of the smallest id (null ids last; equal
    ids: the smallest hash of the text). Documents without words all stay."""
    names = docs.columns
    rows, sets = _linked(docs, percent, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")
    chosen = rows.filter("n_shingles > 0").select("doc_id", "tkey", "h1", "h2").join(sets.select("h1", "h2", "label"), ["h1", "h2"])
    chosen = materialize(chosen.groupBy("label").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("_id"), F.col("o.tkey").alias("_key")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text).alias("_text"))
    same = keyed["_doc"].eqNullSafe(chosen["_id"]) & (keyed["_text"] == chosen["_key"])
    kept = keyed.join(chosen, same, "left_semi")
    copies = rows.join(chosen, (rows["tkey"] == chosen["_key"]) & rows["doc_id"].eqNullSafe(chosen["_id"]), "left_semi").groupBy("doc_id", "tkey").count()
    if not copies.filter("count > 1").isEmpty():  # rows that agree in id and text
        kept = kept.dropDuplicates(["_doc", "_text"])
    bare = keyed.filter(F.col("_row").getField(text_col).isNull() | ~F.col("_row").getField(text_col).rlike(r"[^ \t-\r]"))
    return kept.select("_row").union(bare.select("_row")).select(*[F.col("_row").getField(c).alias(c) for c in names])
