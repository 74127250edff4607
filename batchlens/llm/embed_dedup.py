"""Near-duplicate embeddings by lattice hashing.

Each of ``tables`` random projections takes a unit vector to eight dimensions, scaled by 1/``width``; the
nearest point of the E8 lattice is its home cell. A vector is also entered as a guest in the ``probes``
neighbouring cells (of the 240 that touch the home cell) that lie nearest to it. Two vectors of one label are
candidates if one is at home where the other is at home or a guest; candidates are verified by cosine in
double precision.

Equal vectors of one label are one class, so copies cost one row; a link between classes counts for all
their members. A cell's members meet in a join (home x all) that Spark splits when a cell is hot; nothing is
gathered per cell. With the defaults a pair at cosine 0.93 is found with probability 0.99, at 0.95 almost
surely, and unrelated pairs meet in 0.2 percent of the cases; for much larger tables per label take a
smaller ``width`` and more ``tables``.

Edge cases: a null label, a null or empty vector, a zero vector, and one with null or non-finite
components is linked with nothing (n_links 0, a component of its own); vectors of different lengths are
never linked; repeated rows are linked with each other; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emit, materialize, mix64, odd_multipliers
from .graph import components

TABLES, PROBES, WIDTH = 20, 2, 1.0


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries +-1, or eight entries +-1/2 with an even number of minuses."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: round, and if odd move the least certain coordinate."""
    near = np.rint(y)
    off = y - near
    rows = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[rows]).argmax(1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of the even integers and the even integers plus one half."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, tables: int, probes: int, width: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Cell names: home (n, tables) and guests (n, tables, probes)."""
    rng = np.random.Generator(np.random.PCG64([seed, unit.shape[1]]))
    near, weight = neighbours(), odd_multipliers(seed, 8)
    home, guest = np.zeros((len(unit), tables), np.int64), np.zeros((len(unit), tables, probes), np.int64)

    def name(points: np.ndarray, t: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            doubled = np.rint(2 * points).astype(np.int64).view(np.uint64)
            return mix64((doubled * weight).sum(-1, dtype=np.uint64) + np.uint64(t) * weight[0]).view(np.int64)

    for t in range(tables):
        y = unit @ (rng.standard_normal((unit.shape[1], 8)) / width) + rng.random(8)
        point = nearest(y)
        home[:, t] = name(point, t)
        if probes:
            closest = np.argsort(-((y - point) @ near.T), axis=1, kind="stable")[:, :probes]
            guest[:, t] = name(point[:, None, :] + near[closest], t)
    return home, guest


def _unit(column: pa.Array) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1)[:, None]  # no overflow of the squares
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _coded(classes: DataFrame, tables: int, probes: int, width: float) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_())])

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                dims = np.array(batch.column(2).to_pylist())
                for d in np.unique(dims):
                    some = batch.filter(pa.array(dims == d))
                    home, guest = cells(_unit(some.column(3)), tables, probes, width)
                    n, each = some.num_rows, tables * (1 + probes)
                    all_cells = np.concatenate([home, guest.reshape(n, -1)], 1).ravel()
                    at_home = np.tile(np.arange(each) < tables, n)
                    yield emit(schema, [np.repeat(some.column(0).to_numpy(), each), np.repeat(some.column(1).to_numpy(), each), np.full(n * each, d, np.int32), all_cells, at_home])

    return classes.select("node", "label", "dim", "embedding").mapInArrow(run, "node long, label long, dim int, cell long, home boolean")


def _cosines(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    side = lambda s: classes.select(F.col("node").alias(s), F.col("embedding").alias(f"{s}_v"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            a, b = col["a"].to_numpy(), col["b"].to_numpy()
            dims = np.diff(col["a_v"].offsets.to_numpy())
            for d in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == d))
                x, y = (col[s].take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) for s in ("a_v", "b_v"))
                x, y = x / np.abs(x).max(1)[:, None], y / np.abs(y).max(1)[:, None]
                cosine = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                keep = at.to_numpy()[cosine >= least]
                yield emit(schema, [a[keep], b[keep]])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def near_vectors(
    vectors: DataFrame, least: float = 0.93, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    keys = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64("embedding", F.lit("second"), "label").alias("h2")]
    good = rows.filter("usable").select("vec_id", "label", "embedding", *keys)
    classes = good.groupBy("h1", "h2").agg(F.count("*").alias("size"), F.min("vec_id").alias("least_id"), F.min(F.struct("label", "embedding")).alias("one"))
    classes = materialize(classes.select("h1", "h2", "size", "least_id", "one.*", F.size("one.embedding").alias("dim")).withColumn("node", F.monotonically_increasing_id()))
    coded = _coded(classes, tables, probes, width).withColumn("key", F.xxhash64("label", "dim", "cell")).select("node", "key", "home")
    coded = materialize(coded)
    home = coded.filter("home").select(F.col("node").alias("other"), "key")
    pairs = coded.join(home, "key").filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.lit(1).alias("one")).distinct()
    # cells carry a 64-bit name; label and length are checked again on the rows themselves
    kind = lambda s: classes.select(F.col("node").alias(s), F.struct("label", "dim").alias(f"{s}_kind"))
    pairs = pairs.join(kind("a"), "a").join(kind("b"), "b").filter("a_kind = b_kind").select("a", "b")
    links = materialize(_cosines(pairs, classes, least))
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    linked = both.join(classes.select(F.col("node").alias("b"), "size"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("far"))
    labels = materialize(components(links))
    named = classes.select("node", "h1", "h2", "size", "least_id").join(labels.withColumnRenamed("label", "root"), "node", "left")
    named = named.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = named.join(roots, "root").select("h1", "h2", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), "component_id")
    full = good.select("vec_id", "h1", "h2").join(found, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
