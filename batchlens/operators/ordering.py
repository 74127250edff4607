"""Skew-safe ordered scans: positions, running sums, lag-1 and forward fill per key, in built-in windows.

A ``Window.partitionBy(key)`` puts every row of a key in one task, and one
machine or batch may hold a third of all rows. ``ordered_scan`` is a two-level
prefix scan instead:

1. ``repartitionByRange(P, *keys, *order)`` splits a hot key over several
   partitions by its order columns; the partition's number becomes a column;
2. windows over (partition number, key) give local positions, sums, lags and
   fills: no window is larger than one range partition. The result is written
   once (range bounds are sampled, so it must not be recomputed);
3. only a partition's first and last key can go on elsewhere: their totals
   (<= 2 x P rows, whatever the data) are scanned by key in partition order,
   and the carry, equally small, is broadcast back.

Order columns must make the order unique within a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.session import stored


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns where NULL equals NULL; the right side's columns go."""
    named = right.select(*[F.col(c).alias(f"_os_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"_os_r_{c}")) for c in on]
    return left.join(F.broadcast(named), cond, how).drop(*[f"_os_r_{c}" for c in on])


def _edge_totals(scanned: DataFrame, keys: list[str], sums: list[str], lags: list[str], fills: list[str]) -> DataFrame:
    """The state behind the last row of each partition's first and last key."""
    key = F.struct(*[F.col(k) for k in keys])
    edges = scanned.groupBy("_os_pid").agg(F.min(key).alias("a"), F.max(key).alias("z"))
    edges = edges.select("_os_pid", F.explode(F.array_distinct(F.array("a", "z"))).alias("k")).select("_os_pid", "k.*")
    own = _null_safe(scanned, edges, ["_os_pid", *keys], "inner")
    state = [*[f"_os_ls_{n}" for n in sums], *[f"_os_g_{n}" for n in lags], *[f"_os_lf_{n}" for n in fills]]
    last = [F.max_by(c, "_os_lpos").alias(c) for c in state]
    return own.groupBy("_os_pid", *keys).agg(F.max("_os_lpos").alias("_os_n"), *last)


def _carry(totals: DataFrame, keys: list[str], sums: list[str], lags: list[str], fills: list[str]) -> DataFrame:
    """What each edge key brings along from earlier partitions; a key's window has at most P rows."""
    by = Window.partitionBy(*keys).orderBy("_os_pid")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_os_pid", *keys, F.sum("_os_n").over(before).alias("_os_c_n"),
        *[F.sum(f"_os_ls_{n}").over(before).alias(f"_os_c_{n}") for n in sums],
        *[F.lag(f"_os_g_{n}").over(by).alias(f"_os_p_{n}") for n in lags],
        *[F.last(f"_os_lf_{n}", ignorenulls=True).over(before).alias(f"_os_pf_{n}") for n in fills],
    ).filter(F.col("_os_c_n").isNotNull())


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    ffills: Mapping[str, Column] | None = None,
    partitions: int | None = None,
    pos_col: str = "pos",
    layout_col: str | None = None,
    presorted: str | None = None,
) -> DataFrame:
    """Add ``pos_col`` (1-based position within ``keys`` by ``order``), the
    inclusive running sum of each ``sums`` expression (NULL counts as 0), and
    the previous row's value of each ``lags`` expression (NULL on a key's
    first row), and each ``ffills`` expression forward-filled within the key
    (last non-NULL value so far). With ``keys=[]`` the whole table is one
    ordered sequence. An empty table stays empty.

    ``layout_col`` keeps the partition number of this scan's range layout in the
    output. Passing that column as ``presorted`` to a later scan over the same
    keys and order uses the split that is already there: no second sampling and range shuffle."""
    sums, lags, ffills, keys = dict(sums or {}), dict(lags or {}), dict(ffills or {}), list(keys)
    d = df
    if not keys:
        d, keys = d.withColumn("_os_k", F.lit(0)), ["_os_k"]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    if presorted is not None:
        laid = d.withColumn("_os_pid", F.col(presorted))
    else:
        parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        laid = d.repartitionByRange(parts, *[F.col(k) for k in keys], *order_cols).withColumn("_os_pid", F.spark_partition_id())
    w = Window.partitionBy("_os_pid", *keys).orderBy(*order_cols)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    local = {"_os_lpos": F.row_number().over(w).cast("long")}
    local |= {f"_os_ls_{n}": F.sum(F.coalesce(e.cast("double"), F.lit(0.0))).over(running) for n, e in sums.items()}
    local |= {f"_os_g_{n}": e for n, e in lags.items()}
    local |= {f"_os_ll_{n}": F.lag(e).over(w) for n, e in lags.items()}
    local |= {f"_os_lf_{n}": F.last(e, ignorenulls=True).over(running) for n, e in ffills.items()}
    scanned = stored(laid.select("*", *[e.alias(n) for n, e in local.items()]))
    names = list(sums), list(lags), list(ffills)
    carry = _carry(_edge_totals(scanned, keys, *names), keys, *names)
    out = _null_safe(scanned, carry, ["_os_pid", *keys], "left")
    cols = {pos_col: F.col("_os_lpos") + F.coalesce("_os_c_n", F.lit(0))}
    cols |= {n: F.col(f"_os_ls_{n}") + F.coalesce(f"_os_c_{n}", F.lit(0.0)) for n in sums}
    # only a key's first row in a partition needs the carried value
    cols |= {n: F.when((F.col("_os_lpos") == 1) & F.col("_os_c_n").isNotNull(), F.col(f"_os_p_{n}")).otherwise(F.col(f"_os_ll_{n}")) for n in lags}
    cols |= {n: F.coalesce(f"_os_lf_{n}", f"_os_pf_{n}") for n in ffills}
    if layout_col is not None:
        cols[layout_col] = F.col("_os_pid")
    out = out.withColumns(cols)
    return out.drop(*[c for c in out.columns if c.startswith("_os_")])


def ordered_index(df: DataFrame, order: Sequence[str | Column], col: str = "row_index") -> DataFrame:
    """Dense 0-based global position by ``order`` (unique), without a
    single-partition window."""
    out = ordered_scan(df, [], order, pos_col=col)
    return out.withColumn(col, F.col(col) - F.lit(1))
