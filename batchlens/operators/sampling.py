"""Explicit sampling operators (never applied implicitly).

Both keep every k-th row of each batch in a deterministic order computed by
the skew-safe ordered scan; the stride is derived from the batch sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.operators.ordering import ordered_scan
from batchlens.operators.stats import stats_row


def _keep_every(df: DataFrame, batch_col: str, order: Sequence[str], stride) -> DataFrame:
    """Keep rows at positions 1, 1 + k, 1 + 2k, ... of each batch, where
    ``stride(n)`` gives k from the batch size n. Batches with k = 1 are kept
    whole without computing positions; only thinned batches are ordered."""
    sizes = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", stride(F.col("__n")))
    sized = df.join(sizes, on=batch_col)
    whole = sized.filter(F.col("__k") == 1).drop("__n", "__k")
    if sizes.filter(F.col("__k") > 1).limit(1).count() == 0:
        return whole
    thin = sized.filter(F.col("__k") > 1)
    p = ordered_scan(thin, [batch_col], [F.col(o) for o in order], pos_col="__pos")
    kept = p.filter((F.col("__pos") - 1) % F.col("__k") == 0).drop("__pos", "__n", "__k")
    return whole.unionByName(kept)


def stride_sample(df: DataFrame, max_rows: int, batch_col: str | None, order: Sequence[str]) -> DataFrame:
    """Tables above ``max_rows`` keep every k-th row per batch with
    k = max(1, n_batch // max(1, max_rows // n_batches)); without a batch
    column a global stride max(1, n // max_rows). Smaller tables pass through."""
    st = stats_row(df, [F.count(F.lit(1)).alias("n")] + ([F.countDistinct(batch_col).alias("b")] if batch_col else []))
    if st["n"] <= max_rows:
        return df
    if batch_col:
        per_batch = max(1, max_rows // max(st["b"], 1))
        return _keep_every(df, batch_col, order, lambda n: F.greatest(F.lit(1), F.floor(n / F.lit(per_batch))))
    step = max(1, st["n"] // max_rows)
    p = ordered_scan(df, [], [F.col(o) for o in order], pos_col="pos")
    return p.filter((F.col("pos") - 1) % F.lit(step) == 0).drop("pos")


def decimate(df: DataFrame, batch_col: str, order: Sequence[str], max_points: int = 900) -> DataFrame:
    """Per batch, at most ~``max_points`` rows: batches longer than that
    keep every (n // max_points)-th row."""
    return _keep_every(df, batch_col, order,
                       lambda n: F.when(n > max_points, F.greatest(F.lit(1), F.floor(n / F.lit(max_points)))).otherwise(F.lit(1)))
