"""Surrogate models (controls -> KPIs) and candidate search (L1-L3).

Training uses Spark ML's distributed ``GBTRegressor`` with the reference
settings (80 trees, depth 3, step 0.1, subsample 0.8, seed 42), one model
per KPI; the six fits are independent Spark jobs submitted concurrently.
Tree models are invariant to feature scaling, so no scaler is fitted.
Spark's trees see no more of an input than its bin (32 at most), so above ``CELL_ROWS`` rows the bins are cut beforehand
from all rows, and rows that share the bins of all inputs are fitted as weighted means, each bin combination in
``PARTS`` random parts for the trees' subsampling. Every row counts; a fit then passes over the combinations instead of the rows.
Candidate search is a distributed table: golden profiles x N perturbations
(seeded integer draws), scored by ``model.transform``, best per scenario by
``max_by``; nothing is looped on the driver.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.constants import CONTROL_PARAMETERS, DEFAULT_EMISSION_FACTOR, PRIMARY_OBJECTIVES
from batchlens.functions.numeric import rint_dp
from batchlens.functions.zones import zone_candidate
from batchlens.operators.candidates import composite_score, uniform
from batchlens.operators.stats import pct, stats_row
from batchlens.session import stored

#: Above so many rows the models are fitted on bin combinations.
CELL_ROWS = 100_000
#: Bins of an input (``maxBins`` of the models), and random parts of each combination.
BINS, PARTS = 32, 40


@dataclass
class Surrogates:
    inputs: list[str]
    models: dict[str, GBTRegressionModel] = field(default_factory=dict)
    summary: list[tuple] = field(default_factory=list)
    #: Per input the upper ends of all bins but the last, if the models read bin numbers instead of values.
    cuts: dict[str, list[float]] | None = None

    @property
    def ready(self) -> bool:
        return len(self.models) >= 2

    def vector(self, df: DataFrame, columns: list[str], out: str = "__x") -> DataFrame:
        """Adds the vector that the models read; ``columns`` hold the inputs, in their order."""
        if self.cuts is not None:
            df, columns = self.binned(df, columns)
        return VectorAssembler(inputCols=columns, outputCol=out).transform(df)

    def binned(self, df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
        """Adds the bin number of every input (how many cuts lie below the value), and the names of these columns."""
        names = [f"__bin_{c}" for c in self.inputs]
        cut = [(c, b, self.cuts[i]) for i, c, b in zip(self.inputs, columns, names, strict=True) if self.cuts[i]]
        if cut:  # a bucket holds its lower end, a bin its upper end
            splits = [[-math.inf, *(math.nextafter(t, math.inf) for t in ts), math.inf] for _c, _b, ts in cut]
            df = Bucketizer(splitsArray=splits, inputCols=[c for c, _b, _t in cut], outputCols=[b for _c, b, _t in cut]).transform(df)
        # a sum drops the mark of a category that the buckets carry: bins are ordered
        return df.withColumns({b: F.col(b) + F.lit(0.0) if self.cuts[i] else F.lit(0.0) for i, b in zip(self.inputs, names, strict=True)}), names

    def threshold(self, feature: int, at: float) -> float:
        """The input value at which a split of the models divides (left: up to it)."""
        return at if self.cuts is None else self.cuts[self.inputs[feature]][math.floor(at)]


def bin_cuts(data: DataFrame, inputs: list[str]) -> dict[str, list[float]]:
    """Upper ends of at most ``BINS`` bins per input, but the last: between all values if they are so few, else quantiles of all rows."""
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    st = data.agg(*[f(c).alias(f"{p}_{c}") for c in inputs for p, f in (("n", F.approx_count_distinct), ("max", F.max))],
                  *[F.percentile_approx(c, shares, 10_000).alias(f"q_{c}") for c in inputs]).first()
    few = [c for c in inputs if st[f"n_{c}"] <= 2 * BINS]
    values: dict[str, list[float]] = {c: [] for c in few}
    if few:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in few]))
        for r in data.select(pairs.alias("p")).select("p.*").distinct().collect():  # about 2 * BINS values per input
            values[r["c"]].append(r["x"])
    cuts = {}
    for c in inputs:
        xs = sorted(values.get(c, []))
        some = [a / 2 + b / 2 for a, b in zip(xs, xs[1:])] if c in values and len(xs) <= BINS else [q for q in st[f"q_{c}"] if q < st[f"max_{c}"]]
        cuts[c] = sorted({t for t in some if math.isfinite(t)})
    return cuts


def cells(data: DataFrame, sur: Surrogates, targets: list[str], seed: int) -> DataFrame:
    """Rows that share all bins, in ``PARTS`` random parts: bin numbers, __n (rows) and the mean of every target."""
    data, names = sur.binned(data, sur.inputs)
    part = F.floor(F.rand(seed) * PARTS)
    return data.groupBy(*names, part.alias("__part")).agg(F.count(F.lit(1)).cast("double").alias("__n"), *[F.avg(t).alias(t) for t in targets])


def train(features: DataFrame, max_iter: int = 80, max_depth: int = 3, step: float = 0.1,
          subsample: float = 0.8, seed: int = 42, min_rows: int = 30, min_distinct: int = 5) -> Surrogates:
    """L1: one GBT per KPI with >= ``min_distinct`` distinct values; needs >= 2
    control inputs and >= ``min_rows`` rows. Inputs and targets are
    median-filled. More than ``CELL_ROWS`` rows are fitted by bin combinations."""
    inputs = [c for c in CONTROL_PARAMETERS if c in features.columns]
    targets = [t for t in PRIMARY_OBJECTIVES if t in features.columns]
    st = stats_row(features, [F.count(F.lit(1)).alias("n")]
                   + [pct(c, 0.5).alias(f"m_{c}") for c in inputs + targets]
                   + [F.countDistinct(F.coalesce(F.col(t).cast("double"), F.lit(float("nan")))).alias(f"d_{t}") for t in targets])
    sur = Surrogates(inputs)
    if len(inputs) < 2 or st["n"] < min_rows:
        sur.summary = [(t, int(st[f"d_{t}"]), False) for t in targets]
        return sur
    filled = features.select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(float(st[f"m_{c}"] or 0.0))).alias(c) for c in inputs],
        *[F.coalesce(F.col(t).cast("double"), F.lit(float(st[f"m_{t}"] or 0.0))).alias(t) for t in targets],
    )
    weight = {}
    if st["n"] > CELL_ROWS:
        sur.cuts = bin_cuts(filled, inputs)
        some = stored(cells(filled, sur, targets, seed))
        few = some.coalesce(max(1, some.count() // 20_000))
        data = VectorAssembler(inputCols=[f"__bin_{c}" for c in inputs], outputCol="__x").transform(few).select("__x", "__n", *targets).cache()
        weight = {"weightCol": "__n"}
    else:
        data = sur.vector(filled, inputs).select("__x", *targets).cache()
    eligible = [t for t in targets if st[f"d_{t}"] >= min_distinct]

    def fit(t: str):
        gbt = GBTRegressor(featuresCol="__x", labelCol=t, maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                           subsamplingRate=subsample, maxBins=BINS, seed=seed, **weight)
        return t, gbt.fit(data)

    try:
        with ThreadPoolExecutor(max_workers=max(1, len(eligible))) as pool:
            for t, m in pool.map(fit, eligible):
                sur.models[t] = m
    finally:
        data.unpersist()
    sur.summary = [(t, int(st[f"d_{t}"]), t in sur.models) for t in targets]
    return sur


def search(profiles: DataFrame, sur: Surrogates, seed_col: str, n: int = 40, spread: float = 0.05,
           emission_factor: float = DEFAULT_EMISSION_FACTOR, id_prefix: str = "SIM_ML_") -> DataFrame:
    """L2/L3: around each golden profile row, ``n`` perturbations of every
    control by U(-spread, +spread); KPIs predicted by the surrogates, carbon
    and eco re-derived; per profile the best composite replaces the golden
    one only when strictly better."""
    inputs = sur.inputs
    keep = [*inputs, *PRIMARY_OBJECTIVES]
    profiles = profiles.withColumn("__golden", F.struct(*[F.col(c).cast("double").alias(c) for c in keep]))
    s = F.col(seed_col).cast("bigint")
    cand = profiles.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    pert = {c: F.col(c).cast("double") * (F.lit(1.0) + uniform(s * F.lit(1000) + F.col("__k"), j + 1, -spread, spread))
            for j, c in enumerate(inputs)}
    cand = cand.withColumns({f"__p_{c}": e for c, e in pert.items()})
    cand = sur.vector(cand, [f"__p_{c}" for c in inputs])
    for t, m in sur.models.items():
        cand = m.setFeaturesCol("__x").setPredictionCol(f"__pred_{t}").transform(cand)
    new = {c: rint_dp(F.col(f"__p_{c}"), 3) for c in inputs}
    new.update({t: rint_dp(F.col(f"__pred_{t}"), 3) for t in sur.models})
    cand = cand.withColumns(new)
    cand = cand.withColumn("Carbon_kg", rint_dp(F.col("Total_Energy_kWh") * F.lit(float(emission_factor)), 3))
    g_e = F.greatest(F.lit(1.0), F.col("__g_e"))
    g_c = F.greatest(F.lit(1.0), F.col("__g_c"))
    eco = (
        F.lit(0.40) * (F.col("Yield_Percent") / F.lit(100.0))
        + F.lit(0.15) * (F.col("Quality_Score") / F.lit(100.0))
        + F.lit(0.20) * F.greatest(F.lit(0.0), F.lit(1.0) - F.col("Total_Energy_kWh") / g_e)
        + F.lit(0.15) * F.greatest(F.lit(0.0), F.lit(1.0) - F.col("Carbon_kg") / g_c)
    ) * F.lit(100.0)
    cand = cand.withColumn("Eco_Efficiency_Score", rint_dp(F.greatest(F.lit(0.0), F.least(F.lit(100.0), eco)), 2))
    cand = cand.withColumn("__comp", composite_score(cand))
    best = cand.groupBy("scenario").agg(
        F.max_by(F.struct(*[F.col(c).cast("double").alias(c) for c in keep]), F.col("__comp")).alias("b"),
        F.first("__golden").alias("g"),
        F.max("__comp").alias("best_composite"),
        F.first("__golden_composite").alias("golden_composite"),
        F.first("Batch_ID").alias("golden_batch"),
    )
    improved = F.col("best_composite") > F.col("golden_composite")
    out = best.select(
        "scenario", "golden_batch", improved.alias("improved"),
        F.when(improved, F.concat(F.lit(id_prefix), F.col("golden_batch"))).otherwise(F.col("golden_batch")).alias("Batch_ID"),
        rint_dp(F.col("best_composite"), 6).alias("best_composite"), rint_dp(F.col("golden_composite"), 6).alias("golden_composite"),
        *[F.when(improved, F.col(f"b.{c}")).otherwise(F.col(f"g.{c}")).alias(c) for c in keep],
    )
    return out.withColumn("Green_Zone", zone_candidate("Eco_Efficiency_Score"))


def prepare_profiles(top: DataFrame, seed_col: str) -> DataFrame:
    """Golden profile rows with the golden composite and baselines attached."""
    return top.withColumns({
        "__golden_composite": composite_score(top),
        "__g_e": F.coalesce(F.col("Total_Energy_kWh").cast("double"), F.lit(1.0)),
        "__g_c": F.coalesce(F.col("Carbon_kg").cast("double"), F.lit(1.0)),
    })
