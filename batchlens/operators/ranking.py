"""Targets, target filter, weighted scenario ranking, candidate scoring.

Normalisation is always against the *full* feature table (even after the
target filter). "If the filter leaves nothing, rank everything" is decided
by a ``limit(1)`` existence probe that picks one of two plans.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.constants import (
    DEFAULT_SCENARIOS,
    OBJECTIVE_DIRECTIONS,
    PRIMARY_OBJECTIVES,
    STRICTNESS_QUANTILE,
)
from batchlens.functions.numeric import clip_keep_null, rint_dp
from batchlens.operators.stats import minmax_aggs, pct, stats_row

TARGET_COLUMNS = ["min_yield", "min_quality", "max_energy", "max_carbon", "min_eco_score"]


def strictness_quantiles(strictness: str) -> tuple[float, float]:
    q = STRICTNESS_QUANTILE.get(strictness, STRICTNESS_QUANTILE["Standard"])
    return q, 1.0 - q + 0.15


def targets_frame(features: DataFrame, strictness: str = "Standard", with_eco: bool = True) -> DataFrame:
    """D3: one-row targets frame from quantiles of the feature table."""
    t = build_targets(features, strictness, with_eco)
    schema = ", ".join(f"{c} double" for c in TARGET_COLUMNS)
    return features.sparkSession.createDataFrame([tuple(t[c] for c in TARGET_COLUMNS)], schema)


def build_targets(features: DataFrame, strictness: str = "Standard", with_eco: bool = True) -> dict:
    """D3 as plain values (one statistics pass)."""
    q, qmax = strictness_quantiles(strictness)
    aggs = [
        pct("Yield_Percent", q).alias("min_yield"),
        pct("Quality_Score", q).alias("min_quality"),
        pct("Total_Energy_kWh", qmax).alias("max_energy"),
        pct("Carbon_kg", qmax).alias("max_carbon"),
    ]
    if with_eco:
        aggs.append(pct("Eco_Efficiency_Score", q).alias("min_eco_score"))
    t = stats_row(features, aggs)
    t.setdefault("min_eco_score", None)
    return t


def target_condition(t: Mapping[str, float | None]) -> Column:
    """yield >=, quality >=, energy <=, carbon <=, optional eco >=.
    NULL comparisons count as failing."""
    def lit(k):
        return F.lit(None).cast("double") if t.get(k) is None else F.lit(float(t[k]))

    cond = (
        (F.col("Yield_Percent") >= lit("min_yield"))
        & (F.col("Quality_Score") >= lit("min_quality"))
        & (F.col("Total_Energy_kWh") <= lit("max_energy"))
        & (F.col("Carbon_kg") <= lit("max_carbon"))
    )
    if t.get("min_eco_score") is not None:
        cond = cond & (F.col("Eco_Efficiency_Score") >= lit("min_eco_score"))
    return F.coalesce(cond, F.lit(False))


def target_filter(features: DataFrame, targets: Mapping[str, float | None]) -> DataFrame:
    return features.filter(target_condition(targets))


def _candidates(features: DataFrame, targets: Mapping[str, float | None] | None) -> DataFrame:
    """Rows passing the targets, or every row when none passes (decided by a
    one-row existence probe, ``limit(1)``, not a full count)."""
    if targets is None:
        return features
    passing = target_filter(features, targets)
    return passing if passing.limit(1).count() > 0 else features


def weights_frame(spark: SparkSession, scenarios: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Long scenario table (scenario, objective, weight): tiny, fixed size."""
    scenarios = scenarios or DEFAULT_SCENARIOS
    rows = [(s, o, float(w.get(o, 0.0))) for s, w in scenarios.items() for o in PRIMARY_OBJECTIVES]
    return spark.createDataFrame(rows, "scenario string, objective string, weight double")


def objective_stats(features: DataFrame) -> dict:
    return stats_row(features, minmax_aggs(PRIMARY_OBJECTIVES))


def _norm_objective(obj: str, st: Mapping[str, float | None]) -> Column:
    lo, hi = st.get(f"min_{obj}"), st.get(f"max_{obj}")
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    if abs(hi - lo) <= 1e-8:
        norm = F.lit(0.5)
    else:
        norm = (F.col(obj) - F.lit(float(lo))) / F.lit(float(hi - lo))
    if OBJECTIVE_DIRECTIONS[obj] == "min":
        norm = F.lit(1.0) - norm
    return clip_keep_null(norm, 0.0, 1.0)


def score_expr(weights: Mapping[str, float], st: Mapping[str, float | None]) -> Column:
    denom = float(sum(float(weights.get(o, 0.0)) for o in PRIMARY_OBJECTIVES))
    if abs(denom) <= 1e-8:
        denom = 1.0
    total = None
    for o in PRIMARY_OBJECTIVES:
        term = _norm_objective(o, st) * F.lit(float(weights.get(o, 0.0)))
        total = term if total is None else total + term
    return rint_dp(total / F.lit(denom) * F.lit(100.0), 2)


def rank_batches(
    features: DataFrame, weights: Mapping[str, float], targets: Mapping[str, float | None] | None = None
) -> DataFrame:
    """H1-H2: rows passing the targets (or all rows when none pass), scored
    against the full table's min/max. Adds ``Scenario_Score``. Presentation
    order (score desc, Batch_ID asc) is left to the caller's ``orderBy``."""
    st = objective_stats(features)
    return _candidates(features, targets).withColumn("Scenario_Score", score_expr(weights, st))


def rank_all_scenarios(
    features: DataFrame,
    targets: Mapping[str, float | None] | None = None,
    scenarios: Mapping[str, Mapping[str, float]] | None = None,
) -> DataFrame:
    """All scenarios in one pass: each candidate row is emitted once per
    scenario (fixed, small fan-out) with ``scenario`` and ``Scenario_Score``."""
    scenarios = scenarios or DEFAULT_SCENARIOS
    st = objective_stats(features)
    cand = _candidates(features, targets)
    scored = F.array(
        *[F.struct(F.lit(n).alias("scenario"), score_expr(w, st).alias("Scenario_Score")) for n, w in scenarios.items()]
    )
    out = cand.withColumn("__s", F.explode(scored))
    return out.withColumns({"scenario": F.col("__s.scenario"), "Scenario_Score": F.col("__s.Scenario_Score")}).drop("__s")


def score_candidates(candidates: DataFrame, reference: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """H3: score external candidates against the reference table's min/max.
    A zero weight sum gives 0.0."""
    denom = float(sum(float(weights.get(o, 0.0)) for o in PRIMARY_OBJECTIVES))
    if abs(denom) <= 1e-8:
        return candidates.withColumn("Candidate_Score", F.lit(0.0))
    return candidates.withColumn("Candidate_Score", score_expr(weights, objective_stats(reference)))


def renormalise_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """H5: custom weights scaled to sum 1 (all-zero stays all-zero)."""
    total = sum(float(weights.get(o, 0.0)) for o in PRIMARY_OBJECTIVES)
    if abs(total) <= 1e-12:
        return {o: 0.0 for o in PRIMARY_OBJECTIVES}
    return {o: float(weights.get(o, 0.0)) / total for o in PRIMARY_OBJECTIVES}


def display_scores(features: DataFrame, weights: Mapping[str, float], targets: Mapping[str, float | None] | None) -> DataFrame:
    """H6: 0-1 display score. Batches in the ranked set (passing the targets,
    or all when none pass) use Scenario_Score / 100 (the looked-up 0-100
    score, rescaled); others the fallback weighted score in which a constant
    objective counts 0.0. ``Page_Score`` is .45 eco + .30 quality + .25 yield
    (each / 100), clipped to [0, 1]. One projection, no join."""
    st = objective_stats(features)
    total = None
    for o in PRIMARY_OBJECTIVES:
        lo, hi = st.get(f"min_{o}"), st.get(f"max_{o}")
        if lo is None or hi is None or hi == lo:
            n = F.lit(0.0)
        else:
            n = (F.col(o) - F.lit(float(lo))) / F.lit(float(hi - lo))
            if OBJECTIVE_DIRECTIONS[o] == "min":
                n = F.lit(1.0) - n
            n = clip_keep_null(n, 0.0, 1.0)
        term = F.lit(float(weights.get(o, 0.0))) * n
        total = term if total is None else total + term
    tw = float(sum(float(v) for v in weights.values())) or 1.0
    fallback = rint_dp(clip_keep_null(total / F.lit(tw), 0.0, 1.0), 9)
    page = clip_keep_null(
        F.lit(0.45) * (F.col("Eco_Efficiency_Score") / F.lit(100.0))
        + F.lit(0.3) * (F.col("Quality_Score") / F.lit(100.0))
        + F.lit(0.25) * (F.col("Yield_Percent") / F.lit(100.0)),
        0.0, 1.0,
    )
    if targets is None:
        in_ranked = F.lit(True)
    else:
        any_pass = target_filter(features, targets).limit(1).count() > 0
        in_ranked = target_condition(targets) if any_pass else F.lit(True)
    looked_up = clip_keep_null(score_expr(weights, st) / F.lit(100.0), 0.0, 1.0)
    return features.select(
        "Batch_ID",
        F.when(in_ranked, F.coalesce(looked_up, fallback)).otherwise(fallback).alias("Display_Score"),
        rint_dp(page, 9).alias("Page_Score"),
    )
