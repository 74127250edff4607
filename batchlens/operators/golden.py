"""Golden signatures: best batch per scenario, promotion, history.

Top-k per scenario is a ``row_number() <= k`` filter over
``partitionBy(scenario)``: Catalyst plans it with a partial
``WindowGroupLimit`` before the shuffle, so each map task forwards only its
own top-k per scenario and the shuffle carries k x scenarios x tasks rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchlens.constants import CONTROL_PARAMETERS, PRIMARY_OBJECTIVES
from batchlens.operators.ranking import rank_all_scenarios, score_expr

PROFILE_COLUMNS = ["Batch_ID", *CONTROL_PARAMETERS, *PRIMARY_OBJECTIVES, "Green_Zone", "Scenario_Score"]

SIGNATURE_SCHEMA = T.StructType(
    [
        T.StructField("scenario", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("weights", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("profile", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "alternatives",
            T.ArrayType(T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("score", T.DoubleType())])),
        ),
        T.StructField("promoted_from", T.StringType()),
        T.StructField("promoted_at_utc", T.StringType()),
    ]
)


def top_per_scenario(ranked: DataFrame, top_n: int = 3) -> DataFrame:
    w = Window.partitionBy("scenario").orderBy(F.col("Scenario_Score").desc_nulls_last(), F.col("Batch_ID"))
    return ranked.withColumn("alt_rank", F.row_number().over(w)).filter(F.col("alt_rank") <= top_n)


def golden_signatures(
    features: DataFrame,
    targets: Mapping[str, float | None] | None,
    scenarios: Mapping[str, Mapping[str, float]] | None = None,
    top_n: int = 3,
) -> DataFrame:
    """H7 (flat form): per scenario the top-``top_n`` rows with ``alt_rank``
    (1 = the signature) and the profile columns."""
    ranked = rank_all_scenarios(features, targets, scenarios)
    cols = [c for c in PROFILE_COLUMNS if c in ranked.columns]
    return top_per_scenario(ranked, top_n).select("scenario", "alt_rank", *cols)


def nest_signatures(top: DataFrame, scenarios: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Flat top-k rows -> one nested signature row per scenario."""
    weight_rows = F.create_map(
        *[x for n, w in scenarios.items() for x in (F.lit(n), F.create_map(*[y for o in PRIMARY_OBJECTIVES for y in (F.lit(o), F.lit(float(w.get(o, 0.0))))]))]
    )
    prof_cols = [c for c in PROFILE_COLUMNS if c in top.columns]
    profile = F.create_map(*[x for c in prof_cols for x in (F.lit(c), F.col(c).cast("string"))])
    g = top.groupBy("scenario").agg(
        F.min_by(F.struct(F.col("Batch_ID").alias("batch_id"), F.col("Scenario_Score").alias("score"), profile.alias("profile")), F.col("alt_rank")).alias("best"),
        F.sort_array(F.collect_list(F.struct("alt_rank", F.col("Batch_ID").alias("batch_id"), F.col("Scenario_Score").alias("score")))).alias("alts"),
    )
    return g.select(
        "scenario",
        F.col("best.batch_id").alias("batch_id"),
        F.col("best.score").alias("score"),
        weight_rows[F.col("scenario")].alias("weights"),
        F.col("best.profile").alias("profile"),
        F.transform("alts", lambda a: F.struct(a["batch_id"].alias("batch_id"), a["score"].alias("score"))).alias("alternatives"),
        F.lit(None).cast("string").alias("promoted_from"),
        F.lit(None).cast("string").alias("promoted_at_utc"),
    )


def score_batches(features: DataFrame, stats: Mapping, scenarios: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """H3 for whole batches: each one once per scenario with ``Scenario_Score`` against the objective ranges ``stats`` of
    another table (those that the current signatures were ranked with)."""
    scored = F.array(*[F.struct(F.lit(n).alias("scenario"), score_expr(w, stats).alias("Scenario_Score")) for n, w in scenarios.items()])
    return features.withColumn("__s", F.explode(scored)).select("*", "__s.scenario", "__s.Scenario_Score").drop("__s")


def promote_if_better(current: DataFrame, candidates: DataFrame, source_tag: str, as_of: str) -> DataFrame:
    """H8: per scenario, replace the signature when the candidate's score is
    strictly greater. Scenarios without a current signature are ignored.
    All other columns of ``current`` (weights, alternatives, ...) are kept; a
    ``profile`` is replaced by the candidate's, if it brings one, together with
    the batch. ``current``: (scenario, batch_id, score, ...); ``candidates``:
    (scenario, Batch_ID, Scenario_Score[, profile])."""
    own_profile = "profile" in current.columns and "profile" in candidates.columns
    cand = candidates.select(
        "scenario", F.col("Batch_ID").alias("cand_batch_id"), F.col("Scenario_Score").alias("cand_score"),
        *([F.col("profile").alias("cand_profile")] if own_profile else []),
    )
    rest = [c for c in current.columns if c not in ("scenario", "batch_id", "score", "promoted", "promoted_from", "promoted_at_utc")]
    j = current.join(cand, on="scenario", how="left")
    better = F.coalesce(F.col("cand_score") > F.col("score"), F.lit(False))
    return j.select(
        "scenario",
        F.when(better, F.col("cand_batch_id")).otherwise(F.col("batch_id")).alias("batch_id"),
        F.when(better, F.col("cand_score")).otherwise(F.col("score")).alias("score"),
        better.alias("promoted"),
        F.when(better, F.lit(source_tag)).otherwise(F.col("promoted_from") if "promoted_from" in current.columns else F.lit(None).cast("string")).alias("promoted_from"),
        F.when(better, F.lit(as_of)).otherwise(F.col("promoted_at_utc") if "promoted_at_utc" in current.columns else F.lit(None).cast("string")).alias("promoted_at_utc"),
        *[F.when(better, F.col("cand_profile")).otherwise(F.col(c)).alias(c) if c == "profile" and own_profile else F.col(c) for c in rest],
    )


def history_rows(signatures: DataFrame, timestamp: str, load_seq: int) -> DataFrame:
    """Signature table -> history rows (timestamp, scenario, score, batch_id,
    promoted_from, approved_by) tagged with a load sequence number."""
    pf = F.coalesce(F.col("promoted_from"), F.lit("initial")) if "promoted_from" in signatures.columns else F.lit("initial")
    return signatures.select(
        F.lit(timestamp).alias("timestamp"),
        "scenario",
        F.col("score").cast("double").alias("score"),
        F.col("batch_id").cast("string").alias("batch_id"),
        pf.alias("promoted_from"),
        F.lit("system").alias("approved_by"),
        F.lit(load_seq).alias("__seq"),
    )


def merge_history(*frames: DataFrame) -> DataFrame:
    """Union all, then keep the last row per (timestamp, scenario)."""
    allrows = frames[0]
    for f in frames[1:]:
        allrows = allrows.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy("timestamp", "scenario").orderBy(F.col("__seq").desc())
    return allrows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__seq")
