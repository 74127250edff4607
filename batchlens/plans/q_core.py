"""Core queries: aggregation, join, cleaning, KPIs, targets, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchlens.constants import DEFAULT_SCENARIOS, PRIMARY_OBJECTIVES
from batchlens.operators import features as feat
from batchlens.operators import ranking
from batchlens.operators.stats import iqr_clip
from batchlens.plans import context
from batchlens.plans import sqlgen as S
from batchlens.plans.registry import query
from batchlens.plans.structured import clean_production, numeric_columns
from batchlens.sources.tables import process_readings, production_batches

OBJ = ", ".join(PRIMARY_OBJECTIVES)


@query("process_agg", lambda: f"""WITH {S.structured_ctes()}
SELECT * FROM agg""")
def q_process_agg(spark, sf):
    """Per-batch process features over every reading."""
    return feat.process_agg(process_readings(spark, sf))


@query("clean_median", lambda: f"""WITH {S.structured_ctes()}
SELECT * FROM prod""")
def q_clean_median(spark, sf):
    """Production table with every NULL replaced by its column median."""
    return clean_production(production_batches(spark, sf))[0]


@query("batch_join", lambda: f"""WITH {S.structured_ctes()}
SELECT * FROM merged""")
def q_batch_join(spark, sf):
    """Cleaned production LEFT JOIN cleaned process aggregate."""
    return context.structured(spark, sf).merged


@query("clean_iqr", lambda: f"""WITH {S.structured_ctes()}
SELECT * FROM clipped""")
def q_clean_iqr(spark, sf):
    """IQR winsorisation of every numeric column of the joined table."""
    merged = context.structured(spark, sf).merged
    return iqr_clip(merged, numeric_columns(merged))[0]


@query("kpi_features", lambda: f"""WITH {S.structured_ctes()}
SELECT * FROM features""")
def q_kpi_features(spark, sf):
    """F2-F8 + C5: the full feature table of the structured path."""
    return context.features(spark, sf)


@query("build_targets", lambda: f"""WITH {S.structured_ctes()}, {S.targets_cte('Standard')}
SELECT * FROM targets""")
def q_build_targets(spark, sf):
    """D3: quantile targets at 'Standard' strictness."""
    return ranking.targets_frame(context.features(spark, sf), "Standard")


@query("target_filter", lambda: f"""WITH {S.structured_ctes()}, {S.targets_cte('Strict')}
SELECT Batch_ID, {OBJ} FROM features CROSS JOIN targets WHERE {S.TARGET_COND}""")
def q_target_filter(spark, sf):
    """batches meeting the 'Strict' targets."""
    f = context.features(spark, sf)
    t = ranking.build_targets(f, "Strict")
    return ranking.target_filter(f, t).select("Batch_ID", *PRIMARY_OBJECTIVES)


def _rank_sql(scenario: str, strictness: str) -> str:
    return f"""WITH {S.structured_ctes()}, {S.targets_cte(strictness)}, {S.objective_stats_cte()},
{S.candidates_cte()}
SELECT Batch_ID, {OBJ}, Green_Zone, {S.score_sql(DEFAULT_SCENARIOS[scenario])} AS Scenario_Score
FROM cand CROSS JOIN ost"""


@query("rank_batches", lambda: _rank_sql("Balanced", "Standard"))
def q_rank_batches(spark, sf):
    """H1-H2: 'Balanced' scenario ranking under 'Standard' targets."""
    f = context.features(spark, sf)
    r = ranking.rank_batches(f, DEFAULT_SCENARIOS["Balanced"], ranking.build_targets(f, "Standard"))
    return r.select("Batch_ID", *PRIMARY_OBJECTIVES, "Green_Zone", "Scenario_Score")


def flagship(spark, sf):
    """Scan -> per-batch aggregate -> join -> KPIs -> ranked batches, best first."""
    return q_rank_batches(spark, sf).orderBy(F.col("Scenario_Score").desc_nulls_last(), "Batch_ID")
