"""Decision queries: Pareto front, golden signatures, promotion, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchlens.constants import CONTROL_PARAMETERS, DEFAULT_SCENARIOS, PRIMARY_OBJECTIVES
from batchlens.operators import golden, pareto, ranking
from batchlens.plans import context
from batchlens.plans import sqlgen as S
from batchlens.plans.registry import query

OBJ = ", ".join(PRIMARY_OBJECTIVES)
PROFILE = ", ".join(["Batch_ID", *CONTROL_PARAMETERS, *PRIMARY_OBJECTIVES, "Green_Zone", "Scenario_Score"])
AS_OF = "2024-06-30T00:00:00+00:00"


def _candidates(spark, sf, strictness="Standard"):
    f = context.features(spark, sf)
    return ranking._candidates(f, ranking.build_targets(f, strictness))


def _cand_sql(strictness="Standard") -> str:
    return f"{S.structured_ctes()}, {S.targets_cte(strictness)}, {S.objective_stats_cte()},\n{S.candidates_cte()}"


@query("pareto_front", lambda: f"""WITH {_cand_sql()}
SELECT Batch_ID, {OBJ}, Green_Zone FROM cand u
WHERE NOT EXISTS (SELECT 1 FROM cand v WHERE {S.dominance_sql('u', 'v')})""")
def q_pareto_front(spark, sf):
    """H4: exact Pareto front of the target-passing batches (no cap, no sample)."""
    cand = _candidates(spark, sf).select("Batch_ID", *PRIMARY_OBJECTIVES, "Green_Zone")
    return pareto.pareto_front(cand)


@query("pareto_proxy_topk", lambda: f"""WITH {_cand_sql()},
mx AS (SELECT max(Yield_Percent) + 1e-9 AS my, max(Total_Energy_kWh) + 1e-9 AS me FROM cand),
top AS (SELECT cand.* FROM cand CROSS JOIN mx
        ORDER BY Yield_Percent / my - Total_Energy_kWh / me DESC NULLS LAST, Batch_ID LIMIT 300)
SELECT Batch_ID, {OBJ}, Green_Zone FROM top u
WHERE NOT EXISTS (SELECT 1 FROM top v WHERE {S.dominance_sql('u', 'v')})""")
def q_pareto_proxy_topk(spark, sf):
    """H4 (capped variant): front of the 300 best rows by the yield/energy proxy."""
    cand = _candidates(spark, sf).select("Batch_ID", *PRIMARY_OBJECTIVES, "Green_Zone")
    return pareto.pareto_front(pareto.proxy_topk(cand, 300))


@query("golden_signatures", lambda: f"""WITH {_cand_sql()},
{S.ranked_all_cte()},
top AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY Scenario_Score DESC NULLS LAST, Batch_ID) AS alt_rank FROM ranked)
SELECT scenario, alt_rank, {PROFILE} FROM top WHERE alt_rank <= 3""")
def q_golden_signatures(spark, sf):
    """H7: per scenario the signature batch and its two alternatives."""
    f = context.features(spark, sf)
    return golden.golden_signatures(f, ranking.build_targets(f, "Standard"), DEFAULT_SCENARIOS, 3).withColumn(
        "alt_rank", F.col("alt_rank").cast("bigint")
    )


def _sig_sql_parts() -> str:
    from batchlens.plans.q_reports import rc_ctes

    case = "CASE scenario " + " ".join(f"WHEN '{n}' THEN {S.score_sql(w)}" for n, w in DEFAULT_SCENARIOS.items()) + " END"
    return f"""{rc_ctes()},
cur AS (SELECT scenario, Batch_ID AS batch_id, Scenario_Score AS score FROM top),
cnd AS (SELECT scenario, Batch_ID AS cand_batch_id, {case} AS cand_score FROM rc CROSS JOIN ost),
prom AS (SELECT cur.scenario,
  CASE WHEN coalesce(cand_score > score, false) THEN cand_batch_id ELSE batch_id END AS batch_id,
  CASE WHEN coalesce(cand_score > score, false) THEN cand_score ELSE score END AS score,
  coalesce(cand_score > score, false) AS promoted,
  CASE WHEN coalesce(cand_score > score, false) THEN 'simulation' ELSE NULL END AS promoted_from,
  CASE WHEN coalesce(cand_score > score, false) THEN '{AS_OF}' ELSE NULL END AS promoted_at_utc
  FROM cur LEFT JOIN cnd USING (scenario))"""


def _current_and_promoted(spark, sf):
    """Current signatures ('Standard' targets) and the result of challenging
    them with simulated improved candidates (L5), each scored with its own
    scenario's weights against the full table's ranges (H3)."""
    from batchlens.plans.q_reports import simulated_candidates

    f = context.features(spark, sf)
    cur = golden.golden_signatures(f, ranking.build_targets(f, "Standard"), DEFAULT_SCENARIOS, 1).select(
        "scenario", F.col("Batch_ID").alias("batch_id"), F.col("Scenario_Score").alias("score"),
        F.lit(None).cast("string").alias("promoted_from"), F.lit(None).cast("string").alias("promoted_at_utc"),
    )
    st = ranking.objective_stats(f)
    score = None
    for n, w in DEFAULT_SCENARIOS.items():
        score = (F.when(F.col("scenario") == n, ranking.score_expr(w, st)) if score is None
                 else score.when(F.col("scenario") == n, ranking.score_expr(w, st)))
    cand = simulated_candidates(spark, sf).withColumn("Scenario_Score", score)
    return cur, golden.promote_if_better(cur, cand, "simulation", AS_OF)


@query("golden_promote", lambda: f"""WITH {_sig_sql_parts()}
SELECT * FROM prom""")
def q_golden_promote(spark, sf):
    """H8: signatures challenged by simulated improved candidates; a strictly
    greater score promotes, alternatives and unknown scenarios are untouched."""
    return _current_and_promoted(spark, sf)[1]


@query("golden_history", lambda: f"""WITH {_sig_sql_parts()},
h AS (
  SELECT '2024-06-01T00:00:00+00:00' AS timestamp, scenario, score, batch_id, 'initial' AS promoted_from, 'system' AS approved_by, 1 AS seq FROM cur
  UNION ALL
  SELECT '{AS_OF}' AS timestamp, scenario, score, batch_id, 'initial', 'system', 2 FROM cur
  UNION ALL
  SELECT '{AS_OF}' AS timestamp, scenario, score, batch_id, coalesce(promoted_from, 'initial'), 'system', 3 FROM prom)
SELECT timestamp, scenario, score, batch_id, promoted_from, approved_by FROM (
  SELECT *, row_number() OVER (PARTITION BY timestamp, scenario ORDER BY seq DESC) AS rn FROM h) WHERE rn = 1""")
def q_golden_history(spark, sf):
    """History log merge; duplicates on (timestamp, scenario) keep the last."""
    cur, prom = _current_and_promoted(spark, sf)
    return golden.merge_history(
        golden.history_rows(cur, "2024-06-01T00:00:00+00:00", 1),
        golden.history_rows(cur, AS_OF, 2),
        golden.history_rows(prom, AS_OF, 3),
    )
