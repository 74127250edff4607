"""Queries over versions: signatures promoted by batches of a later period and read back, a feature store that is rebuilt in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchlens import constants as K
from batchlens.constants import DEFAULT_SCENARIOS, OBJECTIVE_DIRECTIONS
from batchlens.operators import compare as C
from batchlens.operators import golden, ranking
from batchlens.plans import context
from batchlens.plans import sqlgen as S
from batchlens.plans.q_io import AS_OF, scratch
from batchlens.plans.registry import query
from batchlens.sources import incremental, versions
from batchlens.sources import signature_versions as SV
from batchlens.sources.tables import process_readings, production_batches

#: Share of the batch numbers that make the first period.
EARLY = 0.3
#: Scenario that isn't stored, so readers fall back to the best-ranked batch.
UNSTORED = "Balanced"


def _periods(features):
    number = F.substring("Batch_ID", 2, 18).cast("long")
    last = features.agg(F.max(number)).first()[0] or 0
    cut = int(last * EARLY // 1)
    return features.filter(number <= cut), features.filter(number > cut)


def _lifecycle(spark, sf):
    """(root of the store, best-ranked batches of the first period): signatures of the first period published, then challenged by the
    best batch of the later one under every scenario."""
    early, late = _periods(context.features(spark, sf))
    top = golden.golden_signatures(early, ranking.build_targets(early, "Standard"), DEFAULT_SCENARIOS, 3)
    nested = golden.nest_signatures(top, DEFAULT_SCENARIOS)
    root = scratch(spark, "signature-versions")
    SV.publish(spark, root, nested.filter(F.col("scenario") != UNSTORED), 0, "first period")
    rivals = golden.top_per_scenario(golden.score_batches(late, ranking.objective_stats(early), DEFAULT_SCENARIOS), 1)
    rivals = golden.nest_signatures(rivals, DEFAULT_SCENARIOS)
    SV.promote(spark, root, rivals.select("scenario", F.col("batch_id").alias("Batch_ID"), F.col("score").alias("Scenario_Score"), "profile"), "later period", AS_OF)
    return root, top.filter("alt_rank = 1")


def _lifecycle_ctes() -> str:
    number = "CAST(substr(Batch_ID, 2) AS BIGINT)"
    return f"""{S.structured_ctes()},
cut AS (SELECT CAST(floor(coalesce(max({number}), 0) * {EARLY!r}) AS BIGINT) AS last FROM features),
early AS (SELECT features.* FROM features CROSS JOIN cut WHERE {number} <= last),
late AS (SELECT features.* FROM features CROSS JOIN cut WHERE {number} > last),
{S.targets_cte('Standard', 'early')}, {S.objective_stats_cte('early')},
{S.candidates_cte('early')},
{S.ranked_all_cte()},
{S.ranked_all_cte('late').replace('ranked AS (', 'rivals AS (', 1)},
top AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY Scenario_Score DESC NULLS LAST, Batch_ID) AS alt_rank FROM ranked),
best AS (SELECT scenario, max(CASE WHEN alt_rank = 1 THEN Batch_ID END) AS batch_id, max(CASE WHEN alt_rank = 1 THEN Scenario_Score END) AS score,
  CAST(count(*) AS INTEGER) AS n_alternatives FROM top WHERE alt_rank <= 3 GROUP BY scenario),
rival AS (SELECT scenario, Batch_ID, Scenario_Score FROM rivals
  QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY Scenario_Score DESC NULLS LAST, Batch_ID) = 1),
v1 AS (SELECT * FROM best WHERE scenario <> '{UNSTORED}'),
v2 AS (SELECT v1.scenario, coalesce(r.Scenario_Score > score, false) AS better, r.Batch_ID AS rival_id, r.Scenario_Score AS rival_score, v1.batch_id, v1.score, n_alternatives
  FROM v1 LEFT JOIN rival r ON r.scenario = v1.scenario)"""


@query("golden_versions", lambda: f"""WITH {_lifecycle_ctes()}
SELECT CAST(1 AS BIGINT) AS version, scenario, batch_id, score, CAST(NULL AS VARCHAR) AS promoted_from, CAST(NULL AS VARCHAR) AS promoted_at_utc, n_alternatives FROM v1
UNION ALL
SELECT 2, scenario, CASE WHEN better THEN rival_id ELSE batch_id END, CASE WHEN better THEN rival_score ELSE score END,
  CASE WHEN better THEN 'later period' END, CASE WHEN better THEN '{AS_OF}' END, n_alternatives FROM v2 WHERE (SELECT bool_or(better) FROM v2)""")
def q_golden_versions(spark, sf):
    """Every published version of the signatures, the second by promotion of real later batches."""
    root, _best = _lifecycle(spark, sf)
    out = None
    for version in range(1, SV.read(spark, root)[0] + 1):
        rows = SV.read(spark, root, version)[1].select(
            F.lit(version).cast("long").alias("version"), "scenario", "batch_id", "score", "promoted_from", "promoted_at_utc", F.size("alternatives").alias("n_alternatives"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _stored_sql() -> str:
    parts = []
    for m in C.FOCUS:
        dev, d = f"(f.{m} - g.{m})", OBJECTIVE_DIRECTIONS.get(m)
        if d:
            good, bad = (K.STATUS_MAX_OK, K.STATUS_MAX_BAD) if d == "max" else (K.STATUS_MIN_OK, K.STATUS_MIN_BAD)
            status = f"CASE WHEN {dev} {'>=' if d == 'max' else '<='} 0 THEN '{good}' ELSE '{bad}' END"
        else:
            status = f"CASE WHEN abs{dev} <= 0.05 * (abs(g.{m}) + 1e-6) THEN '{K.STATUS_ALIGNED}' ELSE '{K.STATUS_ADJUST}' END"
        parts.append(
            f"SELECT g.scenario, f.Batch_ID, '{m}' AS Metric, {S.rint(f'CAST(f.{m} AS DOUBLE)', 3)} AS Current, {S.rint(f'g.{m}', 3)} AS Golden, {S.rint(dev, 3)} AS Deviation, "
            f"{S.rint(f'CASE WHEN abs(g.{m}) <= 1e-8 THEN 0.0 ELSE {dev} / g.{m} * 100.0 END', 2)} AS Deviation_Pct, {status} AS Status FROM late f CROSS JOIN g"
        )
    return f"""WITH {_lifecycle_ctes()},
ids AS (SELECT scenario, CASE WHEN better THEN rival_id ELSE batch_id END AS id FROM v2 UNION ALL SELECT scenario, batch_id FROM best WHERE scenario = '{UNSTORED}'),
g AS (SELECT ids.scenario, {", ".join(f"CAST(coalesce({m}, 0.0) AS DOUBLE) AS {m}" for m in C.FOCUS)} FROM ids JOIN features ON Batch_ID = id)
""" + "\nUNION ALL\n".join(parts)


@query("compare_stored_golden", _stored_sql)
def q_compare_stored_golden(spark, sf):
    """Every later batch against the stored signature of every scenario, read from the latest version (one scenario isn't
    stored and falls back to the best-ranked batch)."""
    root, best = _lifecycle(spark, sf)
    _version, stored = SV.read(spark, root)
    return C.compare_to_signatures(_periods(context.features(spark, sf))[1], SV.profiles(stored, best))


FILES = 8
CHANGED = 3
POWER = "l_extendedprice / 1000.0 AS Power_Consumption_kW"


def _incremental_sql() -> str:
    sql = f"WITH {S.structured_ctes()}\nSELECT features.* FROM features"
    changed = POWER.replace("l_extendedprice / 1000.0", f"CASE WHEN l_orderkey % {FILES} = {CHANGED} THEN l_extendedprice / 500.0 ELSE l_extendedprice / 1000.0 END")
    if POWER not in sql:
        raise ValueError("the readings' view has changed")
    return sql.replace(POWER, changed)


def split_readings(readings, path: str) -> list[str]:
    """Readings dealt by batch number into FILES folders, in one pass by all tasks; the folders."""
    numbered = readings.withColumn("f", F.substring("Batch_ID", 2, 18).cast("long") % FILES).filter(F.col("f").between(0, FILES - 1))
    numbered.write.partitionBy("f").parquet(path)
    folders = [f"{path}/f={k}" for k in range(FILES)]
    for folder in folders:
        if not versions.exists(readings.sparkSession, folder):  # no reading fell into it
            readings.limit(0).write.parquet(folder)
    return folders


@query("store_incremental", _incremental_sql)
def q_store_incremental(spark, sf):
    """Features of a store over files, refreshed after one of the eight folders of readings has changed (its power doubled): that
    folder is read again, the other per-batch aggregates stay as they are."""
    base = scratch(spark, "incremental")
    number = F.substring("Batch_ID", 2, 18).cast("long")
    readings = process_readings(spark, sf)
    production_batches(spark, sf).write.parquet(f"{base}/production")
    folders = split_readings(readings, f"{base}/process")
    production = incremental.Source([f"{base}/production"], ["*"])
    process = incremental.Source(folders, ["*"])
    incremental.refresh(spark, f"{base}/store", production, process, buckets=FILES)
    doubled = readings.filter(number % FILES == CHANGED).withColumn("Power_Consumption_kW", F.col("Power_Consumption_kW") * 2)
    doubled.write.mode("overwrite").parquet(folders[CHANGED])
    return incremental.refresh(spark, f"{base}/store", production, process).tables["features"]
