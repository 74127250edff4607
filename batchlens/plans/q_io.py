"""Adapter and source/sink queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from batchlens import constants as K
from batchlens.constants import DEFAULT_SCENARIOS
from batchlens.operators import adapters as AD
from batchlens.operators import compare as C
from batchlens.operators import golden, ranking
from batchlens.operators import schema_map as sm
from batchlens.plans import context, pipeline
from batchlens.plans import sqlgen as S
from batchlens.plans.adaptive import SIGNALS
from batchlens.plans.q_reports import _kpi_sql, kpi_rows
from batchlens.plans.registry import query
from batchlens.session import ensure_checkpoint_dir
from batchlens.sources import eventlog, export, files, signatures, store
from batchlens.sources.tables import PROCESS_EXPRS, PRODUCTION_EXPRS, process_readings, sensor_readings

AS_OF = "2024-06-30 00:00:00"
TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_FMT_SQL = "%Y-%m-%d %H:%M:%S.%f"
STD_NUM = AD.NUMERIC


def scratch(spark, name: str) -> str:
    """A fresh folder in the session's shared checkpoint location."""
    return os.path.join(ensure_checkpoint_dir(spark), "out", f"{name}-{uuid.uuid4().hex}")


def _std_out(df):
    return df.withColumn("timestamp", F.date_format("timestamp", TS_FMT_SPARK))


def _std_sql(src: str, cols: dict[str, str], tag: str, ts: str | None, ids: str, keep: str = "") -> str:
    """Standard-schema normalisation in SQL over CTE ``src`` with canonical
    expressions ``cols`` (absent -> NULL)."""
    def c(n):
        return cols.get(n, "CAST(NULL AS DOUBLE)")

    energy = S.clip(f"CAST({c('energy_kwh')} AS DOUBLE)", "0.0")
    ptime = S.clip(f"CAST({c('process_time_min')} AS DOUBLE)", "0.0")
    carbon = f"coalesce(CAST({c('carbon_kg')} AS DOUBLE), {energy} * 0.82)"
    num = {"temperature_c": f"CAST({c('temperature_c')} AS DOUBLE)", "pressure_bar": f"CAST({c('pressure_bar')} AS DOUBLE)",
           "rpm": f"CAST({c('rpm')} AS DOUBLE)", "energy_kwh": energy, "yield_percent": f"CAST({c('yield_percent')} AS DOUBLE)",
           "quality_score": f"CAST({c('quality_score')} AS DOUBLE)", "process_time_min": ptime, "carbon_kg": carbon}
    tsx = f"coalesce(CAST({ts} AS TIMESTAMP), TIMESTAMP '{AS_OF}')" if ts else f"TIMESTAMP '{AS_OF}'"
    return f"""std0 AS (SELECT {keep}{ids} AS batch_id, {tsx} AS ts, {", ".join(f"{v} AS {k}" for k, v in num.items())} FROM {src}),
std_m AS (SELECT {", ".join(f"quantile_cont({k}, 0.5) AS m_{k}" for k in STD_NUM)} FROM std0),
std AS (SELECT {keep}strftime(ts, '{TS_FMT_SQL}') AS timestamp, batch_id, {", ".join(f"coalesce({k}, m_{k}, 0.0) AS {k}" for k in STD_NUM)}, '{tag}' AS source_tag FROM std0 CROSS JOIN std_m)"""


@query("std_normalize", lambda: f"""WITH {S.views('sensor_readings')},
{_std_sql('sensor_readings', {'temperature_c': 'temperature_c'}, 'sensor_adapter', 'timestamp',
          "'GEN_' || " + S.zfill4_sql('row_number() OVER (ORDER BY row_order)'), 'row_order, ')}
SELECT * FROM std""")
def q_std_normalize(spark, sf):
    """The sensor view mapped to the standard schema (generated ids)."""
    d = AD.normalize_to_standard(sensor_readings(spark, sf), AS_OF, "row_order", source_tag="sensor_adapter")
    return _std_out(d)


FEAT_STD = {"temperature_c": "Avg_Temperature", "pressure_bar": "Avg_Pressure", "rpm": "Machine_Speed", "energy_kwh": "Total_Energy_kWh",
            "yield_percent": "Yield_Percent", "quality_score": "Quality_Score", "process_time_min": "Duration_Minutes", "carbon_kg": "Carbon_kg"}


@query("std_from_features", lambda: f"""WITH {S.structured_ctes()},
{_std_sql('features', FEAT_STD, 'historical_excel_adapter', None, 'Batch_ID')}
SELECT * FROM std""")
def q_std_from_features(spark, sf):
    """The feature table as standard rows."""
    raw = AD.features_to_standard_raw(context.features(spark, sf))
    return _std_out(AD.normalize_to_standard(raw, AS_OF, source_tag="historical_excel_adapter"))


@query("std_manual", lambda: f"""WITH {S.structured_ctes()},
{_std_sql('features', {**{k: v for k, v in FEAT_STD.items() if k != 'carbon_kg'}, 'carbon_kg': 'Total_Energy_kWh * 0.82'}, 'manual_adapter', None, 'Batch_ID')}
SELECT * FROM std""")
def q_std_manual(spark, sf):
    """Manual entries (here: every batch re-entered) as standard rows."""
    entries = AD.features_to_standard_raw(context.features(spark, sf)).drop("carbon_kg")
    return _std_out(AD.normalize_to_standard(AD.manual_rows(entries), AS_OF, source_tag="manual_adapter"))


def _scada_sql_cte() -> str:
    return f"""snap AS (SELECT Batch_ID AS batch_id,
    coalesce({S.xsum(S.clip('Power_Consumption_kW', '0.0'))}, 0.0) / 60.0 AS energy_kwh, max(Time_Minutes) AS process_time_min,
    {S.xavg('Temperature_C')} AS temperature_c, {S.xavg('Pressure_Bar')} AS pressure_bar, {S.xavg('Motor_Speed_RPM')} AS rpm
  FROM process_readings WHERE Batch_ID IS NOT NULL GROUP BY Batch_ID),
{_std_sql('snap', {'temperature_c': 'temperature_c', 'pressure_bar': 'pressure_bar', 'rpm': 'rpm', 'energy_kwh': 'energy_kwh',
                   'process_time_min': 'process_time_min', 'carbon_kg': 'energy_kwh * 0.82'}, 'scada_adapter', None, 'batch_id')}"""


@query("std_scada_snapshot", lambda: f"""WITH {S.views('process_readings')},
{_scada_sql_cte()}
SELECT * FROM std""")
def q_std_scada_snapshot(spark, sf):
    """A SCADA-style snapshot of every batch as standard rows."""
    raw = AD.scada_snapshot_raw(process_readings(spark, sf))
    return _std_out(AD.normalize_to_standard(raw, AS_OF, source_tag="scada_adapter"))


def _cand_sql() -> str:
    from batchlens.plans.q_compare import _gp_sql

    gp = _gp_sql()
    y = "CASE WHEN s.yield_percent <= 0 THEN g.Yield_Percent ELSE s.yield_percent END"
    q = "CASE WHEN s.quality_score <= 0 THEN g.Quality_Score ELSE s.quality_score END"
    perf = (f"greatest(0.0, least(100.0, g.Performance_Score * 0.5 * (s.rpm / greatest(1.0, g.Machine_Speed) + "
            f"greatest(0.4, g.Duration_Minutes / greatest(1.0, s.process_time_min)))))")
    eco = (f"greatest(0.0, least(100.0, (0.25 * ({y} / 100.0) + 0.15 * ({q} / 100.0) "
           f"+ 0.30 * (1.0 - least(2.0, s.energy_kwh / greatest(1.0, g.Total_Energy_kWh)) / 2.0) "
           f"+ 0.20 * (1.0 - least(2.0, s.carbon_kg / greatest(1.0, g.Carbon_kg)) / 2.0) "
           f"+ 0.10 * (1.0 - least(2.0, s.process_time_min / greatest(1.0, g.Duration_Minutes)) / 2.0)) * 100.0))")
    return f"""WITH {gp},
{_scada_sql_cte()}
SELECT s.batch_id AS Batch_ID, s.temperature_c AS Avg_Temperature, s.pressure_bar AS Avg_Pressure, s.rpm AS Machine_Speed,
  s.process_time_min AS Duration_Minutes, s.energy_kwh AS Total_Energy_kWh, coalesce(s.carbon_kg, s.energy_kwh * 0.82) AS Carbon_kg,
  {y} AS Yield_Percent, {q} AS Quality_Score, {S.rint(perf, 9)} AS Performance_Score, {S.rint(eco, 9)} AS Eco_Efficiency_Score,
  CASE WHEN {eco} >= 70.0 THEN 'Green' WHEN {eco} >= 40.0 THEN 'Yellow' ELSE 'Red' END AS Green_Zone,
  g.* EXCLUDE (Batch_ID, Avg_Temperature, Avg_Pressure, Machine_Speed, Duration_Minutes, Total_Energy_kWh, Carbon_kg, Yield_Percent,
    Quality_Score, Performance_Score, Eco_Efficiency_Score, Green_Zone)
FROM std s CROSS JOIN gp g"""


@query("std_to_candidate", _cand_sql)
def q_std_to_candidate(spark, sf):
    """SCADA snapshots turned into engine candidates against the golden batch's feature row."""
    std = AD.normalize_to_standard(AD.scada_snapshot_raw(process_readings(spark, sf)), AS_OF, source_tag="scada_adapter")
    return AD.to_candidate(std, context.golden_profile(spark, sf))


@query("src_union_tagged", lambda: f"""WITH {S.views('production_batches', 'process_readings')}
SELECT 'orders.parquet' AS Source_Sheet, * FROM production_batches
UNION ALL BY NAME
SELECT 'lineitem.parquet' AS Source_Sheet, * FROM process_readings""")
def q_src_union_tagged(spark, sf):
    """A2: multi-file scan, each row tagged with its source file (union by name)."""
    return files.read_tagged(spark, [os.path.join(sf, "orders.parquet"), os.path.join(sf, "lineitem.parquet")],
                             [PRODUCTION_EXPRS, PROCESS_EXPRS])


@query("src_fingerprint")
def q_src_fingerprint(spark, sf):
    """Input fingerprint (version, factor, file paths, sizes, mtimes)."""
    paths = [os.path.join(sf, f"{t}.parquet") for t in ("orders", "lineitem", "events")]
    return files.fingerprint(spark, paths, K.STORE_VERSION, K.DEFAULT_EMISSION_FACTOR)


@query("store_roundtrip", lambda: f"WITH {S.structured_ctes()}\nSELECT * FROM features")
def q_store_roundtrip(spark, sf):
    """A4/A5: features written to the versioned store, then served from it
    (manifest + count + content-hash checks)."""
    paths = [os.path.join(sf, f"{t}.parquet") for t in ("orders", "lineitem")]
    fp = files.fingerprint(spark, paths, K.STORE_VERSION, K.DEFAULT_EMISSION_FACTOR).first()["fingerprint"]
    root = scratch(spark, "store")
    build = lambda: {"features": context.features(spark, sf)}
    store.load_or_build(spark, fp, build, ["features"], root=root)  # miss: builds and writes
    tables, hit = store.load_or_build(spark, fp, build, ["features"], root=root)
    assert hit, "second read must be served by the store"
    return tables["features"]


@query("golden_roundtrip", lambda: f"""WITH {S.structured_ctes()}, {S.targets_cte('Standard')}, {S.objective_stats_cte()},
{S.candidates_cte()},
{S.ranked_all_cte()},
top AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY Scenario_Score DESC NULLS LAST, Batch_ID) AS alt_rank FROM ranked)
SELECT scenario, max(CASE WHEN alt_rank = 1 THEN Batch_ID END) AS batch_id, max(CASE WHEN alt_rank = 1 THEN Scenario_Score END) AS score,
  CAST(count(*) AS INTEGER) AS n_alternatives, string_agg(Batch_ID, ',' ORDER BY alt_rank) AS alternative_ids
FROM top WHERE alt_rank <= 3 GROUP BY scenario""")
def q_golden_roundtrip(spark, sf):
    """Nested signatures saved as JSON lines and loaded back."""
    f = context.features(spark, sf)
    top = golden.golden_signatures(f, ranking.build_targets(f, "Standard"), DEFAULT_SCENARIOS, 3)
    path = scratch(spark, "signatures")
    signatures.save(golden.nest_signatures(top, DEFAULT_SCENARIOS), path)
    back = signatures.load(spark, path)
    return back.select(
        "scenario", "batch_id", "score", F.size("alternatives").alias("n_alternatives"),
        F.array_join(F.transform("alternatives", lambda a: a["batch_id"]), ",").alias("alternative_ids"),
    )


@query("event_log", lambda: f"""WITH {S.structured_ctes()}
SELECT 'red_zone_alert' AS event, count(*) AS n_events, count(DISTINCT Batch_ID) AS n_batches
FROM features WHERE Green_Zone = 'Red' AND NOT (Eco_Efficiency_Score <= 20.0)""")
def q_event_log(spark, sf):
    """One log event per red-zone alert, written as JSON lines and summarised."""
    f = context.features(spark, sf)
    alerted = f.filter((F.col("Green_Zone") == "Red") & (F.col("Eco_Efficiency_Score") <= 20.0))
    alerts = C.red_zone_alerts(f, alerted).join(f.select("Batch_ID", "Eco_Efficiency_Score"), on="Batch_ID")
    ev = eventlog.events(alerts, AS_OF, F.lit("red_zone_alert"),
                         F.create_map(F.lit("batch"), F.col("Batch_ID"), F.lit("eco"), F.col("Eco_Efficiency_Score").cast("string")))
    path = scratch(spark, "events")
    eventlog.append(ev, path)
    return eventlog.summary(eventlog.read(spark, path))


def _safe_sql() -> str:
    base = _kpi_sql()
    cond = " OR ".join(f"starts_with(Value, '{p}')" for p in ["=", "+", "-", "@"]) + " OR starts_with(Value, chr(9))"
    return (f"WITH rep AS ({base})\nSELECT Batch_ID, Row_No, KPI, "
            f"CASE WHEN {cond} THEN '''' || Value ELSE Value END AS Value FROM rep").replace(
        "WITH rep AS (WITH ", "WITH rep AS (WITH ", 1)


@query("export_safe_csv", _safe_sql)
def q_export_safe_csv(spark, sf):
    """A10: the KPI report exported as formula-safe CSV and read back."""
    rep = kpi_rows(context.features(spark, sf), context.golden_profile(spark, sf))
    path = scratch(spark, "csv")
    export.write_csv(rep, path)
    return export.read_csv(spark, path, "Batch_ID string, Row_No bigint, KPI string, Value string")


def stored_features(spark, sf):
    """Features served from the versioned parquet store (built on first use)."""
    paths = [os.path.join(sf, f"{t}.parquet") for t in ("orders", "lineitem")]
    fp = files.fingerprint(spark, paths, K.STORE_VERSION, K.DEFAULT_EMISSION_FACTOR).first()["fingerprint"]
    root = os.path.join(ensure_checkpoint_dir(spark), "feature_store")
    tables, _ = store.load_or_build(spark, fp, lambda: {"features": context.features(spark, sf)}, ["features"], root=root)
    return tables["features"]


def _lookup_sql() -> str:
    from batchlens.plans.q_compare import _gp_sql

    return f"WITH {_gp_sql()}\nSELECT features.* FROM features WHERE Batch_ID = (SELECT Batch_ID FROM gp)"


@query("batch_lookup", _lookup_sql)
def q_batch_lookup(spark, sf):
    """one batch's feature row by id (here the golden batch); the equality
    is pushed into the parquet scan of the feature store."""
    bid = context.golden_profile(spark, sf)["Batch_ID"]
    return stored_features(spark, sf).filter(F.col("Batch_ID") == F.lit(bid))


# ------------------------------------------------------------------------ A1
#: Headers as a plant might write them; each normalises to an alias of the canonical name.
MESSY = {"timestamp": "Time ", "machine_id": "Machine ID", "operation_mode": "Operation-Mode", "temperature_c": "Temperature (C)", "power_kw": " POWER kW", "defect_rate": "Defect Rate", "throughput": "Throughput"}


def messy_copy(spark, sf: str, fmt: str) -> str:
    """The sensor view written as CSV or JSON lines under messy headers; its folder."""
    path = f"{scratch(spark, 'sensors')}.{fmt}"
    # a CSV writer's own time format stops at milliseconds: times are written as text
    df = sensor_readings(spark, sf).withColumn("timestamp", F.col("timestamp").cast("string"))
    df = df.select("row_order", *[F.col(c).alias(h) for c, h in MESSY.items()])
    df.write.format(fmt).option("header", True).save(path)
    return path


def _coerced_sql() -> str:
    have = {"temperature_c": "temperature_c", "power_kw": "power_kw", "defect_rate": "defect_rate", "output_qty": "throughput"}
    cols = ", ".join(f"CAST({have.get(s, 'NULL')} AS DOUBLE) AS {s}" for s in SIGNALS)
    return f"WITH {S.views('sensor_readings')}\nSELECT row_order, {cols} FROM sensor_readings"


def _read_back(spark, sf: str, fmt: str):
    df = files.read_table(spark, messy_copy(spark, sf, fmt))
    mapped = sm.map_columns(df, sm.resolve_engine([c for c in df.columns if c != "row_order"]), keep=[F.col("row_order").cast("long").alias("row_order")])
    return sm.coerce_numeric(mapped, SIGNALS, keep=["row_order"])


@query("src_csv", _coerced_sql)
def q_src_csv(spark, sf):
    """A1: CSV with arbitrary headers, all cells text: aliases resolved, signals coerced."""
    return _read_back(spark, sf, "csv")


@query("src_json", _coerced_sql)
def q_src_json(spark, sf):
    """A1: the same from JSON lines."""
    return _read_back(spark, sf, "json")


@query("pipeline_run", lambda: f"WITH {S.adaptive_ctes()}\nSELECT 'adaptive' AS route, ad_features.* FROM ad_features")
def q_pipeline_run(spark, sf):
    """CSV readings under messy headers through the whole pipeline: scan, map, route, features."""
    readings = files.read_table(spark, messy_copy(spark, sf, "csv")).withColumn("row_order", F.col("row_order").cast("long"))
    path, features = pipeline.run_pipeline(readings, "row_order")
    return features.select(F.lit(path).alias("route"), "*")
