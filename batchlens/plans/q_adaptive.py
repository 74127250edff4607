"""Adaptive-path, sessionisation and schema/validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchlens.constants import REQUIRED_PROCESS_COLUMNS, REQUIRED_PRODUCTION_COLUMNS
from batchlens.operators import schema_map as sm
from batchlens.operators import sessions as ss
from batchlens.plans import context
from batchlens.plans import sqlgen as S
from batchlens.plans.adaptive import SIGNALS, adaptive_agg, prepare_rows
from batchlens.plans.registry import query
from batchlens.sources.tables import process_readings, production_batches, sensor_readings

SENS = S.views("sensor_readings")
TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_FMT_SQL = "%Y-%m-%d %H:%M:%S.%f"


@query("map_engine_schema", lambda: f"""WITH {SENS}
SELECT row_order, timestamp, machine_id, operation_mode, temperature_c, power_kw, defect_rate, throughput AS output_qty
FROM sensor_readings""")
def q_map_engine_schema(spark, sf):
    """B1: engine alias resolution applied to the sensor view."""
    df = sensor_readings(spark, sf)
    resolved = sm.resolve_engine([c for c in df.columns if c != "row_order"])
    return sm.map_columns(df, resolved, keep=["row_order"])


@query("coerce_numeric", lambda: f"""WITH {SENS}
SELECT row_order, {", ".join(
    f"CAST({ {'temperature_c': 'temperature_c', 'power_kw': 'power_kw', 'defect_rate': 'defect_rate', 'output_qty': 'throughput'}[s] } AS DOUBLE) AS {s}"
    if s in ('temperature_c', 'power_kw', 'defect_rate', 'output_qty') else f"CAST(NULL AS DOUBLE) AS {s}" for s in SIGNALS)}
FROM sensor_readings""")
def q_coerce_numeric(spark, sf):
    """Every engine signal as double; absent signals are all NULL."""
    df = sensor_readings(spark, sf)
    resolved = sm.resolve_engine([c for c in df.columns if c != "row_order"])
    mapped = sm.map_columns(df, resolved, keep=["row_order"])
    return sm.coerce_numeric(mapped, SIGNALS, keep=["row_order"])


def _validate_sql() -> str:
    prod_num = [c for c in REQUIRED_PRODUCTION_COLUMNS if c != "Batch_ID"]
    proc_num = [c for c in REQUIRED_PROCESS_COLUMNS if c not in ("Batch_ID", "Phase")]
    from batchlens.sources.tables import PROCESS_EXPRS, PRODUCTION_EXPRS

    have_prod = {e.split(" AS ")[-1].strip() for e in PRODUCTION_EXPRS}
    have_proc = {e.split(" AS ")[-1].strip() for e in PROCESS_EXPRS}

    def num_ok(cols, have, tbl):
        if not all(c in have for c in cols):
            return "false"
        return "(SELECT " + " AND ".join(f"count(TRY_CAST({c} AS DOUBLE)) > 0" for c in cols) + f" FROM {tbl})"

    return f"""WITH {S.views('production_batches', 'process_readings')}
SELECT 'production_columns' AS "check", {str(all(c in have_prod for c in REQUIRED_PRODUCTION_COLUMNS)).lower()} AS passed
UNION ALL SELECT 'process_columns', {str(all(c in have_proc for c in REQUIRED_PROCESS_COLUMNS)).lower()}
UNION ALL SELECT 'production_non_empty', (SELECT count(*) > 0 FROM production_batches)
UNION ALL SELECT 'production_numeric', {num_ok(prod_num, have_prod, 'production_batches')}
UNION ALL SELECT 'process_non_empty', (SELECT count(*) > 0 FROM process_readings)
UNION ALL SELECT 'process_numeric', {num_ok(proc_num, have_proc, 'process_readings')}"""


@query("validate_structured", _validate_sql)
def q_validate_structured(spark, sf):
    """Structural validation of the production/process pair."""
    return sm.validate_structured(production_batches(spark, sf), process_readings(spark, sf))


def _gate_sql_part(tbl: str, cols: list[str], extra: str) -> str:
    nulls = " + ".join(f"count_if({c} IS NULL)" for c in cols)
    return f"""SELECT '{tbl}' AS table_name, 'null_rate' AS rule, CAST({nulls} AS BIGINT) AS violations,
  CAST({nulls} AS DOUBLE) / CAST(count(*) * {len(cols)} AS DOUBLE) <= 0.55 AS passed FROM {tbl}{extra}"""


def _gate_sql() -> str:
    from batchlens.sources.tables import PROCESS_EXPRS, PRODUCTION_EXPRS

    pcols = [e.split(" AS ")[-1].strip() for e in PRODUCTION_EXPRS]
    rcols = [e.split(" AS ")[-1].strip() for e in PROCESS_EXPRS]
    temp = """
UNION ALL SELECT 'process_readings', 'temperature_bounds', CAST(count_if(Temperature_C < -50.0 OR Temperature_C > 300.0) AS BIGINT),
  count_if(Temperature_C < -50.0 OR Temperature_C > 300.0) = 0 FROM process_readings"""
    return f"""WITH {S.views('production_batches', 'process_readings')}
{_gate_sql_part('production_batches', pcols, '')}
UNION ALL
{_gate_sql_part('process_readings', rcols, '')}{temp}"""


@query("quality_gate", _gate_sql)
def q_quality_gate(spark, sf):
    """Null-rate, energy and temperature rules per input table."""
    return sm.quality_gate({"production_batches": production_batches(spark, sf), "process_readings": process_readings(spark, sf)})


def _data_check_sql() -> str:
    from batchlens.sources.tables import PROCESS_EXPRS, PRODUCTION_EXPRS

    pcols = [e.split(" AS ")[-1].strip() for e in PRODUCTION_EXPRS]
    rcols = [e.split(" AS ")[-1].strip() for e in PROCESS_EXPRS]
    pn = " + ".join(f"count_if({c} IS NULL)" for c in pcols)
    rn = " + ".join(f"count_if({c} IS NULL)" for c in rcols)
    return f"""WITH {S.views('production_batches', 'process_readings')},
a AS (SELECT count(*) AS rows, {pn} AS missing, count(*) * {len(pcols)} AS cells, 0 AS bad FROM production_batches),
b AS (SELECT count(*) AS rows, {rn} AS missing, count(*) * {len(rcols)} AS cells,
  count_if(Temperature_C < -50.0 OR Temperature_C > 300.0) AS bad FROM process_readings)
SELECT a.rows + b.rows AS rows,
  {S.rint('100.0 * CAST(a.missing + b.missing AS DOUBLE) / CAST(greatest(1, a.cells + b.cells) AS DOUBLE)')} AS missing_pct,
  {S.rint('100.0 * CAST(a.bad + b.bad AS DOUBLE) / CAST(greatest(1, a.rows + b.rows) AS DOUBLE)')} AS out_of_range_pct
FROM a CROSS JOIN b"""


@query("data_check", _data_check_sql)
def q_data_check(spark, sf):
    """Rows, missing-cell % and out-of-range % over both inputs."""
    return sm.data_check(production_batches(spark, sf), process_readings(spark, sf))


@query("repair_ts", lambda: f"""WITH {SENS}
SELECT row_order, strftime(CAST(timestamp AS TIMESTAMP), '{TS_FMT_SQL}') AS Timestamp FROM sensor_readings""")
def q_repair_ts(spark, sf):
    """Timestamps parsed, forward/back-filled in row order."""
    d = ss.repair_timestamps(sensor_readings(spark, sf), "timestamp", "row_order")
    return d.select("row_order", F.date_format("Timestamp", TS_FMT_SPARK).alias("Timestamp"))


@query("infer_step", lambda: f"""WITH {SENS},
d AS (SELECT date_diff('microsecond', lag(timestamp) OVER (ORDER BY timestamp, row_order), timestamp) / 60000000.0 AS d FROM sensor_readings)
SELECT coalesce(least(greatest(quantile_cont(d, 0.5), 0.2), 15.0), 1.0) AS step_minutes FROM d WHERE d > 0 AND d < 120""")
def q_infer_step(spark, sf):
    """Sampling step in minutes from the global sorted timestamp gaps."""
    d = sensor_readings(spark, sf).withColumnRenamed("timestamp", "Timestamp")
    return ss.step_frame(d, "Timestamp", "row_order")


def _vb(spark, sf, sparse):
    d = sensor_readings(spark, sf).withColumn("Timestamp", F.col("timestamp"))
    return ss.virtual_batches(d, "Timestamp", "machine_id", "operation_mode", "row_order", sparse=sparse, out="Batch_ID").frame


@query("virtual_batches", lambda: f"""WITH {SENS},
{S.sessions_ctes()}
SELECT row_order, sensor_readings.machine_id, operation_mode, gap_id AS Batch_ID FROM vb JOIN sensor_readings USING (row_order)""")
def q_virtual_batches(spark, sf):
    """Gap + mode-edge virtual batch ids per machine."""
    return _vb(spark, sf, "never").select("row_order", "machine_id", "operation_mode", "Batch_ID")


@query("virtual_batches_sparse", lambda: f"""WITH {SENS},
{S.sessions_ctes()}
SELECT row_order, sensor_readings.machine_id, win_id AS Batch_ID FROM vb JOIN sensor_readings USING (row_order)""")
def q_virtual_batches_sparse(spark, sf):
    """Fixed 60-row windows per machine (sparse-stream fallback)."""
    return _vb(spark, sf, "always").select("row_order", "machine_id", "Batch_ID")


@query("batch_id_fill", lambda: f"""WITH {SENS},
{S.sessions_ctes()}
SELECT row_order, CASE WHEN operation_mode = 'Running' THEN 'LOT_' || sensor_readings.machine_id ELSE Batch_ID END AS Batch_ID
FROM vb_auto JOIN sensor_readings USING (row_order)""")
def q_batch_id_fill(spark, sf):
    """Provided ids kept (here: running rows carry a lot id), missing
    ones filled with virtual ids."""
    d = sensor_readings(spark, sf).withColumn("Timestamp", F.col("timestamp"))
    d = d.withColumn("lot", F.when(F.col("operation_mode") == "Running", F.concat(F.lit("LOT_"), F.col("machine_id"))))
    vb = ss.virtual_batches(d, "Timestamp", "machine_id", "operation_mode", "row_order").frame
    return ss.fill_batch_ids(vb, "lot").select("row_order", "Batch_ID")


def _ad_sql(select: str) -> callable:
    return lambda: f"WITH {S.adaptive_ctes()}\n{select}"


@query("elapsed_minutes", _ad_sql("SELECT row_order, Batch_ID, Time_Minutes FROM ts_filled"))
def q_elapsed_minutes(spark, sf):
    """Minutes since each (virtual) batch started."""
    return context.adaptive(spark, sf).timeseries.select("row_order", "Batch_ID", "Time_Minutes")


@query("quality_signals", _ad_sql("SELECT row_order, quality AS Quality_Score_Row FROM r1"))
def q_quality_signals(spark, sf):
    """per-row quality from the best available signal (here 100 - defect %)."""
    rows, *_ = prepare_rows(sensor_readings(spark, sf), "row_order")
    d = rows.withColumn("__q", F.lit(100.0) - F.col("sig_defect_rate") * F.lit(100.0))
    mx = d.agg(F.max("sig_defect_rate")).first()[0]
    from batchlens.functions.numeric import clip_keep_null

    q = F.lit(100.0) - F.col("sig_defect_rate") * (F.lit(100.0) if (mx is not None and mx <= 1.5) else F.lit(1.0))
    return rows.select("row_order", clip_keep_null(q, 0.0, 100.0).alias("Quality_Score_Row"))


@query("row_energy", _ad_sql("SELECT row_order, energy AS Energy_kWh_Row, throughput AS Output_Signal FROM r1"))
def q_row_energy(spark, sf):
    """per-row energy (power x step / 60) and output signal."""
    rows, *_ = prepare_rows(sensor_readings(spark, sf), "row_order")
    step = ss.step_minutes(rows, "Timestamp", "row_order")
    from batchlens.functions.numeric import clip_keep_null

    return rows.select(
        "row_order",
        (clip_keep_null(F.col("sig_power_kw"), 0.0) * F.lit(float(step)) / F.lit(60.0)).alias("Energy_kWh_Row"),
        F.col("sig_output_qty").alias("Output_Signal"),
    )


@query("fill_signals", _ad_sql("SELECT * EXCLUDE (Machine_ID) FROM ts_filled"))
def q_fill_signals(spark, sf):
    """The filled per-row process time series."""
    return context.adaptive(spark, sf).timeseries.drop("Timestamp", "Machine_ID")


@query("adaptive_agg", _ad_sql("SELECT * FROM ad_agg"))
def q_adaptive_agg(spark, sf):
    """Per-batch aggregation of the adaptive time series."""
    return adaptive_agg(context.adaptive(spark, sf).timeseries)


@query("adaptive_features", _ad_sql("SELECT * FROM ad_features"))
def q_adaptive_features(spark, sf):
    """F10/F11 + C4/C5: feature table of the adaptive path."""
    return context.adaptive(spark, sf).features
