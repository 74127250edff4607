"""Streaming queries (T1-T5); each returns a batch read of the stream's
output, so the oracle is the batch SQL of the same rows."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from batchlens.operators import compare as C
from batchlens.operators.sessions import utc_instant, utc_wall_clock
from batchlens.plans import context
from batchlens.plans import sqlgen as S
from batchlens.plans.q_compare import _compare_sql
from batchlens.plans.q_io import scratch
from batchlens.plans.registry import query
from batchlens.sources.tables import sensor_readings
from batchlens.streaming import streams as ST

SESSION_GAP_MIN = 90
WATERMARK = "1 hour"


def _sensor_stream(spark, sf, tag):
    base = scratch(spark, tag)
    src = os.path.join(base, "src")
    sensor = sensor_readings(spark, sf)
    fpc = ST.stage_time_chunks(sensor, "timestamp", src, 4)
    stream = spark.readStream.schema(sensor.schema).option("maxFilesPerTrigger", fpc).parquet(src)
    return stream.withColumn("ts", utc_instant("timestamp")), base


@query("stream_machine_window", lambda: f"""WITH {S.views('sensor_readings')}
SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d %H:%M:%S') AS window_start, machine_id, count(*) AS n_readings,
  {S.xsum('power_kw')} AS sum_power_kw, max(temperature_c) AS max_temperature_c
FROM sensor_readings GROUP BY ALL""")
def q_stream_machine_window(spark, sf):
    """1-day tumbling windows per machine over a replayed sensor feed
    (watermark 1 hour, update mode, latest version per window)."""
    from batchlens.functions.numeric import exact_sum

    stream, base = _sensor_stream(spark, sf, "stream-window")
    # event time = the UTC instant of the wall clock: day windows do not depend on the session time zone
    agg = stream.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 day"), "machine_id").agg(
        F.count(F.lit(1)).alias("n_readings"), exact_sum("power_kw").alias("sum_power_kw"), F.max("temperature_c").alias("max_temperature_c"),
    )
    out = agg.select(F.date_format(utc_wall_clock("window.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     "machine_id", "n_readings", "sum_power_kw", "max_temperature_c")
    ST.run_available_now(out, os.path.join(base, "out"), os.path.join(base, "ckpt"), "update")
    return ST.read_latest(spark, os.path.join(base, "out"), ["window_start", "machine_id"])


@query("stream_sessions", lambda: f"""WITH {S.views('sensor_readings')},
g AS (SELECT machine_id, timestamp,
  CASE WHEN date_diff('microsecond', lag(timestamp) OVER (PARTITION BY machine_id ORDER BY timestamp, row_order), timestamp) >= {SESSION_GAP_MIN * 60000000}
       OR lag(timestamp) OVER (PARTITION BY machine_id ORDER BY timestamp, row_order) IS NULL THEN 1 ELSE 0 END AS new_s,
  row_order FROM sensor_readings),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY machine_id ORDER BY timestamp, row_order ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT machine_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(max(timestamp) + INTERVAL {SESSION_GAP_MIN} MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n_readings
FROM s GROUP BY machine_id, sid""")
def q_stream_sessions(spark, sf):
    """Gap-based machine sessions with ``session_window`` (fixed 90-minute
    gap; the global-median gap of the batch rule is not known on a stream).
    Session windows support append or complete mode only. Append emits a
    session once the watermark passes its end, so the still-open last session
    of each machine would be missing at the end of a finite replay; this
    replay therefore runs in complete mode (state = all sessions) and reads the
    last epoch. A long-running feed would use append mode."""
    stream, base = _sensor_stream(spark, sf, "stream-sessions")
    agg = stream.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", f"{SESSION_GAP_MIN} minutes"), "machine_id").agg(
        F.count(F.lit(1)).alias("n_readings"))
    out = agg.select(
        "machine_id",
        F.date_format(utc_wall_clock("session_window.start"), "yyyy-MM-dd HH:mm:ss").alias("session_start"),
        F.date_format(utc_wall_clock("session_window.end"), "yyyy-MM-dd HH:mm:ss").alias("session_end"),
        "n_readings",
    )
    ST.run_available_now(out, os.path.join(base, "out"), os.path.join(base, "ckpt"), "complete")
    return ST.read_last_epoch(spark, os.path.join(base, "out"))


@query("stream_deviation", _compare_sql)
def q_stream_deviation(spark, sf):
    """T4: arriving batches compared with the golden profile as they stream in
    (stream-static: the profile is a fixed one-row input)."""
    base = scratch(spark, "stream-deviation")
    src = os.path.join(base, "src")
    f = context.features(spark, sf)
    f = f.select("Batch_ID", *[c for c in C.FOCUS if c in f.columns])  # what the comparison reads
    fpc = ST.stage_key_chunks(f, "Batch_ID", src, 4)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", fpc).parquet(src)
    out = C.compare_to_golden(stream, context.golden_profile(spark, sf))
    ST.run_available_now(out, os.path.join(base, "out"), os.path.join(base, "ckpt"), "append")
    return ST.read_all(spark, os.path.join(base, "out"))


@query("stream_alerts", lambda: f"""WITH {S.views('sensor_readings')}
SELECT DISTINCT machine_id FROM sensor_readings WHERE defect_rate >= 0.09""")
def q_stream_alerts(spark, sf):
    """T5: alert once per machine (high defect rate), deduplicated across
    micro-batches by streaming state."""
    stream, base = _sensor_stream(spark, sf, "stream-alerts")
    alerts = stream.filter(F.col("defect_rate") >= 0.09).withWatermark("ts", WATERMARK).dropDuplicates(["machine_id"]).select("machine_id")
    ST.run_available_now(alerts, os.path.join(base, "out"), os.path.join(base, "ckpt"), "append")
    return ST.read_all(spark, os.path.join(base, "out"))


BATCH_GAP_MIN = 90.0


def _stream_batches_sql() -> str:
    from batchlens.constants import ACTIVE_MODES

    modes = ", ".join(f"'{m}'" for m in ACTIVE_MODES)
    w = "PARTITION BY m ORDER BY timestamp, row_order"
    return f"""WITH {S.views('sensor_readings')},
a AS (SELECT row_order, timestamp, coalesce(nullif(CAST(machine_id AS VARCHAR), ''), 'M01') AS m,
  coalesce(lower(CAST(operation_mode AS VARCHAR)) IN ({modes}), false) AS act FROM sensor_readings),
g AS (SELECT *, coalesce(date_diff('microsecond', lag(timestamp) OVER ({w}), timestamp), 0) > {BATCH_GAP_MIN * 60000000.0!r}
    OR (act AND NOT coalesce(lag(act) OVER ({w}), false)) AS nb FROM a),
n AS (SELECT *, 1 + sum(CASE WHEN nb THEN 1 ELSE 0 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS num FROM g)
SELECT row_order, m AS machine_id, 'AUTO_' || {S.token_sql('m')} || '_' || {S.zfill4_sql('num')} AS Batch_ID FROM n"""


@query("stream_batches", _stream_batches_sql)
def q_stream_batches(spark, sf):
    """T3 (mode-edge rule): virtual batch ids assigned on a replayed sensor
    feed by a custom stateful operator (``applyInPandasWithState``), numbering
    continuing across micro-batches through per-machine state."""
    base = scratch(spark, "stream-batches")
    src = os.path.join(base, "src")
    sensor = sensor_readings(spark, sf)
    fpc = ST.stage_time_chunks(sensor, "timestamp", src, 4)
    stream = spark.readStream.schema(sensor.schema).option("maxFilesPerTrigger", fpc).parquet(src)
    out = ST.stateful_batches(stream, BATCH_GAP_MIN)
    ST.run_available_now(out, os.path.join(base, "out"), os.path.join(base, "ckpt"), "append")
    return ST.read_all(spark, os.path.join(base, "out"))
