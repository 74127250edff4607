"""Queries of long-running feeds: closed sessions, late rows, alerts sent once, rolling z-scores and calendar months."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from batchlens.constants import ACTIVE_MODES
from batchlens.operators import compare as C
from batchlens.operators import timeseries as TS
from batchlens.operators.sessions import epoch_micros
from batchlens.plans import context
from batchlens.plans import sqlgen as S
from batchlens.plans.q_io import scratch
from batchlens.plans.registry import query
from batchlens.sources.tables import sensor_readings
from batchlens.streaming import feeds
from batchlens.streaming import streams as ST

GAP_MIN = 90
DELAY_MIN = 60
CHUNKS = 4
#: Every so many rows, one arrives two chunks after its time.
LATE_EVERY = 37


def _chunk(lo: int, hi: int):
    us = epoch_micros("timestamp")
    return F.least(F.lit(CHUNKS - 1), F.floor((us - F.lit(lo)) * CHUNKS / F.lit(max(1, hi - lo))).cast("int"))


def _chunk_sql() -> str:
    return f"least({CHUNKS - 1}, CAST(floor((epoch_us(timestamp) - lo) * {CHUNKS} / greatest(1, hi - lo)) AS INTEGER))"


def _bounds(df):
    row = df.agg(F.min(epoch_micros("timestamp")).alias("lo"), F.max(epoch_micros("timestamp")).alias("hi")).first()
    return row["lo"] or 0, row["hi"] or 0


def _sensor_feed(spark, sf, base, chunk):
    sensor = sensor_readings(spark, sf)
    src = os.path.join(base, "src")
    files = feeds.stage_in_order(sensor, chunk(sensor), CHUNKS, src)
    return spark.readStream.schema(sensor.schema).option("maxFilesPerTrigger", files).parquet(src)


def _sessions_sql() -> str:
    modes = ", ".join(f"'{m}'" for m in ACTIVE_MODES)
    w = "PARTITION BY m ORDER BY us, row_order"
    return f"""WITH {S.views('sensor_readings')},
b AS (SELECT (max(epoch_ms(timestamp)) - {DELAY_MIN * 60000}) * 1000 AS wm FROM sensor_readings),
a AS (SELECT row_order, epoch_us(timestamp) AS us, coalesce(nullif(CAST(machine_id AS VARCHAR), ''), 'M01') AS m,
  coalesce(lower(CAST(operation_mode AS VARCHAR)) IN ({modes}), false) AS act, wm FROM sensor_readings CROSS JOIN b WHERE epoch_us(timestamp) < wm),
g AS (SELECT *, CASE WHEN lag(us) OVER ({w}) IS NULL OR us - lag(us) OVER ({w}) > {GAP_MIN * 60000000} OR (act AND NOT lag(act) OVER ({w})) THEN 1 ELSE 0 END AS nb FROM a),
s AS (SELECT *, sum(nb) OVER ({w} ROWS UNBOUNDED PRECEDING) AS sid, max(us) OVER (PARTITION BY m) AS last_us FROM g),
t AS (SELECT m, sid, min(us) AS start_us, max(us) AS end_us, count(*) AS n_readings, count(*) FILTER (act) AS n_active, first(row_order ORDER BY us, row_order) AS first_row, any_value(last_us) AS last_us, any_value(wm) AS wm
  FROM s GROUP BY m, sid)
SELECT 'AUTO_' || {S.token_sql('m')} || '_' || strftime(make_timestamp(start_us), '%Y%m%d%H%M%S%f') || '_' || CAST(first_row AS VARCHAR) AS Batch_ID, m AS machine_id,
  CAST(start_us AS BIGINT) AS start_us, CAST(end_us AS BIGINT) AS end_us, n_readings, n_active
FROM t WHERE end_us < last_us OR end_us + {GAP_MIN * 60000000} < wm"""


@query("stream_closed_batches", _sessions_sql)
def q_stream_closed_batches(spark, sf):
    """Gap and mode-edge batches of a replayed feed with event-time timers, append mode: what the watermark has closed
    (the newest time less an hour when the replay ends)."""
    base = scratch(spark, "stream-closed")
    lo, hi = _bounds(sensor_readings(spark, sf))
    stream = _sensor_feed(spark, sf, base, lambda _d: _chunk(lo, hi))
    out = feeds.closed_sessions(stream, GAP_MIN, f"{DELAY_MIN} minutes").select("Batch_ID", "machine_id", "start_us", "end_us", "n_readings", "n_active")
    ST.run_available_now(out, os.path.join(base, "out"), os.path.join(base, "ckpt"), "append")
    return ST.read_all(spark, os.path.join(base, "out"))


@query("stream_late_rows", lambda: f"""WITH {S.views('sensor_readings')},
b AS (SELECT min(epoch_us(timestamp)) AS lo, max(epoch_us(timestamp)) AS hi FROM sensor_readings),
c AS (SELECT epoch_us(timestamp) AS us, least({CHUNKS - 1}, {_chunk_sql()} + CASE WHEN row_order % {LATE_EVERY} = 0 THEN 2 ELSE 0 END) AS chunk
  FROM sensor_readings CROSS JOIN b),
m AS (SELECT chunk, max(us) AS top FROM c GROUP BY chunk),
w AS (SELECT a.chunk, (max(p.top) // 1000 - {DELAY_MIN * 60000}) * 1000 AS wm FROM m a LEFT JOIN m p ON p.chunk < a.chunk - 1 GROUP BY a.chunk)
SELECT CAST(row_number() OVER (ORDER BY chunk) - 1 AS BIGINT) AS micro_batch, count(*) AS n_read, count(*) FILTER (wm IS NULL OR us > wm) AS n_accepted,
  count(*) FILTER (us <= wm) AS n_dropped FROM c JOIN w USING (chunk) GROUP BY chunk""")
def q_stream_late_rows(spark, sf):
    """Late rows: a feed in which every 37th row comes two chunks late; rows accepted and rows dropped by the
    watermark of each micro-batch."""
    base = scratch(spark, "stream-late")
    lo, hi = _bounds(sensor_readings(spark, sf))
    late = F.when(F.col("row_order") % LATE_EVERY == 0, 2).otherwise(0)
    stream = _sensor_feed(spark, sf, base, lambda _d: F.least(F.lit(CHUNKS - 1), _chunk(lo, hi) + late))
    out = os.path.join(base, "out")
    seen = feeds.run_counted(feeds.accepted_rows(stream, "timestamp", f"{DELAY_MIN} minutes", ["row_order"]), out, os.path.join(base, "ckpt"))
    counts = [(k, read, dropped) for k, (read, dropped, _left) in sorted(seen.items()) if read]
    read = spark.createDataFrame(counts, "micro_batch long, n_read long, n_dropped long")
    kept = spark.read.option("basePath", out).parquet(os.path.join(out, "epoch=*")).groupBy(F.col("_epoch").cast("long").alias("micro_batch")).agg(F.count("*").alias("n"))
    return read.join(kept, "micro_batch", "left").select("micro_batch", "n_read", F.coalesce("n", F.lit(0)).alias("n_accepted"), "n_dropped")


ALERT_COLUMNS = ["Batch_ID", "Total_Energy_kWh", "Quality_Score", "Eco_Efficiency_Score", "Green_Zone"]


@query("stream_red_alerts", lambda: f"""WITH {S.structured_ctes()}
SELECT Batch_ID, 'Alert: Red Zone batch ' || Batch_ID AS Subject,
  'Batch ' || Batch_ID || ' is in Red Zone.' || chr(10) || 'Energy=' || printf('%.2f', {S.rint('Total_Energy_kWh')}) ||
  ' kWh, Quality=' || printf('%.2f', {S.rint('Quality_Score')}) || ', Eco=' || printf('%.2f', {S.rint('Eco_Efficiency_Score')}) AS Body
FROM features WHERE Green_Zone = 'Red'""")
def q_stream_red_alerts(spark, sf):
    """T5: one alert per Red batch. The feed of finished batches (one a minute, by number) is read in four chunks; then the
    source sends its first chunk again (at least once delivery), and at last a new run without the old state reads everything."""
    base = scratch(spark, "stream-red")
    src, alerts = os.path.join(base, "src"), os.path.join(base, "alerts")
    at = F.timestamp_seconds(F.lit(1704067200) + F.substring("Batch_ID", 2, 18).cast("long") * 60)
    f = context.features(spark, sf).select(at.alias("at"), *ALERT_COLUMNS)  # the feed is staged with what an alert says, not the whole table
    bounds = f.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    if bounds["lo"] is None:
        return C.red_zone_alerts(f, f.select("Batch_ID"))
    lo, hi = (F.lit(x).cast("long") for x in bounds)
    part = F.least(F.lit(CHUNKS - 1), F.floor((F.col("at").cast("long") - lo) * CHUNKS / F.greatest(F.lit(1), hi - lo)).cast("int"))
    files = feeds.stage_in_order(f, part, CHUNKS, src, 2)

    def run(checkpoint):
        stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", files).parquet(src)
        red = stream.filter(F.col("Green_Zone") == "Red").select("at", *ALERT_COLUMNS)
        feeds.alert_once(red, "Batch_ID", "at", f"{DELAY_MIN} minutes", alerts, os.path.join(base, checkpoint))
        return red.schema

    run("ckpt")
    feeds.stage_in_order(f, part, 1, src, 2)
    run("ckpt")
    schema = run("ckpt-new")
    sent = feeds.read_alerts(spark, alerts, schema)
    return C.red_zone_alerts(sent, sent.select("Batch_ID").limit(0))


FRAME_MIN = 7 * 24 * 60
Z = 2.2


def _z_sql() -> str:
    w = f"PARTITION BY m ORDER BY us RANGE BETWEEN {FRAME_MIN * 60_000_000} PRECEDING AND CURRENT ROW"
    rolled = f"CASE WHEN rs > {TS.NO_SPREAD!r} THEN abs(power_kw - rm) / rs END"
    whole = f"CASE WHEN sd > {TS.NO_SPREAD!r} THEN abs(power_kw - mu) / sd END"
    return f"""WITH {S.views('sensor_readings')},
a AS (SELECT row_order, machine_id, power_kw, coalesce(nullif(CAST(machine_id AS VARCHAR), ''), 'M01') AS m, epoch_us(timestamp) AS us FROM sensor_readings),
s AS (SELECT *, avg(power_kw) OVER (PARTITION BY m) AS mu, stddev_pop(power_kw) OVER (PARTITION BY m) AS sd,
  count(power_kw) OVER ({w}) AS n_rolling, avg(power_kw) OVER ({w}) AS rm, stddev_pop(power_kw) OVER ({w}) AS rs FROM a)
SELECT row_order, machine_id, {S.rint(whole, 6)} AS z_machine, coalesce({whole} >= {Z}, false) AS flag_machine, n_rolling,
  {S.rint(rolled, 6)} AS z_rolling, coalesce({rolled} >= {Z}, false) AS flag_rolling FROM s"""


@query("zscore_rolling", _z_sql)
def q_zscore_rolling(spark, sf):
    """W9 per machine and rolling: power of every reading against all readings of its machine and those of the last 7 days."""
    out = TS.rolling_zscores(sensor_readings(spark, sf), "power_kw", FRAME_MIN, Z)
    return out.select("row_order", "machine_id", "z_machine", "flag_machine", "n_rolling", "z_rolling", "flag_rolling")


STRETCH = 12


@query("monthly_machine_energy", lambda: f"""WITH {S.views('sensor_readings')},
a AS (SELECT coalesce(nullif(CAST(machine_id AS VARCHAR), ''), 'M01') AS m, power_kw,
  CAST(date_trunc('month', make_timestamp(1704067200000000 + (epoch_us(timestamp) - 1704067200000000) * {STRETCH})) AS DATE) AS mon
  FROM sensor_readings WHERE operation_mode = 'Idle'),
e AS (SELECT m, mon, count(*) AS n, {S.xsum('power_kw')} AS e FROM a GROUP BY m, mon),
r AS (SELECT CAST(unnest(generate_series(CAST(min(mon) AS TIMESTAMP), CAST(max(mon) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS mon FROM e),
f AS (SELECT k.m, r.mon, coalesce(n, 0) AS n, coalesce(e, 0.0) AS e FROM (SELECT DISTINCT m FROM e) k CROSS JOIN r LEFT JOIN e ON e.m = k.m AND e.mon = r.mon)
SELECT m AS machine_id, strftime(mon, '%Y-%m-%d') AS Month, n AS n_readings, e AS Energy_kWh,
  {S.rint('avg(e) OVER (PARTITION BY m ORDER BY mon ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 6)} AS Rolling_kWh FROM f""")
def q_monthly_machine_energy(spark, sf):
    """D6 on event time: energy of idle readings per machine and calendar month, months without any as 0. The feed covers one month,
    so its times are stretched twelvefold from its start."""
    us = F.lit(1704067200000000) + (epoch_micros("timestamp") - F.lit(1704067200000000)) * STRETCH
    year = sensor_readings(spark, sf).filter(F.col("operation_mode") == "Idle").withColumn(
        "timestamp", F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    return TS.monthly_series(year, "power_kw")
