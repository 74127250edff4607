"""Every branch of the adaptive rules on projections of the sensor table that leave only its signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchlens.operators import sessions as ss
from batchlens.plans import sqlgen as S
from batchlens.plans.adaptive import SIGNALS, row_signals
from batchlens.plans.registry import query
from batchlens.sources.tables import sensor_readings

STEP = 2.5
TS_SPARK, TS_SQL = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"

#: Branch -> signals made of the sensor table (expressions that both engines read). Scaled and unscaled forms of each.
QUALITY = {
    "quality share": {"quality_score": "1.0 - defect_rate"},
    "quality percent": {"quality_score": "throughput / 5.0"},
    "defect share": {"defect_rate": "defect_rate", "error_rate": "power_kw"},
    "defect percent": {"defect_rate": "defect_rate * 300.0"},
    "error share": {"error_rate": "defect_rate / 2.0"},
    "error percent": {"error_rate": "defect_rate * 700.0"},
    "proxy": {"temperature_c": "temperature_c", "vibration_mm_s": "power_kw / 50.0", "output_qty": "throughput"},
}
ENERGY = {
    "energy": {"energy_kwh": "power_kw - 20.0", "power_kw": "power_kw", "output_qty": "throughput"},
    "power": {"power_kw": "power_kw - 20.0", "motor_speed_rpm": "temperature_c * 9.0 - 400.0"},
    "output": {"output_qty": "CASE WHEN row_order % 4 > 0 THEN throughput - 260.0 END"},
    "nothing": {"temperature_c": "temperature_c"},
}


def _rows(spark, sf, signals):
    cols = [F.expr(f"cast({signals[s]} AS double)" if s in signals else "cast(NULL AS double)").alias(f"sig_{s}") for s in SIGNALS]
    return sensor_readings(spark, sf).select("row_order", *cols)


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _quality_sql() -> str:
    parts = []
    for name, signals in QUALITY.items():
        if name == "proxy":
            t, v, o = signals["temperature_c"], signals["vibration_mm_s"], signals["output_qty"]
            norm = lambda x, k: f"least(1.0, greatest(0.0, ({x} - lo_{k}) / (hi_{k} - lo_{k})))"
            parts.append(f"""SELECT '{name}', row_order, CASE WHEN d IS NULL OR v IS NULL OR o IS NULL THEN NULL ELSE
  greatest(20.0, least(95.0, (0.45 * (1.0 - {norm('d', 'd')}) + 0.35 * (1.0 - {norm('v', 'v')}) + 0.20 * {norm('o', 'o')}) * 100.0)) END
FROM (SELECT *, min(d) OVER () AS lo_d, max(d) OVER () AS hi_d, min(v) OVER () AS lo_v, max(v) OVER () AS hi_v, min(o) OVER () AS lo_o, max(o) OVER () AS hi_o
  FROM (SELECT row_order, abs({t} - (SELECT quantile_cont({t}, 0.5) FROM sensor_readings)) AS d, {v} AS v, {o} AS o FROM sensor_readings))""")
            continue
        kind = next(iter(signals))
        x = f"CAST({signals[kind]} AS DOUBLE)"
        scaled = f"({x} * CASE WHEN (SELECT max({x}) FROM sensor_readings) <= 1.5 THEN 100.0 ELSE 1.0 END)"
        parts.append(f"SELECT '{name}', row_order, {S.clip(scaled if kind == 'quality_score' else f'100.0 - {scaled}', '0.0', '100.0')} FROM sensor_readings")
    return f"WITH {S.views('sensor_readings')},\nu(branch, row_order, q) AS (" + "\nUNION ALL\n".join(parts) + f")\nSELECT branch, row_order, {S.rint('q', 9)} AS Quality_Score_Row FROM u"


@query("quality_branches", _quality_sql)
def q_quality_branches(spark, sf):
    """row quality from each signal it may come from, as shares and as percents, and from the proxy."""
    from batchlens.functions.numeric import rint_dp

    return _union([row_signals(_rows(spark, sf, signals), STEP)[0].select(F.lit(name).alias("branch"), "row_order", rint_dp("__quality", 9).alias("Quality_Score_Row"))
                   for name, signals in QUALITY.items()])


def _energy_sql() -> str:
    parts = []
    for name, signals in ENERGY.items():
        x = {k: f"CAST({e} AS DOUBLE)" for k, e in signals.items()}
        if "energy_kwh" in x:
            energy = S.clip(x["energy_kwh"], "0.0")
        elif "power_kw" in x:
            energy = f"{S.clip(x['power_kw'], '0.0')} * {STEP!r} / 60.0"
        else:
            out = f"coalesce({x['output_qty']}, (SELECT quantile_cont({x['output_qty']}, 0.5) FROM sensor_readings))" if "output_qty" in x else "50.0"
            energy = f"greatest(abs({out}) * 0.01, 0.1)"
        output = x.get("output_qty") or (S.clip(f"({x['motor_speed_rpm']} * 0.75)", "0.0") if "motor_speed_rpm" in x else "50.0")
        parts.append(f"SELECT '{name}', row_order, {energy}, {output} FROM sensor_readings")
    return f"WITH {S.views('sensor_readings')},\nu(branch, row_order, e, o) AS (" + "\nUNION ALL\n".join(parts) + (
        f")\nSELECT branch, row_order, {S.rint('e', 9)} AS Energy_kWh_Row, {S.rint('o', 9)} AS Output_Signal FROM u")


@query("energy_branches", _energy_sql)
def q_energy_branches(spark, sf):
    """row energy from a meter, from power, from output or from nothing; output from its own signal, motor speed or 50."""
    from batchlens.functions.numeric import rint_dp

    return _union([row_signals(_rows(spark, sf, signals), STEP)[0].select(
        F.lit(name).alias("branch"), "row_order", rint_dp("__energy", 9).alias("Energy_kWh_Row"), rint_dp("__output", 9).alias("Output_Signal"))
        for name, signals in ENERGY.items()])


NOON = "2024-05-01 12:00:00"


@query("elapsed_branches", lambda: f"""WITH {S.views('sensor_readings')},
p AS (SELECT row_order, CASE WHEN row_order % 3 = 1 THEN power_kw END AS pt FROM sensor_readings)
SELECT 'times' AS branch, row_order, {S.rint("date_diff('microsecond', min(timestamp) OVER (PARTITION BY machine_id), timestamp) / 60000000.0", 6)} AS Time_Minutes FROM sensor_readings
UNION ALL SELECT 'positions', row_order, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY row_order) - 1 AS DOUBLE) FROM sensor_readings
UNION ALL SELECT 'process time', row_order, {S.rint('coalesce(last_value(pt IGNORE NULLS) OVER (ORDER BY row_order), 0.0)', 6)} FROM p""")
def q_elapsed_branches(spark, sf):
    """Minutes from the times; positions where all times are equal; the process time where batches have one row each, too."""
    from batchlens.functions.numeric import rint_dp

    d = sensor_readings(spark, sf).withColumn("pt", F.when(F.col("row_order") % 3 == 1, F.col("power_kw")))
    still = d.withColumn("timestamp", F.lit(NOON).cast("timestamp_ntz"))
    run = lambda x, batch: ss.elapsed_minutes(x, batch, "timestamp", "row_order", "pt")
    parts = [("times", run(d, "machine_id")), ("positions", run(still, "machine_id")), ("process time", run(still.withColumn("own", F.col("row_order").cast("string")), "own"))]
    return _union([x.select(F.lit(n).alias("branch"), "row_order", rint_dp("Time_Minutes", 6).alias("Time_Minutes")) for n, x in parts])


KNOWN = "row_order % 7 > 2 AND row_order >= 40"


@query("repair_branches", lambda: f"""WITH {S.views('sensor_readings')},
k AS (SELECT row_order, CASE WHEN {KNOWN} THEN timestamp END AS t FROM sensor_readings),
f AS (SELECT row_order, last_value(t IGNORE NULLS) OVER (ORDER BY row_order) AS f,
  first_value(t IGNORE NULLS) OVER (ORDER BY row_order ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM k),
s AS (SELECT row_order, TIMESTAMP '{ss.SYNTHETIC_START}' + to_minutes(CAST(row_number() OVER (ORDER BY row_order) - 1 AS BIGINT)) AS t FROM sensor_readings)
SELECT 'gaps' AS branch, row_order, strftime(coalesce(f, b), '{TS_SQL}') AS Timestamp FROM f
UNION ALL SELECT 'unreadable', row_order, strftime(t, '{TS_SQL}') FROM s
UNION ALL SELECT 'absent', row_order, strftime(t, '{TS_SQL}') FROM s""")
def q_repair_branches(spark, sf):
    """Times with gaps (also at the start) filled forward, then back; unreadable and absent times made up from the row order."""
    d = sensor_readings(spark, sf).withColumn("text", F.when(F.expr(KNOWN), F.date_format("timestamp", TS_SPARK)))
    parts = [("gaps", ss.repair_timestamps(d, "text", "row_order")), ("unreadable", ss.repair_timestamps(d.withColumn("text", F.lit("n/a")), "text", "row_order")),
             ("absent", ss.repair_timestamps(d.drop("text"), None, "row_order"))]
    return _union([x.select(F.lit(n).alias("branch"), "row_order", F.date_format("Timestamp", TS_SPARK).alias("Timestamp")) for n, x in parts])
