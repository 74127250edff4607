"""The adaptive path: narrow phase counts, largest elapsed time without a join over all rows."""

import datetime as dt
import re

from pyspark.sql import functions as F

from batchlens.operators import sessions
from batchlens.plans import adaptive

COLUMNS = ["Time_Minutes", "Temperature_C", "Pressure_Bar", "Humidity_Percent", "Compression_Force_kN", "Power_Consumption_kW", "Motor_Speed_RPM",
           "Vibration_mm_s", "Flow_Rate_LPM", "Output_Signal", "Quality_Score_Row", "Energy_kWh_Row"]


def _series(spark):
    rows = [("b1", "A", 1.0), ("b1", "A", 2.0), ("b1", "B", None), ("b2", None, 4.0), (None, "A", 6.0), (None, "B", 8.0), (None, None, 8.0)]
    df = spark.createDataFrame(rows, "Batch_ID string, Phase string, v double")
    return df.select("Batch_ID", "Phase", *[df.v.alias(c) for c in COLUMNS])


def test_wide_aggregate_is_keyed_by_batch_alone(spark):
    plan = adaptive.adaptive_agg(_series(spark))._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if re.search(r"keys=\[[^\]]*Phase", line)]
    assert keyed and not any("sum(" in line or "max(" in line for line in keyed)


def test_a_null_batch_is_a_group(spark):
    got = {r["Batch_ID"]: r for r in adaptive.adaptive_agg(_series(spark)).collect()}
    assert {k: (r["Phase_Count"], r["Data_Points"], r["Total_Energy_kWh"]) for k, r in got.items()} == {"b1": (2, 2, 3.0), "b2": (0, 1, 4.0), None: (2, 3, 22.0)}


def test_largest_elapsed_time_is_found_without_a_join(spark, monkeypatch):
    plans = []
    keep = sessions.stats_row
    monkeypatch.setattr(sessions, "stats_row", lambda df, aggs: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, aggs))
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("b1", at(0), 1), ("b1", at(7), 2), ("b2", at(3), 3), ("b2", None, 4), (None, at(90), 5), (None, at(99), 6)]
    df = spark.createDataFrame(rows, "Batch_ID string, Timestamp timestamp_ntz, row_order long")
    got = {r["row_order"]: r["Time_Minutes"] for r in sessions.elapsed_minutes(df).collect()}
    assert got == {1: 0.0, 2: 7.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}
    assert len(plans) == 1 and "Join" not in plans[0]
    # times of a NULL batch alone don't count: positions are taken instead
    odd = {r["row_order"]: r["Time_Minutes"] for r in sessions.elapsed_minutes(df.filter(F.col("row_order").isin(1, 5, 6))).collect()}
    assert odd == {1: 0.0, 5: 0.0, 6: 1.0}
