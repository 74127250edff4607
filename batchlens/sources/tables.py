"""Driver tables and the three domain views built on them.

The driver tables carry no factory data; three projections give them the
domain schema (one row per batch, one row per process reading, one row per
machine sensor reading). The projections are plain ``selectExpr`` lists, so
Catalyst prunes the parquet scan to the referenced columns and pushes any
later filter into it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Projections (same text is used by the SQL oracle, see plans/oracle.py).
PRODUCTION_EXPRS = [
    "'B' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS Batch_ID",
    "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 80.0 + CAST(o_orderkey * 37 % 1000 AS DOUBLE) / 50.0 END AS Dissolution_Rate",
    "80.0 + CAST(o_orderkey * 53 % 1000 AS DOUBLE) / 25.0 AS Hardness",
    "CASE WHEN o_orderkey % 101 = 0 THEN 5.0 ELSE 0.2 + CAST(o_orderkey * 71 % 1000 AS DOUBLE) / 1250.0 END AS Friability",
    "6.0 + CAST(o_orderkey * 29 % 1000 AS DOUBLE) / 80.0 AS Disintegration_Time",
    "96.0 + CAST(o_orderkey * 41 % 1000 AS DOUBLE) / 125.0 AS Content_Uniformity",
    "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 1.4 + CAST(o_orderkey * 43 % 1000 AS DOUBLE) / 600.0 END AS Moisture_Content",
    "120.0 + CAST(o_orderkey * 61 % 1000 AS DOUBLE) / 4.0 AS Machine_Speed",
]

PROCESS_EXPRS = [
    "'B' || lpad(CAST(l_orderkey AS STRING), 9, '0') AS Batch_ID",
    "CAST(l_linenumber AS DOUBLE) * 5.0 AS Time_Minutes",
    "l_returnflag AS Phase",
    "60.0 + l_quantity * 0.8 AS Temperature_C",
    "1.0 + l_tax * 50.0 AS Pressure_Bar",
    "30.0 + l_discount * 300.0 AS Humidity_Percent",
    "800.0 + l_quantity * 20.0 AS Motor_Speed_RPM",
    "10.0 + l_tax * 200.0 AS Compression_Force_kN",
    "5.0 + l_discount * 100.0 AS Flow_Rate_LPM",
    "l_extendedprice / 1000.0 AS Power_Consumption_kW",
    "0.5 + l_discount * 20.0 + l_tax * 10.0 AS Vibration_mm_s",
]

SENSOR_EXPRS = [
    "event_id AS row_order",
    "ts AS timestamp",
    "'M' || lpad(CAST(user_id AS STRING), 4, '0') AS machine_id",
    "CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'Running' ELSE 'Idle' END AS operation_mode",
    "value AS power_kw",
    "CASE WHEN event_id % 17 = 0 THEN NULL ELSE 40.0 + CAST(event_id * 13 % 400 AS DOUBLE) / 10.0 END AS temperature_c",
    "CAST(event_id * 7 % 100 AS DOUBLE) / 1000.0 AS defect_rate",
    "200.0 + CAST(event_id * 11 % 300 AS DOUBLE) AS throughput",
]


def production_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per batch (from ``orders``)."""
    return read_table(spark, sf_dir, "orders").selectExpr(*PRODUCTION_EXPRS)


def process_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process time series, many rows per batch (from ``lineitem``)."""
    return read_table(spark, sf_dir, "lineitem").selectExpr(*PROCESS_EXPRS)


def sensor_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine sensor stream without batch ids (from ``events``)."""
    return read_table(spark, sf_dir, "events").selectExpr(*SENSOR_EXPRS)


def view_sql(name: str) -> str:
    """The same projections as SQL text (for oracles and ``spark.sql`` users)."""
    src, exprs = {
        "production_batches": ("orders", PRODUCTION_EXPRS),
        "process_readings": ("lineitem", PROCESS_EXPRS),
        "sensor_readings": ("events", SENSOR_EXPRS),
    }[name]
    return "SELECT " + ",\n  ".join(exprs) + f"\nFROM {src}"
