"""Event log sink/source (A9): one JSON object per line with ts_utc, event
(<= 128 chars) and details (map of strings; keys <= 64, values <= 256)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "ts_utc string, event string, details map<string,string>"


def events(df: DataFrame, ts_utc: str, event: Column, details: Column) -> DataFrame:
    """Shape rows as log events; every detail value is stringified and cut."""
    d = F.transform_values(F.transform_keys(details, lambda k, v: F.substring(k, 1, 64)), lambda k, v: F.substring(v.cast("string"), 1, 256))
    return df.select(F.lit(ts_utc).alias("ts_utc"), F.substring(event.cast("string"), 1, 128).alias("event"), d.alias("details"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(path)


def summary(log: DataFrame) -> DataFrame:
    return log.groupBy("event").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct(F.col("details")["batch"]).alias("n_batches"))
