"""Signature store (A7): nested signature rows as JSON lines; an unreadable
or corrupt store reads as empty (PERMISSIVE, corrupt rows dropped)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from batchlens.operators.golden import SIGNATURE_SCHEMA


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType([*SIGNATURE_SCHEMA.fields, StructField("_corrupt_record", StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    try:
        raw = reader.json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SIGNATURE_SCHEMA)
    return raw.filter(F.col("_corrupt_record").isNull() & F.col("scenario").isNotNull()).drop("_corrupt_record")
