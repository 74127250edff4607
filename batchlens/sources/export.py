"""Formula-safe CSV export (A10): string cells starting with = + - @ or TAB
get a leading apostrophe; numeric columns are untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.constants import FORMULA_PREFIXES


def safe_cell(c: Column) -> Column:
    starts = None
    for p in FORMULA_PREFIXES:
        cond = F.startswith(c, F.lit(p))
        starts = cond if starts is None else (starts | cond)
    return F.when(starts, F.concat(F.lit("'"), c)).otherwise(c)


def sanitize(df: DataFrame) -> DataFrame:
    return df.withColumns({c: safe_cell(F.col(c)) for c, t in df.dtypes if t == "string"})


# Empty strings are written quoted ("") and NULLs as \N, so both survive a round trip. A report repeats its texts for
# every batch; compressed, the files are a small part of that.
WRITE_OPTIONS = {"header": "true", "nullValue": "\\N", "escape": '"', "quote": '"', "compression": "gzip"}
READ_OPTIONS = {"header": "true", "nullValue": "\\N", "emptyValue": "", "escape": '"', "quote": '"'}


def write_csv(df: DataFrame, path: str) -> None:
    sanitize(df).write.mode("overwrite").options(**WRITE_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**READ_OPTIONS).csv(path)
