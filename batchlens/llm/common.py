"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.session import ensure_checkpoint_dir

#: White space of all word rules: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shard_count(spark: SparkSession) -> int:
    """Tasks of a shuffle as the session sets them (sized to the input by whoever runs it)."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write to a fresh table in the shared checkpoint folder and read it back.

    Parquet in ``spark.checkpoint.dir`` outlives lost executors, and later readers prune columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop_materialized(df: DataFrame) -> None:
    """Delete a table written by ``materialize`` that nothing lazy reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._llm_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(col: str = "text"):
    """A text column as UTF-8 bytes, null as empty, for Arrow code."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def batch_columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def emit(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (xor-shift and odd multipliers)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def odd_multipliers(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(words: np.ndarray, k: int, multipliers: np.ndarray) -> np.ndarray:
    """Hash of each run of k word hashes; position-dependent odd multipliers, then a scramble."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[:n] * multipliers[0]
        for j in range(1, k):
            total += words[j : j + n] * multipliers[j]
    return mix64(total)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words given as bytes, the same in every process."""
    from pandas.util import hash_array

    return hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


def arrow_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field(k, v) for k, v in fields.items()])


def batches_of(schema: pa.Schema, rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Pack Python rows into record batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield emit(schema, list(zip(*held, strict=True)))
            held = []
    if held:
        yield emit(schema, list(zip(*held, strict=True)))
