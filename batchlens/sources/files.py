"""File-level sources: tagged multi-file scans and input fingerprints."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.constants import SNIFF_KEYWORDS

FORMATS = ("parquet", "csv", "json")


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A1: a table from Parquet, CSV with a header line (all cells text, as
    written: they are coerced after the columns are mapped) or JSON lines. The
    format is that of the name's ending unless given."""
    if fmt is None:
        fmt = next((f for f in FORMATS if path.rstrip("/").lower().endswith((f".{f}", f".{f}.gz"))), "parquet")
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}: one of {', '.join(FORMATS)}")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", False).option("escape", '"')
    return reader.format(fmt).load(path)


def read_tagged(spark: SparkSession, paths: Sequence[str], projections: Sequence[Sequence[str]] | None = None,
                tag: str = "Source_Sheet") -> DataFrame:
    """A2: union of several files (one per former sheet), each row tagged with
    its file name; differing schemas are aligned by name (missing -> NULL).
    ``projections``: optional select-expressions per path (pruned scans)."""
    frames = []
    for i, p in enumerate(paths):
        raw = read_table(spark, p)
        exprs = list(projections[i]) if projections else ["*"]
        frames.append(raw.selectExpr(*exprs, f"_metadata.file_name AS {tag}"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def fingerprint(spark: SparkSession, paths: Sequence[str], version: str, emission_factor: float) -> DataFrame:
    """SHA-256 over (version, emission factor, and every input file's path,
    size and modification time, in any order). File listing only: the
    ``binaryFile`` source prunes the content column, no data is read."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length", "modificationTime")
    entry = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("long").cast("string")), 256)
    # the sums of four 60-bit parts of all entry hashes: any order, one row, no list of files
    parts = [F.sum(F.conv(F.substring(entry, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return files.agg(
        F.sha2(F.concat_ws("\n", F.lit(version), F.lit(repr(float(emission_factor))), F.count(F.lit(1)).cast("string"), *parts), 256).alias("fingerprint"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("length").alias("total_bytes"),
    )


def first_non_empty(readers) -> DataFrame | None:
    """The first reader (a zero-argument callable returning a DataFrame)
    whose result is readable and has at least one row (``limit(1)`` probe)."""
    for read in readers:
        try:
            df = read()
        except (AnalysisException, OSError):  # no such path, no files, no schema, not readable
            continue
        if df is not None and df.limit(1).count() > 0:
            return df
    return None


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A3: an optional side table (e.g. a summary sheet exported as its own
    file): read when present, else None. It is carried along, never queried."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # no such path
        return None


_SENSOR_WORD = re.compile("|".join(map(re.escape, SNIFF_KEYWORDS)), re.IGNORECASE)


def looks_like_process_table(columns) -> bool:
    """A single file is a process-data candidate when two or more of its
    column names hold a time or sensor word (schema only, no data read)."""
    sensor_columns = filter(_SENSOR_WORD.search, map(str, columns))
    return len(list(islice(sensor_columns, 2))) == 2
