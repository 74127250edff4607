"""Versioned feature store (A4, A5): parquet tables + a manifest written last.

Layout under a shared root (default: ``<spark.checkpoint.dir>/feature_store``):
``<root>/<fingerprint>/<table>/`` parquet and ``<root>/<fingerprint>/_manifest``
(one JSON row: version, fingerprint, per-table row count and content hash).
A read is a hit only if the manifest exists, its fingerprint matches and every
table's count and sum of row hashes match what is on disk; anything
else rebuilds. Everything goes through Spark readers/writers, so the root can
be any shared file system the cluster mounts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.constants import STORE_VERSION
from batchlens.session import ensure_checkpoint_dir


def default_root(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "feature_store")


def content_hash(df: DataFrame) -> tuple[int, int]:
    """(row count, sum of the per-row 64-bit hashes modulo 2**61): the same in any
    row order, and equal rows don't cancel out."""
    total = F.sum(F.xxhash64(*[f"`{c}`" for c in df.columns]).cast("decimal(38,0)"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(total, F.lit(0)).alias("h")).first()
    return int(row["n"]), int(row["h"]) % 2**61


def _manifest_path(root: str, fp: str) -> str:
    return os.path.join(root, fp, "_manifest")


def write_tables(spark: SparkSession, root: str, fp: str, tables: Mapping[str, DataFrame], extra: Mapping[str, str] | None = None) -> dict:
    entries = []
    for name, df in tables.items():
        path = os.path.join(root, fp, name)
        df.write.mode("overwrite").parquet(path)
        n, h = content_hash(spark.read.parquet(path))  # hash what is on disk
        entries.append((name, n, h))
    manifest = spark.createDataFrame(
        [(STORE_VERSION, fp, name, n, h, dict(extra or {})) for name, n, h in entries],
        "version string, fingerprint string, table_name string, rows bigint, row_hash bigint, meta map<string,string>",
    )
    manifest.coalesce(1).write.mode("overwrite").json(_manifest_path(root, fp))
    return {name: (n, h) for name, n, h in entries}


def read_tables(spark: SparkSession, root: str, fp: str, names: list[str]) -> dict[str, DataFrame] | None:
    """Return the tables when the manifest and every integrity check agree, else None."""
    try:
        man = spark.read.schema(
            "version string, fingerprint string, table_name string, rows bigint, row_hash bigint, meta map<string,string>"
        ).json(_manifest_path(root, fp)).collect()
    except AnalysisException:  # no manifest: a miss
        return None
    expected = {r["table_name"]: (r["rows"], r["row_hash"]) for r in man if r["fingerprint"] == fp and r["version"] == STORE_VERSION}
    if set(names) - set(expected):
        return None
    out = {}
    for name in names:
        try:
            df = spark.read.parquet(os.path.join(root, fp, name))
        except AnalysisException:
            return None
        if content_hash(df) != expected[name]:
            return None
        out[name] = df
    return out


def load_or_build(spark: SparkSession, fp: str, build: Callable[[], Mapping[str, DataFrame]], names: list[str],
                  root: str | None = None, use_store: bool = True, force_rebuild: bool = False) -> tuple[dict[str, DataFrame], bool]:
    """A4/A5: (tables, cache_hit)."""
    root = root or default_root(spark)
    if use_store and not force_rebuild:
        hit = read_tables(spark, root, fp, names)
        if hit is not None:
            return hit, True
    tables = dict(build())
    if use_store:
        write_tables(spark, root, fp, tables)
        return {n: spark.read.parquet(os.path.join(root, fp, n)) for n in names}, False
    return tables, False
