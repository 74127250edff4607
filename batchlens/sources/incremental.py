"""A feature store that rebuilds what changed.

The inputs are files. A version's manifest keeps a tree of fingerprints: each file's (path, size, change time), each table's over its
files, and the root's over the tables and the emission factor. Equal roots are a hit, found from file listings alone: no data page
is read, neither of the inputs nor of the store. Otherwise the trees are compared downwards, and

* raw rows are stored per input file, so only changed files are read again (``raw/<table>/<write>/src_file=../src_bucket=..``);
* the batches of changed files name the buckets (by hash of Batch_ID) whose per-batch aggregates are made again from the stored raw
  rows of those buckets; all others keep their folders (``agg/<write>/src_bucket=..``);
* scores depend on ranges over all batches, so features are made from the joined per-batch tables (one row a batch).

The manifest of the new version, with the report, is published last by compare and swap (``versions``); folders that no
manifest names are left-overs of failed writes and are never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchlens.constants import DEFAULT_EMISSION_FACTOR, STORE_VERSION
from batchlens.operators.features import kpi_features, process_agg
from batchlens.operators.stats import iqr_clip, median_impute
from batchlens.plans.structured import clean_production, numeric_columns
from batchlens.session import stored
from batchlens.sources import versions

#: Buckets of a new store unless told otherwise; a changed file rewrites those of its batches.
BUCKETS = 64
RAW = ("production_raw", "process_timeseries_raw")


@dataclass
class Source:
    """Files of one input table and the projection to its domain columns."""

    paths: Sequence[str]
    exprs: Sequence[str]


@dataclass
class StoreRead:
    version: int
    hit: bool
    tables: dict[str, DataFrame]
    report: dict
    files_read: int
    buckets_written: int


def listing(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """Leaf fingerprints: file -> hash of its path, size and change time. Names only, no content."""
    out = {}
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.listFiles(place, True)
        while found.hasNext():
            f = found.next()
            name = f.getPath().getName()
            if not name.startswith(("_", ".")):
                where = str(f.getPath().toUri().getPath())
                out[where] = hashlib.sha256(f"{where}|{f.getLen()}|{f.getModificationTime()}".encode()).hexdigest()[:32]
    return out


def tree(leaves: Mapping[str, Mapping[str, str]], factor: float) -> dict:
    """Table nodes over their leaves, and the root."""
    nodes = {t: hashlib.sha256("\n".join(sorted(files.values())).encode()).hexdigest() for t, files in leaves.items()}
    root = hashlib.sha256("\n".join([STORE_VERSION, repr(float(factor)), *(f"{t}={nodes[t]}" for t in sorted(nodes))]).encode()).hexdigest()
    return {"root": root, "nodes": nodes, "leaves": {t: dict(files) for t, files in leaves.items()}}


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(F.col("Batch_ID").cast("string")), F.lit(buckets)).cast("int")


def _spread(spark: SparkSession, buckets: int):
    """Part of a bucket that one task writes: as many parts a bucket as give every task of a shuffle one."""
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, buckets))
    return F.pmod(F.hash("Batch_ID"), F.lit(parts))


def _write_raw(spark: SparkSession, root: str, table: str, source: Source, files: Mapping[str, str], buckets: int) -> tuple[str, list[int]]:
    """Store the rows of some input files, one folder a file; the folder written and the buckets with rows."""
    path = f"{root}/raw/{table}/{uuid.uuid4().hex}"
    names = spark.createDataFrame(list(files.items()), "src_path string, src_file string")
    found = spark.read.parquet(*files)
    # a file's address is decoded once, not with each of its rows
    uris = found.select(F.col("_metadata.file_path").alias("src_uri")).distinct()
    names = uris.selectExpr("src_uri", "url_decode(replace(parse_url(src_uri, 'PATH'), '+', '%2B')) AS src_path").join(names, "src_path").drop("src_path")
    rows = found.selectExpr(*source.exprs, "_metadata.file_path AS src_uri").join(F.broadcast(names), "src_uri")
    rows = rows.withColumn("src_bucket", _bucket(buckets)).drop("src_uri")
    rows.repartition("src_file", "src_bucket").write.partitionBy("src_file", "src_bucket").parquet(path)
    return path, _buckets(spark.read.schema(rows.schema).parquet(path))


def _buckets(rows: DataFrame) -> list[int]:
    """Numbers of the buckets that have rows (from the folders' names)."""
    return [r["src_bucket"] for r in rows.select("src_bucket").distinct().collect()]


def _read_raw(spark: SparkSession, folders: Mapping[str, Sequence[str]], schema: T.StructType) -> DataFrame | None:
    """Rows of the files that a manifest names: write folder -> leaves in it that are still valid."""
    out = None
    typed = T.StructType([*schema.fields, T.StructField("src_file", T.StringType()), T.StructField("src_bucket", T.IntegerType())])
    for path, leaves in folders.items():
        part = spark.read.schema(typed).parquet(path).filter(F.col("src_file").isin(*leaves))
        out = part if out is None else out.unionByName(part)
    return out


def _schema(spark: SparkSession, source: Source) -> T.StructType:
    """Of the projected input, from one footer."""
    return spark.read.option("recursiveFileLookup", True).parquet(*source.paths).selectExpr(*source.exprs).schema


def _typed(manifest: dict, table: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(manifest["schemas"][table]))


def _raw_state(new: Mapping[str, str], folders: Mapping[str, list[str]]) -> tuple[dict[str, str], dict[str, list[str]], list[str]]:
    """Files to read, folders with the leaves that stay valid, leaves that went."""
    known = {leaf for leaves in folders.values() for leaf in leaves}
    fresh = {where: leaf for where, leaf in new.items() if leaf not in known}
    valid = set(new.values())
    kept = {path: [x for x in leaves if x in valid] for path, leaves in folders.items()}
    return fresh, {p: x for p, x in kept.items() if x}, sorted(known - valid)


def refresh(spark: SparkSession, root: str, production: Source, process: Source, factor: float = DEFAULT_EMISSION_FACTOR, buckets: int = BUCKETS) -> StoreRead:
    """The store's tables (production_raw, process_timeseries_raw, process_agg, features) for the inputs as they are now, built
    anew where they changed, and the report. ``buckets`` holds for a new store. Raises ``versions.Lost`` if another writer published meanwhile."""
    sources = dict(zip(RAW, (production, process), strict=True))
    now = tree({t: listing(spark, s.paths) for t, s in sources.items()}, factor)
    version, old = versions.read(spark, root)
    if old and old["tree"]["root"] == now["root"] and all(versions.exists(spark, p) for p in _folders(old)):
        return StoreRead(version, True, _tables(spark, old), old["report"], 0, 0)
    whole = not old or not all(versions.exists(spark, p) for p in _folders(old))
    buckets = buckets if whole else old["buckets"]
    raw, files_read, touched = {}, 0, set()
    shapes = {t: _schema(spark, source) for t, source in sources.items()}
    for table, source in sources.items():
        before = {} if whole else old["raw"][table]
        fresh, kept, gone = _raw_state(now["leaves"][table], before)
        if gone and table == RAW[1]:
            lost = _read_raw(spark, {p: [x for x in leaves if x in gone] for p, leaves in before.items() if set(leaves) & set(gone)}, shapes[table])
            touched |= set(_buckets(lost))
        if fresh:
            path, own = _write_raw(spark, root, table, source, fresh, buckets)
            kept[path], files_read = sorted(fresh.values()), files_read + len(fresh)
            touched |= set(own) if table == RAW[1] else set()
        raw[table] = kept
    agg = {} if whole else {int(b): p for b, p in old["agg"].items() if int(b) not in touched}
    if touched:
        rows = _read_raw(spark, raw[RAW[1]], shapes[RAW[1]])
        path = f"{root}/agg/{uuid.uuid4().hex}"
        if rows is not None:
            made = process_agg(rows.filter(F.col("src_bucket").isin(*sorted(touched))).drop("src_file", "src_bucket")).withColumn("src_bucket", _bucket(buckets))
            made.repartition("src_bucket", _spread(spark, len(touched))).write.partitionBy("src_bucket").parquet(path)
            agg |= dict.fromkeys(_buckets(spark.read.schema(made.schema).parquet(path)), path)
    shapes["process_agg"] = process_agg(spark.createDataFrame([], shapes[RAW[1]])).schema
    manifest = {"tree": now, "buckets": buckets, "raw": raw, "agg": {str(b): p for b, p in agg.items()}, "schemas": {t: x.json() for t, x in shapes.items()}}
    tables = _tables(spark, manifest)
    merged, filled = _joined(tables)
    merged = stored(merged)
    clipped, counter = iqr_clip(merged, numeric_columns(merged))
    path = f"{root}/features/{uuid.uuid4().hex}"
    features = kpi_features(clipped, factor, with_controls=True)
    features.write.parquet(path)
    manifest["features"], manifest["schemas"]["features"] = path, features.schema.json()
    manifest["report"] = {
        "rows_production": tables[RAW[0]].count(), "rows_process": tables[RAW[1]].count(), "missing_values_filled": int(filled),
        "outlier_points_clipped": int(merged.agg(counter).first()[0]), "files": sum(len(x) for x in now["leaves"].values()),
    }
    version = versions.publish(spark, root, version, manifest)
    return StoreRead(version, False, _tables(spark, manifest), manifest["report"], files_read, len(touched))


def _folders(manifest: dict) -> set[str]:
    return {p for folders in manifest["raw"].values() for p in folders} | set(manifest["agg"].values()) | {manifest["features"]}


def _tables(spark: SparkSession, manifest: dict) -> dict[str, DataFrame]:
    """The tables that a manifest names; schemas are stored with it, so nothing is read for them."""
    out = {}
    for table in RAW:
        rows = _read_raw(spark, manifest["raw"][table], _typed(manifest, table))
        out[table] = spark.createDataFrame([], _typed(manifest, table)) if rows is None else rows.drop("src_file", "src_bucket")
    schema = _typed(manifest, "process_agg")
    typed, agg = T.StructType([*schema.fields, T.StructField("src_bucket", T.IntegerType())]), None
    for path in sorted(set(manifest["agg"].values())):
        own = [int(b) for b, p in manifest["agg"].items() if p == path]
        part = spark.read.schema(typed).parquet(path).filter(F.col("src_bucket").isin(*own))
        agg = part if agg is None else agg.unionByName(part)
    out["process_agg"] = spark.createDataFrame([], schema) if agg is None else agg.drop("src_bucket")
    if "features" in manifest:
        out["features"] = spark.read.schema(_typed(manifest, "features")).parquet(manifest["features"])
    return out


def _joined(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, int]:
    """J1 over the stored tables."""
    clean, a = clean_production(tables[RAW[0]])
    agg, b = median_impute(tables["process_agg"], numeric_columns(tables["process_agg"]))
    return clean.join(agg, on="Batch_ID", how="left"), a + b
