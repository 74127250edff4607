"""Versions of a stored thing: numbered JSON manifests, published by compare and swap, on any file system Spark reads.

A writer reads the latest version, writes new data beside the old, and publishes ``expected + 1``. The manifest is written
under a temporary name and renamed to its number, which fails if that number is taken, so of two writers that read the same
version one wins and the other sees it. Readers take one version and are not disturbed by later ones. (A store without
an atomic rename, as some object stores, needs its own lock.)
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Lost(Exception):
    """Another writer has published the version first."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _place(spark, path)
    return fs.exists(place)


def versions(spark: SparkSession, root: str) -> list[int]:
    place, fs = _place(spark, f"{root}/versions")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """(version, manifest); the latest unless one is named. (0, {}) where there is none."""
    if version is None:
        version = max(versions(spark, root), default=0)
    if not version:
        return 0, {}
    place, fs = _place(spark, f"{root}/versions/{version}.json")
    stream = fs.open(place)
    try:
        return version, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, expected: int, manifest: dict) -> int:
    """Publish ``manifest`` as the version after ``expected``; raises ``Lost`` if that one is there already."""
    version = expected + 1
    folder, fs = _place(spark, f"{root}/versions")
    fs.mkdirs(folder)
    temporary, _ = _place(spark, f"{root}/versions/_{uuid.uuid4().hex}")
    target, _ = _place(spark, f"{root}/versions/{version}.json")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(temporary), fs.makeQualified(target), plain)
    except Py4JJavaError as failed:
        fs.delete(temporary, False)
        if "FileAlreadyExists" in failed.java_exception.getClass().getName():
            raise Lost(f"version {version} of {root} is taken") from None
        raise
    return version
