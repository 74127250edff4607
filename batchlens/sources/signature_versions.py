"""Golden signatures as versions (A7, H8, H9): a version is a nested table of one row per scenario and never changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.constants import CONTROL_PARAMETERS, PRIMARY_OBJECTIVES
from batchlens.operators import golden
from batchlens.sources import signatures, versions

FOCUS = [*PRIMARY_OBJECTIVES, *CONTROL_PARAMETERS]


def publish(spark: SparkSession, root: str, rows: DataFrame, expected: int, note: str = "") -> int:
    """Write the rows beside earlier ones and publish them as the version after ``expected`` (raises ``versions.Lost``)."""
    path = f"{root}/data/{uuid.uuid4().hex}"
    signatures.save(rows, path)
    return versions.publish(spark, root, expected, {"path": path, "note": note})


def read(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, DataFrame]:
    """(version, signatures): the latest unless one is named; version 0 is empty."""
    version, manifest = versions.read(spark, root, version)
    if not version:
        return 0, spark.createDataFrame([], golden.SIGNATURE_SCHEMA)
    return version, signatures.load(spark, manifest["path"])


def promote(spark: SparkSession, root: str, candidates: DataFrame, tag: str, as_of: str, attempts: int = 5) -> tuple[int, DataFrame]:
    """Challenge the latest signatures with ``candidates`` (scenario, Batch_ID, Scenario_Score, profile) and publish the outcome.
    Where another writer was faster, its version is the one that is challenged next. Returns the version published and
    its rows with ``promoted``; without any promotion nothing is published."""
    for _ in range(attempts):
        version, current = read(spark, root)
        out = golden.promote_if_better(current, candidates, tag, as_of)
        if out.filter("promoted").isEmpty():
            return version, out
        rows = out.select(*[f.name for f in golden.SIGNATURE_SCHEMA.fields])
        try:
            return publish(spark, root, rows, version, tag), out
        except versions.Lost:
            continue
    raise versions.Lost(f"{attempts} attempts to promote into {root}")


def profiles(stored: DataFrame, best: DataFrame) -> DataFrame:
    """scenario and, per metric, the golden value of every scenario of ``best`` (scenario, metrics; its best-ranked batch):
    the stored profile where there is one (H9: else the best-ranked batch)."""
    own = stored.select(F.col("scenario"), *[F.col("profile")[m].try_cast("double").alias(f"own_{m}") for m in FOCUS], F.lit(True).alias("found"))
    joined = best.join(own, "scenario", "left")
    return joined.select("scenario", *[F.when(F.col("found"), F.col(f"own_{m}")).otherwise(F.col(m).cast("double")).alias(m) for m in FOCUS])
