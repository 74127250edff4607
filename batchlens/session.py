"""Session helpers: the settings every operator assumes, and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
#: The JVM compiles no method above this many bytes of bytecode, so the fused code of a wide projection would run
#: interpreted for every row. Beyond it Spark runs the operators one by one, in short methods that are compiled.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "batchlens") -> SparkSession:
    """Local/test session. On a cluster, build the session outside and pass it in."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("BATCHLENS_DRIVER_MEMORY", "16g"))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_method_limit(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_method_limit(spark: SparkSession) -> None:
    """Keep fused code within what the JVM compiles, unless the session has a limit of its own."""
    key, limit = METHOD_LIMIT
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, limit)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Only a local master, whose
    tasks all run on this machine, may go without: it gets a scratch folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="batchlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared checkpoint folder: readers
    prune its columns and push filters into its scan."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable ``checkpoint()`` into the shared checkpoint
    folder, for frames whose partition layout is needed afterwards (see
    ``operators/ordering.py``; files may be split and merged by their reader).
    The frame is persisted for the duration of the checkpoint so the plan is
    computed once (checkpointing an unpersisted RDD recomputes it)."""
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()
