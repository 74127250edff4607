"""Structured Streaming versions of the polled/snapshotted parts.

Sources are file streams (``readStream`` parquet with ``maxFilesPerTrigger``)
run with ``trigger(availableNow=True)`` and a checkpoint location, so a rerun
resumes where it stopped and a lost executor only replays its micro-batch.
Sinks use ``foreachBatch``: each micro-batch's output is appended with its
epoch id (idempotent per epoch: a replayed epoch overwrites its own folder),
and readers keep the latest version per key.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stage_time_chunks(df: DataFrame, ts_col: str, path: str, chunks: int = 4, files_per_chunk: int | None = None) -> int:
    """Replay staging: write ``df`` in ``chunks`` ascending, disjoint time
    ranges, one write job after the other, each as exactly ``files_per_chunk``
    files (round-robin, written in parallel), so modification times follow
    event time. Returns the file count per chunk: use it as
    ``maxFilesPerTrigger`` and every micro-batch is one whole chunk."""
    fpc = files_per_chunk or df.sparkSession.sparkContext.defaultParallelism
    bounds = df.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    step = (hi - lo) / chunks
    for i in range(chunks):
        cond = F.col(ts_col) >= F.lit(lo + step * i)
        if i < chunks - 1:
            cond = cond & (F.col(ts_col) < F.lit(lo + step * (i + 1)))
        part = df.filter(cond)
        if part.limit(1).count():
            part.repartition(fpc).write.mode("append").parquet(path)
    return fpc


def stage_key_chunks(df: DataFrame, key: str, path: str, chunks: int = 4, files_per_chunk: int | None = None) -> int:
    """Split a keyed table into ``chunks`` key ranges (range partitioning,
    checkpointed so the split is fixed), written in order, one job each, as
    ``files_per_chunk`` files; returns that count (for ``maxFilesPerTrigger``).
    A chunk is several neighbouring ranges, so no task reads a whole chunk."""
    from batchlens.operators.stats import materialize

    fpc = files_per_chunk or df.sparkSession.sparkContext.defaultParallelism
    per_chunk = max(fpc, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // chunks))
    chunk = F.floor(F.spark_partition_id() / F.lit(per_chunk)).cast("int")
    ranged = materialize(df.repartitionByRange(chunks * per_chunk, key).withColumn("_chunk", chunk))
    for i in range(chunks):
        part = ranged.filter(F.col("_chunk") == i).drop("_chunk")
        if part.limit(1).count():
            part.repartition(fpc).write.mode("append").parquet(path)
    return fpc


def foreach_batch_sink(out_path: str) -> Callable[[DataFrame, int], None]:
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(os.path.join(out_path, f"epoch={epoch}"))

    return sink


def run_available_now(stream_df: DataFrame, out_path: str, checkpoint: str, mode: str = "update") -> None:
    q: StreamingQuery = (
        stream_df.writeStream.outputMode(mode)
        .foreachBatch(foreach_batch_sink(out_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def read_latest(spark: SparkSession, out_path: str, keys: Sequence[str], schema_from: DataFrame | None = None) -> DataFrame:
    """Latest emitted version per key (a window partitioned by the key)."""
    df = spark.read.option("basePath", out_path).parquet(os.path.join(out_path, "epoch=*"))
    w = Window.partitionBy(*keys).orderBy(F.col("_epoch").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_epoch", "epoch")


def read_last_epoch(spark: SparkSession, out_path: str) -> DataFrame:
    """For complete-mode sinks: the last epoch holds the whole result."""
    df = spark.read.option("basePath", out_path).parquet(os.path.join(out_path, "epoch=*"))
    last = df.agg(F.max("_epoch")).first()[0]
    return df.filter(F.col("_epoch") == last).drop("_epoch", "epoch")


def read_all(spark: SparkSession, out_path: str) -> DataFrame:
    df = spark.read.option("basePath", out_path).parquet(os.path.join(out_path, "epoch=*"))
    return df.drop("_epoch", "epoch")


def stateful_batches(stream_df: DataFrame, gap_minutes: float, key: str = "machine_id", ts_col: str = "timestamp",
                     order_col: str = "row_order", mode_col: str = "operation_mode", out: str = "Batch_ID") -> DataFrame:
    """Virtual batch ids on a stream (W2 rule): per machine, a new batch starts
    on a gap above ``gap_minutes`` or an inactive->active edge. State per
    machine (last event time, last active flag, batch number) lives in the
    streaming state store, so numbering continues across micro-batches. The
    gap threshold is a parameter (the global median gap of the batch rule is
    not known on an unbounded stream), and every machine's modes are taken
    as given (no 'nothing active anywhere' fallback)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from batchlens.constants import ACTIVE_MODES
    from batchlens.operators.sessions import clean_machine, epoch_micros

    active_set = set(ACTIVE_MODES)
    thr_us = gap_minutes * 60_000_000.0

    def step(key_tuple, batches, state):
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["__us", order_col], kind="stable")
        if state.exists:
            last_us, last_active, num = state.get
        else:
            last_us, last_active, num = None, False, 1
        us = pdf["__us"].to_numpy()
        active = pdf[mode_col].astype("string").str.lower().isin(active_set).fillna(False).to_numpy(dtype=bool)
        prev_us = pd.Series(us).shift(1).to_numpy(dtype="float64")
        prev_us[0] = float("nan") if last_us is None else float(last_us)
        gap = us.astype("float64") - prev_us
        gap[pd.isna(gap)] = 0.0
        prev_active = pd.Series(active).shift(1, fill_value=bool(last_active)).to_numpy(dtype=bool)
        new = (gap > thr_us) | (active & ~prev_active)
        nums = num + new.cumsum()
        machine = str(key_tuple[0])
        token = "".join(ch for ch in machine if ch.isascii() and ch.isalnum()).upper()[:12]
        if token != machine:  # as operators/sessions.machine_token
            token += "-" + hashlib.sha256(machine.encode()).hexdigest()[:16]
        ids = [f"AUTO_{token}_{n:04d}" for n in nums]
        state.update((int(us[-1]), bool(active[-1]), int(nums[-1])))
        yield pd.DataFrame({order_col: pdf[order_col].to_numpy(), key: key_tuple[0], out: ids})

    keyed = stream_df.withColumn(key, clean_machine(F.col(key))).withColumn("__us", epoch_micros(ts_col))
    return keyed.select(key, order_col, mode_col, "__us").groupBy(key).applyInPandasWithState(
        step,
        f"{order_col} long, {key} string, {out} string",
        "last_us long, last_active boolean, num long",
        "append",
        GroupStateTimeout.NoTimeout,
    )
