"""Long-running feeds: state that ends, late rows that are counted, alerts that are sent once.

* ``closed_sessions``: machine batches by gap and mode edge with event-time timers (``transformWithState``, append
  mode). Rows wait in the state until the watermark passes them, so rows out of order are put in order; a batch is
  emitted when its successor starts or the watermark passes its gap, and then the machine has no state left.
* ``accepted_rows``: rows behind the watermark are dropped and counted exactly, from the progress of the query.
* ``alert_once``: one alert per id. Within the watermark the streaming state knows the ids, beyond it the written
  alert table does, also for another run of the stream.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from batchlens.operators.sessions import active_flag, clean_machine, epoch_micros, machine_token
from batchlens.streaming.streams import foreach_batch_sink

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stage_in_order(df: DataFrame, chunk: Column, chunks: int, path: str, files_per_chunk: int | None = None) -> int:
    """Write the rows of chunk 0, 1, ... one job after the other, so a file stream delivers them in that order.
    Every chunk has the same number of files, which is returned (``maxFilesPerTrigger``); chunks without rows
    are left out."""
    files = files_per_chunk or df.sparkSession.sparkContext.defaultParallelism
    for k in range(chunks):
        part = df.filter(chunk == k)
        if not part.isEmpty():
            part.repartition(files).write.mode("append").parquet(path)
    return files


# --------------------------------------------------------------- closed sessions
class ModeEdgeSessions(StatefulProcessor):
    """One machine's batches. ``pending`` holds rows ahead of the watermark as packed (time, order, active) triples;
    ``open`` is the batch that may still go on: start, last time, last active, rows, active rows, order of the first row."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.open = handle.getValueState("open", T.StructType([T.StructField(f"v{k}", T.LongType()) for k in range(6)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:  # slices of bounded size; only three numbers of a row are kept
            packed = np.stack([some["us"].to_numpy(np.int64), some["ord"].to_numpy(np.int64), some["act"].to_numpy(np.int64)], 1)
            self.pending.appendValue((packed.tobytes(),))
        yield from self._drain(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drain(key, timerValues)

    def _drain(self, key, timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs() * 1000
        parts = [np.frombuffer(bytes(x[0]), np.int64).reshape(-1, 3) for x in self.pending.get()] if self.pending.exists() else []
        rows = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        ready, wait = rows[rows[:, 0] < passed], rows[rows[:, 0] >= passed]
        now = self.open.get() if self.open.exists() else None
        done: list[tuple] = []
        if len(ready):
            ready = ready[np.lexsort((ready[:, 1], ready[:, 0]))]
            us, active = ready[:, 0], ready[:, 2] > 0
            before = np.append(us[0] if now is None else now[1], us[:-1])
            was = np.append(False if now is None else bool(now[2]), active[:-1])
            new = (us - before > self.gap_us) | (active & ~was)
            if now is None:
                new[0] = True
            starts = np.flatnonzero(new)
            bounds = np.append(starts, len(us))
            head = int(bounds[0])
            if head:  # the open batch goes on
                now = (now[0], int(us[head - 1]), int(active[head - 1]), now[3] + head, now[4] + int(active[:head].sum()), now[5])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if now is not None:
                    done.append(now)
                now = (int(us[a]), int(us[b - 1]), int(active[b - 1]), b - a, int(active[a:b].sum()), int(ready[a, 1]))
        if now is not None and now[1] + self.gap_us < passed:
            done.append(now)
            now = None
        if len(ready) or parts:
            self.pending.clear()
            if len(wait):
                self.pending.appendValue((wait.tobytes(),))
        if now is None:
            self.open.clear()
        else:
            self.open.update(now)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = ([int(wait[:, 0].min()) // 1000] if len(wait) else []) + ([] if now is None else [(now[1] + self.gap_us) // 1000])
        if due:
            self.handle.registerTimer(max(min(due), passed // 1000 + 1))
        if done:
            yield pd.DataFrame({"machine_id": key[0], "start_us": [d[0] for d in done], "end_us": [d[1] for d in done],
                                "n_readings": [d[3] for d in done], "n_active": [d[4] for d in done], "first_row": [d[5] for d in done]})

    def close(self) -> None:
        pass


def closed_sessions(stream: DataFrame, gap_minutes: float, delay: str, machine: str = "machine_id", ts_col: str = "timestamp",
                    order_col: str = "row_order", mode_col: str = "operation_mode") -> DataFrame:
    """Batch_ID, machine_id, start_us, end_us, n_readings, n_active of every closed batch, in append mode: per machine, a batch ends
    with a gap above ``gap_minutes`` or before an inactive->active edge. Ids carry the start time and the
    first row's order (two batches may start at one time), so no count has to be kept. NULL machines are ``M01``, NULL modes inactive; rows without a time are left out; rows more than
    ``delay`` late are dropped by the watermark."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # transformWithState has no other
    rows = stream.filter(F.col(ts_col).isNotNull()).select(
        clean_machine(F.col(machine)).alias("machine_id"), F.timestamp_micros(epoch_micros(ts_col)).alias("at"), epoch_micros(ts_col).alias("us"),
        F.col(order_col).cast("long").alias("ord"), active_flag(F.col(mode_col).cast("string")).cast("long").alias("act"),
    )
    out = rows.withWatermark("at", delay).groupBy("machine_id").transformWithStateInPandas(
        ModeEdgeSessions(int(gap_minutes * 60_000_000)), "machine_id string, start_us long, end_us long, n_readings long, n_active long, first_row long", "Append", "EventTime"
    )
    stamp = F.date_format(F.timestamp_add("MICROSECOND", "start_us", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyyMMddHHmmssSSSSSS")
    return out.withColumn("Batch_ID", F.concat(F.lit("AUTO_"), machine_token(F.col("machine_id")), F.lit("_"), stamp, F.lit("_"), F.col("first_row").cast("string")))


# --------------------------------------------------------------- late rows
class DropCounter(StreamingQueryListener):
    """Rows that the first stateful operator dropped behind the watermark, and rows read, per micro-batch of one query."""

    def __init__(self):
        self.ended, self.query_id, self.counts = threading.Event(), None, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.counts.setdefault(p["id"], {})[p["batchId"]] = (
            int(p.get("numInputRows", 0)), sum(int(o.get("numRowsDroppedByWatermark", 0)) for o in p.get("stateOperators", [])),
            sum(int(o.get("numRowsTotal", 0)) for o in p.get("stateOperators", [])),
        )

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query_id:
            self.ended.set()


def run_counted(stream: DataFrame, out_path: str, checkpoint: str, mode: str = "append") -> dict[int, tuple[int, int, int]]:
    """Run to the end of what is there; micro-batch -> (rows read, rows dropped as late, rows of state left)."""
    spark, counter = stream.sparkSession, DropCounter()
    spark.streams.addListener(counter)
    try:
        q = (stream.writeStream.outputMode(mode).foreachBatch(foreach_batch_sink(out_path)).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        counter.query_id = str(q.id)
        q.awaitTermination()
        counter.ended.wait(60)  # events of the listener come after the query's end
    finally:
        spark.streams.removeListener(counter)
    return counter.counts.get(str(q.id), {})


def accepted_rows(stream: DataFrame, ts_col: str, delay: str, id_cols: list[str]) -> DataFrame:
    """Rows that arrive no later than ``delay`` behind the newest one, each id once. (Spark compares a micro-batch with the
    watermark that the one before it ran under, so with the newest row up to the last but one.) The gate is the first stateful operator and sees single rows, so its count of dropped rows is exact (an aggregate would count
    its partial groups). Ids are forgotten when the watermark passes them."""
    gated = stream.withColumn("event_time", F.timestamp_micros(epoch_micros(ts_col))).withWatermark("event_time", delay)
    return gated.dropDuplicatesWithinWatermark(id_cols).drop("event_time")


# --------------------------------------------------------------- alerts
def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_alerts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def alert_once(stream: DataFrame, id_col: str, ts_col: str, delay: str, alerts: str, checkpoint: str):
    """Append the first row of every id to the alert table ``alerts``; returns the ended query. Repeated rows within
    ``delay`` meet the streaming state, which forgets an id when the watermark passes it; later ones, and those of
    another run, meet the table (``left_anti``). Each micro-batch owns one folder of the table, named by its run and
    number, which it overwrites when it is repeated after a failure; its own earlier rows don't count as sent."""
    schema, run = stream.schema, hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def sink(batch: DataFrame, epoch: int) -> None:
        own = f"{run}-{epoch}"
        sent = read_alerts(batch.sparkSession, alerts, schema)
        if sent.isStreaming is False and sent.inputFiles():
            sent = sent.filter(~F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).eqNullSafe(own))
        new = batch.dropDuplicates([id_col]).join(sent.select(id_col), id_col, "left_anti")
        new.select(*schema.names).write.mode("overwrite").parquet(f"{alerts}/{own}")

    gated = stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark([id_col])
    q = gated.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
