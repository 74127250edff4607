"""Feeds that end, forget and count: event-time sessions, late rows, alerts once; ordered scans without Python."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from batchlens.operators import sessions as ss
from batchlens.operators import timeseries as ts
from batchlens.operators.ordering import ordered_scan
from batchlens.streaming import feeds
from batchlens.streaming import streams as st

T0 = dt.datetime(2024, 1, 1)
SENSOR = "row_order long, machine_id string, timestamp timestamp_ntz, operation_mode string"
GAP, DELAY = 30, 10


def sensor_rows(seed=3):
    """Machines with gaps and mode edges; one of them has most rows, one a null name, one falls silent early."""
    rnd, out, k = random.Random(seed), [], 0
    for name, n in (("HOT", 400), ("M 1", 40), (None, 30), ("quiet", 5)):
        at = 0.0
        for _ in range(n):
            at += rnd.choice([0, 0.5, 1, 2, 3, 31 if name != "HOT" else 2])
            out.append((k, name, T0 + dt.timedelta(minutes=at), rnd.choice(["Running", "Running", "Idle", None])))
            k += 1
    return out


def plain_sessions(rows, until):
    """Batches of rows before ``until`` that end before it."""
    active, out = {"run", "running", "production", "productive", "active", "on"}, []
    per = {}
    for k, name, at, mode in rows:
        if at < until:
            per.setdefault(name or "M01", []).append((at, k, (mode or "").lower() in active))
    for name, some in per.items():
        groups = []
        for at, _k, act in sorted(some):
            if not groups or (at - groups[-1][-1][0]).total_seconds() > GAP * 60 or (act and not groups[-1][-1][1]):
                groups.append([])
            groups[-1].append((at, act))
        for i, g in enumerate(groups):
            if i < len(groups) - 1 or g[-1][0] + dt.timedelta(minutes=GAP) < until:
                out.append((name, g[0][0], g[-1][0], len(g), sum(a for _, a in g)))
    return sorted(out)


def test_closed_sessions_out_of_order(spark, tmp_path):
    """Rows arrive up to the delay out of order and in slices of 16; what is emitted are the sessions of the ordered feed, each
    once; a machine without an open session has no state."""
    rows = sensor_rows()
    end = max(r[2] for r in rows)
    rnd = random.Random(1)
    arrive = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rnd.uniform(0, DELAY * 0.9)))
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    size = -(-len(arrive) // 6)
    df = spark.createDataFrame([(*r, k // size) for k, r in enumerate(arrive)], SENSOR + ", chunk int")
    files = feeds.stage_in_order(df, F.col("chunk"), 6, src, 2)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(src)
        seen = feeds.run_counted(feeds.closed_sessions(stream, GAP, f"{DELAY} minutes"), out, str(tmp_path / "ck"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = st.read_all(spark, out).collect()
    at = lambda us: T0 + dt.timedelta(microseconds=us - 1704067200000000)
    want = plain_sessions(rows, end - dt.timedelta(minutes=DELAY))
    assert sorted((r.machine_id, at(r.start_us), at(r.end_us), r.n_readings, r.n_active) for r in got) == want
    assert len({r.Batch_ID for r in got}) == len(got) and sum(v[1] for v in seen.values()) == 0


def test_idle_machines_leave_no_state(spark, tmp_path):
    rows = [(k, f"m{k % 50}", T0 + dt.timedelta(minutes=k % 5), "Running") for k in range(500)]
    rows += [(9000 + k, "late", T0 + dt.timedelta(days=1, minutes=k), "Running") for k in range(3)]
    df = spark.createDataFrame([(*r, int(r[1] == "late")) for r in rows], SENSOR + ", chunk int")
    src = str(tmp_path / "src")
    files = feeds.stage_in_order(df, F.col("chunk"), 2, src, 1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(src)
    seen = feeds.run_counted(feeds.closed_sessions(stream, GAP, f"{DELAY} minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert {r.machine_id for r in st.read_all(spark, str(tmp_path / "out")).collect()} == {f"m{k}" for k in range(50)}
    left = [seen[k][2] for k in sorted(seen)]
    assert max(left) >= 50 and left[-1] <= 6  # only the last machine's rows, batch and timer


def test_late_rows_are_counted_exactly(spark, tmp_path):
    """Chunk by chunk, compared with a plain replay; repeated rows inside the delay count as accepted once."""
    rows = [(k, "m", T0 + dt.timedelta(minutes=k), "Running", k // 100) for k in range(500)]
    rows += [(1000 + k, "m", T0 + dt.timedelta(minutes=k), "Running", 4) for k in range(0, 200, 10)]  # long late
    rows += [(499 - k, "m", T0 + dt.timedelta(minutes=499 - k), "Running", 4) for k in range(5)]  # repeated
    df = spark.createDataFrame(rows, SENSOR + ", chunk int")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    files = feeds.stage_in_order(df, F.col("chunk"), 5, src, 2)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(src)
    seen = feeds.run_counted(feeds.accepted_rows(stream, "timestamp", f"{DELAY} minutes", ["row_order"]), out, str(tmp_path / "ck"))
    reads = {k: v for k, v in seen.items() if v[0]}
    assert sum(v[1] for v in reads.values()) == 20 and sum(v[0] for v in reads.values()) == len(rows)
    got = st.read_all(spark, out)
    assert got.count() == 500 and got.select("row_order").distinct().count() == 500
    assert max(v[2] for v in seen.values()) <= 250  # ids are forgotten behind the watermark


def test_alerts_once_over_restart_watermark_and_lost_state(spark, tmp_path):
    df = spark.createDataFrame([(f"B{k % 60:03d}", T0 + dt.timedelta(minutes=k % 60), float(k)) for k in range(120)], "Batch_ID string, at timestamp, x double")
    src, alerts = str(tmp_path / "src"), str(tmp_path / "alerts")

    def run(checkpoint):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        return feeds.alert_once(stream, "Batch_ID", "at", f"{DELAY} minutes", alerts, str(tmp_path / checkpoint))

    def sent():
        return sorted(r.Batch_ID for r in feeds.read_alerts(spark, alerts, df.schema).collect())

    every = [f"B{k:03d}" for k in range(60)]
    feeds.stage_in_order(df, F.lit(0), 1, src, 1)
    run("one")
    assert sent() == every
    run("one")  # nothing new
    feeds.stage_in_order(df, F.lit(0), 1, src, 1)
    q = run("one")  # the source repeats everything: partly late, partly known to the state
    assert sent() == every
    assert sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) <= 2 * DELAY + 1
    run("two")  # state lost: only the table knows
    assert sent() == every


def test_a_repeated_micro_batch_rewrites_its_own_alerts(spark, tmp_path):
    """The folder of a micro-batch that failed after writing doesn't count as sent when it runs again."""
    df = spark.createDataFrame([("B1", T0, 1.0), ("B2", T0, 2.0)], "Batch_ID string, at timestamp, x double")
    src, alerts, ck = str(tmp_path / "src"), str(tmp_path / "alerts"), str(tmp_path / "ck")
    feeds.stage_in_order(df, F.lit(0), 1, src, 1)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)
    feeds.alert_once(stream(), "Batch_ID", "at", "1 minute", alerts, ck)
    for name in sorted(os.listdir(f"{ck}/commits")):
        os.remove(f"{ck}/commits/{name}")  # as if the driver had been lost before the commit
    feeds.alert_once(stream(), "Batch_ID", "at", "1 minute", alerts, ck)
    assert sorted(r.Batch_ID for r in feeds.read_alerts(spark, alerts, df.schema).collect()) == ["B1", "B2"]


def test_ordered_scan_runs_without_python(spark):
    df = spark.createDataFrame([(k, "a" if k % 3 else None, float(k) if k % 4 == 0 else None) for k in range(300)], "i long, key string, v double")
    w = Window.partitionBy("key").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("i", F.row_number().over(w).alias("pos"), F.sum(F.coalesce("v", F.lit(0.0))).over(upto).alias("s"), F.lag("v").over(w).alias("l"), F.last("v", True).over(upto).alias("f"))
    for parts in (1, 5, 40):
        got = ordered_scan(df, ["key"], ["i"], sums={"s": F.col("v")}, lags={"l": F.col("v")}, ffills={"f": F.col("v")}, partitions=parts)
        plan = got._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
        assert sorted(map(tuple, got.select("i", "pos", "s", "l", "f").collect())) == sorted(map(tuple, want.collect()))
    assert ordered_scan(df.limit(0), ["key"], ["i"], lags={"l": F.col("v")}).count() == 0


@pytest.mark.parametrize("parts", ["1", "6"])
def test_repair_fills_across_partitions_and_ends(spark, parts):
    """NULL and unreadable times at both ends, in runs longer than a partition, filled forward and then back."""
    n = 120
    text = lambda k: None if k < 25 or 40 <= k < 85 or k >= 110 else "never" if k % 7 == 0 else f"2024-03-01 00:{k % 60:02d}:00"
    times = [text(k) for k in range(n)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(list(enumerate(times)), "row_order long, t string").repartition(4)
        got = [r.Timestamp for r in ss.repair_timestamps(df, "t", "row_order").orderBy("row_order").collect()]
        none = [r.Timestamp for r in ss.repair_timestamps(df.withColumn("t", F.lit("?")), "t", "row_order").orderBy("row_order").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    good = [dt.datetime.fromisoformat(t) if t and t != "never" else None for t in times]
    last, want = None, []
    for g in good:
        last = g or last
        want.append(last)
    first = next(w for w in want if w)
    assert got == [w or first for w in want]
    assert none == [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k) for k in range(n)]


def test_step_ignores_zero_and_long_gaps(spark):
    minutes = [0, 0, 1, 3, 5, 500, 502, 502, 900]
    df = spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m)) for k, m in enumerate(minutes)], "row_order long, Timestamp timestamp_ntz")
    assert ss.step_minutes(df, "Timestamp", "row_order") == 2.0
    assert ss.step_minutes(df.limit(0), "Timestamp", "row_order") == 1.0


def test_rolling_zscore_buckets(spark):
    """Equal to a plain range window for any bucket, with a hot machine, ties, NULL values and times, and equal values."""
    rnd = random.Random(2)
    rows = [(k, "HOT" if k % 2 else f"m{k % 7}", None if k % 50 == 3 else T0 + dt.timedelta(minutes=rnd.randint(0, 2000)), None if k % 31 == 0 else rnd.gauss(10, 3)) for k in range(800)]
    rows += [(9000 + k, "same", T0 + dt.timedelta(minutes=k), 0.1) for k in range(30)] + [(9100, None, T0, 1.0)]
    df = spark.createDataFrame(rows, "row_order long, machine_id string, timestamp timestamp_ntz, x double").repartition(5)
    us = ss.epoch_micros("timestamp")
    w = Window.partitionBy("machine_id").orderBy("us").rangeBetween(-120 * 60_000_000, 0)
    plain = df.filter("timestamp IS NOT NULL").withColumn("us", us).select("row_order", "x", F.avg("x").over(w).alias("m"), F.stddev_pop("x").over(w).alias("s"), F.count("x").over(w).alias("n"))
    want = {r.row_order: (r.n, abs(r.x - r.m) / r.s if r.x is not None and r.s is not None and r.s > 1e-9 else None) for r in plain.collect()}
    for bucket in (None, 120, 1000, 10**6):
        got = ts.rolling_zscores(df, "x", 120, 2.0, bucket_minutes=bucket).collect()
        assert len(got) == len(rows)
        for r in got:
            n, z = want.get(r.row_order, (0, None))
            assert r.n_rolling == n and (r.z_rolling is None) == (z is None) and (z is None or abs(r.z_rolling - z) < 2e-6)
            assert r.flag_rolling == (z is not None and z >= 2.0)
            if r.machine_id == "same":
                assert r.z_machine is None and not r.flag_machine
    with pytest.raises(ValueError):
        ts.rolling_zscores(df, "x", 120, 2.0, bucket_minutes=60)
    assert ts.rolling_zscores(df.limit(0), "x", 120, 2.0).count() == 0


def test_monthly_series_has_empty_months(spark):
    rows = [("a", dt.datetime(2024, 1, 31, 23, 59), 1.0), ("a", dt.datetime(2024, 4, 1), 3.0), ("a", None, 9.0), (None, dt.datetime(2023, 12, 5), None), ("b", dt.datetime(2024, 2, 1), 2.0)]
    df = spark.createDataFrame(rows, "machine_id string, timestamp timestamp_ntz, kw double")
    got = {(r.machine_id, r.Month[:7]): (r.n_readings, r.Energy_kWh, r.Rolling_kWh) for r in ts.monthly_series(df, "kw").collect()}
    assert len(got) == 3 * 5  # from the first month of all to the last
    assert got["a", "2024-01"] == (1, 1.0, 0.5) and got["a", "2024-02"] == (0, 0.0, round(1 / 3, 6)) and got["a", "2024-04"] == (1, 3.0, 1.0)
    assert got["M01", "2023-12"] == (1, 0.0, 0.0) and got["b", "2024-04"] == (0, 0.0, round(2 / 3, 6))
    assert ts.monthly_series(df.limit(0), "kw").count() == 0
