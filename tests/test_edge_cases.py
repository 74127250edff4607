"""Hand-made edge tables (constant / all-NULL columns, zone edges, NULL power,
empty target filter, equal Pareto rows, equal-score promotion, mode edges,
sparse fallback, empty months, formula-looking cells)."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchlens.constants import DEFAULT_SCENARIOS, PRIMARY_OBJECTIVES
from batchlens.functions.numeric import to_double
from batchlens.functions.zones import zone_candidate, zone_feature
from batchlens.operators import analytics, candidates, features, golden, pareto, ranking, sessions, stats
from batchlens.sources import export


def test_normalize_constant_and_all_null(spark):
    df = spark.createDataFrame([(1, 5.0, None, 1.0), (2, 5.0, None, None), (3, 5.0, None, 3.0)], "id int, c double, n double, v double")
    out = stats.normalize_columns(df, [("c", False, "nc"), ("n", True, "nn"), ("v", False, "nv")]).orderBy("id").collect()
    assert [r.nc for r in out] == [0.5, 0.5, 0.5]
    assert [r.nn for r in out] == [0.5, 0.5, 0.5]
    assert [r.nv for r in out] == [0.0, None, 1.0]


def test_text_numbers_become_null(spark):
    df = spark.createDataFrame([("abc",), ("NaN",), ("inf",), ("-Infinity",), ("2.5",)], "s string")
    vals = [r[0] for r in df.select(to_double("s")).collect()]
    assert vals == [None, None, None, None, 2.5]


def test_zone_edges(spark):
    df = spark.createDataFrame([(40.0,), (40.01,), (70.0,), (70.01,), (None,)], "e double")
    rows = df.select(zone_feature("e").alias("z"), zone_candidate("e").alias("c")).collect()
    assert [r.z for r in rows] == ["Red", "Yellow", "Yellow", "Green", None]
    assert [r.c for r in rows] == ["Yellow", "Yellow", "Green", "Green", "Red"]


def test_batch_with_only_null_power(spark):
    proc = spark.createDataFrame(
        [("B1", 1.0, "A", 70.0, 2.0, 1000.0, 20.0, 8.0, None, 1.0), ("B1", 2.0, "A", 71.0, 2.0, 1000.0, 20.0, 8.0, None, 1.0),
         ("B2", 1.0, "N", 72.0, 2.0, 1000.0, 20.0, 8.0, -5.0, 1.0), ("B2", 2.0, "R", 72.0, 2.0, 1000.0, 20.0, 8.0, 60.0, 1.0)],
        "Batch_ID string, Time_Minutes double, Phase string, Temperature_C double, Pressure_Bar double, Motor_Speed_RPM double, "
        "Compression_Force_kN double, Flow_Rate_LPM double, Power_Consumption_kW double, Vibration_mm_s double",
    )
    out = {r.Batch_ID: r for r in features.process_agg(proc).collect()}
    assert out["B1"].Total_Energy_kWh == 0.0 and out["B1"].Avg_Power_Consumption_kW is None
    assert out["B2"].Total_Energy_kWh == 1.0  # (0 + 60) / 60, negative power clipped
    assert out["B2"].Phase_Count == 2


def _feat(spark, rows):
    return spark.createDataFrame(rows, "Batch_ID string, " + ", ".join(f"{o} double" for o in PRIMARY_OBJECTIVES))


def test_empty_target_filter_ranks_everything(spark):
    f = _feat(spark, [("a", 90.0, 80.0, 50.0, 5.0, 4.1, 60.0), ("b", 85.0, 70.0, 40.0, 6.0, 4.9, 50.0)])
    impossible = {"min_yield": 1e9, "min_quality": 0.0, "max_energy": 1e9, "max_carbon": 1e9, "min_eco_score": None}
    r = ranking.rank_batches(f, DEFAULT_SCENARIOS["Balanced"], impossible)
    assert r.count() == 2
    scores = {x.Batch_ID: x.Scenario_Score for x in r.collect()}
    assert scores["a"] == 100.0 and scores["b"] == 0.0


def test_large_pareto_front_is_never_gathered_in_one_task(spark, monkeypatch):
    dealt, real = [], pareto.local_fronts
    monkeypatch.setattr(pareto, "local_fronts", lambda df, o: dealt.append(df.rdd.getNumPartitions()) or real(df, o))
    df = spark.range(400, numPartitions=8).selectExpr("cast(id AS string) AS Batch_ID", "cast(id AS double) AS Yield_Percent", "cast(id AS double) AS Total_Energy_kWh")
    got = pareto.pareto_front(df, objectives=["Yield_Percent", "Total_Energy_kWh"], max_broadcast_rows=100)
    assert got.count() == 400 and min(dealt) > 1


def test_equal_pareto_rows_both_survive_and_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(f"r{i}", *[float(v) for v in rng.integers(0, 6, 6)]) for i in range(300)]
    rows += [("dupA", 99.0, 99.0, 99.0, 0.0, 0.0, 99.0), ("dupB", 99.0, 99.0, 99.0, 0.0, 0.0, 99.0), ("nul", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = _feat(spark, rows).repartition(7)
    got = {r.Batch_ID for r in pareto.pareto_front(df, max_broadcast_rows=25).collect()}
    obj = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], dtype=float)
    obj[:, [0, 1, 2, 5]] *= -1
    diff = obj[None, :, :] - obj[:, None, :]
    dom = np.all(diff <= 0, axis=2) & np.any(diff < 0, axis=2)
    np.fill_diagonal(dom, False)
    expect = {rows[i][0] for i in np.flatnonzero(~dom.any(axis=1))}
    assert got == expect
    assert {"dupA", "dupB", "nul"} <= got


def test_promotion_requires_strictly_greater(spark):
    cur = spark.createDataFrame([("S1", "b1", 80.0, None, None), ("S2", "b2", 70.0, None, None)],
                                "scenario string, batch_id string, score double, promoted_from string, promoted_at_utc string")
    cand = spark.createDataFrame([("S1", "c1", 80.0), ("S2", "c2", 70.5), ("S3", "c3", 99.0)], "scenario string, Batch_ID string, Scenario_Score double")
    out = {r.scenario: r for r in golden.promote_if_better(cur, cand, "auto", "t").collect()}
    assert set(out) == {"S1", "S2"}
    assert not out["S1"].promoted and out["S1"].batch_id == "b1"
    assert out["S2"].promoted and out["S2"].batch_id == "c2" and out["S2"].promoted_from == "auto"


def test_virtual_batch_numbering_mode_edges(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    rows = []
    for i, mode in enumerate(["Running", "Running", "Idle", "Running"]):
        rows.append((i, t0 + dt.timedelta(minutes=i), "m-1", mode))
    for i, mode in enumerate(["Idle", "Running", "Running"]):
        rows.append((10 + i, t0 + dt.timedelta(minutes=i), "M2", mode))
    rows.append((20, t0 + dt.timedelta(minutes=10_000), "M2", "Running"))  # long gap -> new batch
    df = spark.createDataFrame(rows, "row_order long, Timestamp timestamp_ntz, machine_id string, operation_mode string")
    res = sessions.virtual_batches(df, "Timestamp", "machine_id", "operation_mode", "row_order", sparse="never")
    ids = {r.row_order: r.Auto_Batch_ID for r in res.frame.collect()}
    # "m-1" can't be told from "M1" by its letters and digits: a hash of the id follows
    token = "M1-" + hashlib.sha256(b"m-1").hexdigest()[:16]
    assert [ids[i] for i in range(4)] == [f"AUTO_{token}_{n}" for n in ("0002", "0002", "0002", "0003")]
    assert [ids[10], ids[11], ids[12], ids[20]] == ["AUTO_M2_0001", "AUTO_M2_0002", "AUTO_M2_0002", "AUTO_M2_0003"]


def test_machines_never_share_batch_ids(spark):
    from batchlens.plans.adaptive import run_adaptive

    t0 = dt.datetime(2024, 1, 1)
    names = ["LINE-A1", "LINEA1", "PRESSSTATION-01", "PRESSSTATION-02", "linea1"]
    rows = [(20 * k + i, t0 + dt.timedelta(minutes=i), m, "Running", 5.0) for k, m in enumerate(names) for i in range(20)]
    df = spark.createDataFrame(rows, "row_order long, timestamp timestamp_ntz, machine_id string, operation_mode string, power_kw double")
    res = sessions.virtual_batches(df, "timestamp", "machine_id", "operation_mode", "row_order")
    assert res.frame.select("Auto_Batch_ID").distinct().count() == len(names)
    assert run_adaptive(df, "row_order").features.count() == len(names)


def test_sparse_fallback_windows(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=24 * i), "M1", "Running") for i in range(130)]
    df = spark.createDataFrame(rows, "row_order long, Timestamp timestamp_ntz, machine_id string, operation_mode string")
    res = sessions.virtual_batches(df, "Timestamp", "machine_id", "operation_mode", "row_order", sparse="always")
    ids = {r.row_order: r.Auto_Batch_ID for r in res.frame.collect()}
    assert ids[0] == "AUTO_M1_0001" and ids[59] == "AUTO_M1_0001" and ids[60] == "AUTO_M1_0002" and ids[129] == "AUTO_M1_0003"


def test_monthly_energy_fills_empty_months(spark):
    # 3 batches -> step = 25920 // 3 = 8640 hours: dates 2024-01-01, 2024-12-26,
    # 2025-12-21, so 24 months from Jan 2024 to Dec 2025, all but 3 empty
    f = spark.createDataFrame([("B1", 1.0), ("B2", 2.0), ("B3", 4.0)], "Batch_ID string, Total_Energy_kWh double")
    rows = sorted(analytics.monthly_energy(f, keep_last=100).collect(), key=lambda r: r.Month)
    assert rows[0].Month == "2024-01-01" and rows[0].Energy_kWh == 1.0
    assert len(rows) == 24 and sum(r.Energy_kWh for r in rows) == 7.0
    assert {r.Month: r.Energy_kWh for r in rows}["2024-12-01"] == 2.0
    assert rows[1].Energy_kWh == 0.0 and rows[1].Rolling_3M_kWh == 0.5


def test_formula_safe_cells(spark):
    df = spark.createDataFrame([("hello", 1), ("=SUM(1,2)", 2), ("-1", 3), ("@cmd", 4), ("\tstart", 5)], "KPI string, n int")
    out = [r.KPI for r in export.sanitize(df).orderBy("n").collect()]
    assert out == ["hello", "'=SUM(1,2)", "'-1", "'@cmd", "'\tstart"]


def test_median_and_iqr_clip(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 3.0), (5, 100.0)], "id int, v double")
    filled, n = stats.median_impute(df, ["v"])
    assert n == 1 and {r.id: r.v for r in filled.collect()}[3] == 2.5
    clipped, counter = stats.iqr_clip(df, ["v"])
    got = {r.id: r.v for r in clipped.collect()}
    # q1 = 1.75, q3 = 27.25, iqr = 25.5 -> upper 65.5
    assert got[5] == pytest.approx(65.5) and got[3] is None
    assert df.agg(counter).first()[0] == 1


def test_rolling_means_small_and_large_batches_match_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = []
    for b, n in (("BIG", 730), ("SMALL", 12)):
        for i in range(n):
            v = None if i % 97 == 5 else float(rng.integers(0, 100))
            rows.append((b, float(i), v))
    df = spark.createDataFrame(rows, "Batch_ID string, t double, v double").repartition(5)
    got = analytics.rolling_means(df, "Batch_ID", ["t"], ["v"]).toPandas()
    for b, g in pd.DataFrame(rows, columns=["Batch_ID", "t", "v"]).groupby("Batch_ID"):
        w = max(5, len(g) // 50)
        exp = g.sort_values("t")["v"].astype(float).rolling(window=w, min_periods=1).mean().round(6).tolist()
        mine = got[got.Batch_ID == b].sort_values("t")["v_Roll"].tolist()
        assert len(mine) == len(exp)
        assert all((np.isnan(e) and (m is None or np.isnan(m))) or abs(m - e) < 1e-6 for m, e in zip(mine, exp))


def test_source_helpers(spark, tmp_path):
    from batchlens.sources import files

    empty = spark.createDataFrame([], "a int")
    full = spark.createDataFrame([(1,)], "a int")

    def broken():
        raise OSError("unreadable")

    assert files.first_non_empty([broken, lambda: empty, lambda: full]).count() == 1
    assert files.first_non_empty([lambda: empty]) is None
    assert files.optional_table(spark, str(tmp_path / "missing")) is None
    assert files.looks_like_process_table(["Time_Minutes", "Temperature_C", "Batch_ID"])
    assert not files.looks_like_process_table(["Batch_ID", "Yield"])


def test_stream_replay_is_idempotent(spark, tmp_path):
    """A stream restarted on the same checkpoint processes nothing twice."""
    import os

    from batchlens.streaming import streams as ST

    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=7 * i), f"M{i % 3}", float(i)) for i in range(200)],
                               "row_order long, timestamp timestamp_ntz, machine_id string, power_kw double")
    src = str(tmp_path / "src")
    fpc = ST.stage_time_chunks(df, "timestamp", src, 4, files_per_chunk=3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", fpc).parquet(src)
    agg = stream.withColumn("ts", sessions.utc_instant("timestamp")).withWatermark("ts", "1 hour") \
        .groupBy(F.window("ts", "1 day"), "machine_id").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("window.start").alias("w"), "machine_id", "n")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    ST.run_available_now(agg, out, ck, "update")
    first = sorted(ST.read_latest(spark, out, ["w", "machine_id"]).collect())
    epochs = len(os.listdir(out))
    ST.run_available_now(agg, out, ck, "update")  # restart: no new input
    assert sorted(ST.read_latest(spark, out, ["w", "machine_id"]).collect()) == first
    assert sum(r.n for r in first) == 200 and len(os.listdir(out)) == epochs


def test_decimate_and_stride_thin_long_batches(spark):
    from batchlens.operators import sampling

    rows = [("LONG", float(i)) for i in range(2000)] + [("SHORT", float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "Batch_ID string, t double").repartition(4)
    dec = {(r.Batch_ID, r.t) for r in sampling.decimate(df, "Batch_ID", ["t"], 900).collect()}
    assert dec == {("LONG", float(i)) for i in range(0, 2000, 2)} | {("SHORT", float(i)) for i in range(7)}
    # 2007 rows > 100 -> per batch 100 // 2 = 50 rows: k = n // 50
    st = {(r.Batch_ID, r.t) for r in sampling.stride_sample(df, 100, "Batch_ID", ["t"]).collect()}
    assert st == {("LONG", float(i)) for i in range(0, 2000, 40)} | {("SHORT", float(i)) for i in range(7)}


def test_baseline_performance_comes_from_its_parts_when_entirely_missing(spark):
    rows = [("a", 80.0, 90.0, 60.0, None), ("b", None, 100.0, 40.0, None)]
    df = spark.createDataFrame(rows, "Batch_ID string, Quality_Score double, Yield_Percent double, Process_Health_Score double, Performance_Score string")
    want = {"a": 0.4 * 80 + 0.35 * 90 + 0.25 * 60, "b": 0.4 * 86 + 0.35 * 100 + 0.25 * 40}
    for table in (df, df.drop("Performance_Score"), df.withColumn("Performance_Score", F.lit("n/a"))):
        assert {r.Batch_ID: r.Performance_Score for r in candidates.baseline_fill(table).collect()} == pytest.approx(want)
    one = df.withColumn("Performance_Score", F.when(F.col("Batch_ID") == "a", F.lit("70.5")))
    assert {r.Batch_ID: r.Performance_Score for r in candidates.baseline_fill(one).collect()} == {"a": 70.5, "b": 85.0}


def test_baseline_rows_without_ids_are_numbered(spark):
    df = spark.createDataFrame([(30.0,), (None,), (10.0,), (20.0,), (20.0,)], "Yield_Percent double").repartition(3)
    got = sorted((r.Batch_ID, r.Yield_Percent) for r in candidates.baseline_fill(df).collect())
    assert got == [("BATCH_0001", 90.0), ("BATCH_0002", 10.0), ("BATCH_0003", 20.0), ("BATCH_0004", 20.0), ("BATCH_0005", 30.0)]
    back = candidates.baseline_fill(df.withColumn("nth", -F.coalesce("Yield_Percent", F.lit(0.0))), order=["nth"]).collect()
    assert {r.Yield_Percent: r.Batch_ID for r in back}[30.0] == "BATCH_0001"
