"""Store, signature store and event log behaviours (miss/hit/tamper, corrupt
input, truncation)."""

import os

from pyspark.sql import functions as F

from batchlens.sources import eventlog, signatures, store


def test_feature_store_hit_miss_and_tamper(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(i, float(i) / 3) for i in range(50)], "id int, v double")
    calls = []

    def build():
        calls.append(1)
        return {"t": df}

    t1, hit1 = store.load_or_build(spark, "fp1", build, ["t"], root=root)
    t2, hit2 = store.load_or_build(spark, "fp1", build, ["t"], root=root)
    assert (hit1, hit2) == (False, True) and len(calls) == 1
    assert sorted(t2["t"].collect()) == sorted(df.collect())
    # a different fingerprint is a miss
    _, hit3 = store.load_or_build(spark, "fp2", build, ["t"], root=root)
    assert not hit3 and len(calls) == 2
    # tampering with the stored table breaks the content hash -> rebuild
    spark.createDataFrame([(999, 1.0)], "id int, v double").write.mode("append").parquet(os.path.join(root, "fp1", "t"))
    _, hit4 = store.load_or_build(spark, "fp1", build, ["t"], root=root)
    assert not hit4 and len(calls) == 3
    # force_rebuild always rebuilds
    _, hit5 = store.load_or_build(spark, "fp1", build, ["t"], root=root, force_rebuild=True)
    assert not hit5 and len(calls) == 4


def test_corrupt_signature_store_reads_empty(spark, tmp_path):
    path = tmp_path / "sig"
    path.mkdir()
    (path / "part-0.json").write_text('{"scenario": "Balanced", "batch_id": "B1", "score": 9\n{broken json\n')
    assert signatures.load(spark, str(path)).count() == 0 or \
        [r.scenario for r in signatures.load(spark, str(path)).collect()] == []
    assert signatures.load(spark, str(tmp_path / "missing")).count() == 0


def test_event_log_truncates_and_stringifies(spark, tmp_path):
    df = spark.createDataFrame([("x" * 300, 1.5)], "k string, v double")
    ev = eventlog.events(df, "2024-01-01T00:00:00", F.lit("e" * 200), F.create_map(F.col("k"), F.col("v").cast("string")))
    path = str(tmp_path / "log")
    eventlog.append(ev, path)
    eventlog.append(ev, path)
    back = eventlog.read(spark, path).collect()
    assert len(back) == 2
    r = back[0]
    assert len(r.event) == 128
    (k, v), = r.details.items()
    assert len(k) == 64 and v == "1.5"
