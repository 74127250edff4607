"""The incremental store is written by many tasks, whatever the number of its folders and buckets."""

import glob
import tempfile

from pyspark.sql import functions as F

from batchlens.plans import q_versions
from batchlens.sources import incremental


def test_a_folder_of_readings_is_written_by_several_tasks(spark):
    path = tempfile.mkdtemp(prefix="bl-split-") + "/process"
    ids = spark.range(0, 400, 1, 4).filter("id % 8 <> 5")
    rows = ids.select(F.format_string("B%09d", "id").alias("Batch_ID"), "id").unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS Batch_ID, 1L AS id"))
    folders = q_versions.split_readings(rows, path)
    assert len(folders) == 8
    for k, folder in enumerate(folders):
        back = spark.read.schema(rows.schema).parquet(folder)
        assert sorted(r["id"] for r in back.collect()) == ([] if k == 5 else list(range(k, 400, 8)))
        assert len(glob.glob(f"{folder}/*.parquet")) >= (1 if k == 5 else 4)


def test_a_bucket_is_dealt_over_tasks(spark):
    parts = spark.range(500).select(F.format_string("B%09d", "id").alias("Batch_ID")).select(incremental._spread(spark, 2).alias("p")).distinct()
    assert sorted(r["p"] for r in parts.collect()) == [0, 1, 2, 3]  # 8 shuffle partitions over 2 buckets


def test_files_under_odd_names_are_told_apart(spark):
    base = tempfile.mkdtemp(prefix="bl-odd-")
    paths = [f"{base}/a b+c", f"{base}/d%20e", f"{base}/plain"]
    for k, p in enumerate(paths):
        spark.createDataFrame([(f"B{k}", k)], "Batch_ID string, v long").coalesce(1).write.parquet(p)
    files = incremental.listing(spark, paths)
    written, _ = incremental._write_raw(spark, f"{base}/store", "t", incremental.Source(paths, ["*"]), files, 2)
    back = spark.read.parquet(written)
    assert sorted((r["Batch_ID"], r["v"]) for r in back.collect()) == [("B0", 0), ("B1", 1), ("B2", 2)]
    assert {r["src_file"] for r in back.select(F.col("src_file").cast("string")).distinct().collect()} <= set(files.values())
    assert back.select("src_file").distinct().count() == 3
