"""Versions, promotion, the incremental store, and the structured route end to end."""

import pytest
from pyspark.sql import functions as F

from batchlens.constants import DEFAULT_SCENARIOS, REQUIRED_PROCESS_COLUMNS, REQUIRED_PRODUCTION_COLUMNS
from batchlens.operators import adapters, compare, golden, schema_map
from batchlens.operators.features import KPI_PRODUCTION_COLUMNS
from batchlens.plans import pipeline
from batchlens.plans.structured import build_features
from batchlens.sources import incremental, signature_versions, versions
from batchlens.sources.tables import process_readings, production_batches
from conftest import SF_SMALL


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "v")
    assert versions.read(spark, root) == (0, {})
    assert versions.publish(spark, root, 0, {"x": 1}) == 1
    with pytest.raises(versions.Lost):
        versions.publish(spark, root, 0, {"x": 2})
    assert versions.read(spark, root) == (1, {"x": 1})
    assert versions.publish(spark, root, 1, {"x": 3}) == 2
    assert versions.read(spark, root, 1) == (1, {"x": 1}) and versions.versions(spark, root) == [1, 2]


def signature(spark, rows):
    return spark.createDataFrame([(s, b, x, {"w": 1.0}, {"Yield_Percent": str(x), "Total_Energy_kWh": "2.0"}, [("z", 0.5)], None, None) for s, b, x in rows], golden.SIGNATURE_SCHEMA)


def rival(spark, rows):
    return spark.createDataFrame([(s, b, x, {"Yield_Percent": str(x)}) for s, b, x in rows], "scenario string, Batch_ID string, Scenario_Score double, profile map<string,string>")


def test_promotion_challenges_the_version_that_won(spark, tmp_path, monkeypatch):
    """A writer that loses the race reads the winner's version and challenges that one."""
    root = str(tmp_path / "s")
    signature_versions.publish(spark, root, signature(spark, [("A", "a1", 1.0), ("B", "b1", 1.0)]), 0)
    real, calls = versions.publish, []

    def racing(s, r, expected, manifest):
        if not calls:
            calls.append(1)  # another writer publishes a better A just before
            path = f"{root}/data/other"
            signature_versions.signatures.save(signature(spark, [("A", "a2", 3.0), ("B", "b1", 1.0)]), path)
            real(s, r, expected, {"path": path})
        return real(s, r, expected, manifest)

    monkeypatch.setattr(versions, "publish", racing)
    version, out = signature_versions.promote(spark, root, rival(spark, [("A", "a3", 2.0), ("B", "b3", 2.0), ("C", "c3", 9.0)]), "later", "2024-01-01")
    got = {r.scenario: (r.batch_id, r.score, r.promoted_from) for r in signature_versions.read(spark, root)[1].collect()}
    assert version == 3 and got == {"A": ("a2", 3.0, None), "B": ("b3", 2.0, "later")}
    assert {r.scenario: (r.batch_id) for r in signature_versions.read(spark, root, 1)[1].collect()} == {"A": "a1", "B": "b1"}  # pinned
    assert signature_versions.promote(spark, root, rival(spark, [("A", "a4", 3.0)]), "later", "x")[0] == 3  # equal: nothing published
    assert versions.versions(spark, root) == [1, 2, 3]


def test_profiles_fall_back_to_the_best_batch(spark, tmp_path):
    stored = signature(spark, [("A", "a1", 90.0)])
    best = spark.createDataFrame([("A", *[1.0] * len(signature_versions.FOCUS)), ("B", *[2.0] * len(signature_versions.FOCUS))], ["scenario", *signature_versions.FOCUS])
    got = {r.scenario: r for r in signature_versions.profiles(stored, best).collect()}
    assert (got["A"].Yield_Percent, got["A"].Quality_Score, got["B"].Yield_Percent) == (90.0, None, 2.0)
    features = spark.createDataFrame([("x", 95.0, 3.0)], "Batch_ID string, Yield_Percent double, Total_Energy_kWh double")
    rows = {(r.scenario, r.Metric): (r.Deviation, r.Status) for r in compare.compare_to_signatures(features, signature_versions.profiles(stored, best)).collect()}
    assert rows["A", "Yield_Percent"][0] == 5.0 and rows["A", "Total_Energy_kWh"][0] == 1.0 and len(rows) == 4


def write(df, path):
    df.coalesce(1).write.mode("overwrite").parquet(path)


def test_store_rebuilds_what_changed(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    production, readings = production_batches(spark, SF_SMALL), process_readings(spark, SF_SMALL)
    number = F.substring("Batch_ID", 2, 18).cast("long")
    write(production, f"{base}/p")
    for k in range(3):
        write(readings.filter(number % 60 % 3 == k), f"{base}/r/f{k}")
    extra = readings.filter(number < 12)
    write(extra.limit(0), f"{base}/r/f9")
    sources = incremental.Source([f"{base}/p"], ["*"]), incremental.Source([f"{base}/r"], ["*"])
    refresh = lambda: incremental.refresh(spark, f"{base}/store", *sources, buckets=16)
    rows = lambda df: sorted(map(tuple, df.collect()))
    full = lambda: rows(build_features(spark.read.parquet(f"{base}/p"), spark.read.option("recursiveFileLookup", True).parquet(f"{base}/r")).features)
    first = refresh()
    assert (first.version, first.hit) == (1, False) and first.files_read >= 4 and first.buckets_written == 16
    assert set(first.tables) == {"production_raw", "process_timeseries_raw", "process_agg", "features"}
    assert rows(first.tables["features"]) == full() and first.report["rows_process"] == readings.count()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("hit", "")
    second = refresh()
    assert second.hit and second.version == 1 and not jobs.getJobIdsForGroup("hit")  # no job, so no data page read
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows(second.tables["process_agg"]) == rows(first.tables["process_agg"])
    write(extra.withColumn("Temperature_C", F.lit(99.0)), f"{base}/r/f9")  # more readings of a few batches
    third = refresh()
    assert (third.version, third.files_read) == (2, 1) and 0 < third.buckets_written < 16
    assert rows(third.tables["features"]) == full()
    write(extra.limit(0), f"{base}/r/f9")  # and away again: the batches of the file that went are made anew
    fourth = refresh()
    assert fourth.version == 3 and 0 < fourth.buckets_written < 16 and rows(fourth.tables["features"]) == rows(first.tables["features"])
    monkeypatch.setattr(incremental, "versions", incremental.versions)
    with pytest.raises(versions.Lost):
        versions.publish(spark, f"{base}/store", 2, {})


def vocabulary(spark, rows=40, missing=None):
    """Production with both vocabularies (some columns left out) and readings that pass every check."""
    ids = spark.range(rows)
    batch = F.concat(F.lit("B"), F.lpad((F.col("id") % 20).cast("string"), 4, "0")).alias("Batch_ID")
    names = [c for c in [*REQUIRED_PRODUCTION_COLUMNS, *KPI_PRODUCTION_COLUMNS] if c not in ("Batch_ID", missing)]
    production = ids.limit(20).select(batch, *[(F.lit(5.0 + k) + F.col("id") * 0.1).alias(c) for k, c in enumerate(dict.fromkeys(names))])
    process = ids.select("id", batch, F.lit("Mix").alias("Phase"), *[(F.lit(10.0 + k) + F.col("id") * 0.5).alias(c) for k, c in enumerate(REQUIRED_PROCESS_COLUMNS) if c not in ("Batch_ID", "Phase")])
    return production, process


def test_structured_route_end_to_end_and_its_fallback(spark):
    production, process = vocabulary(spark)
    path, features = pipeline.run_pipeline(process, "id", production)
    assert path == "structured" and features.count() == 20 and {"Quality_Score", "Cycle_Time", "Green_Zone"} <= set(features.columns)
    for lacking in ("Dissolution_Rate", "Moisture_Content"):  # the generic names alone can't make the scores
        production, process = vocabulary(spark, missing=lacking)
        assert pipeline.route(production, process).name == "structured"
        path, features = pipeline.run_pipeline(process, "id", production)
        assert path == "adaptive" and features.count() == 20


def test_each_check_fails_in_turn(spark):
    production, process = vocabulary(spark)
    verdict = lambda a, b: {r.check: r.passed for r in schema_map.validate_structured(a, b).collect()}
    assert all(verdict(production, process).values())
    assert not verdict(production.drop("Unit_Weight"), process)["production_columns"]
    assert not verdict(production, process.drop("Flow_Rate_LPM"))["process_columns"]
    assert not verdict(production.limit(0), process)["production_non_empty"]
    assert not verdict(production, process.limit(0))["process_non_empty"]
    assert not verdict(production.withColumn("Unit_Weight", F.lit("text")), process)["production_numeric"]
    assert not verdict(production, process.withColumn("Flow_Rate_LPM", F.lit(None).cast("double")))["process_numeric"]
    gate = lambda **t: {(r.table_name, r.rule): r.passed for r in schema_map.quality_gate(t).collect()}
    assert all(gate(a=production, b=process).values())
    assert not gate(b=process.withColumn("Temperature_C", F.lit(301.0)))["b", "temperature_bounds"]
    assert not gate(a=production.withColumn("Total_Energy_kWh", F.lit(-1.0)))["a", "energy_bounds"]
    assert not gate(a=production.select("Batch_ID", *[F.lit(None).cast("double").alias(c) for c in "uvw"]))["a", "null_rate"]
    for bad in (production.limit(0), production.withColumn("Total_Energy_kWh", F.lit(-1.0))):
        assert pipeline.run_pipeline(process, "id", bad)[0] == "adaptive"


def test_candidates_keep_the_template(spark):
    std = spark.createDataFrame([("x", 1.0, 2.0, 100.0, 10.0, 0.0, 60.0, 30.0, 5.0)], "batch_id string, temperature_c double, pressure_bar double, rpm double, energy_kwh double, yield_percent double, quality_score double, process_time_min double, carbon_kg double")
    row = adapters.to_candidate(std, {"Batch_ID": "T", "Yield_Percent": 88.0, "Heat_Temp": 71.5, "Note": "n", "Phase_Count": 3, "Unknown": None}).first().asDict()
    assert (row["Batch_ID"], row["Yield_Percent"], row["Heat_Temp"], row["Note"], row["Phase_Count"], row["Unknown"]) == ("x", 88.0, 71.5, "n", 3, None)
    assert "Green_Zone" not in row and "Eco_Efficiency_Score" not in row and DEFAULT_SCENARIOS
