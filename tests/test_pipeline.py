"""Fixed answers: signature store, surrogate search, routing, sources of other formats."""

import datetime as dt

from pyspark.sql import functions as F

from batchlens.constants import PRIMARY_OBJECTIVES, REQUIRED_PROCESS_COLUMNS, REQUIRED_PRODUCTION_COLUMNS
from batchlens.operators import learning, schema_map
from batchlens.operators.golden import SIGNATURE_SCHEMA
from batchlens.plans import pipeline
from batchlens.sources import files, signatures, store


def test_signature_store_loads_twice(spark, tmp_path):
    from tests.conftest import SF_SMALL
    import __spark_entry__ as entry

    fields = len(SIGNATURE_SCHEMA.fields)
    first = entry.queries()["golden_roundtrip"](spark, SF_SMALL).count()
    assert first > 0 and entry.queries()["golden_roundtrip"](spark, SF_SMALL).count() == first
    assert len(SIGNATURE_SCHEMA.fields) == fields
    assert signatures.load(spark, str(tmp_path / "none")).count() == 0


def test_surrogate_row_is_the_golden_one_unless_improved(spark):
    from tests.conftest import SF_SMALL
    import __spark_entry__ as entry
    from batchlens.plans import context

    out = entry.queries()["surrogate_candidates"](spark, SF_SMALL).collect()
    features = {r.Batch_ID: r for r in context.features(spark, SF_SMALL).collect()}
    assert out
    for r in out:
        if not r.improved:
            assert r.Batch_ID == r.golden_batch
            for c in PRIMARY_OBJECTIVES:
                assert abs(r[c] - features[r.Batch_ID][c]) < 1e-9
        else:
            assert r.Batch_ID != r.golden_batch and r.best_composite > r.golden_composite
    assert learning.search  # the query above runs it


def generic(spark, null_share):
    prod = [c for c in REQUIRED_PRODUCTION_COLUMNS if c != "Batch_ID"]
    proc = [c for c in REQUIRED_PROCESS_COLUMNS if c not in ("Batch_ID", "Phase")]
    value = lambda k: F.when(F.col("id") % 100 >= int(100 * null_share), F.lit(10.0 + k))
    rows = spark.range(200)
    batch = F.concat(F.lit("B"), (F.col("id") % 20).cast("string")).alias("Batch_ID")
    production = rows.select(batch, *[value(k).alias(c) for k, c in enumerate(prod)])
    process = rows.select(batch, F.lit("Mix").alias("Phase"), *[value(k).alias(c) for k, c in enumerate(proc)])
    return production, process


def test_route_uses_the_null_rate(spark):
    full = pipeline.route(*generic(spark, 0.0))
    assert (full.structured_columns, full.validation_passed, full.gate_passed, full.name) == (True, True, True, "structured")
    sparse = pipeline.route(*generic(spark, 0.6))
    assert sparse.structured_columns and sparse.validation_passed and not sparse.gate_passed and sparse.name == "adaptive"


def test_formats_and_messy_headers(spark, tmp_path):
    df = spark.createDataFrame([(1, "M1", 5.5, dt.datetime(2024, 1, 1)), (2, None, None, None)], "n long, `Machine ID` string, `Temp (C)` double, Time timestamp_ntz")
    for fmt in ("csv", "json"):
        path = str(tmp_path / f"t.{fmt}")
        df.write.format(fmt).option("header", True).save(path)
        back = files.read_table(spark, path)
        resolved = schema_map.resolve_engine(back.columns)
        assert resolved["machine_id"] == "Machine ID" and resolved["temperature_c"] == "Temp (C)" and resolved["timestamp"] == "Time"
        got = schema_map.coerce_numeric(schema_map.map_columns(back, resolved, keep=["n"]), ["temperature_c", "rpm"], keep=["n"]).orderBy(F.col("n").cast("long")).collect()
        assert [(r.temperature_c, r.rpm) for r in got] == [(5.5, None), (None, None)]


def test_resolver_priorities():
    aliases = {"t": ["temp", "temperature"], "u": ["temperature"]}
    assert schema_map.resolve(["Temperature", "TEMP", "temp "], aliases, schema_map.engine_name) == {"t": "temp ", "u": "Temperature"}
    assert schema_map.resolve([], aliases, schema_map.engine_name) == {}
    assert schema_map.engine_name("  Quality Control: Defect-Rate (%) ") == "quality_control_defect_rate"


def test_content_hash_sees_replaced_pairs(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (2,)], "x int")
    b = spark.createDataFrame([(3,), (3,), (2,), (2,)], "x int")
    assert store.content_hash(a) != store.content_hash(b)
    assert store.content_hash(a) == store.content_hash(a.repartition(3))


def test_promotion_keeps_the_whole_signature(spark):
    from batchlens.operators import golden

    current = spark.createDataFrame(
        [("S1", "a", 1.0, {"w": 0.5}, (1.5,), [("z", 0.9)]), ("S2", "b", 2.0, {"w": 0.1}, (2.5,), [])],
        "scenario string, batch_id string, score double, weights map<string,double>, profile struct<y:double>, alternatives array<struct<batch_id:string,score:double>>",
    )
    candidates = spark.createDataFrame([("S1", "c", 1.1, (9.0,)), ("S2", "d", 2.0, (8.0,)), ("S3", "e", 9.0, (7.0,))], "scenario string, Batch_ID string, Scenario_Score double, profile struct<y:double>")
    out = {r.scenario: r for r in golden.promote_if_better(current, candidates, "test", "2024-01-01").collect()}
    assert set(out) == {"S1", "S2"}
    assert (out["S1"].batch_id, out["S1"].profile.y, out["S1"].weights, len(out["S1"].alternatives)) == ("c", 9.0, {"w": 0.5}, 1)
    assert (out["S2"].batch_id, out["S2"].profile.y, out["S2"].promoted) == ("b", 2.5, False)
