"""The per-batch aggregate: phases counted beside the wide aggregate, not inside it."""

import re

from batchlens.operators import features as feat


def _readings(spark):
    rows = [("b1", "A", 1.0), ("b1", "A", 2.0), ("b1", "B", None), ("b2", None, 4.0), ("b2", None, 5.0), ("b3", "A", 6.0), ("b3", None, 7.0), (None, "A", 8.0)]
    df = spark.createDataFrame(rows, "Batch_ID string, Phase string, v double")
    return df.select("Batch_ID", "Phase", *[df.v.alias(c) for c in feat.PROCESS_NUMERIC])


def test_wide_aggregate_is_keyed_by_batch_alone(spark):
    plan = feat.process_agg(_readings(spark))._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if re.search(r"keys=\[[^\]]*Phase", line)]
    assert keyed and not any("sum(" in line or "max(" in line for line in keyed)


def test_phase_counts_of_nulls_and_repeats(spark):
    df = _readings(spark)
    got = {r["Batch_ID"]: r for r in feat.process_agg(df).collect()}
    assert {k: r["Phase_Count"] for k, r in got.items()} == {"b1": 2, "b2": 0, "b3": 1}
    assert {k: r["Data_Points"] for k, r in got.items()} == {"b1": 2, "b2": 2, "b3": 2}
    assert feat.process_agg(df).columns == ["Batch_ID", *feat.PROCESS_FEATURES]
    assert {r["Phase_Count"] for r in feat.process_agg(df.drop("Phase")).collect()} == {1}
