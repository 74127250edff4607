"""Surrogates of large tables: fitted on bin combinations that hold every row."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from batchlens.operators import learning, optimum

ROWS = 6000


@pytest.fixture(scope="module")
def table(spark):
    x = F.rand(3) * 100
    df = spark.range(ROWS).select(
        F.concat(F.lit("B"), "id").alias("Batch_ID"), x.alias("Machine_Speed"), (F.col("id") % 4).cast("double").alias("Heat_Temp"), F.lit(1.0).alias("Press_Force"))
    noise = F.randn(5)
    return df.withColumns({"Yield_Percent": 90 + 3 * F.sin(F.col("Machine_Speed") / 9) + F.col("Heat_Temp") + noise * 0.1,
                           "Quality_Score": 60 + F.col("Machine_Speed") / 10 - F.col("Heat_Temp") + noise * 0.1}).cache()


def predicted(sur, df):
    out = sur.vector(df, sur.inputs)
    for t, m in sur.models.items():
        out = m.setFeaturesCol("__x").setPredictionCol(f"p_{t}").transform(out)
    return out


def test_many_rows_are_fitted_as_weighted_bin_combinations(spark, table, monkeypatch):
    rows = learning.train(table, max_iter=10)
    assert rows.cuts is None
    seen, fit = [], GBTRegressor.fit

    def spy(self, data, *more):
        seen.append((data.count(), data.agg(F.sum("__n")).first()[0] if "__n" in data.columns else None))
        return fit(self, data, *more)

    monkeypatch.setattr(GBTRegressor, "fit", spy)
    monkeypatch.setattr(learning, "CELL_ROWS", 1000)
    monkeypatch.setattr(learning, "PARTS", 8)
    sur = learning.train(table, max_iter=10)
    assert len(seen) == 2 and all(n <= 32 * 4 * 8 and weight == ROWS for n, weight in seen)
    assert sur.summary == rows.summary
    assert {c: len(t) for c, t in sur.cuts.items()} == {"Machine_Speed": 31, "Heat_Temp": 3, "Press_Force": 0}

    def errors(s):
        return predicted(s, table).agg(*[F.avg(F.pow(F.col(t) - F.col(f"p_{t}"), 2)).alias(t) for t in s.models]).first()

    for t in sur.models:
        assert errors(sur)[t] < 1.1 * errors(rows)[t]


def test_the_ensemble_of_binned_models_reads_values(spark, table, monkeypatch):
    monkeypatch.setattr(learning, "CELL_ROWS", 1000)
    sur = learning.train(table, max_iter=6)
    weights = optimum.composite_weights(sur.models)
    ensemble = optimum.flatten(spark, sur.models, weights, sur)
    ends = spark.createDataFrame([(x, 0.5, 1.0) for t in sur.cuts["Machine_Speed"] for x in (t, float(np.nextafter(t, 1e9)))], "Machine_Speed double, Heat_Temp double, Press_Force double")
    got = predicted(sur, table.select(*sur.inputs).limit(100).unionByName(ends)).collect()
    at = np.array([[r[c] for c in sur.inputs] for r in got])
    assert np.allclose(ensemble.best(at, at), [sum(w * r[f"p_{t}"] for t, w in weights.items()) for r in got])


def test_bins_of_few_values_and_of_rare_ones(spark):
    df = spark.range(3000).select(F.when(F.col("id") == 0, 7.0).otherwise(F.col("id") % 2).alias("a"), F.col("id").cast("double").alias("b"), F.lit(2.0).alias("c"))
    cuts = learning.bin_cuts(df, ["a", "b", "c"])
    assert cuts["a"] == [0.5, 4.0] and cuts["c"] == [] and len(cuts["b"]) == 31
    sizes = learning.Surrogates(["a", "b", "c"], cuts=cuts).binned(df, ["a", "b", "c"])[0].groupBy("__bin_b").count().collect()
    assert len(sizes) == 32 and all(80 <= r["count"] <= 108 for r in sizes)
