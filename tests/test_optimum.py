"""Branch and bound over tree ensembles against every cell of the threshold grid."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchlens.operators import learning, optimum


def cells(ensemble, low, high):
    """Best value over one point of every cell that the thresholds cut out of the box."""
    axes = []
    for k in range(len(low)):
        inner = [t for t in ensemble.cuts(k) if low[k] <= t < high[k]]
        ends = [low[k], *[np.nextafter(t, np.inf) for t in inner]]
        axes.append(ends)
    points = np.array(list(product(*axes)))
    return float(ensemble.best(points, points).max())


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(50, 150, (400, 3))
    rows = [(f"B{k:03d}", *map(float, r), float(90 + 3 * np.sin(r[0] / 9) + (r[1] > 100) * 2), float(60 + np.cos(r[2] / 7) * 5 + r[0] / 50), float(200 - r[1] / 3 + 10 * np.sin(r[2] / 5))) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "Batch_ID string, Machine_Speed double, Heat_Temp double, Press_Force double, Yield_Percent double, Quality_Score double, Total_Energy_kWh double")
    return df, learning.train(df, max_iter=6)


def test_ensemble_predicts_as_the_models(spark, trained):
    df, sur = trained
    weights = optimum.composite_weights(sur.models)
    assert set(weights) == {"Yield_Percent", "Quality_Score", "Total_Energy_kWh"}
    ensemble = optimum.flatten(spark, sur.models, weights)
    from pyspark.ml.feature import VectorAssembler

    out = VectorAssembler(inputCols=sur.inputs, outputCol="__x").transform(df.limit(50))
    for t, m in sur.models.items():
        out = m.setFeaturesCol("__x").setPredictionCol(f"p_{t}").transform(out)
    got = out.collect()
    at = np.array([[r[c] for c in sur.inputs] for r in got])
    want = [sum(w * r[f"p_{t}"] for t, w in weights.items()) for r in got]
    assert np.allclose(ensemble.best(at, at), want)


def test_never_below_the_grid_and_certified(spark, trained):
    df, sur = trained
    ensemble = optimum.flatten(spark, sur.models, optimum.composite_weights(sur.models))
    boxes = [("a", [60.0, 60.0, 60.0], [90.0, 90.0, 90.0]), ("b", [50.0, 50.0, 50.0], [150.0, 150.0, 150.0]), ("c", [100.0, 100.0, 100.0], [100.0, 100.0, 100.0])]
    frame = spark.createDataFrame(boxes, "key string, low array<double>, high array<double>")
    want = {k: cells(ensemble, lo, hi) for k, lo, hi in boxes}
    for budget, rounds in ((3000, 8), (20, 200)):  # in one round, and handed on over many rounds and tasks
        got = {r.key: r for r in optimum.maximise(frame, ensemble, budget, rounds).collect()}
        for k, lo, hi in boxes:
            assert got[k].certified and abs(got[k].value - want[k]) < 1e-9 and abs(got[k].bound - got[k].value) < 1e-9
            at = np.array([got[k].point])
            assert (at >= lo).all() and (at <= hi).all() and abs(ensemble.best(at, at)[0] - want[k]) < 1e-9
        if budget == 20:
            break
    early = {r.key: r for r in optimum.maximise(frame, ensemble, 2, 1).collect()}
    for k in want:  # stopped early: the bound still holds
        assert early[k].value <= want[k] + 1e-9 <= early[k].bound + 2e-9
    assert not early["b"].certified and early["c"].certified


def test_bounded_optimum_of_profiles(spark, trained):
    df, sur = trained
    top = df.limit(2).withColumn("scenario", F.concat(F.lit("S"), F.col("Batch_ID")))
    got = optimum.bounded_optimum(top, sur).collect()
    base = {r.Batch_ID: r for r in top.collect()}
    assert len(got) == 2
    for r in got:
        assert r.certified and r.value >= r.golden_value
        for c in sur.inputs:
            assert 0.9 * base[r.golden_batch][c] - 1e-9 <= r[c] <= 1.1 * base[r.golden_batch][c] + 1e-9
