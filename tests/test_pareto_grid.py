"""The skyline through a grid: exact on fronts of any shape, and far fewer comparisons than pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchlens.constants import OBJECTIVE_DIRECTIONS, PRIMARY_OBJECTIVES
from batchlens.operators import pareto


def plain(obj):
    """Rows that no other row dominates, by all pairs."""
    out = np.ones(len(obj), bool)
    for k, row in enumerate(obj):
        if not np.isnan(row).any():
            out[k] = not ((obj <= row).all(axis=1) & (obj < row).any(axis=1)).any()
    return out


def shapes(rng, n, d):
    anti = rng.dirichlet(np.ones(d), n)  # every sum is 1: nearly all rows are on the front
    yield anti
    yield anti + rng.uniform(0, 0.05, (n, 1))
    yield rng.uniform(0, 1, (n, d))
    yield rng.integers(0, 4, (n, d)).astype(float)  # ties in every objective, repeated rows
    yield np.repeat(rng.uniform(0, 1, (max(1, n // 50), d)), 50, axis=0)
    some = rng.uniform(0, 1, (n, d))
    some[rng.uniform(0, 1, (n, d)) < 0.02] = np.nan
    yield some


@pytest.mark.parametrize("d", [1, 2, 6])
def test_front_mask_is_exact(monkeypatch, d):
    monkeypatch.setattr(pareto, "PIVOTS", 5)
    monkeypatch.setattr(pareto, "PLAIN", 20)
    rng = np.random.default_rng(d)
    for n in (1, 7, 900):
        for obj in shapes(rng, n, d):
            assert (pareto._front_mask(obj) == plain(obj)).all()
    grid = pareto.Grid(np.zeros((0, d)), np.zeros((3, d)))
    assert not grid.dominated(rng.uniform(0, 1, (5, d))).any()


def test_few_comparisons_on_a_large_front():
    rng = np.random.default_rng(9)
    obj, counter = rng.dirichlet(np.ones(6), 20_000), []
    mask = pareto._front_mask(obj, counter)
    assert mask.sum() > 19_000 and counter[0] < 0.05 * mask.sum() ** 2


@pytest.mark.parametrize("most", [100, 100_000])
def test_distributed_front_is_exact(spark, most):
    rng = np.random.default_rng(3)
    for obj in shapes(rng, 600, 6):
        signed = obj * np.array([-1.0 if OBJECTIVE_DIRECTIONS[o] == "max" else 1.0 for o in PRIMARY_OBJECTIVES])
        rows = [(f"B{k}", *[None if np.isnan(x) else float(x) for x in r]) for k, r in enumerate(signed)]
        df = spark.createDataFrame(rows, "Batch_ID string, " + ", ".join(f"{o} double" for o in PRIMARY_OBJECTIVES)).repartition(5)
        counted = pareto.Comparisons(spark)
        got = {r.Batch_ID for r in pareto.pareto_front(df, max_broadcast_rows=most, comparisons=counted).collect()}
        assert got == {f"B{k}" for k in np.flatnonzero(plain(obj))} and counted.value > 0
    assert pareto.pareto_front(df.limit(0)).count() == 0
    same = df.limit(1).crossJoin(spark.range(300)).withColumn("Batch_ID", F.col("id").cast("string")).drop("id")
    assert pareto.pareto_front(same, max_broadcast_rows=most).count() == 300  # equal rows all stay
