"""Learning queries (rows-only checks: iterative model fitting)."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchlens.constants import DEFAULT_SCENARIOS
from batchlens.operators import golden, learning, optimum, ranking
from batchlens.plans import context
from batchlens.plans.registry import query

SCEN_INDEX = {n: i for i, n in enumerate(DEFAULT_SCENARIOS)}


def surrogates(spark, sf):
    key = context._key(spark, sf, "surrogates")
    with context._LOCK:
        hit = context._CACHE.get(key)
    if hit is not None:
        return hit
    sur = learning.train(context.features(spark, sf))
    with context._LOCK:
        context._CACHE[key] = sur
    return sur


@query("surrogate_train")
def q_surrogate_train(spark, sf):
    """L1: one GBT surrogate per KPI (controls -> KPI); which were trained."""
    sur = surrogates(spark, sf)
    rows = [(t, d, ok, sur.ready) for t, d, ok in sur.summary]
    return spark.createDataFrame(rows, "target string, n_distinct long, trained boolean, ready boolean")


def _profiles(spark, sf):
    f = context.features(spark, sf)
    top = golden.golden_signatures(f, ranking.build_targets(f, "Standard"), DEFAULT_SCENARIOS, 1)
    idx = F.create_map(*[x for n, i in SCEN_INDEX.items() for x in (F.lit(n), F.lit(i))])[F.col("scenario")]
    return learning.prepare_profiles(top.withColumn("seed_idx", idx + F.lit(42)), "seed_idx")


@query("surrogate_candidates")
def q_surrogate_candidates(spark, sf):
    """L2: 40 perturbations (+-5 %) around every scenario signature, best by composite."""
    return learning.search(_profiles(spark, sf), surrogates(spark, sf), "seed_idx", n=40, spread=0.05)


@query("surrogate_bounded")
def q_surrogate_bounded(spark, sf):
    """L3 (re-aimed): the same search inside +-10 % bounds."""
    return learning.search(_profiles(spark, sf), surrogates(spark, sf), "seed_idx", n=40, spread=0.10, id_prefix="SIM_OPT_")


@query("surrogate_optimum")
def q_surrogate_optimum(spark, sf):
    """L3 exact: the best predicted composite within +-10 % of every scenario signature, with its bound."""
    return optimum.bounded_optimum(_profiles(spark, sf), surrogates(spark, sf))
