"""The bounded optimum of tree surrogates by branch and bound (L3).

A gradient-boosted model is a sum of trees, so it is constant between its split thresholds, and the composite score, linear in the
predicted KPIs, is one weighted sum of trees. Over a box of controls no tree exceeds its best leaf that the box
reaches; the sum of these is a bound, exact where no threshold cuts the box. Boxes are cut at thresholds until none
can beat the best point found. They are rows of a table: each round, every task works through its boxes best
bound first, up to a budget, and returns the open ones and its best points; the best point of each profile goes into the
next round. Each profile ends with its best point and a bound; where they meet, the point is a proven optimum.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Mapping

import numpy as np
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.constants import DEFAULT_EMISSION_FACTOR
from batchlens.operators.learning import Surrogates
from batchlens.session import ensure_checkpoint_dir, stored

#: Boxes that one task cuts in one round.
BUDGET = 3000


class Ensemble:
    """Trees as flat arrays; a node's children follow it, so a backward pass sees children first."""

    def __init__(self, feature, threshold, left, right, value, roots):
        self.feature, self.threshold = np.array(feature, np.int64), np.array(threshold, float)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.value, self.roots = np.array(value, float), np.array(roots, np.int64)

    def cuts(self, k: int) -> np.ndarray:
        return np.unique(self.threshold[self.feature == k])

    def best(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Upper bound of every box (rows of ``low`` and ``high``, ends included); for low = high the value itself. Left is <= threshold."""
        reach = np.empty((len(self.value), len(low)))
        for n in range(len(self.value) - 1, -1, -1):
            f = self.feature[n]
            if f < 0:
                reach[n] = self.value[n]
            else:
                a = np.where(low[:, f] <= self.threshold[n], reach[self.left[n]], -np.inf)
                reach[n] = np.maximum(a, np.where(high[:, f] > self.threshold[n], reach[self.right[n]], -np.inf))
        return reach[self.roots].sum(axis=0)


def flatten(spark: SparkSession, models: Mapping[str, GBTRegressionModel], weights: Mapping[str, float], sur: Surrogates | None = None) -> Ensemble:
    """The weighted sum of some models as one ensemble, read from their saved nodes (bounded by the models' size). ``sur``: the
    models' bins, if they read bin numbers; the ensemble reads values."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    for target, model in models.items():
        if not weights.get(target):
            continue
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
        model.write().save(path)
        trees: dict[int, dict[int, tuple]] = {}
        for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
            trees.setdefault(r["treeID"], {})[r["id"]] = r
        for tree, weight in enumerate(model.treeWeights):
            nodes, base = trees[tree], len(value)
            order = sorted(nodes)  # saved in pre-order: a parent's number is lower than its children's
            place = {n: base + k for k, n in enumerate(order)}
            roots.append(base)
            for n in order:
                r = nodes[n]
                inner = r["leftChild"] >= 0
                feature.append(r["split"]["featureIndex"] if inner else -1)
                at = r["split"]["leftCategoriesOrThreshold"][0] if inner else 0.0
                threshold.append(sur.threshold(r["split"]["featureIndex"], at) if inner and sur else at)
                left.append(place[r["leftChild"]] if inner else -1)
                right.append(place[r["rightChild"]] if inner else -1)
                value.append(r["prediction"] * weight * weights[target])
    return Ensemble(feature, threshold, left, right, value, roots)


def composite_weights(models, factor: float = DEFAULT_EMISSION_FACTOR) -> dict[str, float]:
    """L4 with carbon from the predicted energy, as weights of the predicted KPIs."""
    out = {"Yield_Percent": 0.30, "Quality_Score": 0.25, "Total_Energy_kWh": -0.20 / 1000.0 - 0.15 * factor / 100.0, "Eco_Efficiency_Score": 0.10}
    return {k: w for k, w in out.items() if k in models}


def _point(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low + high) / 2


def branch(ensemble: Ensemble, low: np.ndarray, high: np.ndarray, best: float, budget: int, tolerance: float = 1e-12):
    """Cut boxes (rows), best bound first, up to ``budget`` times. Best value above ``best`` and its point (or None), and the boxes
    that are still open, as (bound, low, high)."""
    lines = [ensemble.cuts(k) for k in range(low.shape[1])]
    heap, point, n = [], None, 0

    def push(lo, hi):
        nonlocal best, point, n
        bounds, middles = ensemble.best(lo, hi), _point(lo, hi)
        values = ensemble.best(middles, middles)
        k = int(values.argmax())
        if values[k] > best:
            best, point = float(values[k]), middles[k]
        for b, v, a, z in zip(bounds, values, lo, hi, strict=True):
            if b > v + tolerance:  # else no threshold matters inside: the middle is the box's optimum
                n += 1
                heapq.heappush(heap, (-float(b), n, a, z))

    push(low, high)
    while heap and budget:
        some_lo, some_hi = [], []
        while heap and budget and len(some_lo) < 64:
            bound, _, lo, hi = heapq.heappop(heap)
            if -bound <= best + tolerance:
                heap.clear()
                break
            inside = [(x[(x >= a) & (x < z)], k) for k, (x, a, z) in enumerate(zip(lines, lo, hi, strict=True))]
            cut, k = max(inside, key=lambda c: len(c[0]))
            if not len(cut):
                continue
            at = cut[len(cut) // 2]
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[k], right_lo[k] = at, np.nextafter(at, np.inf)
            some_lo += [lo, right_lo]
            some_hi += [left_hi, hi]
            budget -= 1
        if some_lo:
            push(np.array(some_lo), np.array(some_hi))
    open_ = [(-b, lo, hi) for b, _, lo, hi in heap if -b > best + tolerance]
    return best, point, open_


ROWS = "key string, bound double, low array<double>, high array<double>, value double, point array<double>"


def maximise(boxes: DataFrame, ensemble: Ensemble, budget: int = BUDGET, rounds: int = 8) -> DataFrame:
    """boxes (key, low, high) -> key, value, point, bound, certified: the maximum of the ensemble over the boxes of every
    key. ``certified``: no box is open, value = bound; else the optimum lies between value and bound."""
    spark = boxes.sparkSession
    shared = spark.sparkContext.broadcast(ensemble)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for key, some in pdf.groupby("key", sort=False):
                low, high = np.array(some["low"].tolist(), float), np.array(some["high"].tolist(), float)
                seen = some["value"].to_numpy(float, na_value=-np.inf)
                best, point, open_ = branch(shared.value, low, high, float(seen.max()), budget)
                if point is not None:
                    out.append((key, None, None, None, best, point.tolist()))
                out += [(key, b, lo.tolist(), hi.tolist(), None, None) for b, lo, hi in open_]
            yield pd.DataFrame(out, columns=["key", "bound", "low", "high", "value", "point"])

    todo, found = boxes.select("key", "low", "high", F.lit(None).cast("double").alias("value")), None
    for _ in range(rounds):
        done = stored(todo.mapInPandas(run, ROWS))
        points = done.filter("point IS NOT NULL").select("key", "value", "point")
        found = points if found is None else found.unionByName(points)
        best = stored(found.groupBy("key").agg(F.max_by("point", "value").alias("point"), F.max("value").alias("value")))
        found = best.select("key", "value", "point")
        open_ = stored(done.filter("bound IS NOT NULL").select("key", "bound", "low", "high").join(found.select("key", "value"), "key").filter("bound > value"))
        n = open_.count()
        if not n:
            break
        todo = open_.repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, n // 200))).select("key", "low", "high", "value")
    bound = open_.groupBy("key").agg(F.max("bound").alias("open_bound"))
    return found.join(bound, "key", "left").select(
        "key", "value", "point", F.coalesce("open_bound", "value").alias("bound"), F.col("open_bound").isNull().alias("certified")
    )


def bounded_optimum(profiles: DataFrame, sur: Surrogates, spread: float = 0.10, factor: float = DEFAULT_EMISSION_FACTOR, budget: int = BUDGET, rounds: int = 8) -> DataFrame:
    """L3: for the golden profile of every scenario the controls within +-``spread`` with the best predicted composite: scenario,
    golden_batch, predicted composite at the profile and at the optimum, its bound, certified, and the controls."""
    spark = profiles.sparkSession
    ensemble = flatten(spark, sur.models, composite_weights(sur.models, factor), sur)
    base = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in sur.inputs]
    ends = [(F.least(b * (1 - spread), b * (1 + spread)), F.greatest(b * (1 - spread), b * (1 + spread))) for b in base]
    boxes = stored(profiles.select(F.col("scenario").alias("key"), F.col("Batch_ID").alias("golden_batch"), F.array(*base).alias("base"),
                                   F.array(*[e[0] for e in ends]).alias("low"), F.array(*[e[1] for e in ends]).alias("high")))
    at = boxes.select("key", F.col("base").alias("low"), F.col("base").alias("high"))
    now = maximise(at, ensemble, 1, 1).select("key", F.col("value").alias("golden_value"))
    out = maximise(boxes, ensemble, budget, rounds).join(now, "key").join(boxes.select("key", "golden_batch"), "key")
    return out.select(F.col("key").alias("scenario"), "golden_batch", "golden_value", "value", "bound", "certified", *[F.col("point")[k].alias(c) for k, c in enumerate(sur.inputs)])
