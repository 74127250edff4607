"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


EDGES_PER_TASK = 300_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b: long) to (node, label): label is the smallest node of the component. Nodes without
    edges don't appear. Each round points neighbours at the smallest one they know: first the larger
    neighbours of every node, then the smaller ones; a hub's edges are spread by the split of skewed joins,
    and minima are pre-aggregated. A chain of n nodes takes about log n rounds."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = _state(now)
    while state[0]:
        tasks = 1 + state[0] // EDGES_PER_TASK  # few edges: few tasks and files per round
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct().coalesce(tasks))
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(below.select("a", F.col("m").alias("b")))
        after = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().coalesce(tasks))
        drop_materialized(large)
        drop_materialized(now)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
