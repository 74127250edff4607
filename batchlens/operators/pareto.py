"""Exact 6-objective Pareto front (skyline) on all rows, distributed.

Rows are compared through a grid: each objective is cut at quantiles, so a row lies in a cell, and a row can only
dominate rows of cells that are nowhere lower. A cell that lies below another in every objective dominates it
as a whole, without any comparison of rows; of the rest only cells that can dominate meet.

Stage 1 (``mapInPandas``): each partition keeps its local front. A row dominated inside its partition is
dominated globally, so this only removes losers. While the union U of local fronts is larger than
``max_broadcast_rows`` and a round still removes half of it, it is re-partitioned into fewer, larger partitions.

Stage 2: a row of U survives if no row of U dominates it. A dominator's objective sum is never larger, so U is cut into
ranges of that sum, each of at most ``max_broadcast_rows`` rows (counted; a range beyond is cut again); each range in
turn is broadcast as a grid, and the candidates of this and later ranges are tested against it. Checking only
against surviving candidates is enough: dominance is transitive, so every dominated row is dominated by some front row.
The number of row comparisons is kept (``Comparisons``).

Rows with a NULL objective neither dominate nor are dominated (as with NaN
comparisons in numpy, and SQL's unknown in an anti join): they always stay.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.constants import OBJECTIVE_DIRECTIONS, PRIMARY_OBJECTIVES
from batchlens.session import stored


def _min_form(pdf: pd.DataFrame, objectives: list[str]) -> np.ndarray:
    cols = []
    for o in objectives:
        v = pdf[o].to_numpy(dtype=float, na_value=np.nan)
        cols.append(-v if OBJECTIVE_DIRECTIONS.get(o, "max") == "max" else v)
    return np.column_stack(cols) if cols else np.zeros((len(pdf), 0))


def _dominated(cand: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each row of ``cand``: is some row of ``by`` dominating it?"""
    if by.shape[0] == 0 or cand.shape[0] == 0:
        return np.zeros(cand.shape[0], dtype=bool)
    out = np.zeros(cand.shape[0], dtype=bool)
    step = max(1, int(4_000_000 // max(1, by.shape[0] * by.shape[1])))
    for s in range(0, cand.shape[0], step):
        c = cand[s:s + step, None, :]
        leq = (by[None, :, :] <= c).all(axis=2)
        lt = (by[None, :, :] < c).any(axis=2)
        out[s:s + step] = (leq & lt).any(axis=1)
    return out


#: Rows of the lowest sums that are tried on all others first, and rows up to which no grid is made.
PIVOTS = 256
PLAIN = 2048
BINS = 4
#: Values of a partition that its quantiles are taken from (they only place the grid's lines).
PLACING = 20_000


class Grid:
    """Rows (minimisation form, no NaN) sorted by cell."""

    def __init__(self, rows: np.ndarray, lines: np.ndarray | None = None):
        if lines is None:
            step = max(1, len(rows) // PLACING)
            lines = np.quantile(rows[::step], np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
        self.lines = lines
        codes = self.codes(rows)
        order = np.lexsort(codes.T[::-1])
        self.rows, codes = rows[order], codes[order]
        new = np.append(True, (codes[1:] != codes[:-1]).any(axis=1)) if len(codes) else np.zeros(0, bool)
        self.start = np.append(np.flatnonzero(new), len(codes))
        self.cells = codes[new]
        self.compared = 0

    def codes(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(self.lines[:, k], rows[:, k], "right") for k in range(rows.shape[1])]).astype(np.int8)

    def dominated(self, cand: np.ndarray) -> np.ndarray:
        """For each row of ``cand``: does some row of the grid dominate it?"""
        out = np.zeros(len(cand), bool)
        if not len(cand) or not len(self.rows):
            return out
        codes = self.codes(cand)
        order = np.lexsort(codes.T[::-1])
        new = np.append(True, (codes[order][1:] != codes[order][:-1]).any(axis=1))
        bounds = np.append(np.flatnonzero(new), len(order))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = order[a:b]
            near = (self.cells <= codes[own[0]]).all(axis=1)
            if (self.cells[near] < codes[own[0]]).all(axis=1).any():
                out[own] = True  # a whole cell below
                continue
            alive = own
            for k in np.flatnonzero(near).tolist():
                rows = self.rows[self.start[k] : self.start[k + 1]]
                self.compared += len(alive) * len(rows)
                alive = alive[~_dominated(cand[alive], rows)]
                if not len(alive):
                    break
            out[own] = True
            out[alive] = False
        return out


def _front_mask(obj: np.ndarray, counter: list | None = None) -> np.ndarray:
    """Boolean mask of non-dominated rows (minimisation form). NaN rows kept. ``counter``: adds the comparisons of rows."""
    keep = np.ones(obj.shape[0], dtype=bool)
    idx = np.flatnonzero(~np.isnan(obj).any(axis=1))
    if idx.size == 0:
        return keep
    idx = idx[np.argsort(obj[idx].sum(axis=1), kind="stable")]
    compared, pivots = 0, obj[idx[:PIVOTS]]
    dead = _dominated(obj[idx], pivots)
    compared += len(idx) * len(pivots)
    keep[idx[dead]] = False
    rest = idx[~dead]
    if len(rest) <= PLAIN:
        left = _dominated(obj[rest], obj[rest])
        compared += len(rest) ** 2
    else:
        grid = Grid(obj[rest])
        left = grid.dominated(obj[rest])
        compared += grid.compared
    keep[rest[left]] = False
    if counter is not None:
        counter.append(compared)
    return keep


def _local_front_fn(objectives: list[str], compared=None):
    def run(batches):
        carry = None
        for pdf in batches:
            block, counter = pdf if carry is None else pd.concat([carry, pdf], ignore_index=True), []
            carry = block[_front_mask(_min_form(block, objectives), counter)].reset_index(drop=True)
            if compared is not None:
                compared.add(sum(counter))
        if carry is not None and len(carry):
            yield carry

    return run


class Comparisons:
    """Row comparisons of one run, added up over its tasks (tasks that run twice count twice)."""

    def __init__(self, spark):
        self.count = spark.sparkContext.accumulator(0)

    @property
    def value(self) -> int:
        return self.count.value


def dominated_by(u: str, v: str, objectives: list[str]) -> Column:
    """SQL predicate: row ``v`` dominates row ``u`` (NULL -> unknown -> no)."""
    better_eq, strictly = [], []
    for o in objectives:
        a, b = F.col(f"{v}.{o}"), F.col(f"{u}.{o}")
        if OBJECTIVE_DIRECTIONS.get(o, "max") == "max":
            better_eq.append(a >= b)
            strictly.append(a > b)
        else:
            better_eq.append(a <= b)
            strictly.append(a < b)
    cond = better_eq[0]
    for c in better_eq[1:]:
        cond = cond & c
    any_strict = strictly[0]
    for c in strictly[1:]:
        any_strict = any_strict | c
    return cond & any_strict


def local_fronts(df: DataFrame, objectives: list[str], compared=None) -> DataFrame:
    return df.mapInPandas(_local_front_fn(objectives, compared), schema=df.schema)


def _ranges(keyed: DataFrame, n: int, most: int) -> list[tuple[float, float]]:
    """Ranges (low, high] of the objective sum with at most ``most`` rows each, but for rows of one sum."""
    cuts = [-math.inf, math.inf]
    pieces = max(1, math.ceil(1.2 * n / most))
    if pieces > 1:
        inner = keyed.agg(F.percentile_approx("__sum", F.array(*[F.lit(k / pieces) for k in range(1, pieces)]), 100 * pieces)).first()[0] or []
        cuts = [-math.inf, *sorted(set(inner)), math.inf]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def pareto_front(
    df: DataFrame,
    id_col: str = "Batch_ID",
    objectives: list[str] | None = None,
    max_broadcast_rows: int = 100_000,
    comparisons: Comparisons | None = None,
) -> DataFrame:
    """Exact Pareto front of ``df`` (all columns kept, equal rows stay together)."""
    objectives = list(objectives or PRIMARY_OBJECTIVES)
    compared = None if comparisons is None else comparisons.count
    counted = () if compared is None else (compared,)
    u = stored(local_fronts(df, objectives, *counted))
    n = u.count()
    parts = max(1, df.rdd.getNumPartitions()) if n > max_broadcast_rows else 1
    # A round that leaves more than half shows a large front: it stays spread over the tasks for the second stage.
    before = math.inf
    while max_broadcast_rows < n <= before / 2 and (fewer := max(parts // 4, math.ceil(n / max_broadcast_rows))) < parts:
        before, parts = n, fewer
        u = stored(local_fronts(u.repartition(parts), objectives, *counted))
        n = u.count()
    if n == 0:
        return u
    forms = [-F.col(o).cast("double") if OBJECTIVE_DIRECTIONS.get(o, "max") == "max" else F.col(o).cast("double") for o in objectives]
    total = forms[0]
    for f in forms[1:]:
        total = total + f
    survivors = u.withColumn("__sum", F.nanvl(total, F.lit(None).cast("double")))
    ranges = _ranges(survivors, n, max_broadcast_rows)
    while ranges:
        low, high = ranges.pop(0)
        here = survivors.filter((F.col("__sum") > F.lit(low)) & (F.col("__sum") <= F.lit(high)))
        size = here.count()
        if size > max_broadcast_rows:
            middle = here.agg(F.percentile_approx("__sum", 0.5, 1000), F.max("__sum")).first()
            if middle[0] < middle[1]:  # cut again; rows of one sum can't dominate each other and never need a wider grid
                ranges[:0] = [(low, middle[0]), (middle[0], high)]
                continue
        survivors = _against(survivors, here, objectives, low, compared, max_broadcast_rows, size)
        if ranges:
            survivors = stored(survivors)
    return survivors.drop("__sum")


def _against(survivors: DataFrame, here: DataFrame, objectives: list[str], low: float, compared, most: int, size: int) -> DataFrame:
    """Survivors without the rows that a row of ``here`` dominates. ``here`` has at most ``most`` rows, or rows of one
    sum, which can only dominate larger sums and are tested in slices."""
    spark = survivors.sparkSession
    slices = max(1, math.ceil(size / most))
    for k in range(slices):
        part = here if slices == 1 else here.filter(F.pmod(F.xxhash64(*objectives), F.lit(slices)) == k)
        rows = part.select(*[F.col(o).cast("double").alias(o) for o in objectives]).toPandas()
        if not len(rows):
            continue
        shared = spark.sparkContext.broadcast(Grid(_min_form(rows, objectives)))

        def run(batches, shared=shared):
            grid = shared.value
            for pdf in batches:
                at = np.flatnonzero(pdf["__sum"].to_numpy(dtype=float, na_value=-np.inf) > low)
                grid.compared = 0
                dead = grid.dominated(_min_form(pdf.iloc[at], objectives))
                if compared is not None:
                    compared.add(grid.compared)
                keep = np.ones(len(pdf), bool)
                keep[at[dead]] = False
                yield pdf[keep]

        survivors = survivors.mapInPandas(run, schema=survivors.schema)
    return survivors


def proxy_topk(df: DataFrame, k: int = 300) -> DataFrame:
    """The reference's candidate cap, offered explicitly: top-k rows by
    yield/max(yield) - energy/max(energy) (ties: Batch_ID ascending)."""
    mx = df.agg(F.max("Yield_Percent").alias("my"), F.max("Total_Energy_kWh").alias("me")).first()
    my = (mx["my"] or 0.0) + 1e-9
    me = (mx["me"] or 0.0) + 1e-9
    proxy = F.col("Yield_Percent") / F.lit(my) - F.col("Total_Energy_kWh") / F.lit(me)
    return df.withColumn("__proxy", proxy).orderBy(F.col("__proxy").desc_nulls_last(), "Batch_ID").limit(k).drop("__proxy")
