"""Dashboard analytics as distributed plans.

Whole-table statistics are one aggregation pass each. Positions in Batch_ID
order come from ``ordered_index`` (range-partitioned), never from an
unpartitioned window over the data; the 3-month rolling mean is a bounded
fan-out plus ``groupBy``. The only unpartitioned window numbers a top-k result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.constants import ANALYSIS_METRICS, HISTORY_COLUMNS
from batchlens.functions.numeric import exact_avg, exact_sum, rint_dp
from batchlens.operators.ordering import ordered_index, ordered_scan
from batchlens.operators.stats import pct, stats_row

KPI5 = ["Yield_Percent", "Quality_Score", "Total_Energy_kWh", "Carbon_kg", "Eco_Efficiency_Score"]
LOWER_IS_BETTER = {"Total_Energy_kWh", "Carbon_kg"}


def analysis_metrics(df: DataFrame) -> list[str]:
    present = [c for c in ANALYSIS_METRICS if c in df.columns]
    return present or [c for c, t in df.dtypes if t in ("double", "bigint", "int")][:4]


# ----------------------------------------------------------------------- D4
def plant_average(features: DataFrame, metrics: Sequence[str] = KPI5) -> DataFrame:
    return features.agg(*[exact_avg(m).alias(m) for m in metrics])


# ----------------------------------------------------------------------- D5
def benchmark_values(features: DataFrame, golden: Mapping, metrics: Sequence[str] = KPI5) -> dict[str, dict[str, float]]:
    """Golden (profile value, missing -> median), top-10 % (quantile .9, or .1
    where lower is better) and median, from one aggregation pass."""
    aggs = []
    for m in metrics:
        aggs += [pct(m, 0.5).alias(f"med_{m}"), pct(m, 0.1 if m in LOWER_IS_BETTER else 0.9).alias(f"top_{m}"), F.count(m).alias(f"n_{m}")]
    st = stats_row(features, aggs)
    out = {}
    for m in metrics:
        if st[f"n_{m}"] == 0:
            out[m] = {"Golden": 0.0, "Top10": 0.0, "Median": 0.0}
            continue
        g = golden.get(m)
        gv = st[f"med_{m}"] if g is None else float(g)
        out[m] = {"Golden": float(gv), "Top10": float(st[f"top_{m}"]), "Median": float(st[f"med_{m}"])}
    return out


def benchmark_profile(features: DataFrame, golden: Mapping, metrics: Sequence[str] = KPI5) -> DataFrame:
    vals = benchmark_values(features, golden, metrics)
    rows = [(m, v["Golden"], v["Top10"], v["Median"]) for m, v in vals.items()]
    return features.sparkSession.createDataFrame(rows, "Metric string, Golden double, Top10 double, Median double")


# ----------------------------------------------------------------------- D6
def monthly_energy(features: DataFrame, start: str = "2024-01-01 00:00:00", keep_last: int = 30) -> DataFrame:
    """Batches in Batch_ID order get dates every max(1, 25920 // n) hours from
    ``start``; energy summed per month with empty months = 0; 3-month rolling
    mean (min 1); the last ``keep_last`` months."""
    n = features.count()
    step = max(1, 25920 // max(n, 1))
    idx = ordered_index(features.select("Batch_ID", "Total_Energy_kWh"), ["Batch_ID"], "i")
    ts = F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("i") * F.lit(step))
    monthly = idx.groupBy(F.date_trunc("month", ts).cast("date").alias("m")).agg(exact_sum("Total_Energy_kWh").alias("e"))
    # months as numbers from the first one on: at many batches the dates run past any calendar of the driver
    first = F.trunc(F.lit(start).cast("date"), "month")
    number = ((F.year("m") - F.year(first)) * 12 + F.month("m") - F.month(first)).cast("int")
    rng = monthly.agg(F.min(number).alias("m0"), F.max(number).alias("m1")).first()
    if rng["m0"] is None:
        return features.sparkSession.createDataFrame([], "Month string, Energy_kWh double, Rolling_3M_kWh double")
    spine = features.sparkSession.range(rng["m0"], rng["m1"] + 1).select(F.add_months(first, F.col("id").cast("int")).alias("m"))
    full = spine.join(monthly, on="m", how="left").select("m", F.coalesce(F.col("e"), F.lit(0.0)).alias("Energy_kWh"))
    # 3-month rolling mean without an unpartitioned window: every month feeds
    # itself and the next two months (bounded 3x fan-out), grouped by target.
    last_m = F.add_months(first, F.lit(rng["m1"]))
    fan = full.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"), "m", "Energy_kWh")
    fan = fan.withColumn("t", F.add_months("m", F.col("k"))).filter(F.col("t") <= last_m)
    rolled = fan.groupBy(F.col("t").alias("m")).agg(
        F.max(F.when(F.col("k") == 0, F.col("Energy_kWh"))).alias("Energy_kWh"),
        rint_dp(exact_avg("Energy_kWh"), 6).alias("Rolling_3M_kWh"),
    )
    last = rolled.orderBy(F.col("m").desc()).limit(keep_last)
    return last.select(F.date_format("m", "yyyy-MM-dd").alias("Month"), "Energy_kWh", "Rolling_3M_kWh")


# ----------------------------------------------------------------------- D7
def corr_expr(a: str, b: str) -> Column:
    """Pearson correlation on pair-complete rows (one moment aggregate); undefined -> 0.0."""
    r = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
    return F.coalesce(F.nanvl(rint_dp(r, 9), F.lit(0.0)), F.lit(0.0))


def corr_matrix(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long form (Metric_A, Metric_B, Corr) over the upper triangle, the lower half mirrored, on pair-complete rows. A first
    pass takes the columns' means; in a second one every row adds its pairs of centred values to narrow sums per
    pair, combined in the tasks (one wide aggregate of all pairs is too long a method to be compiled). A column that is constant
    on a pair's rows correlates with nothing, itself included (0.0)."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in metrics])
    first = d.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(metrics)]).first()
    centred = [F.col(c) - F.lit(first[f"m{i}"] or 0.0) for i, c in enumerate(metrics)]
    pairs = [(i, j) for i in range(len(metrics)) for j in range(i, len(metrics))]
    cells = F.array(*[F.struct(F.lit(k).alias("k"), centred[i].alias("a"), centred[j].alias("b")) for k, (i, j) in enumerate(pairs)])
    long = d.select(F.explode(cells).alias("x")).select("x.*").filter("a IS NOT NULL AND b IS NOT NULL")
    sums = long.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("a")).alias("aa"),
        F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("a") * F.col("b")).alias("ab"),
        *[f(c).alias(f"{n}{c}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))],
    )
    value = dict.fromkeys(pairs, 0.0)
    for r in sums.collect():  # one row a pair
        va, vb = r["aa"] - r["sa"] ** 2 / r["n"], r["bb"] - r["sb"] ** 2 / r["n"]
        if r["loa"] < r["hia"] and r["lob"] < r["hib"] and va > 0 and vb > 0:
            value[pairs[r["k"]]] = rint9((r["ab"] - r["sa"] * r["sb"] / r["n"]) / (math.sqrt(va) * math.sqrt(vb)))
    rows = [(metrics[x], metrics[y], float(v)) for (i, j), v in value.items() for x, y in dict.fromkeys(((i, j), (j, i)))]
    return df.sparkSession.createDataFrame(rows, "Metric_A string, Metric_B string, Corr double")


# ----------------------------------------------------------------------- D8
def score_summary(scores: DataFrame, col: str = "Scenario_Score") -> DataFrame:
    sd = F.stddev_samp(col)
    return scores.agg(
        F.count(col).alias("n"),
        exact_avg(col).alias("mean_score"),
        rint_dp(sd, 9).alias("sd_score"),
        rint_dp(F.greatest(F.lit(0.0), F.lit(100.0) - sd * F.lit(2.0)), 9).alias("confidence"),
    )


# ----------------------------------------------------------------------- D9
def window_summary(features: DataFrame) -> DataFrame:
    """Latest energy (by Batch_ID), mean of all earlier batches, sample sd and
    stability class, temperature range, yield-quality correlation class."""
    last_id = stats_row(features, [F.max("Batch_ID").alias("m")])["m"]
    earlier = F.when(F.col("Batch_ID") != F.lit(last_id), F.col("Total_Energy_kWh"))
    sd = F.stddev_samp("Total_Energy_kWh")
    yq = corr_expr("Yield_Percent", "Quality_Score")
    out = features.agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("Total_Energy_kWh", "Batch_ID").alias("energy_latest"),
        exact_avg(earlier).alias("energy_prev_mean"),
        rint_dp(sd, 9).alias("energy_sd"),
        F.min("Avg_Temperature").alias("temp_min"),
        exact_avg("Avg_Temperature").alias("temp_mean"),
        F.max("Avg_Temperature").alias("temp_max"),
        yq.alias("yield_quality_corr"),
    )
    return out.withColumns(
        {
            "energy_prev_mean": F.coalesce(F.col("energy_prev_mean"), F.col("energy_latest")),
            "stability": F.when(F.coalesce(F.col("energy_sd"), F.lit(0.0)) < 4, F.lit("stable")).otherwise(F.lit("needs tighter control")),
            "alignment": F.when(F.col("yield_quality_corr") >= 0.6, F.lit("strongly aligned"))
            .when(F.col("yield_quality_corr") >= 0.3, F.lit("moderately aligned")).otherwise(F.lit("weakly aligned")),
        }
    )


# ----------------------------------------------------------------------- W6
def rolling_means(readings: DataFrame, batch_col: str, order: Sequence[str], cols: Sequence[str], min_width: int = 5, divisor: int = 50) -> DataFrame:
    """Per batch, rolling mean (min 1 value) over the last
    w = max(min_width, n // divisor) rows, n = the batch's row count.

    Batches shorter than ``min_width * divisor`` rows all have w = min_width:
    they use an ordinary per-batch window with a constant frame (each such
    window partition is small by construction). Longer batches, where w varies
    and one batch may be huge, use the skew-safe ordered scan: running sums and
    non-NULL counts, with the value w rows back fetched by an equi-join on
    (batch, position), which is unique and therefore skew-free."""
    big = min_width * divisor
    sizes = readings.groupBy(batch_col).agg(F.count(F.lit(1)).alias("__n"))
    sized = readings.join(sizes, on=batch_col)
    small = sized.filter(F.col("__n") < big)
    w = Window.partitionBy(batch_col).orderBy(*[F.col(o) for o in order])
    frame = w.rowsBetween(-(min_width - 1), 0)
    small_out = small.select(
        *readings.columns,
        F.row_number().over(w).cast("bigint").alias("pos"),
        *[rint_dp(F.avg(F.col(c).cast("double")).over(frame), 6).alias(f"{c}_Roll") for c in cols],
    )
    if sizes.filter(F.col("__n") >= big).limit(1).count() == 0:
        return small_out  # no long batch: skip the ordered-scan path entirely
    large = sized.filter(F.col("__n") >= big).drop("__n")
    return small_out.unionByName(_rolling_scan(large, batch_col, order, cols, min_width, divisor))


def _rolling_scan(readings: DataFrame, batch_col: str, order: Sequence[str], cols: Sequence[str], min_width: int, divisor: int) -> DataFrame:
    sums = {}
    for c in cols:
        sums[f"cs_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        sums[f"cc_{c}"] = F.col(c).isNotNull().cast("double")
    scanned = ordered_scan(readings, [batch_col], [F.col(o) for o in order], sums=sums, pos_col="pos")
    sizes = scanned.groupBy(batch_col).agg(F.max("pos").alias("n"))
    s = scanned.join(sizes, on=batch_col).withColumn("w", F.greatest(F.lit(min_width), F.floor(F.col("n") / F.lit(divisor))))
    back = s.select(F.col(batch_col).alias("__b"), F.col("pos").alias("__p"), *[F.col(k).alias(f"b_{k}") for k in sums])
    j = s.join(back, (F.col(batch_col) == F.col("__b")) & (F.col("__p") == F.col("pos") - F.col("w")), "left")
    out = {}
    for c in cols:
        tot = F.col(f"cs_{c}") - F.coalesce(F.col(f"b_cs_{c}"), F.lit(0.0))
        cnt = F.col(f"cc_{c}") - F.coalesce(F.col(f"b_cc_{c}"), F.lit(0.0))
        out[f"{c}_Roll"] = rint_dp(F.try_divide(tot, F.when(cnt > 0, cnt)), 6)
    return j.select(*readings.columns, F.col("pos").cast("bigint").alias("pos"), *[v.alias(k) for k, v in out.items()])


# ------------------------------------------------------------------- W9-W11
def energy_stats(features: DataFrame, col: str = "Total_Energy_kWh") -> dict:
    return stats_row(features, [exact_avg(col).alias("mean"), F.stddev_pop(col).alias("sd"), F.count(col).alias("n")])


def zscore_flags(features: DataFrame, z: float = 2.2, col: str = "Total_Energy_kWh") -> DataFrame:
    """|x - mean| / population sd >= z; sd 0 or undefined -> no flags."""
    st = energy_stats(features, col)
    if st["sd"] is None or st["sd"] == 0:
        return features.withColumns({"z_score": F.lit(None).cast("double"), "Energy_Anomaly": F.lit(False)})
    zc = F.abs(F.col(col) - F.lit(st["mean"])) / F.lit(st["sd"])
    return features.withColumns({"z_score": rint_dp(zc, 6), "Energy_Anomaly": F.coalesce(zc >= F.lit(float(z)), F.lit(False))})


def control_limits(features: DataFrame, z: float = 2.2, col: str = "Total_Energy_kWh") -> DataFrame:
    st = energy_stats(features, col)
    mean, sd = st["mean"], st["sd"] or 0.0
    upper, lower = (None, None) if mean is None else (mean + sd * z, mean - sd * z)
    agg = features.agg(
        F.count_if(F.col(col) > F.lit(upper)).alias("n_above"),
        F.count_if(F.col(col) < F.lit(lower)).alias("n_below"),
    ).first()
    spark = features.sparkSession
    return spark.createDataFrame(
        [(rint9(mean), rint9(upper), rint9(lower), int(agg["n_above"]), int(agg["n_below"]))],
        "mean double, upper double, lower double, n_above bigint, n_below bigint",
    )


def rint9(x):
    if x is None:
        return None
    import numpy as np

    return float(np.rint(x * 1e9) / 1e9)


def top_anomalies(features: DataFrame, z: float = 2.2, k: int = 10) -> DataFrame:
    flagged = zscore_flags(features, z).filter("Energy_Anomaly")
    return flagged.orderBy(F.col("Total_Energy_kWh").desc(), "Batch_ID").limit(k).select(
        "Batch_ID", "Total_Energy_kWh", "Quality_Score", "Yield_Percent", "Carbon_kg"
    )


# ----------------------------------------------------------------------- W8, R1
def lookback(features: DataFrame, n: int = 80, cols: Sequence[str] = HISTORY_COLUMNS) -> DataFrame:
    """Last ``n`` batches by Batch_ID (a top-k: TakeOrderedAndProject), numbered
    1..n oldest first. The numbering window runs over at most n rows."""
    last = features.select(*cols).orderBy(F.col("Batch_ID").desc()).limit(n)
    return last.withColumn("Batch_Seq", F.row_number().over(Window.orderBy("Batch_ID")).cast("bigint"))


def metric_long(features: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Melt to (Batch_Seq, Metric, Value), Batch_Seq = 1-based position by Batch_ID."""
    idx = ordered_index(features.select("Batch_ID", *metrics), ["Batch_ID"], "Batch_Seq")
    wide = idx.select((F.col("Batch_Seq") + F.lit(1)).alias("Batch_Seq"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot("Batch_Seq", list(metrics), "Metric", "Value")
