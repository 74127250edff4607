"""Series of machines over real time: z-scores per machine and over a rolling time range (W9), calendar months.

A machine may hold a third of all rows, so no window covers a whole machine: rolling ranges run over (machine, time
bucket), where a row near a bucket's end is also context of the next bucket, and everything else is pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.functions.numeric import exact_sum, rint_dp
from batchlens.operators.sessions import clean_machine, epoch_micros
from batchlens.session import stored

#: A spread below this is that of equal values.
NO_SPREAD = 1e-9


def _flags(z: Column, threshold: float) -> Column:
    return F.coalesce(z >= F.lit(float(threshold)), F.lit(False))


def _z(x: Column, mean: Column, sd: Column) -> Column:
    """|x - mean| / sd; NULL without a value or a spread."""
    return F.when(sd > NO_SPREAD, F.abs(x - mean) / sd)


def machine_moments(readings: DataFrame, value: str, machine: str = "machine_id") -> DataFrame:
    """machine, n, mean and population sd of the values of every machine (partial sums per task, one row each)."""
    x = F.col(value).cast("double")
    return readings.groupBy(clean_machine(F.col(machine)).alias("__m")).agg(F.count(x).alias("__n"), F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__sd"))


def rolling_zscores(
    readings: DataFrame,
    value: str,
    minutes: float,
    z: float,
    ts_col: str = "timestamp",
    machine: str = "machine_id",
    bucket_minutes: float | None = None,
) -> DataFrame:
    """Adds z_machine and flag_machine (against all values of the row's machine) and z_rolling, n_rolling and flag_rolling (against
    the machine's values of the last ``minutes``, the row and rows of the same time included). Values are
    centred by the machine's mean first. ``bucket_minutes`` (at least ``minutes``, twice that by default) is the span
    of one window partition. NULL values and spreads of zero give NULL and no flag; rows without a time have no rolling
    score; NULL machines count as ``M01``. The other columns stay as they are."""
    frame = int(minutes * 60_000_000)
    span = int((bucket_minutes or 2 * minutes) * 60_000_000)
    if span < frame:
        raise ValueError("a bucket must be at least as long as the frame")
    own = readings.columns
    d = readings.withColumns({"__m": clean_machine(F.col(machine)), "__us": epoch_micros(ts_col), "__x": F.col(value).cast("double")})
    moments = machine_moments(readings, value, machine)
    d = d.join(moments, "__m").withColumn("__c", F.col("__x") - F.col("__mean"))
    zm = _z(F.col("__c"), F.lit(0.0), F.col("__sd"))
    d = d.withColumns({"z_machine": rint_dp(zm, 6), "flag_machine": _flags(zm, z)})
    b = F.floor(F.col("__us") / F.lit(span)).cast("long")
    reach = F.when(F.col("__us") + F.lit(frame) >= (b + 1) * F.lit(span), F.array(b, b + 1)).otherwise(F.array(b))
    copies = d.filter("__us IS NOT NULL").withColumns({"__own": b, "__to": F.explode(reach)})
    w = Window.partitionBy("__m", "__to").orderBy("__us").rangeBetween(-frame, Window.currentRow)
    scored = copies.withColumns({"n_rolling": F.count("__c").over(w), "__rm": F.avg("__c").over(w), "__rs": F.stddev_pop("__c").over(w)})
    zr = _z(F.col("__c"), F.col("__rm"), F.col("__rs"))
    scored = scored.filter("__own = __to").withColumns({"z_rolling": rint_dp(zr, 6), "flag_rolling": _flags(zr, z)})
    cols = [*own, "z_machine", "flag_machine", "n_rolling", "z_rolling", "flag_rolling"]
    none = d.filter("__us IS NULL").withColumns({"n_rolling": F.lit(0).cast("long"), "z_rolling": F.lit(None).cast("double"), "flag_rolling": F.lit(False)})
    return scored.select(*cols).unionByName(none.select(*cols))


def monthly_series(readings: DataFrame, value: str, ts_col: str = "timestamp", machine: str = "machine_id", width: int = 3) -> DataFrame:
    """machine_id, Month, n_readings, Energy_kWh, Rolling_kWh: the sum of every machine and calendar month of event time from the
    table's first month to its last. Months without readings are there with 0, also at a machine's ends; the rolling mean takes
    the last ``width`` months that there are. Rows without a time are left out, NULL values add nothing."""
    month = F.date_trunc("month", F.col(ts_col)).cast("date")
    sums = stored(readings.filter(F.col(ts_col).isNotNull()).groupBy(clean_machine(F.col(machine)).alias("machine_id"), month.alias("m")).agg(
        F.count(F.lit(1)).alias("n_readings"), exact_sum(value).alias("e")))
    ends = sums.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))  # one row
    months = F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))
    spine = sums.select("machine_id").distinct().crossJoin(F.broadcast(ends)).select("machine_id", F.explode(months).alias("m"))
    full = spine.join(sums, ["machine_id", "m"], "left").select(
        "machine_id", "m", F.coalesce("n_readings", F.lit(0)).alias("n_readings"), F.coalesce("e", F.lit(0.0)).alias("Energy_kWh")
    )
    w = Window.partitionBy("machine_id").orderBy("m").rowsBetween(1 - width, 0)  # one row per month
    rolled = rint_dp(F.avg("Energy_kWh").over(w), 6)
    return full.select("machine_id", F.date_format("m", "yyyy-MM-dd").alias("Month"), "n_readings", "Energy_kWh", rolled.alias("Rolling_kWh"))
