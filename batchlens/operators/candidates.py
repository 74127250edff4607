"""Candidate generation and scoring around golden profiles.

Random offsets come from a seeded linear-congruential draw on integers
(identical on every executor and reproducible in SQL), never from the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.constants import BASELINE_DEFAULTS, DEFAULT_EMISSION_FACTOR
from batchlens.functions.numeric import rint_dp
from batchlens.functions.zones import zone_candidate
from batchlens.operators.ordering import ordered_scan
from batchlens.operators.stats import pct, stats_row

LCG_A = 1103515245
LCG_C = 12345
LCG_M = 2147483648


def uniform(seed: Column, draw: int, lo: float, hi: float) -> Column:
    """Deterministic U(lo, hi) from an integer seed column and a draw index."""
    x = (seed * F.lit(LCG_A) + F.lit(LCG_C + 7919 * draw)) % F.lit(LCG_M)
    x = (x * F.lit(LCG_A) + F.lit(LCG_C)) % F.lit(LCG_M)
    return F.lit(float(lo)) + (x.cast("double") / F.lit(float(LCG_M))) * F.lit(float(hi - lo))


def composite_score(df: DataFrame) -> Column:
    """L4: .30 yield + .25 quality - .20 energy/1000 - .15 carbon/100 + .10 eco."""
    def g(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)

    return (
        F.lit(0.30) * g("Yield_Percent")
        + F.lit(0.25) * g("Quality_Score")
        - F.lit(0.20) * g("Total_Energy_kWh") / F.lit(1000.0)
        - F.lit(0.15) * g("Carbon_kg") / F.lit(100.0)
        + F.lit(0.10) * g("Eco_Efficiency_Score")
    )


def random_candidates(profiles: DataFrame, seed_col: str, emission_factor: float = DEFAULT_EMISSION_FACTOR, seed: int = 42) -> DataFrame:
    """One bounded random improvement per golden profile row."""
    s = F.col(seed_col).cast("bigint") + F.lit(seed)

    def g(c, d):
        return F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in profiles.columns else F.lit(d)

    y = rint_dp(g("Yield_Percent", 85.0) + uniform(s, 1, 0.2, 1.2), 2)
    q = rint_dp(g("Quality_Score", 70.0) + uniform(s, 2, 0.4, 1.8), 2)
    p = rint_dp(g("Performance_Score", 60.0) + uniform(s, 3, 0.3, 1.5), 2)
    e = rint_dp(g("Total_Energy_kWh", 100.0) * (F.lit(1.0) - uniform(s, 4, 0.025, 0.09)), 3)
    c = rint_dp(e * F.lit(float(emission_factor)), 3)
    dt = rint_dp(F.greatest(F.lit(1.0), g("Drying_Time", 10.0) - uniform(s, 5, 0.5, 2.5)), 2)
    dtemp = rint_dp(g("Drying_Temp", 80.0) - uniform(s, 6, 0.2, 1.8), 2)
    spd = rint_dp(g("Machine_Speed", 200.0) + uniform(s, 7, 1.0, 8.0), 2)
    base_e = F.greatest(F.lit(1.0), g("Total_Energy_kWh", 1.0))
    base_c = F.greatest(F.lit(1.0), g("Carbon_kg", 1.0))
    base_t = F.greatest(F.lit(1.0), F.col("Drying_Time").cast("double") if "Drying_Time" in profiles.columns else dt)
    eco = (
        F.lit(0.40) * (y / F.lit(100.0))
        + F.lit(0.15) * (q / F.lit(100.0))
        + F.lit(0.20) * F.greatest(F.lit(0.0), F.lit(1.0) - e / base_e)
        + F.lit(0.15) * F.greatest(F.lit(0.0), F.lit(1.0) - c / base_c)
        + F.lit(0.10) * F.greatest(F.lit(0.0), F.lit(1.0) - dt / base_t)
    ) * F.lit(100.0)
    eco = rint_dp(F.greatest(F.lit(0.0), F.least(F.lit(100.0), eco)), 2)
    out = profiles.select(
        "*",
        y.alias("c_Yield_Percent"), q.alias("c_Quality_Score"), p.alias("c_Performance_Score"),
        e.alias("c_Total_Energy_kWh"), c.alias("c_Carbon_kg"), dt.alias("c_Drying_Time"),
        dtemp.alias("c_Drying_Temp"), spd.alias("c_Machine_Speed"), eco.alias("c_Eco_Efficiency_Score"),
    )
    return out.withColumn("c_Green_Zone", zone_candidate("c_Eco_Efficiency_Score"))


def baseline_fill(features: DataFrame, emission_factor: float = DEFAULT_EMISSION_FACTOR, order: Sequence[str] | None = None) -> DataFrame:
    """Complete a partial feature table: batch ids by ``order`` (all columns
    unless given) when that column is missing; defaults for missing columns and
    NULL cells; carbon = energy x factor when every carbon value is <= 0;
    performance from quality/yield/health when entirely missing; zone split
    at the median eco score (>= median Green, else Yellow)."""
    if "Batch_ID" not in features.columns:
        numbered = ordered_scan(features, [], order or features.columns, pos_col="Batch_ID")
        features = numbered.withColumn("Batch_ID", F.format_string("BATCH_%04d", "Batch_ID"))
    given = {c: F.col(c).try_cast("double") if c in features.columns else F.lit(None).cast("double") for c in BASELINE_DEFAULTS}
    performance = given.pop("Performance_Score")
    f = features.withColumns({c: F.coalesce(x, F.lit(BASELINE_DEFAULTS[c])) for c, x in given.items()})
    st = stats_row(f, [F.count_if(F.col("Carbon_kg") > 0).alias("pos_carbon"), F.count(performance).alias("performance"), pct("Eco_Efficiency_Score", 0.5).alias("med_eco")])
    if st["pos_carbon"] == 0:
        f = f.withColumn("Carbon_kg", F.col("Total_Energy_kWh") * F.lit(float(emission_factor)))
    if st["performance"]:
        f = f.withColumn("Performance_Score", F.coalesce(performance, F.lit(BASELINE_DEFAULTS["Performance_Score"])))
    else:
        f = f.withColumn("Performance_Score", F.lit(0.4) * F.col("Quality_Score") + F.lit(0.35) * F.col("Yield_Percent") + F.lit(0.25) * F.col("Process_Health_Score"))
    if "Green_Zone" not in features.columns:
        f = f.withColumn("Green_Zone", F.when(F.col("Eco_Efficiency_Score") >= F.lit(float(st["med_eco"])), F.lit("Green")).otherwise(F.lit("Yellow")))
    return f
