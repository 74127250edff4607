"""Standard 10-column schema and the adapters around it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.constants import DEFAULT_EMISSION_FACTOR, STANDARD_SCHEMA
from batchlens.functions.numeric import clip_keep_null, exact_avg, exact_sum, rint_dp, to_double
from batchlens.functions.zones import zone_candidate
from batchlens.operators.ordering import ordered_index
from batchlens.operators.schema_map import resolve_standard
from batchlens.operators.sessions import parse_timestamp, zfill4
from batchlens.operators.stats import pct, stats_row

NUMERIC = [c for c in STANDARD_SCHEMA if c not in ("timestamp", "batch_id")]


def normalize_to_standard(
    df: DataFrame, as_of: str, order_col: str | None = None,
    emission_factor: float = DEFAULT_EMISSION_FACTOR, source_tag: str = "unknown",
) -> DataFrame:
    """G1: map -> ids (GEN_0001.. in row order when all missing) -> timestamps
    (missing/bad -> ``as_of``) -> numeric coercion -> energy and time >= 0 ->
    carbon = energy x factor where missing -> median fill (all NULL -> 0.0) -> tag."""
    resolved = resolve_standard(df.columns)
    keep = [order_col] if order_col else []
    cols = {c: (F.col(resolved[c]) if c in resolved else F.lit(None)) for c in STANDARD_SCHEMA}
    d = df.select(*keep, *[v.alias(f"__{k}") for k, v in cols.items()])
    has_ids = "batch_id" in resolved and stats_row(d, [F.count("__batch_id").alias("n")])["n"] > 0
    if has_ids:
        d = d.withColumn("batch_id", F.col("__batch_id").cast("string"))
    else:
        if order_col is None:
            raise ValueError("generated ids need an order column")
        d = ordered_index(d, [order_col], "__i").withColumn("batch_id", F.concat(F.lit("GEN_"), zfill4(F.col("__i") + F.lit(1))))
    asof = F.lit(as_of).cast("timestamp_ntz")
    d = d.withColumn("timestamp", F.coalesce(parse_timestamp(F.col("__timestamp").cast("string")) if "timestamp" in resolved else F.lit(None).cast("timestamp_ntz"), asof))
    num = {c: to_double(F.col(f"__{c}")) for c in NUMERIC}
    num["energy_kwh"] = clip_keep_null(num["energy_kwh"], 0.0)
    num["process_time_min"] = clip_keep_null(num["process_time_min"], 0.0)
    num["carbon_kg"] = F.coalesce(num["carbon_kg"], num["energy_kwh"] * F.lit(float(emission_factor)))
    d = d.withColumns(num)
    st = stats_row(d, [pct(c, 0.5).alias(c) for c in NUMERIC])
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(0.0 if st[c] is None else float(st[c]))) for c in NUMERIC})
    d = d.withColumn("source_tag", F.lit(source_tag))
    return d.select(*keep, *STANDARD_SCHEMA, "source_tag")


def features_to_standard_raw(features: DataFrame) -> DataFrame:
    """G2 input: feature columns renamed to standard names."""
    return features.select(
        F.col("Batch_ID").alias("batch_id"),
        F.col("Avg_Temperature").alias("temperature_c"),
        F.col("Avg_Pressure").alias("pressure_bar"),
        F.col("Machine_Speed").alias("rpm"),
        F.col("Total_Energy_kWh").alias("energy_kwh"),
        F.col("Yield_Percent").alias("yield_percent"),
        F.col("Quality_Score").alias("quality_score"),
        F.col("Duration_Minutes").alias("process_time_min"),
        F.col("Carbon_kg").alias("carbon_kg"),
    )


def manual_rows(entries: DataFrame, emission_factor: float = DEFAULT_EMISSION_FACTOR) -> DataFrame:
    """G3 input: manual entries (batch_id, temperature_c, pressure_bar, rpm,
    energy_kwh, yield_percent, quality_score, process_time_min) with carbon
    computed from energy."""
    return entries.withColumn("carbon_kg", F.col("energy_kwh") * F.lit(float(emission_factor)))


def scada_snapshot_raw(process: DataFrame, emission_factor: float = DEFAULT_EMISSION_FACTOR) -> DataFrame:
    """G4 input: one snapshot per batch from the process readings: energy =
    sum(max(power, 0)) / 60, time = max minutes, mean temperature, pressure and
    rpm; yield and quality unknown."""
    power = clip_keep_null(to_double("Power_Consumption_kW"), 0.0)
    snap = process.filter(F.col("Batch_ID").isNotNull()).groupBy("Batch_ID").agg(
        (F.coalesce(exact_sum(power), F.lit(0.0)) / F.lit(60.0)).alias("energy_kwh"),
        F.max(to_double("Time_Minutes")).alias("process_time_min"),
        exact_avg(to_double("Temperature_C")).alias("temperature_c"),
        exact_avg(to_double("Pressure_Bar")).alias("pressure_bar"),
        exact_avg(to_double("Motor_Speed_RPM")).alias("rpm"),
    )
    return snap.select(
        F.col("Batch_ID").alias("batch_id"), "temperature_c", "pressure_bar", "rpm", "energy_kwh",
        F.lit(None).cast("double").alias("yield_percent"), F.lit(None).cast("double").alias("quality_score"),
        "process_time_min", (F.col("energy_kwh") * F.lit(float(emission_factor))).alias("carbon_kg"),
    )


def to_candidate(standard: DataFrame, template: Mapping, emission_factor: float = DEFAULT_EMISSION_FACTOR) -> DataFrame:
    """Standard rows -> engine candidates against a template feature row
    (one row, folded in as literals). A candidate is a copy of the template: columns that the
    standard row says nothing about keep the template's value. Scores and zone are only made where the template has them."""
    def t(k, d):
        v = template.get(k)
        return float(d) if v is None else float(v)

    rpm, ptime = F.col("rpm"), F.col("process_time_min")
    energy, carbon = F.col("energy_kwh"), F.col("carbon_kg")
    y = F.when(F.col("yield_percent") <= 0, F.lit(t("Yield_Percent", 85.0))).otherwise(F.col("yield_percent"))
    q = F.when(F.col("quality_score") <= 0, F.lit(t("Quality_Score", 55.0))).otherwise(F.col("quality_score"))
    cols: dict[str, Column] = {
        "Batch_ID": F.col("batch_id").cast("string"),
        "Avg_Temperature": F.col("temperature_c"),
        "Avg_Pressure": F.col("pressure_bar"),
        "Machine_Speed": rpm,
        "Duration_Minutes": ptime,
        "Total_Energy_kWh": energy,
        "Carbon_kg": F.coalesce(carbon, energy * F.lit(float(emission_factor))),
        "Yield_Percent": y,
        "Quality_Score": q,
    }
    if "Performance_Score" in template:
        speed = rpm / F.lit(max(1.0, t("Machine_Speed", 1.0)))
        timef = F.greatest(F.lit(0.4), F.lit(t("Duration_Minutes", 1.0)) / F.greatest(F.lit(1.0), ptime))
        perf = F.lit(t("Performance_Score", 50.0)) * F.lit(0.5) * (speed + timef)
        cols["Performance_Score"] = rint_dp(F.greatest(F.lit(0.0), F.least(F.lit(100.0), perf)), 9)
    if "Eco_Efficiency_Score" in template:
        eb = F.greatest(F.lit(1.0), F.lit(t("Total_Energy_kWh", 0.0)) if "Total_Energy_kWh" in template else energy)
        cb = F.greatest(F.lit(1.0), F.lit(t("Carbon_kg", 0.0)) if "Carbon_kg" in template else carbon)
        tb = F.greatest(F.lit(1.0), F.lit(t("Duration_Minutes", 0.0)) if "Duration_Minutes" in template else ptime)
        ep = F.least(F.lit(2.0), energy / eb)
        cp = F.least(F.lit(2.0), carbon / cb)
        tp = F.least(F.lit(2.0), ptime / tb)
        eco = (
            F.lit(0.25) * (y / F.lit(100.0)) + F.lit(0.15) * (q / F.lit(100.0))
            + F.lit(0.30) * (F.lit(1.0) - ep / F.lit(2.0)) + F.lit(0.20) * (F.lit(1.0) - cp / F.lit(2.0))
            + F.lit(0.10) * (F.lit(1.0) - tp / F.lit(2.0))
        ) * F.lit(100.0)
        eco = F.greatest(F.lit(0.0), F.least(F.lit(100.0), eco))
        cols["Eco_Efficiency_Score"] = rint_dp(eco, 9)
        if "Green_Zone" in template:
            cols["Green_Zone"] = zone_candidate(eco)
    for name, value in template.items():
        if name not in cols:
            cols[name] = F.lit(None).cast("double") if value is None else F.lit(value)
    return standard.select(*[v.alias(k) for k, v in cols.items()])
