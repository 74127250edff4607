"""Per-batch aggregation and KPI derivation.

``process_agg`` is one ``groupBy(Batch_ID).agg`` (partial aggregation on the
map side, so a batch that holds a third of all readings still arrives at the
reducer as one partial row per map partition); the phases are counted beside it
by an aggregate of their own, with narrow rows. KPI scores need whole-table
min/max of raw and of already-rounded derived columns: two one-row stats
passes, each broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.constants import CONTROL_PARAMETERS, DEFAULT_EMISSION_FACTOR
from batchlens.functions.numeric import clip_keep_null, exact_avg, exact_sum, rint_dp, to_double
from batchlens.functions.zones import zone_feature
from batchlens.operators.stats import minmax_aggs, norm_from, pct, stats_row

PROCESS_NUMERIC = [
    "Time_Minutes", "Temperature_C", "Pressure_Bar", "Motor_Speed_RPM", "Compression_Force_kN",
    "Flow_Rate_LPM", "Power_Consumption_kW", "Vibration_mm_s",
]

#: Columns of the production table that the quality, yield and performance scores read.
KPI_PRODUCTION_COLUMNS = [
    "Dissolution_Rate", "Hardness", "Friability", "Disintegration_Time", "Content_Uniformity", "Moisture_Content", "Machine_Speed",
]

PROCESS_FEATURES = [
    "Duration_Minutes", "Data_Points", "Avg_Temperature", "Max_Temperature", "Avg_Pressure",
    "Max_Compression_Force_kN", "Avg_Power_Consumption_kW", "Peak_Power_kW", "Max_Motor_Speed_RPM",
    "Avg_Vibration_mm_s", "Avg_Flow_Rate_LPM", "Phase_Count", "Total_Energy_kWh",
]


def process_agg(process: DataFrame) -> DataFrame:
    """Per-batch process features. Power is clipped at 0; energy = sum(power)/60
    (one reading per minute is assumed, as in the source behaviour).

    A distinct count inside the wide aggregate would key its map-side rows by batch and phase and shuffle
    them twice. It has its own narrow aggregate instead; both arrive hashed by batch, so the join moves nothing."""
    cols = {c: to_double(c) for c in PROCESS_NUMERIC}
    cols["Power_Consumption_kW"] = clip_keep_null(to_double("Power_Consumption_kW"), 0.0)
    phase = F.col("Phase") if "Phase" in process.columns else F.lit("Run")
    p = process.filter(F.col("Batch_ID").isNotNull()).select("Batch_ID", phase.alias("Phase"), *[v.alias(k) for k, v in cols.items()])
    phases = p.select("Batch_ID", "Phase").distinct().groupBy("Batch_ID").agg(F.count("Phase").alias("Phase_Count"))
    wide = p.groupBy("Batch_ID").agg(
        F.max("Time_Minutes").alias("Duration_Minutes"),
        F.count("Time_Minutes").alias("Data_Points"),
        exact_avg("Temperature_C").alias("Avg_Temperature"),
        F.max("Temperature_C").alias("Max_Temperature"),
        exact_avg("Pressure_Bar").alias("Avg_Pressure"),
        F.max("Compression_Force_kN").alias("Max_Compression_Force_kN"),
        exact_avg("Power_Consumption_kW").alias("Avg_Power_Consumption_kW"),
        F.max("Power_Consumption_kW").alias("Peak_Power_kW"),
        F.max("Motor_Speed_RPM").alias("Max_Motor_Speed_RPM"),
        exact_avg("Vibration_mm_s").alias("Avg_Vibration_mm_s"),
        exact_avg("Flow_Rate_LPM").alias("Avg_Flow_Rate_LPM"),
        (F.coalesce(exact_sum("Power_Consumption_kW"), F.lit(0.0)) / F.lit(60.0)).alias("Total_Energy_kWh"),
    )
    return wide.join(phases, on="Batch_ID").select("Batch_ID", *PROCESS_FEATURES)


def kpi_features(df: DataFrame, emission_factor: float = DEFAULT_EMISSION_FACTOR, with_controls: bool = False) -> DataFrame:
    """F2-F8 on a joined production + process table (structured path).

    Quality, yield, performance, carbon, health, eco and zone. Eco is computed
    from the *rounded* yield/quality/carbon, as the source behaviour does.
    Two one-row statistics passes (raw min/max, then derived min/max).
    """
    unif_dev = F.abs(F.col("Content_Uniformity") - F.lit(100.0))
    raw = [
        "Dissolution_Rate", "Hardness", "Friability", "Disintegration_Time", ("unif_dev", unif_dev),
        "Machine_Speed", "Duration_Minutes", "Avg_Vibration_mm_s", "Avg_Flow_Rate_LPM", "Total_Energy_kWh",
    ]
    s1 = stats_row(df, minmax_aggs(raw))
    quality01 = (
        F.lit(0.30) * norm_from(s1, "Dissolution_Rate")
        + F.lit(0.20) * norm_from(s1, "Hardness")
        + F.lit(0.20) * norm_from(s1, "Friability", invert=True)
        + F.lit(0.15) * norm_from(s1, "Disintegration_Time", invert=True)
        + F.lit(0.15) * norm_from(s1, "unif_dev", unif_dev, invert=True)
    )
    est_yield = (
        F.lit(90.0)
        + F.lit(0.11) * (F.col("Dissolution_Rate") - F.lit(88.0))
        + F.lit(0.04) * (F.col("Hardness") - F.lit(95.0))
        - F.lit(4.2) * F.col("Friability")
        - F.lit(0.23) * unif_dev
        - F.lit(0.90) * F.abs(F.col("Moisture_Content") - F.lit(2.2))
    )
    perf01 = (
        F.lit(0.45) * norm_from(s1, "Machine_Speed")
        + F.lit(0.30) * norm_from(s1, "Duration_Minutes", invert=True)
        + F.lit(0.15) * norm_from(s1, "Avg_Vibration_mm_s", invert=True)
        + F.lit(0.10) * norm_from(s1, "Avg_Flow_Rate_LPM")
    )
    x = df.withColumns(
        {
            "Quality_Score": rint_dp(quality01 * F.lit(100.0), 2),
            "Yield_Percent": rint_dp(clip_keep_null(est_yield, 72.0, 99.8), 2),
            "Performance_Score": rint_dp(perf01 * F.lit(100.0), 2),
            "Carbon_kg": rint_dp(F.col("Total_Energy_kWh") * F.lit(float(emission_factor)), 2),
        }
    )
    x = x.withColumn("Process_Health_Score", health_expr(norm_from(s1, "Total_Energy_kWh")))
    if not with_controls:
        return eco_and_zone(x, s1)
    shared: dict = {}
    y = eco_and_zone(x, s1, controls_aggs(x), shared)
    return ensure_controls(y, shared)


def health_expr(norm_energy: Column) -> Column:
    return rint_dp(
        F.lit(0.35) * F.col("Quality_Score")
        + F.lit(0.35) * F.col("Yield_Percent")
        + F.lit(0.30) * (F.lit(100.0) - norm_energy * F.lit(100.0)),
        2,
    )


def eco_and_zone(x: DataFrame, known: dict | None = None, extra_aggs=(), extra_out: dict | None = None) -> DataFrame:
    """Eco from normalised (rounded) KPIs, then the right-closed zone."""
    known = known or {}
    need = [c for c in ["Yield_Percent", "Quality_Score", "Carbon_kg", "Total_Energy_kWh", "Duration_Minutes"]
            if f"min_{c}" not in known]
    s2 = dict(known)
    s2.update(stats_row(x, minmax_aggs(need) + list(extra_aggs)))
    if extra_out is not None:  # statistics of other operators folded into this pass
        extra_out.update(s2)
    eco01 = (
        F.lit(0.40) * norm_from(s2, "Yield_Percent")
        + F.lit(0.15) * norm_from(s2, "Quality_Score")
        + F.lit(0.20) * norm_from(s2, "Total_Energy_kWh", invert=True)
        + F.lit(0.15) * norm_from(s2, "Carbon_kg", invert=True)
        + F.lit(0.10) * norm_from(s2, "Duration_Minutes", invert=True)
    )
    y = x.withColumn("Eco_Efficiency_Score", rint_dp(eco01 * F.lit(100.0), 2))
    return y.withColumn("Green_Zone", zone_feature("Eco_Efficiency_Score"))


def controls_aggs(f: DataFrame) -> list:
    """The statistics ``ensure_controls`` needs, as aggregates over ``f``
    (so another pass over the same rows can compute them)."""
    return _controls(f, None)


def ensure_controls(f: DataFrame, stats: dict | None = None) -> DataFrame:
    """C5 (see ``_controls``); ``stats`` may come from a shared pass."""
    return _controls(f, stats if stats is not None else {})


def _controls(f: DataFrame, stats: dict | None):
    """Derive the domain control columns and the 8 configured controls.

    Present columns are used (NULL -> derived default); absent ones are derived
    from duration/temperature/force/flow/output/quality signals. All
    statistics come from one aggregation pass.
    """
    cols = set(f.columns)

    def series(c: str, default) -> Column:
        d = default if isinstance(default, Column) else F.lit(default)
        return F.coalesce(to_double(c), d) if c in cols else d

    duration = series("Duration_Minutes", 30.0)
    avg_temp = series("Avg_Temperature", 85.0)
    avg_hum = series("Avg_Humidity_Percent", 44.0)
    max_force = series("Max_Compression_Force_kN", 22.0)
    max_rpm = to_double("Max_Motor_Speed_RPM") if "Max_Motor_Speed_RPM" in cols else F.lit(None).cast("double")
    output_sig = series("Output_Signal", 50.0)
    flow = series("Avg_Flow_Rate_LPM", 10.0)
    quality = series("Quality_Score", 60.0)

    aggs = minmax_aggs([("out", output_sig), ("flow", flow), ("q", quality)])
    derived_medians = {
        "Hardness": F.lit(60.0) + quality * F.lit(0.35),
        "Friability": clip_keep_null((F.lit(100.0) - quality) / F.lit(140.0), 0.05, 1.8),
        "Dissolution_Rate": F.lit(65.0) + quality * F.lit(0.28),
        "Content_Uniformity": F.lit(94.0) + quality * F.lit(0.05),
    }
    aggs += [pct(e, 0.5).alias(f"med_{c}") for c, e in derived_medians.items()]
    present_controls = [c for c in CONTROL_PARAMETERS if c in cols and c != "Machine_Speed"]
    aggs += [pct(to_double(c), 0.5).alias(f"med_{c}") for c in present_controls]
    aggs.append(pct(quality, 0.5).alias("med_q"))
    if stats is None:
        return aggs
    st = stats if stats else stats_row(f, aggs)
    # Median of (1 - norm(q)) * 20 + 6 is that map applied to median(q): the
    # map is affine and monotone, so no second pass is needed.
    if st["min_q"] is None or abs(st["max_q"] - st["min_q"]) <= 1e-8:
        med_dis = (1.0 - 0.5) * 20.0 + 6.0
    else:
        nq = min(1.0, max(0.0, (st["med_q"] - st["min_q"]) / (st["max_q"] - st["min_q"])))
        med_dis = (1.0 - nq) * 20.0 + 6.0
    med = {c: F.lit(float(st[f"med_{c}"]) if st[f"med_{c}"] is not None else None).cast("double")
           for c in derived_medians}
    med["Disintegration_Time"] = F.lit(float(med_dis))

    norm_out = norm_from(st, "out", output_sig)
    norm_flow = norm_from(st, "flow", flow)

    def present_or(c: str, derived: Column) -> Column:
        return to_double(c) if c in cols else derived

    h = f.withColumns(
        {
            "Granulation_Time": clip_keep_null(F.coalesce(present_or("Granulation_Time", duration * 0.35), duration * 0.35), 3.0),
            "Binder_Amount": F.coalesce(present_or("Binder_Amount", F.lit(2.0) + norm_out * F.lit(8.0)), F.lit(5.0)),
            "Drying_Temp": F.coalesce(present_or("Drying_Temp", avg_temp), avg_temp),
            "Drying_Time": clip_keep_null(F.coalesce(present_or("Drying_Time", duration * 0.25), duration * 0.25), 2.0),
            "Compression_Force": F.coalesce(present_or("Compression_Force", max_force), max_force),
        }
    )
    # Machine_Speed is never NULL after this (its fallback is not), so the
    # later control-median fill is a no-op for it.
    speed = F.coalesce(present_or("Machine_Speed", max_rpm), norm_out * F.lit(250.0) + F.lit(120.0))
    h = h.withColumn("Machine_Speed", clip_keep_null(speed, 30.0))
    h = h.withColumns(
        {
            "Lubricant_Conc": F.coalesce(present_or("Lubricant_Conc", F.lit(0.6) + norm_flow * F.lit(1.0)), F.lit(0.9)),
            "Moisture_Content": F.coalesce(
                present_or("Moisture_Content", clip_keep_null(avg_hum / F.lit(20.0), 1.2, 6.5)), F.lit(2.2)
            ),
            "Tablet_Weight": series("Tablet_Weight", 500.0),
            "Hardness": series("Hardness", med["Hardness"]),
            "Friability": series("Friability", med["Friability"]),
            "Disintegration_Time": series("Disintegration_Time", med["Disintegration_Time"]),
            "Dissolution_Rate": series("Dissolution_Rate", med["Dissolution_Rate"]),
            "Content_Uniformity": series("Content_Uniformity", med["Content_Uniformity"]),
        }
    )
    ctrl = {}
    for c in CONTROL_PARAMETERS:
        if c == "Machine_Speed":
            continue
        if c in cols:
            m = st[f"med_{c}"]
            ctrl[c] = F.coalesce(to_double(c), F.lit(0.0 if m is None else float(m)))
        else:
            ctrl[c] = F.lit(0.0)
    return h.withColumns(ctrl)
