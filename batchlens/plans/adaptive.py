"""Adaptive path: any sensor-like table -> per-batch feature table.

Columns are found through the engine alias table; batch ids are provided or
derived (virtual batches); every signal has a precedence of fallbacks that is
decided from one-row statistics. No implicit sampling: every row is used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.constants import DEFAULT_EMISSION_FACTOR
from batchlens.functions.numeric import clip_keep_null, exact_avg, exact_sum, rint_dp, to_double
from batchlens.functions.zones import zone_feature
from batchlens.operators.features import ensure_controls, health_expr
from batchlens.operators.schema_map import resolve_engine
from batchlens.operators.sessions import elapsed_minutes, fill_batch_ids, repair_timestamps, step_minutes, virtual_batches
from batchlens.session import stored
from batchlens.operators.stats import minmax_aggs, norm_from, pct, stats_row

SIGNALS = [
    "temperature_c", "pressure_bar", "humidity_percent", "motor_speed_rpm", "compression_force_kn",
    "flow_rate_lpm", "power_kw", "energy_kwh", "quality_score", "defect_rate", "error_rate",
    "output_qty", "process_time_min", "vibration_mm_s",
]
MEDIAN_SIGNALS = [
    "temperature_c", "pressure_bar", "humidity_percent", "motor_speed_rpm", "compression_force_kn",
    "flow_rate_lpm", "power_kw", "vibration_mm_s", "output_qty",
]


@dataclass
class AdaptiveResult:
    timeseries: DataFrame
    features: DataFrame
    report: dict = field(default_factory=dict)
    step_minutes: float = 1.0
    gap_threshold: float | None = None
    sparse: bool | None = None


def prepare_rows(src: DataFrame, order_col: str) -> tuple[DataFrame, dict, bool, object]:
    """Canonical row table: Timestamp, Batch_ID, Machine_ID, Phase and the
    numeric signals (NULL when absent)."""
    resolved = resolve_engine([c for c in src.columns if c != order_col])
    d = repair_timestamps(src, resolved.get("timestamp"), order_col)
    machine = F.col(resolved["machine_id"]).cast("string") if "machine_id" in resolved else F.lit("M01")
    mode = F.col(resolved["operation_mode"]).cast("string") if "operation_mode" in resolved else F.lit("Run")
    present = [s for s in SIGNALS if s in resolved]
    given = [F.col(resolved[c]).cast("string").alias("given_batch") for c in ("batch_id",) if c in resolved]
    # the scans behind virtual batches shuffle and write every column that they are given
    d = d.select(
        order_col, "Timestamp", F.coalesce(machine, F.lit("M01")).alias("Machine_ID"), F.coalesce(mode, F.lit("Run")).alias("Phase"),
        *[to_double(resolved[s]).alias(f"sig_{s}") for s in present], *given)
    session = None
    generated = "batch_id" not in resolved
    if "batch_id" in resolved:
        b = F.col("given_batch")
        missing = b.isNull() | (b == "") | (b == "nan")
        if stats_row(d, [F.count_if(missing).alias("m")])["m"] > 0:
            session = virtual_batches(d, "Timestamp", "Machine_ID", "Phase", order_col)
            d = fill_batch_ids(session.frame.withColumn("__b", b), "__b").drop("__b", "Auto_Batch_ID")
            generated = True
        else:
            d = d.withColumn("Batch_ID", b)
    else:
        session = virtual_batches(d, "Timestamp", "Machine_ID", "Phase", order_col)
        d = session.frame.withColumnRenamed("Auto_Batch_ID", "Batch_ID")
    signals = [F.col(f"sig_{s}") if s in present else F.lit(None).cast("double").alias(f"sig_{s}") for s in SIGNALS]
    return d.select(order_col, "Timestamp", "Batch_ID", "Machine_ID", "Phase", *signals), resolved, generated, session


def row_signals(rows: DataFrame, step: float) -> tuple[DataFrame, dict, dict]:
    """``__energy``, ``__output`` and ``__quality`` of every row, each from the best signal that the table has,
    and the statistics of the signals and of the derived columns."""
    sig = {s: F.col(f"sig_{s}") for s in SIGNALS}
    aggs = [F.count(sig[s]).alias(f"n_{s}") for s in SIGNALS]
    aggs += [pct(sig[s], 0.5).alias(f"med_{s}") for s in MEDIAN_SIGNALS]
    aggs += [F.max(sig[s]).alias(f"max_{s}") for s in ("quality_score", "defect_rate", "error_rate")]
    a = stats_row(rows, aggs)

    if a["n_energy_kwh"] > 0:
        row_energy = clip_keep_null(sig["energy_kwh"], 0.0)
    elif a["n_power_kw"] > 0:
        row_energy = clip_keep_null(sig["power_kw"], 0.0) * F.lit(float(step)) / F.lit(60.0)
    else:
        proxy_out = F.coalesce(sig["output_qty"], F.lit(a["med_output_qty"] if a["n_output_qty"] > 0 else 50.0))
        row_energy = F.greatest(F.abs(proxy_out) * F.lit(0.01), F.lit(0.1))
    if a["n_output_qty"] > 0:
        output = sig["output_qty"]
    elif a["n_motor_speed_rpm"] > 0:
        output = clip_keep_null(sig["motor_speed_rpm"] * F.lit(0.75), 0.0)
    else:
        output = F.lit(50.0)
    d = rows.withColumns({"__energy": row_energy, "__output": output})
    temp_center = float(a["med_temperature_c"]) if a["med_temperature_c"] is not None else 0.0
    b = stats_row(
        d,
        [pct("__energy", 0.5).alias("med_energy"), pct("__output", 0.5).alias("med_output"), F.count("__output").alias("n_output"),
         *minmax_aggs(["__output", ("tdev", F.abs(sig["temperature_c"] - F.lit(temp_center))), ("vib", sig["vibration_mm_s"])])],
    )
    # quality precedence
    if a["n_quality_score"] > 0:
        q = sig["quality_score"] * (F.lit(100.0) if a["max_quality_score"] <= 1.5 else F.lit(1.0))
        quality = clip_keep_null(q, 0.0, 100.0)
    elif a["n_defect_rate"] > 0 or a["n_error_rate"] > 0:
        name = "defect_rate" if a["n_defect_rate"] > 0 else "error_rate"
        dd = sig[name] * (F.lit(100.0) if a[f"max_{name}"] <= 1.5 else F.lit(1.0))
        quality = clip_keep_null(F.lit(100.0) - dd, 0.0, 100.0)
    else:
        tdev = F.abs(sig["temperature_c"] - F.lit(temp_center))
        proxy = (
            F.lit(0.45) * (F.lit(1.0) - norm_from(b, "tdev", tdev))
            + F.lit(0.35) * (F.lit(1.0) - norm_from(b, "vib", sig["vibration_mm_s"]))
            + F.lit(0.20) * norm_from(b, "__output", F.col("__output"))
        ) * F.lit(100.0)
        quality = clip_keep_null(proxy, 20.0, 95.0)
    d = d.withColumn("__quality", quality)
    return d, a, b


def build_timeseries(rows: DataFrame, order_col: str) -> tuple[DataFrame, float]:
    """The filled per-row process time series."""
    step = step_minutes(rows, "Timestamp", order_col)
    sig = {s: F.col(f"sig_{s}") for s in SIGNALS}
    d, a, b = row_signals(rows, step)
    signals = d
    d = elapsed_minutes(d, "Batch_ID", "Timestamp", order_col, "sig_process_time_min", out="__tmin")

    def med_or(s: str, default: Column | float) -> Column:
        m = a[f"med_{s}"]
        return F.lit(float(m)) if (a[f"n_{s}"] > 0 and m is not None) else (default if isinstance(default, Column) else F.lit(float(default)))

    motor_default = norm_from(b, "__output", F.col("__output")) * F.lit(250.0) + F.lit(120.0)
    power_default = (F.col("__energy") / F.lit(max(step, 0.1))) * F.lit(60.0)
    out_med = b["med_output"]
    ts = d.select(
        order_col,
        "Batch_ID",
        F.coalesce(F.col("__tmin"), F.lit(0.0)).alias("Time_Minutes"),
        "Phase",
        F.coalesce(sig["temperature_c"], med_or("temperature_c", 85.0)).alias("Temperature_C"),
        F.coalesce(sig["pressure_bar"], med_or("pressure_bar", 5.0)).alias("Pressure_Bar"),
        F.coalesce(sig["humidity_percent"], med_or("humidity_percent", 45.0)).alias("Humidity_Percent"),
        F.coalesce(sig["motor_speed_rpm"], med_or("motor_speed_rpm", motor_default)).alias("Motor_Speed_RPM"),
        F.coalesce(sig["compression_force_kn"], med_or("compression_force_kn", 22.0)).alias("Compression_Force_kN"),
        F.coalesce(sig["flow_rate_lpm"], med_or("flow_rate_lpm", 10.0)).alias("Flow_Rate_LPM"),
        F.coalesce(sig["power_kw"], med_or("power_kw", power_default)).alias("Power_Consumption_kW"),
        F.coalesce(sig["vibration_mm_s"], med_or("vibration_mm_s", 1.5)).alias("Vibration_mm_s"),
        "Machine_ID",
        "Timestamp",
        F.coalesce(F.col("__output"), F.lit(float(out_med) if (b["n_output"] > 0 and out_med is not None) else 50.0)).alias("Output_Signal"),
        F.coalesce(F.col("__quality"), F.lit(55.0)).alias("Quality_Score_Row"),
        F.coalesce(F.col("__energy"), F.lit(float(b["med_energy"]) if b["med_energy"] is not None else 1.0)).alias("Energy_kWh_Row"),
    )
    filled_cols = [sig[x] for x in ("temperature_c", "pressure_bar", "humidity_percent", "motor_speed_rpm",
                                     "compression_force_kn", "flow_rate_lpm", "power_kw", "vibration_mm_s")]
    filled_cols += [F.col("__output"), F.col("__quality"), F.col("__energy")]
    missing = sum((F.count_if(c.isNull()) for c in filled_cols), F.lit(0)).cast("bigint").alias("m")
    filled = int(stats_row(signals, [missing])["m"])  # the times add no row and no signal
    return ts, step, filled


def adaptive_agg(ts: DataFrame) -> DataFrame:
    """Per-batch aggregation of the filled time series. The phases are counted by a narrow aggregate of their own, as in
    ``features.process_agg``; a NULL batch is a group."""
    phases = ts.select("Batch_ID", "Phase").distinct().groupBy("Batch_ID").agg(F.count("Phase").alias("Phase_Count"))
    wide = ts.groupBy("Batch_ID").agg(
        F.max("Time_Minutes").alias("Duration_Minutes"),
        F.count("Time_Minutes").alias("Data_Points"),
        exact_avg("Temperature_C").alias("Avg_Temperature"),
        F.max("Temperature_C").alias("Max_Temperature"),
        exact_avg("Pressure_Bar").alias("Avg_Pressure"),
        exact_avg("Humidity_Percent").alias("Avg_Humidity_Percent"),
        F.max("Compression_Force_kN").alias("Max_Compression_Force_kN"),
        exact_avg("Power_Consumption_kW").alias("Avg_Power_Consumption_kW"),
        F.max("Power_Consumption_kW").alias("Peak_Power_kW"),
        F.max("Motor_Speed_RPM").alias("Max_Motor_Speed_RPM"),
        exact_avg("Vibration_mm_s").alias("Avg_Vibration_mm_s"),
        exact_avg("Flow_Rate_LPM").alias("Avg_Flow_Rate_LPM"),
        exact_avg("Output_Signal").alias("Output_Signal"),
        exact_avg("Quality_Score_Row").alias("Quality_Score"),
        F.coalesce(exact_sum("Energy_kWh_Row"), F.lit(0.0)).alias("Total_Energy_kWh"),
    )
    names = wide.columns
    at = names.index("Output_Signal")
    joined = wide.join(phases.withColumnRenamed("Batch_ID", "__b"), F.col("Batch_ID").eqNullSafe(F.col("__b")))
    return joined.select(*names[:at], "Phase_Count", *names[at:])


def adaptive_kpis(agg: DataFrame, emission_factor: float = DEFAULT_EMISSION_FACTOR) -> DataFrame:
    """F10, F11 + carbon, health, eco, zone on the per-batch aggregate."""
    s1 = stats_row(agg, minmax_aggs(["Output_Signal", "Quality_Score", "Duration_Minutes", "Avg_Vibration_mm_s", "Total_Energy_kWh"]))
    speed = F.coalesce(F.col("Max_Motor_Speed_RPM"), norm_from(s1, "Output_Signal") * F.lit(250.0) + F.lit(120.0))
    f = agg.withColumn("Machine_Speed", speed)
    s1.update(stats_row(f, minmax_aggs(["Machine_Speed"])))
    yld = F.lit(68.0) + (F.lit(0.65) * norm_from(s1, "Output_Signal") + F.lit(0.35) * norm_from(s1, "Quality_Score")) * F.lit(31.0)
    perf = (
        F.lit(0.40) * norm_from(s1, "Machine_Speed")
        + F.lit(0.30) * norm_from(s1, "Duration_Minutes", invert=True)
        + F.lit(0.20) * norm_from(s1, "Output_Signal")
        + F.lit(0.10) * norm_from(s1, "Avg_Vibration_mm_s", invert=True)
    ) * F.lit(100.0)
    f = f.withColumns(
        {
            "Yield_Percent": rint_dp(clip_keep_null(yld, 60.0, 99.5), 2),
            "Performance_Score": rint_dp(clip_keep_null(perf, 0.0, 100.0), 2),
            "Carbon_kg": rint_dp(F.col("Total_Energy_kWh") * F.lit(float(emission_factor)), 2),
        }
    )
    f = f.withColumn("Process_Health_Score", health_expr(norm_from(s1, "Total_Energy_kWh")))
    s2 = stats_row(f, minmax_aggs(["Yield_Percent", "Carbon_kg"]))
    s2.update({k: v for k, v in s1.items() if k.endswith(("Quality_Score", "Total_Energy_kWh", "Duration_Minutes"))})
    eco = (
        F.lit(0.40) * norm_from(s2, "Yield_Percent")
        + F.lit(0.15) * norm_from(s2, "Quality_Score")
        + F.lit(0.20) * norm_from(s2, "Total_Energy_kWh", invert=True)
        + F.lit(0.15) * norm_from(s2, "Carbon_kg", invert=True)
        + F.lit(0.10) * norm_from(s2, "Duration_Minutes", invert=True)
    ) * F.lit(100.0)
    f = f.withColumn("Eco_Efficiency_Score", rint_dp(eco, 2))
    return f.withColumn("Green_Zone", zone_feature("Eco_Efficiency_Score"))


def scrub(features: DataFrame, id_cols=("Batch_ID", "Green_Zone")) -> DataFrame:
    """C4: +-Inf -> NULL -> column median (all-NULL column left as is).
    Integer columns (counts) cannot hold Inf and keep their type."""
    num = [c for c, t in features.dtypes if c not in id_cols and t in ("double", "float")]
    clean = {c: to_double(c) for c in num}
    st = stats_row(features.withColumns(clean), [pct(c, 0.5).alias(c) for c in num])
    return features.withColumns({c: F.coalesce(clean[c], F.lit(st[c]).cast("double")) if st[c] is not None else clean[c] for c in num})


def run_adaptive(
    src: DataFrame, order_col: str, emission_factor: float = DEFAULT_EMISSION_FACTOR, rows_production: int = 0
) -> AdaptiveResult:
    rows, resolved, generated, session = prepare_rows(src, order_col)
    rows = stored(rows)
    ts, step, filled = build_timeseries(rows, order_col)
    ts = stored(ts)
    agg = stored(adaptive_agg(ts))
    features = scrub(ensure_controls(adaptive_kpis(agg, emission_factor)))
    has_energy = "power_kw" in resolved or "energy_kwh" in resolved
    has_quality = any(k in resolved for k in ("quality_score", "defect_rate", "error_rate"))
    has_output = "output_qty" in resolved
    has_controls = any(k in resolved for k in ("temperature_c", "pressure_bar", "motor_speed_rpm", "flow_rate_lpm", "process_time_min"))
    if has_energy and has_quality and has_output and has_controls and not generated:
        mode = "Full"
    elif has_energy and (has_quality or has_output or has_controls):
        mode = "Partial"
    else:
        mode = "Minimal"
    report = {
        "rows_production": rows_production,
        "missing_values_filled": filled,
        "data_mode": mode,
        "batch_strategy": "auto-generated" if generated else "provided",
        "signal_coverage": int(has_energy) + int(has_quality) + int(has_output) + int(has_controls),
        "outlier_points_clipped": 0,
    }
    return AdaptiveResult(
        ts, features, report, step,
        session.gap_threshold if session else None, session.sparse if session else None,
    )
