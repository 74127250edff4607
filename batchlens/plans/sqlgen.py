"""SQL text for the independent oracle (DuckDB dialect).

The oracle recomputes every registered query from the driver tables with
plain SQL: CTEs for the three domain views, then the operator chain. Helpers
here generate the repetitive column lists (normalisation, clipping,
half-even rounding) from the same column vocabularies the Spark code uses.
"""

from __future__ import annotations

from batchlens.constants import CONTROL_PARAMETERS, DEFAULT_EMISSION_FACTOR, DEFAULT_SCENARIOS, PRIMARY_OBJECTIVES
from batchlens.sources.tables import view_sql

PROD_COLS = [
    "Dissolution_Rate", "Hardness", "Friability", "Disintegration_Time", "Content_Uniformity",
    "Moisture_Content", "Machine_Speed",
]
AGG_COLS = [
    "Duration_Minutes", "Data_Points", "Avg_Temperature", "Max_Temperature", "Avg_Pressure",
    "Max_Compression_Force_kN", "Avg_Power_Consumption_kW", "Peak_Power_kW", "Max_Motor_Speed_RPM",
    "Avg_Vibration_mm_s", "Avg_Flow_Rate_LPM", "Phase_Count", "Total_Energy_kWh",
]
MERGED_COLS = PROD_COLS + AGG_COLS


def views(*names: str) -> str:
    names = names or ("production_batches", "process_readings", "sensor_readings")
    return ",\n".join(f"{n} AS (\n{view_sql(n)}\n)" for n in names)


def rint(expr: str, dp: int = 2) -> str:
    scale = float(10 ** dp)
    return f"(round_even(({expr}) * {scale!r}, 0) / {scale!r})"


def clip(expr: str, lo: str | None = None, hi: str | None = None) -> str:
    out = expr
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"(CASE WHEN ({expr}) IS NULL THEN NULL ELSE {out} END)"


def norm(expr: str, lo: str, hi: str, invert: bool = False, all_null_half: bool = True) -> str:
    scaled = f"(({expr}) - {lo}) / ({hi} - {lo})"
    if invert:
        scaled = f"(1.0 - {scaled})"
    null_case = f"WHEN {lo} IS NULL THEN {'0.5' if all_null_half else 'NULL'} "
    return f"(CASE {null_case}WHEN abs({hi} - {lo}) <= 1e-8 THEN 0.5 ELSE {clip(scaled, '0.0', '1.0')} END)"


def xsum(expr: str) -> str:
    """Exact sum (decimal accumulation), as double."""
    return f"CAST(sum(CAST(({expr}) AS DECIMAL(38,12))) AS DOUBLE)"


def xavg(expr: str) -> str:
    return f"({xsum(expr)} / CAST(nullif(count({expr}), 0) AS DOUBLE))"


def minmax(cols: list[str], exprs: dict[str, str] | None = None) -> str:
    exprs = exprs or {}
    parts = []
    for c in cols:
        e = exprs.get(c, c)
        parts.append(f"min({e}) AS min_{c}, max({e}) AS max_{c}")
    return ", ".join(parts)


def structured_ctes(emission_factor: float = DEFAULT_EMISSION_FACTOR) -> str:
    """CTE chain ending in ``features`` (and the intermediates ``prod``,
    ``agg``, ``aggc``, ``merged``, ``clipped``)."""
    ef = repr(float(emission_factor))
    p_med = ", ".join(
        f"quantile_cont({c}, 0.5) AS m_{c}, count_if({c} IS NULL) AS n_{c}" for c in PROD_COLS
    )
    prod = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}, 0.0) AS {c}" for c in PROD_COLS)
    a_med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}, count_if({c} IS NULL) AS n_{c}" for c in AGG_COLS)
    aggc = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}, 0.0) AS {c}" for c in AGG_COLS)
    iq = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in MERGED_COLS)
    clipped = ", ".join(
        f"CASE WHEN q1_{c} IS NULL OR abs(q3_{c} - q1_{c}) <= 1e-8 THEN CAST({c} AS DOUBLE) "
        f"ELSE {clip(f'CAST({c} AS DOUBLE)', f'(q1_{c} - 1.5 * (q3_{c} - q1_{c}))', f'(q3_{c} + 1.5 * (q3_{c} - q1_{c}))')} END AS {c}"
        for c in MERGED_COLS
    )
    s1_cols = [
        "Dissolution_Rate", "Hardness", "Friability", "Disintegration_Time", "unif_dev",
        "Machine_Speed", "Duration_Minutes", "Avg_Vibration_mm_s", "Avg_Flow_Rate_LPM", "Total_Energy_kWh",
    ]
    s1 = minmax(s1_cols, {"unif_dev": "abs(Content_Uniformity - 100.0)"})

    def n1(c, inv=False, e=None):
        return norm(e or c, f"s1.min_{c}", f"s1.max_{c}", inv)

    ud = "abs(Content_Uniformity - 100.0)"
    quality = (
        f"0.30 * {n1('Dissolution_Rate')} + 0.20 * {n1('Hardness')} + 0.20 * {n1('Friability', True)} "
        f"+ 0.15 * {n1('Disintegration_Time', True)} + 0.15 * {n1('unif_dev', True, ud)}"
    )
    est_yield = (
        "90.0 + 0.11 * (Dissolution_Rate - 88.0) + 0.04 * (Hardness - 95.0) - 4.2 * Friability "
        f"- 0.23 * {ud} - 0.90 * abs(Moisture_Content - 2.2)"
    )
    perf = (
        f"0.45 * {n1('Machine_Speed')} + 0.30 * {n1('Duration_Minutes', True)} "
        f"+ 0.15 * {n1('Avg_Vibration_mm_s', True)} + 0.10 * {n1('Avg_Flow_Rate_LPM')}"
    )
    health = (
        f"0.35 * Quality_Score + 0.35 * Yield_Percent + 0.30 * (100.0 - {n1('Total_Energy_kWh')} * 100.0)"
    )

    def n2(c, inv=False):
        return norm(c, f"s2.min_{c}", f"s2.max_{c}", inv)

    eco = (
        f"0.40 * {n2('Yield_Percent')} + 0.15 * {n2('Quality_Score')} + 0.20 * {n2('Total_Energy_kWh', True)} "
        f"+ 0.15 * {n2('Carbon_kg', True)} + 0.10 * {n2('Duration_Minutes', True)}"
    )
    zone = (
        "CASE WHEN Eco_Efficiency_Score > -1.0 AND Eco_Efficiency_Score <= 40.0 THEN 'Red' "
        "WHEN Eco_Efficiency_Score > 40.0 AND Eco_Efficiency_Score <= 70.0 THEN 'Yellow' "
        "WHEN Eco_Efficiency_Score > 70.0 AND Eco_Efficiency_Score <= 100.0 THEN 'Green' END"
    )
    flow = "coalesce(Avg_Flow_Rate_LPM, 10.0)"
    q = "coalesce(Quality_Score, 60.0)"
    controls = ", ".join(f"CAST(0.0 AS DOUBLE) AS {c}" for c in CONTROL_PARAMETERS if c != "Machine_Speed")
    return f"""{views("production_batches", "process_readings")},
p_med AS (SELECT {p_med} FROM production_batches),
prod AS (SELECT Batch_ID, {prod} FROM production_batches CROSS JOIN p_med),
agg AS (
  SELECT Batch_ID, max(Time_Minutes) AS Duration_Minutes, count(Time_Minutes) AS Data_Points,
    {xavg("Temperature_C")} AS Avg_Temperature, max(Temperature_C) AS Max_Temperature,
    {xavg("Pressure_Bar")} AS Avg_Pressure, max(Compression_Force_kN) AS Max_Compression_Force_kN,
    {xavg("pw")} AS Avg_Power_Consumption_kW, max(pw) AS Peak_Power_kW,
    max(Motor_Speed_RPM) AS Max_Motor_Speed_RPM, {xavg("Vibration_mm_s")} AS Avg_Vibration_mm_s,
    {xavg("Flow_Rate_LPM")} AS Avg_Flow_Rate_LPM, count(DISTINCT Phase) AS Phase_Count,
    coalesce({xsum("pw")}, 0.0) / 60.0 AS Total_Energy_kWh
  FROM (SELECT *, {clip('Power_Consumption_kW', '0.0')} AS pw FROM process_readings)
  WHERE Batch_ID IS NOT NULL GROUP BY Batch_ID),
a_med AS (SELECT {a_med} FROM agg),
aggc AS (SELECT Batch_ID, {aggc} FROM agg CROSS JOIN a_med),
merged AS (SELECT * FROM prod LEFT JOIN aggc USING (Batch_ID)),
iq AS (SELECT {iq} FROM merged),
clipped AS (SELECT Batch_ID, {clipped} FROM merged CROSS JOIN iq),
s1 AS (SELECT {s1} FROM clipped),
k1 AS (
  SELECT clipped.*,
    {rint(f'({quality}) * 100.0')} AS Quality_Score,
    {rint(clip(est_yield, '72.0', '99.8'))} AS Yield_Percent,
    {rint(f'({perf}) * 100.0')} AS Performance_Score,
    {rint(f'Total_Energy_kWh * {ef}')} AS Carbon_kg
  FROM clipped CROSS JOIN s1),
k2 AS (SELECT k1.*, {rint(health)} AS Process_Health_Score FROM k1 CROSS JOIN s1),
s2 AS (SELECT {minmax(['Yield_Percent', 'Quality_Score', 'Carbon_kg', 'Total_Energy_kWh', 'Duration_Minutes'])} FROM k2),
k3 AS (SELECT k2.*, {rint(f'({eco}) * 100.0')} AS Eco_Efficiency_Score FROM k2 CROSS JOIN s2),
k4 AS (SELECT k3.*, {zone} AS Green_Zone FROM k3),
c_st AS (SELECT min({flow}) AS min_flow, max({flow}) AS max_flow,
    quantile_cont(60.0 + {q} * 0.35, 0.5) AS m_hard,
    quantile_cont({clip(f'(100.0 - {q}) / 140.0', '0.05', '1.8')}, 0.5) AS m_fri,
    quantile_cont(65.0 + {q} * 0.28, 0.5) AS m_diss,
    quantile_cont(94.0 + {q} * 0.05, 0.5) AS m_cu FROM k4),
features AS (
  SELECT Batch_ID,
    coalesce(Dissolution_Rate, m_diss) AS Dissolution_Rate, coalesce(Hardness, m_hard) AS Hardness,
    coalesce(Friability, m_fri) AS Friability, Disintegration_Time,
    coalesce(Content_Uniformity, m_cu) AS Content_Uniformity, coalesce(Moisture_Content, 2.2) AS Moisture_Content,
    greatest(coalesce(Machine_Speed, 245.0), 30.0) AS Machine_Speed,
    {", ".join(AGG_COLS)},
    Quality_Score, Yield_Percent, Performance_Score, Carbon_kg, Process_Health_Score, Eco_Efficiency_Score, Green_Zone,
    greatest(coalesce(Duration_Minutes, 30.0) * 0.35, 3.0) AS Granulation_Time,
    CAST(6.0 AS DOUBLE) AS Binder_Amount,
    coalesce(Avg_Temperature, 85.0) AS Drying_Temp,
    greatest(coalesce(Duration_Minutes, 30.0) * 0.25, 2.0) AS Drying_Time,
    coalesce(Max_Compression_Force_kN, 22.0) AS Compression_Force,
    coalesce(0.6 + {norm(flow, 'min_flow', 'max_flow')} * 1.0, 0.9) AS Lubricant_Conc,
    CAST(500.0 AS DOUBLE) AS Tablet_Weight,
    {controls}
  FROM k4 CROSS JOIN c_st)"""


OBJ_COLS = ", ".join(PRIMARY_OBJECTIVES)


def strictness_q(strictness: str = "Standard") -> tuple[float, float]:
    from batchlens.operators.ranking import strictness_quantiles

    return strictness_quantiles(strictness)


def targets_cte(strictness: str = "Standard", src: str = "features") -> str:
    q, qmax = strictness_q(strictness)
    return (
        f"targets AS (SELECT quantile_cont(Yield_Percent, {q!r}) AS min_yield, "
        f"quantile_cont(Quality_Score, {q!r}) AS min_quality, "
        f"quantile_cont(Total_Energy_kWh, {qmax!r}) AS max_energy, "
        f"quantile_cont(Carbon_kg, {qmax!r}) AS max_carbon, "
        f"quantile_cont(Eco_Efficiency_Score, {q!r}) AS min_eco_score FROM {src})"
    )


TARGET_COND = (
    "coalesce(Yield_Percent >= min_yield AND Quality_Score >= min_quality AND Total_Energy_kWh <= max_energy "
    "AND Carbon_kg <= max_carbon AND (min_eco_score IS NULL OR Eco_Efficiency_Score >= min_eco_score), false)"
)


def score_sql(weights: dict, st: str = "ost") -> str:
    denom = float(sum(float(weights.get(o, 0.0)) for o in PRIMARY_OBJECTIVES))
    if abs(denom) <= 1e-8:
        denom = 1.0
    terms = []
    for o in PRIMARY_OBJECTIVES:
        lo, hi = f"{st}.min_{o}", f"{st}.max_{o}"
        raw = f"(({o} - {lo}) / ({hi} - {lo}))"
        base = f"(CASE WHEN abs({hi} - {lo}) <= 1e-8 THEN 0.5 ELSE {raw} END)"
        from batchlens.constants import OBJECTIVE_DIRECTIONS

        if OBJECTIVE_DIRECTIONS[o] == "min":
            base = f"(1.0 - {base})"
        terms.append(f"{clip(base, '0.0', '1.0')} * {float(weights.get(o, 0.0))!r}")
    return rint(f"(({' + '.join(terms)}) / {denom!r}) * 100.0")


def objective_stats_cte(src: str = "features", name: str = "ost") -> str:
    return f"{name} AS (SELECT {minmax(PRIMARY_OBJECTIVES)} FROM {src})"


def candidates_cte(src: str = "features") -> str:
    """Rows passing the targets, or all rows when none pass."""
    return (
        f"anyp AS (SELECT count(*) > 0 AS any_pass FROM {src} CROSS JOIN targets WHERE {TARGET_COND}),\n"
        f"cand AS (SELECT {src}.* FROM {src} CROSS JOIN targets CROSS JOIN anyp WHERE {TARGET_COND} OR NOT any_pass)"
    )


SCENARIOS = DEFAULT_SCENARIOS


def dominance_sql(u: str = "u", v: str = "v") -> str:
    from batchlens.constants import OBJECTIVE_DIRECTIONS

    ge, gt = [], []
    for o in PRIMARY_OBJECTIVES:
        if OBJECTIVE_DIRECTIONS[o] == "max":
            ge.append(f"{v}.{o} >= {u}.{o}")
            gt.append(f"{v}.{o} > {u}.{o}")
        else:
            ge.append(f"{v}.{o} <= {u}.{o}")
            gt.append(f"{v}.{o} < {u}.{o}")
    return "(" + " AND ".join(ge) + " AND (" + " OR ".join(gt) + "))"


def ranked_all_cte(src: str = "cand", scenarios: dict | None = None) -> str:
    """UNION ALL of every scenario's scored candidates -> ``ranked``."""
    scenarios = scenarios or DEFAULT_SCENARIOS
    parts = [
        f"SELECT {src}.*, '{n}' AS scenario, {score_sql(w)} AS Scenario_Score FROM {src} CROSS JOIN ost"
        for n, w in scenarios.items()
    ]
    return "ranked AS (\n" + "\nUNION ALL\n".join(parts) + ")"


def zfill4_sql(expr: str) -> str:
    return f"(CASE WHEN length(CAST({expr} AS VARCHAR)) < 4 THEN lpad(CAST({expr} AS VARCHAR), 4, '0') ELSE CAST({expr} AS VARCHAR) END)"


def token_sql(m: str) -> str:
    short = f"substr(upper(regexp_replace({m}, '[^A-Za-z0-9]+', '', 'g')), 1, 12)"
    return f"(CASE WHEN {short} = {m} THEN {short} ELSE {short} || '-' || substr(sha256({m}), 1, 16) END)"


def sessions_ctes(src: str = "sensor_readings") -> str:
    """Virtual batches on the sensor view: ``vb`` has row_order, gap_id, win_id,
    and ``vb_auto`` the ids of the default mode."""
    from batchlens.constants import ACTIVE_MODES

    modes = ", ".join(f"'{m}'" for m in ACTIVE_MODES)
    w = "PARTITION BY m ORDER BY ts, row_order"
    return f"""vs0 AS (SELECT row_order, CAST(timestamp AS TIMESTAMP) AS ts,
    coalesce(nullif(CAST(machine_id AS VARCHAR), ''), 'M01') AS m,
    coalesce(CAST(machine_id AS VARCHAR), 'M01') AS mach_raw,
    coalesce(CAST(operation_mode AS VARCHAR), 'Run') AS Phase,
    coalesce(lower(CAST(operation_mode AS VARCHAR)) IN ({modes}), false) AS act0
  FROM {src}),
s_any AS (SELECT count_if(act0) > 0 AS any_act FROM vs0),
vs1 AS (SELECT vs0.*, CASE WHEN any_act THEN act0 ELSE true END AS act FROM vs0 CROSS JOIN s_any),
vs2 AS (SELECT vs1.*,
    coalesce(date_diff('microsecond', lag(ts) OVER ({w}), ts) / 60000000.0, 0.0) AS gap,
    act AND NOT coalesce(lag(act) OVER ({w}), false) AS mode_start,
    row_number() OVER ({w}) AS mpos
  FROM vs1),
s_thr AS (SELECT least(greatest(coalesce(quantile_cont(gap, 0.5) FILTER (WHERE gap > 0), 30.0) * 3.0, 30.0), 720.0) AS thr FROM vs2),
vs3 AS (SELECT vs2.*, sum(CASE WHEN gap > thr OR mode_start THEN 1 ELSE 0 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nb
  FROM vs2 CROSS JOIN s_thr),
vb AS (SELECT vs3.*,
    'AUTO_' || {token_sql('m')} || '_' || {zfill4_sql('nb + 1')} AS gap_id,
    'AUTO_' || {token_sql('m')} || '_' || {zfill4_sql('CAST(floor((mpos - 1) / 60) AS BIGINT) + 1')} AS win_id
  FROM vs3),
vb_auto AS (SELECT vb.*, gap_id AS Batch_ID FROM vb)"""


def adaptive_ctes(ef: float = DEFAULT_EMISSION_FACTOR) -> str:
    """Adaptive path on the sensor view (branches fixed by its columns:
    power -> energy, throughput -> output, defect -> quality)."""
    efr = repr(float(ef))
    return f"""{views('sensor_readings')},
{sessions_ctes()},
st_d AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts, row_order), ts) / 60000000.0 AS d FROM vs0),
stp AS (SELECT coalesce(least(greatest(quantile_cont(d, 0.5), 0.2), 15.0), 1.0) AS step FROM st_d WHERE d > 0 AND d < 120),
sa AS (SELECT quantile_cont(temperature_c, 0.5) AS med_t, quantile_cont(power_kw, 0.5) AS med_p,
    quantile_cont(throughput, 0.5) AS med_o, max(defect_rate) AS max_d,
    min(throughput) AS min_o, max(throughput) AS max_o FROM sensor_readings),
r1 AS (SELECT r.row_order, v.Batch_ID, v.ts, v.mach_raw AS Machine_ID, v.Phase, r.temperature_c, r.power_kw, r.throughput,
    {clip('r.power_kw', '0.0')} * step / 60.0 AS energy,
    {clip("100.0 - r.defect_rate * (CASE WHEN max_d <= 1.5 THEN 100.0 ELSE 1.0 END)", '0.0', '100.0')} AS quality
  FROM sensor_readings r JOIN vb_auto v USING (row_order) CROSS JOIN stp CROSS JOIN sa),
sb AS (SELECT quantile_cont(energy, 0.5) AS med_e FROM r1),
bstart AS (SELECT Batch_ID, min(ts) AS t0 FROM r1 GROUP BY Batch_ID),
ts_filled AS (SELECT r1.row_order, r1.Batch_ID,
    coalesce(date_diff('microsecond', t0, ts) / 60000000.0, 0.0) AS Time_Minutes,
    Phase,
    coalesce(temperature_c, med_t) AS Temperature_C,
    CAST(5.0 AS DOUBLE) AS Pressure_Bar, CAST(45.0 AS DOUBLE) AS Humidity_Percent,
    {norm('throughput', 'min_o', 'max_o')} * 250.0 + 120.0 AS Motor_Speed_RPM,
    CAST(22.0 AS DOUBLE) AS Compression_Force_kN, CAST(10.0 AS DOUBLE) AS Flow_Rate_LPM,
    coalesce(power_kw, med_p) AS Power_Consumption_kW,
    CAST(1.5 AS DOUBLE) AS Vibration_mm_s, Machine_ID,
    coalesce(throughput, med_o) AS Output_Signal,
    coalesce(quality, 55.0) AS Quality_Score_Row,
    coalesce(energy, med_e) AS Energy_kWh_Row
  FROM r1 JOIN bstart USING (Batch_ID) CROSS JOIN sa CROSS JOIN sb),
ad_agg AS (SELECT Batch_ID, max(Time_Minutes) AS Duration_Minutes, count(Time_Minutes) AS Data_Points,
    {xavg('Temperature_C')} AS Avg_Temperature, max(Temperature_C) AS Max_Temperature,
    {xavg('Pressure_Bar')} AS Avg_Pressure, {xavg('Humidity_Percent')} AS Avg_Humidity_Percent,
    max(Compression_Force_kN) AS Max_Compression_Force_kN,
    {xavg('Power_Consumption_kW')} AS Avg_Power_Consumption_kW, max(Power_Consumption_kW) AS Peak_Power_kW,
    max(Motor_Speed_RPM) AS Max_Motor_Speed_RPM, {xavg('Vibration_mm_s')} AS Avg_Vibration_mm_s,
    {xavg('Flow_Rate_LPM')} AS Avg_Flow_Rate_LPM, count(DISTINCT Phase) AS Phase_Count,
    {xavg('Output_Signal')} AS Output_Signal, {xavg('Quality_Score_Row')} AS Quality_Score,
    coalesce({xsum('Energy_kWh_Row')}, 0.0) AS Total_Energy_kWh
  FROM ts_filled GROUP BY Batch_ID),
f_s1 AS (SELECT {minmax(['Output_Signal', 'Quality_Score', 'Duration_Minutes', 'Avg_Vibration_mm_s', 'Total_Energy_kWh'])} FROM ad_agg),
f1 AS (SELECT ad_agg.*, coalesce(Max_Motor_Speed_RPM, {norm('Output_Signal', 'f_s1.min_Output_Signal', 'f_s1.max_Output_Signal')} * 250.0 + 120.0) AS Machine_Speed
  FROM ad_agg CROSS JOIN f_s1),
f_ms AS (SELECT min(Machine_Speed) AS min_ms, max(Machine_Speed) AS max_ms FROM f1),
f2 AS (SELECT f1.*,
    {rint(clip(f"68.0 + (0.65 * {norm('Output_Signal', 'min_Output_Signal', 'max_Output_Signal')} + 0.35 * {norm('Quality_Score', 'min_Quality_Score', 'max_Quality_Score')}) * 31.0", '60.0', '99.5'))} AS Yield_Percent,
    {rint(clip(f"(0.40 * {norm('Machine_Speed', 'min_ms', 'max_ms')} + 0.30 * {norm('Duration_Minutes', 'min_Duration_Minutes', 'max_Duration_Minutes', True)} + 0.20 * {norm('Output_Signal', 'min_Output_Signal', 'max_Output_Signal')} + 0.10 * {norm('Avg_Vibration_mm_s', 'min_Avg_Vibration_mm_s', 'max_Avg_Vibration_mm_s', True)}) * 100.0", '0.0', '100.0'))} AS Performance_Score,
    {rint(f'Total_Energy_kWh * {efr}')} AS Carbon_kg
  FROM f1 CROSS JOIN f_s1 CROSS JOIN f_ms),
f3 AS (SELECT f2.*, {rint(f"0.35 * Quality_Score + 0.35 * Yield_Percent + 0.30 * (100.0 - {norm('Total_Energy_kWh', 'min_Total_Energy_kWh', 'max_Total_Energy_kWh')} * 100.0)")} AS Process_Health_Score
  FROM f2 CROSS JOIN f_s1),
f_s2 AS (SELECT min(Yield_Percent) AS min_y, max(Yield_Percent) AS max_y, min(Carbon_kg) AS min_c, max(Carbon_kg) AS max_c FROM f3),
f4 AS (SELECT f3.*, {rint(f"(0.40 * {norm('Yield_Percent', 'min_y', 'max_y')} + 0.15 * {norm('Quality_Score', 'min_Quality_Score', 'max_Quality_Score')} + 0.20 * {norm('Total_Energy_kWh', 'min_Total_Energy_kWh', 'max_Total_Energy_kWh', True)} + 0.15 * {norm('Carbon_kg', 'min_c', 'max_c', True)} + 0.10 * {norm('Duration_Minutes', 'min_Duration_Minutes', 'max_Duration_Minutes', True)}) * 100.0")} AS Eco_Efficiency_Score
  FROM f3 CROSS JOIN f_s1 CROSS JOIN f_s2),
f5 AS (SELECT f4.*, CASE WHEN Eco_Efficiency_Score > -1.0 AND Eco_Efficiency_Score <= 40.0 THEN 'Red'
    WHEN Eco_Efficiency_Score > 40.0 AND Eco_Efficiency_Score <= 70.0 THEN 'Yellow'
    WHEN Eco_Efficiency_Score > 70.0 AND Eco_Efficiency_Score <= 100.0 THEN 'Green' END AS Green_Zone FROM f4),
c_st2 AS (SELECT min(coalesce(Output_Signal, 50.0)) AS min_out, max(coalesce(Output_Signal, 50.0)) AS max_out,
    min(coalesce(Avg_Flow_Rate_LPM, 10.0)) AS min_flow, max(coalesce(Avg_Flow_Rate_LPM, 10.0)) AS max_flow,
    min(coalesce(Quality_Score, 60.0)) AS min_q, max(coalesce(Quality_Score, 60.0)) AS max_q,
    quantile_cont(coalesce(Quality_Score, 60.0), 0.5) AS med_q,
    quantile_cont(60.0 + coalesce(Quality_Score, 60.0) * 0.35, 0.5) AS m_hard,
    quantile_cont({clip('(100.0 - coalesce(Quality_Score, 60.0)) / 140.0', '0.05', '1.8')}, 0.5) AS m_fri,
    quantile_cont(65.0 + coalesce(Quality_Score, 60.0) * 0.28, 0.5) AS m_diss,
    quantile_cont(94.0 + coalesce(Quality_Score, 60.0) * 0.05, 0.5) AS m_cu FROM f5),
ad_features AS (SELECT f5.* EXCLUDE (Machine_Speed),
    greatest(coalesce(Duration_Minutes, 30.0) * 0.35, 3.0) AS Granulation_Time,
    coalesce(2.0 + {norm('coalesce(Output_Signal, 50.0)', 'min_out', 'max_out')} * 8.0, 5.0) AS Binder_Amount,
    coalesce(Avg_Temperature, 85.0) AS Drying_Temp,
    greatest(coalesce(Duration_Minutes, 30.0) * 0.25, 2.0) AS Drying_Time,
    coalesce(Max_Compression_Force_kN, 22.0) AS Compression_Force,
    greatest(coalesce(Machine_Speed, {norm('coalesce(Output_Signal, 50.0)', 'min_out', 'max_out')} * 250.0 + 120.0), 30.0) AS Machine_Speed,
    coalesce(0.6 + {norm('coalesce(Avg_Flow_Rate_LPM, 10.0)', 'min_flow', 'max_flow')} * 1.0, 0.9) AS Lubricant_Conc,
    coalesce({clip('coalesce(Avg_Humidity_Percent, 44.0) / 20.0', '1.2', '6.5')}, 2.2) AS Moisture_Content,
    CAST(500.0 AS DOUBLE) AS Tablet_Weight, m_hard AS Hardness, m_fri AS Friability,
    (1.0 - (CASE WHEN abs(max_q - min_q) <= 1e-8 THEN 0.5 ELSE least(greatest((med_q - min_q) / (max_q - min_q), 0.0), 1.0) END)) * 20.0 + 6.0 AS Disintegration_Time,
    m_diss AS Dissolution_Rate, m_cu AS Content_Uniformity,
    {", ".join(f"CAST(0.0 AS DOUBLE) AS {c}" for c in CONTROL_PARAMETERS if c != "Machine_Speed")}
  FROM f5 CROSS JOIN c_st2)"""
