"""Analytics queries: averages, benchmarks, trends, correlations, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchlens.constants import DEFAULT_SCENARIOS, INDUSTRY_PROFILES, DEFAULT_CARBON_LIMIT, DEFAULT_ENERGY_LIMIT
from batchlens.operators import analytics as A
from batchlens.operators import compare as C
from batchlens.operators import ranking
from batchlens.plans import context
from batchlens.plans import sqlgen as S
from batchlens.plans.q_compare import _gp_sql
from batchlens.plans.q_decision import _cand_sql
from batchlens.plans.registry import query
from batchlens.sources.tables import process_readings

CORR_METRICS = A.ANALYSIS_METRICS[:8]
TREND_METRICS = A.ANALYSIS_METRICS[:4]
Z = 2.2


@query("plant_average", lambda: f"WITH {S.structured_ctes()}\nSELECT " + ", ".join(f"{S.xavg(m)} AS {m}" for m in A.KPI5) + " FROM features")
def q_plant_average(spark, sf):
    """Plant average of the five headline KPIs."""
    return A.plant_average(context.features(spark, sf))


def _bench_sql_ctes() -> str:
    stats = ", ".join(
        f"quantile_cont({m}, 0.5) AS med_{m}, quantile_cont({m}, {0.1 if m in A.LOWER_IS_BETTER else 0.9}) AS top_{m}"
        for m in A.KPI5
    )
    return f"{_gp_sql()},\nbst AS (SELECT {stats} FROM features)"


@query("benchmark_profile", lambda: f"WITH {_bench_sql_ctes()}\n" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS Metric, coalesce(gp.{m}, med_{m}) AS Golden, top_{m} AS Top10, med_{m} AS Median FROM bst CROSS JOIN gp" for m in A.KPI5))
def q_benchmark_profile(spark, sf):
    """Golden / top-10 % / median benchmark per KPI."""
    return A.benchmark_profile(context.features(spark, sf), context.golden_profile(spark, sf))


def _gap_sql() -> str:
    parts = []
    for col, label, lib, unit in C.GAP_METRICS:
        cur, ref = f"CAST(f.{col} AS DOUBLE)", f"top_{col}"
        delta = f"({cur} - {ref})"
        pct = f"({delta} / abs({ref}) * 100.0)"
        better = f"{delta} < 0" if lib else f"{delta} > 0"
        sent = (f"printf('%.2f', {S.rint(f'abs({delta})', 2)}) || '{unit} ' || CASE WHEN {delta} > 0 THEN 'higher' ELSE 'lower' END || ' (' || "
                f"printf('%.1f', {S.rint(f'abs({pct})', 1)}) || '%) than benchmark, ' || CASE WHEN {better} THEN 'better' ELSE 'worse' END || '.'")
        txt = f"CASE WHEN {ref} = 0 THEN 'No baseline available.' WHEN abs({delta}) < 1e-9 THEN 'On target.' ELSE {sent} END"
        parts.append(f"SELECT f.Batch_ID, '{label}' AS Metric, {txt} AS Gap FROM features f CROSS JOIN bst")
    return f"WITH {_bench_sql_ctes()}\n" + "\nUNION ALL\n".join(parts)


@query("benchmark_gap", _gap_sql)
def q_benchmark_gap(spark, sf):
    """V4: every batch's gap sentence against the top-10 % benchmark."""
    f = context.features(spark, sf)
    vals = A.benchmark_values(f, context.golden_profile(spark, sf))
    return C.benchmark_gap(f, {m: v["Top10"] for m, v in vals.items()})


@query("monthly_energy", lambda: f"""WITH {S.structured_ctes()},
idx AS (SELECT Batch_ID, Total_Energy_kWh, row_number() OVER (ORDER BY Batch_ID) - 1 AS i FROM features),
par AS (SELECT greatest(1, 25920 // count(*)) AS step FROM features),
dated AS (SELECT CAST(date_trunc('month', TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(i * step AS BIGINT))) AS DATE) AS m, Total_Energy_kWh FROM idx CROSS JOIN par),
mon AS (SELECT m, {S.xsum('Total_Energy_kWh')} AS e FROM dated GROUP BY m),
rng AS (SELECT min(m) AS m0, max(m) AS m1 FROM mon),
spine AS (SELECT CAST(unnest(generate_series(CAST(m0 AS TIMESTAMP), CAST(m1 AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM rng),
full_m AS (SELECT spine.m, coalesce(mon.e, 0.0) AS Energy_kWh FROM spine LEFT JOIN mon USING (m)),
roll AS (SELECT m, Energy_kWh, avg(Energy_kWh) OVER (ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r FROM full_m)
SELECT strftime(m, '%Y-%m-%d') AS Month, Energy_kWh, {S.rint('r', 6)} AS Rolling_3M_kWh FROM roll ORDER BY m DESC LIMIT 30""")
def q_monthly_energy(spark, sf):
    """Monthly energy on a synthetic date axis, empty months = 0, 3-month rolling mean, last 30 months."""
    return A.monthly_energy(context.features(spark, sf))


def _corr_sql_expr(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    cov = f"covar_pop(CASE WHEN {both} THEN {a} END, CASE WHEN {both} THEN {b} END)"
    den = f"(stddev_pop(CASE WHEN {both} THEN {a} END) * stddev_pop(CASE WHEN {both} THEN {b} END))"
    return f"coalesce(CASE WHEN {den} > 0 THEN {S.rint(f'{cov} / {den}', 9)} END, 0.0)"


@query("corr_matrix", lambda: f"WITH {S.structured_ctes()}\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS Metric_A, '{b}' AS Metric_B, {_corr_sql_expr(a, b)} AS Corr FROM features" for a in CORR_METRICS for b in CORR_METRICS))
def q_corr_matrix(spark, sf):
    """Pairwise-complete correlation of 8 metrics, long form, undefined -> 0."""
    return A.corr_matrix(context.features(spark, sf), CORR_METRICS)


@query("score_summary", lambda: f"""WITH {S.structured_ctes()}, {S.targets_cte('Standard')}, {S.objective_stats_cte()},
{S.candidates_cte()},
sc AS (SELECT {S.score_sql(DEFAULT_SCENARIOS['Balanced'])} AS s FROM cand CROSS JOIN ost)
SELECT count(s) AS n, {S.xavg('s')} AS mean_score, {S.rint('stddev_samp(s)', 9)} AS sd_score,
  {S.rint('greatest(0.0, 100.0 - stddev_samp(s) * 2.0)', 9)} AS confidence FROM sc""")
def q_score_summary(spark, sf):
    """Mean and spread of the 'Balanced' scores, confidence = max(0, 100 - 2 sd)."""
    f = context.features(spark, sf)
    r = ranking.rank_batches(f, DEFAULT_SCENARIOS["Balanced"], ranking.build_targets(f, "Standard"))
    return A.score_summary(r)


@query("window_summary", lambda: f"""WITH {S.structured_ctes()},
lastid AS (SELECT max(Batch_ID) AS m FROM features),
ws AS (SELECT count(*) AS n, max_by(Total_Energy_kWh, Batch_ID) AS energy_latest,
  {S.xavg('CASE WHEN Batch_ID <> m THEN Total_Energy_kWh END')} AS prev_mean,
  {S.rint('stddev_samp(Total_Energy_kWh)', 9)} AS energy_sd,
  min(Avg_Temperature) AS temp_min, {S.xavg('Avg_Temperature')} AS temp_mean, max(Avg_Temperature) AS temp_max,
  {_corr_sql_expr('Yield_Percent', 'Quality_Score')} AS yield_quality_corr FROM features CROSS JOIN lastid)
SELECT n, energy_latest, coalesce(prev_mean, energy_latest) AS energy_prev_mean, energy_sd, temp_min, temp_mean, temp_max, yield_quality_corr,
  CASE WHEN coalesce(energy_sd, 0.0) < 4 THEN 'stable' ELSE 'needs tighter control' END AS stability,
  CASE WHEN yield_quality_corr >= 0.6 THEN 'strongly aligned' WHEN yield_quality_corr >= 0.3 THEN 'moderately aligned' ELSE 'weakly aligned' END AS alignment
FROM ws""")
def q_window_summary(spark, sf):
    """Latest vs earlier energy, spread, temperature range, yield-quality alignment."""
    return A.window_summary(context.features(spark, sf))


def _zstats_cte() -> str:
    return f"zs AS (SELECT {S.xavg('Total_Energy_kWh')} AS mu, stddev_pop(Total_Energy_kWh) AS sd FROM features)"


@query("zscore_anomalies", lambda: f"""WITH {S.structured_ctes()}, {_zstats_cte()}
SELECT Batch_ID, Total_Energy_kWh,
  CASE WHEN sd > 0 THEN {S.rint('abs(Total_Energy_kWh - mu) / sd', 6)} END AS z_score,
  CASE WHEN sd > 0 THEN coalesce(abs(Total_Energy_kWh - mu) / sd >= {Z}, false) ELSE false END AS Energy_Anomaly
FROM features CROSS JOIN zs""")
def q_zscore_anomalies(spark, sf):
    """Energy z-score flags over the whole table (z = 2.2)."""
    return A.zscore_flags(context.features(spark, sf), Z).select("Batch_ID", "Total_Energy_kWh", "z_score", "Energy_Anomaly")


@query("control_limits", lambda: f"""WITH {S.structured_ctes()}, {_zstats_cte()},
lim AS (SELECT mu, mu + coalesce(sd, 0.0) * {Z} AS up, mu - coalesce(sd, 0.0) * {Z} AS lo FROM zs)
SELECT {S.rint('mu', 9)} AS mean, {S.rint('up', 9)} AS upper, {S.rint('lo', 9)} AS lower,
  CAST((SELECT count_if(Total_Energy_kWh > up) FROM features) AS BIGINT) AS n_above,
  CAST((SELECT count_if(Total_Energy_kWh < lo) FROM features) AS BIGINT) AS n_below FROM lim""")
def q_control_limits(spark, sf):
    """Mean +- 2.2 population sd and how many batches fall outside."""
    return A.control_limits(context.features(spark, sf), Z)


@query("top_anomalies", lambda: f"""WITH {S.structured_ctes()}, {_zstats_cte()}
SELECT Batch_ID, Total_Energy_kWh, Quality_Score, Yield_Percent, Carbon_kg FROM features CROSS JOIN zs
WHERE sd > 0 AND abs(Total_Energy_kWh - mu) / sd >= {Z}
ORDER BY Total_Energy_kWh DESC, Batch_ID LIMIT 10""")
def q_top_anomalies(spark, sf):
    """The 10 highest-energy flagged batches (a top-k report)."""
    return A.top_anomalies(context.features(spark, sf), Z, 10)


@query("lookback_window", lambda: f"""WITH {S.structured_ctes()},
last AS (SELECT {", ".join(A.HISTORY_COLUMNS)} FROM features ORDER BY Batch_ID DESC LIMIT 80)
SELECT *, CAST(row_number() OVER (ORDER BY Batch_ID) AS BIGINT) AS Batch_Seq FROM last""")
def q_lookback_window(spark, sf):
    """The last 80 batches by id, numbered 1..80."""
    return A.lookback(context.features(spark, sf), 80)


@query("metric_long", lambda: f"""WITH {S.structured_ctes()},
idx AS (SELECT row_number() OVER (ORDER BY Batch_ID) AS Batch_Seq, {", ".join(TREND_METRICS)} FROM features)
""" + "\nUNION ALL\n".join(f"SELECT Batch_Seq, '{m}' AS Metric, CAST({m} AS DOUBLE) AS Value FROM idx" for m in TREND_METRICS))
def q_metric_long(spark, sf):
    """Trend metrics melted to long form over every batch."""
    return A.metric_long(context.features(spark, sf), TREND_METRICS)


@query("rolling_process", lambda: f"""WITH {S.views('process_readings')},
p AS (SELECT Batch_ID, Time_Minutes, Temperature_C, Motor_Speed_RPM,
  row_number() OVER (PARTITION BY Batch_ID ORDER BY Time_Minutes, Temperature_C, Motor_Speed_RPM) AS pos,
  count(*) OVER (PARTITION BY Batch_ID) AS n FROM process_readings WHERE Time_Minutes IS NOT NULL),
r AS (SELECT a.Batch_ID, a.Time_Minutes, a.Temperature_C, a.Motor_Speed_RPM, a.pos,
  avg(b.Temperature_C) AS t, avg(b.Motor_Speed_RPM) AS m
  FROM p a JOIN p b ON a.Batch_ID = b.Batch_ID AND b.pos <= a.pos AND b.pos > a.pos - greatest(5, a.n // 50)
  GROUP BY ALL)
SELECT Batch_ID, Time_Minutes, Temperature_C, Motor_Speed_RPM, pos, {S.rint('t', 6)} AS Temperature_C_Roll, {S.rint('m', 6)} AS Motor_Speed_RPM_Roll FROM r""")
def q_rolling_process(spark, sf):
    """Per-batch rolling mean of temperature and rpm, width max(5, n // 50)."""
    rd = process_readings(spark, sf).select("Batch_ID", "Time_Minutes", "Temperature_C", "Motor_Speed_RPM").filter(F.col("Time_Minutes").isNotNull())
    return A.rolling_means(rd, "Batch_ID", ["Time_Minutes", "Temperature_C", "Motor_Speed_RPM"], ["Temperature_C", "Motor_Speed_RPM"])


def _pc_sql() -> str:
    rows = ", ".join(
        f"('{n}', CAST({float(DEFAULT_ENERGY_LIMIT if e is None else e)!r} AS DOUBLE), CAST({float(DEFAULT_CARBON_LIMIT if c is None else c)!r} AS DOUBLE))"
        for n, c, e, s in INDUSTRY_PROFILES
    )
    return f"""WITH {_cand_sql()},
pf AS (SELECT * FROM cand u WHERE NOT EXISTS (SELECT 1 FROM cand v WHERE {S.dominance_sql('u', 'v')})),
ind(industry, energy_limit_kwh, carbon_limit_kg) AS (VALUES {rows})
SELECT industry, count(*) AS n_pareto, CAST(count_if(Total_Energy_kWh <= energy_limit_kwh) AS BIGINT) AS n_energy_compliant,
  CAST(count_if(Carbon_kg <= carbon_limit_kg) AS BIGINT) AS n_carbon_compliant FROM pf CROSS JOIN ind GROUP BY industry"""


@query("pareto_compliance", _pc_sql)
def q_pareto_compliance(spark, sf):
    """How many Pareto-front batches meet each industry's limits."""
    from batchlens.operators import pareto
    from batchlens.plans.q_decision import _candidates

    front = pareto.pareto_front(_candidates(spark, sf).select("Batch_ID", *ranking.PRIMARY_OBJECTIVES))
    ind = C.industry_frame(spark)
    return front.crossJoin(F.broadcast(ind)).groupBy("industry").agg(
        F.count(F.lit(1)).alias("n_pareto"),
        F.count_if(F.col("Total_Energy_kWh") <= F.col("energy_limit_kwh")).alias("n_energy_compliant"),
        F.count_if(F.col("Carbon_kg") <= F.col("carbon_limit_kg")).alias("n_carbon_compliant"),
    )
