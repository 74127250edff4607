"""Comparison, recommendation, ROI, compliance, report and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchlens import constants as K
from batchlens.constants import CONTROL_PARAMETERS, DEFAULT_SCENARIOS, OBJECTIVE_DIRECTIONS, PRIMARY_OBJECTIVES
from batchlens.operators import compare as C
from batchlens.operators.ordering import ordered_scan
from batchlens.plans import context
from batchlens.plans import sqlgen as S
from batchlens.plans.registry import query

FOCUS = [*PRIMARY_OBJECTIVES, *CONTROL_PARAMETERS]


def _gp_sql() -> str:
    """CTEs ending in ``gp``: the 'Balanced' signature row (Standard targets)."""
    return f"""{S.structured_ctes()}, {S.targets_cte('Standard')}, {S.objective_stats_cte()},
{S.candidates_cte()},
gp AS (SELECT * FROM (SELECT cand.*, {S.score_sql(DEFAULT_SCENARIOS['Balanced'])} AS Scenario_Score FROM cand CROSS JOIN ost)
       ORDER BY Scenario_Score DESC NULLS LAST, Batch_ID LIMIT 1)"""


def _compare_sql() -> str:
    parts = []
    for m in FOCUS:
        d = OBJECTIVE_DIRECTIONS.get(m)
        if d == "max":
            st = f"CASE WHEN f.{m} >= g.{m} THEN '{K.STATUS_MAX_OK}' ELSE '{K.STATUS_MAX_BAD}' END"
        elif d == "min":
            st = f"CASE WHEN f.{m} <= g.{m} THEN '{K.STATUS_MIN_OK}' ELSE '{K.STATUS_MIN_BAD}' END"
        else:
            st = f"CASE WHEN abs(f.{m} - g.{m}) <= 0.05 * (abs(g.{m}) + 1e-6) THEN '{K.STATUS_ALIGNED}' ELSE '{K.STATUS_ADJUST}' END"
        parts.append(
            f"SELECT f.Batch_ID, '{m}' AS Metric, {S.rint(f'CAST(f.{m} AS DOUBLE)', 3)} AS Current, {S.rint(f'g.{m}', 3)} AS Golden, "
            f"{S.rint(f'f.{m} - g.{m}', 3)} AS Deviation, "
            f"{S.rint(f'CASE WHEN abs(g.{m}) <= 1e-8 THEN 0.0 ELSE (f.{m} - g.{m}) / g.{m} * 100.0 END', 2)} AS Deviation_Pct, {st} AS Status "
            f"FROM features f CROSS JOIN gp g"
        )
    return f"WITH {_gp_sql()}\n" + "\nUNION ALL\n".join(parts)


@query("compare_golden", _compare_sql)
def q_compare_golden(spark, sf):
    """V1 (+H9/J4): every batch against the 'Balanced' golden profile."""
    return C.compare_to_golden(context.features(spark, sf), context.golden_profile(spark, sf))


def _num(e: str) -> str:
    return f"CAST(CAST({e} AS DOUBLE) AS VARCHAR)"


def recs_ctes() -> str:
    """CTE chain ending in ``recs`` (Batch_ID, Rec_No, Recommendation)."""
    r1 = lambda e: S.rint(e, 1)
    eh = "(g.Total_Energy_kWh > 0 AND f.Total_Energy_kWh > g.Total_Energy_kWh * 1.05)"
    excess = _num(r1("(f.Total_Energy_kWh - g.Total_Energy_kWh) / g.Total_Energy_kWh * 100.0"))
    ql = "(g.Quality_Score > 0 AND f.Quality_Score < g.Quality_Score * 0.97)"
    yl = "(g.Yield_Percent > 0 AND f.Yield_Percent < g.Yield_Percent * 0.98)"
    ygap = _num(r1("(g.Yield_Percent - f.Yield_Percent) / g.Yield_Percent * 100.0"))
    rules = [
        f"CASE WHEN {eh} AND f.Heat_Duration - g.Heat_Duration > 1 THEN 'Reduce heat duration by ~' || {_num('least(6.0, ' + r1('f.Heat_Duration - g.Heat_Duration') + ')')} || ' minutes to cut excess energy (' || {excess} || '% above golden).' END",
        f"CASE WHEN {eh} AND f.Heat_Temp - g.Heat_Temp > 1 THEN 'Lower heat temp by ~' || {_num('least(5.0, ' + r1('f.Heat_Temp - g.Heat_Temp') + ')')} || '°C to align with golden thermal profile.' END",
        f"CASE WHEN {eh} THEN CASE WHEN g.Machine_Speed > 0 AND f.Machine_Speed < g.Machine_Speed * 0.95 THEN '{K.REC_SPEED_LOW}' ELSE '{K.REC_IDLE}' END END",
        f"CASE WHEN {ql} THEN 'Quality score is ' || {_num(r1('(g.Quality_Score - f.Quality_Score) / g.Quality_Score * 100.0'))} || '% below golden benchmark.' END",
        f"CASE WHEN {ql} AND f.Process_Agent_Amount < g.Process_Agent_Amount THEN '{K.REC_AGENT.format(key='process agent amount')}' END",
        f"CASE WHEN {ql} AND f.Press_Force < g.Press_Force THEN '{K.REC_FORCE.format(key='press force')}' END",
        f"CASE WHEN {ql} AND f.Moisture_Level > g.Moisture_Level + 0.1 THEN '{K.REC_MOISTURE.format(key='moisture level')}' END",
        f"CASE WHEN {yl} THEN CASE WHEN f.Cycle_Time < g.Cycle_Time THEN 'Yield is ' || {ygap} || '% below golden — cycle time is shorter than the golden profile. Increase it gradually to improve uniformity and output rate.' "
        f"ELSE 'Yield is ' || {ygap} || '% below golden — run a parameter comparison against the Golden Signature to isolate root cause.' END END",
        f"CASE WHEN g.Carbon_kg > 0 AND f.Carbon_kg > g.Carbon_kg * 1.05 THEN '{K.REC_CARBON}' END",
        f"CASE WHEN g.Eco_Efficiency_Score > 0 AND f.Eco_Efficiency_Score < g.Eco_Efficiency_Score * 0.95 THEN '{K.REC_ECO}' END",
    ]
    union = "\nUNION ALL\n".join(f"SELECT f.Batch_ID, {i} AS k, {r} AS txt FROM features f CROSS JOIN gp g" for i, r in enumerate(rules))
    return f"""{_gp_sql()},
raw AS ({union}),
kept AS (SELECT Batch_ID, k, txt FROM raw WHERE txt IS NOT NULL),
closeby AS (SELECT Batch_ID, 0 AS k, '{K.REC_CLOSE}' AS txt FROM features WHERE Batch_ID NOT IN (SELECT Batch_ID FROM kept)),
allr AS (SELECT * FROM kept UNION ALL SELECT * FROM closeby),
recs AS (SELECT Batch_ID, CAST(row_number() OVER (PARTITION BY Batch_ID ORDER BY k) AS BIGINT) AS Rec_No, txt AS Recommendation FROM allr)"""


@query("recommendations", lambda: f"WITH {recs_ctes()}\nSELECT * FROM recs")
def q_recommendations(spark, sf):
    """V2: rule-based recommendations for every batch vs the golden profile."""
    return C.recommendations(context.features(spark, sf), context.golden_profile(spark, sf))


def _roi_sql(cost: float, batches: int, extra_cols: str = "") -> str:
    per = f"greatest(0.0, (f.Total_Energy_kWh - g.Total_Energy_kWh) * {float(cost)!r})"
    return (f"SELECT f.Batch_ID, {S.rint('f.Total_Energy_kWh - g.Total_Energy_kWh', 3)} AS delta_energy_kwh, "
            f"{S.rint(per, 2)} AS savings_per_batch_usd, {S.rint(f'{per} * {float(batches)!r}', 2)} AS annual_savings_usd{extra_cols} "
            f"FROM features f CROSS JOIN gp g")


@query("roi", lambda: f"WITH {_gp_sql()}\n{_roi_sql(K.DEFAULT_ENERGY_COST, K.DEFAULT_ANNUAL_BATCHES)}")
def q_roi(spark, sf):
    """V3: energy delta, per-batch and annual savings (engine defaults)."""
    return C.roi(context.features(spark, sf), context.golden_profile(spark, sf))


def _industry_values() -> str:
    rows = []
    for n, c, e, s in K.INDUSTRY_PROFILES:
        c = K.DEFAULT_CARBON_LIMIT if c is None else c
        e = K.DEFAULT_ENERGY_LIMIT if e is None else e
        rows.append(f"('{n}', CAST({float(c)!r} AS DOUBLE), CAST({float(e)!r} AS DOUBLE), '{s}')")
    return "ind(industry, carbon_limit_kg, energy_limit_kwh, standard) AS (VALUES " + ", ".join(rows) + ")"


@query("compliance", lambda: f"""WITH {S.structured_ctes()}, {_industry_values()}
SELECT Batch_ID, industry, standard, coalesce(Total_Energy_kWh <= energy_limit_kwh, false) AS energy_compliant,
  coalesce(coalesce(Carbon_kg, Total_Energy_kWh * 0.82) <= carbon_limit_kg, false) AS carbon_compliant
FROM features CROSS JOIN ind""")
def q_compliance(spark, sf):
    """V6: regulatory energy/carbon compliance of every batch for every industry."""
    return C.compliance(context.features(spark, sf))


@query("carbon_impact", lambda: f"""WITH {_gp_sql()}
SELECT f.Batch_ID, {S.rint('f.Total_Energy_kWh * 0.82')} AS Current_CO2_kg, {S.rint('f.Total_Energy_kWh * 0.82 - g.Carbon_kg')} AS CO2_vs_Golden_kg
FROM features f CROSS JOIN gp g""")
def q_carbon_impact(spark, sf):
    """V7: estimated CO2 per batch and its difference to the golden carbon."""
    return C.carbon_impact(context.features(spark, sf), context.golden_profile(spark, sf))


@query("red_zone_alerts", lambda: f"""WITH {S.structured_ctes()}
SELECT Batch_ID, 'Alert: Red Zone batch ' || Batch_ID AS Subject,
  'Batch ' || Batch_ID || ' is in Red Zone.' || chr(10) || 'Energy=' || printf('%.2f', {S.rint('Total_Energy_kWh')}) ||
  ' kWh, Quality=' || printf('%.2f', {S.rint('Quality_Score')}) || ', Eco=' || printf('%.2f', {S.rint('Eco_Efficiency_Score')}) AS Body
FROM features WHERE Green_Zone = 'Red'
  AND Batch_ID NOT IN (SELECT Batch_ID FROM features WHERE Green_Zone = 'Red' AND Eco_Efficiency_Score <= 20.0)""")
def q_red_zone_alerts(spark, sf):
    """V11 (+J7): Red batches minus those already alerted (here: the severe
    ones, eco <= 20, alerted by an earlier pass)."""
    f = context.features(spark, sf)
    alerted = f.filter((F.col("Green_Zone") == "Red") & (F.col("Eco_Efficiency_Score") <= 20.0))
    return C.red_zone_alerts(f, alerted)


def _plant_avg_sql_cte() -> str:
    return "pa AS (SELECT " + ", ".join(f"{S.xavg(c)} AS {c}" for c, _ in C.FLEX_METRICS) + " FROM features)"


def _flex_sql() -> str:
    parts = []
    for label, src in (("Golden benchmark", "gp"), ("Plant average", "pa")):
        for col, name in C.FLEX_METRICS:
            ref = f"coalesce(CAST(f.{col} AS DOUBLE), 0.0)"
            parts.append(f"SELECT f.Batch_ID, '{label}' AS Comparison, '{name}' AS Metric, {S.rint(ref, 6)} AS Reference, "
                         f"{S.rint(f'{src}.{col}', 6)} AS Compared, {S.rint(f'{src}.{col} - {ref}', 6)} AS Delta FROM features f CROSS JOIN {src}")
    for col, name in C.FLEX_METRICS:
        ref = f"coalesce(CAST(f.{col} AS DOUBLE), 0.0)"
        cmpv = f"coalesce(CAST(f.prev_{col} AS DOUBLE), {ref})"
        parts.append(f"SELECT f.Batch_ID, 'Previous batch', '{name}', {S.rint(ref, 6)}, {S.rint(cmpv, 6)}, {S.rint(f'{cmpv} - {ref}', 6)} FROM fp f")
    lags = ", ".join(f"lag({c}) OVER (ORDER BY Batch_ID) AS prev_{c}" for c, _ in C.FLEX_METRICS)
    return f"""WITH {_gp_sql()}, {_plant_avg_sql_cte()},
fp AS (SELECT features.*, {lags} FROM features)
""" + "\nUNION ALL\n".join(parts)


#: Batches that one task sorts for the previous-batch scan.
RANGE_ROWS = 250_000


@query("flex_compare", _flex_sql)
def q_flex_compare(spark, sf):
    """V5: every batch vs golden, plant average and the previous batch (by id)."""
    f = context.features(spark, sf).select("Batch_ID", *[c for c, _ in C.FLEX_METRICS])
    from batchlens.functions.numeric import exact_avg

    pa = f.agg(*[exact_avg(c).alias(c) for c, _ in C.FLEX_METRICS], F.count(F.lit(1)).alias("n")).first().asDict()
    # ranges of bounded size, however many batches there are
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pa.pop("n") // RANGE_ROWS))
    prev = ordered_scan(f, [], ["Batch_ID"], lags={f"prev_{c}": F.col(c) for c, _ in C.FLEX_METRICS}, partitions=parts, pos_col="_pos").drop("_pos")
    return C.flex_compare(f, context.golden_profile(spark, sf), pa, prev)
