"""Reports: KPI report rows, batch answers, run summary, cleaning report,
route decision, random candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from batchlens import constants as K
from batchlens.constants import DEFAULT_SCENARIOS, OBJECTIVE_DIRECTIONS, PRIMARY_OBJECTIVES, CONTROL_PARAMETERS
from batchlens.functions.numeric import exact_avg
from batchlens.operators import candidates as CA
from batchlens.operators import compare as C
from batchlens.operators import golden, ranking
from batchlens.operators import schema_map as sm
from batchlens.plans import context, pipeline
from batchlens.plans import sqlgen as S
from batchlens.plans.q_compare import _gp_sql, recs_ctes
from batchlens.plans.registry import query
from batchlens.sources.tables import process_readings, production_batches, sensor_readings

AS_OF_TEXT = "2024-06-30 00:00 UTC"
IND = K.INDUSTRY_PROFILES[0]  # Pharmaceutical: the first (default) industry


def _fmt_sql(e: str, dp: int) -> str:
    return f"printf('%.{dp}f', {S.rint(e, dp)})"


def kpi_rows(features, profile: dict, emission_factor: float = K.DEFAULT_EMISSION_FACTOR):
    """V8: per batch, the executive report as ordered (Row_No, KPI, Value) rows."""
    ind, c_lim, e_lim, std = IND
    e = F.col("Total_Energy_kWh")
    carbon = F.coalesce(F.col("Carbon_kg"), e * F.lit(float(emission_factor)))
    roi = C.roi_columns(e, C._g(profile, "Total_Energy_kWh"), K.DEFAULT_ENERGY_COST, K.DEFAULT_ANNUAL_BATCHES)
    fixed_rows = [
        ("Report Generated (UTC)", F.lit(AS_OF_TEXT)),
        ("Industry Sector", F.lit(ind)),
        ("Regulatory Standard", F.lit(std)),
        ("Optimization Goal", F.lit("Balanced")),
        ("Current Batch", F.col("Batch_ID")),
        (K.REPORT_SECTION_PERFORMANCE, F.lit("")),
        ("Current Energy (kWh)", C.fixed(e, 2)),
        ("Current Quality Score", C.fixed(F.col("Quality_Score"), 2)),
        ("Current Yield %", C.fixed(F.coalesce(F.col("Yield_Percent"), F.lit(0.0)), 2)),
        ("Current Eco Score", C.fixed(F.col("Eco_Efficiency_Score"), 2)),
        ("Current Carbon (kg)", C.fixed(carbon, 3)),
        (K.REPORT_SECTION_COMPLIANCE, F.lit("")),
        (f"Energy limit ({ind})", F.lit(f"{e_lim:.1f} kWh")),
        ("Energy compliance", F.when(e <= F.lit(e_lim), F.lit(K.COMPLIANT)).otherwise(F.lit(K.NON_COMPLIANT))),
        (f"Carbon limit ({ind})", F.lit(f"{c_lim:.2f} kg")),
        ("Carbon compliance", F.when(carbon <= F.lit(c_lim), F.lit(K.COMPLIANT)).otherwise(F.lit(K.NON_COMPLIANT))),
        (K.REPORT_SECTION_ROI, F.lit("")),
        ("Energy delta vs Golden (kWh)", F.when(roi["delta_energy_kwh"].isNotNull(), F.format_string("%+.3f", roi["delta_energy_kwh"]))),
        ("Savings per batch (USD)", F.concat(F.lit("$"), F.format_string("%.2f", roi["savings_per_batch_usd"]))),
        ("Annual savings (USD)", F.concat(F.lit("$"), F.format_number(roi["annual_savings_usd"], 2))),
        (K.REPORT_SECTION_RECS, F.lit("")),
    ]
    base = F.array(*[F.struct(F.lit(i + 1).cast("bigint").alias("Row_No"), F.lit(k).alias("KPI"), v.alias("Value")) for i, (k, v) in enumerate(fixed_rows)])
    n_fixed = len(fixed_rows)
    recs = F.slice(C.recommendation_array(features, profile), 1, 5)
    rec_rows = F.transform(
        recs,
        lambda x, i: F.struct((F.lit(n_fixed + 1) + i).cast("bigint").alias("Row_No"), F.concat(F.lit("Rec "), (i + 1).cast("string")).alias("KPI"), x.alias("Value")),
    )
    return features.select("Batch_ID", F.explode(F.concat(base, rec_rows)).alias("r")).select("Batch_ID", "r.*")


def _kpi_sql() -> str:
    ind, c_lim, e_lim, std = IND
    e = "f.Total_Energy_kWh"
    carbon = f"coalesce(f.Carbon_kg, {e} * 0.82)"
    per = f"greatest(0.0, ({e} - g.Total_Energy_kWh) * {K.DEFAULT_ENERGY_COST!r})"
    delta3 = S.rint(f"{e} - g.Total_Energy_kWh", 3)
    rows = [
        ("Report Generated (UTC)", f"'{AS_OF_TEXT}'"),
        ("Industry Sector", f"'{ind}'"),
        ("Regulatory Standard", f"'{std}'"),
        ("Optimization Goal", "'Balanced'"),
        ("Current Batch", "f.Batch_ID"),
        (K.REPORT_SECTION_PERFORMANCE, "''"),
        ("Current Energy (kWh)", _fmt_sql(e, 2)),
        ("Current Quality Score", _fmt_sql("f.Quality_Score", 2)),
        ("Current Yield %", _fmt_sql("coalesce(f.Yield_Percent, 0.0)", 2)),
        ("Current Eco Score", _fmt_sql("f.Eco_Efficiency_Score", 2)),
        ("Current Carbon (kg)", _fmt_sql(carbon, 3)),
        (K.REPORT_SECTION_COMPLIANCE, "''"),
        (f"Energy limit ({ind})", f"'{e_lim:.1f} kWh'"),
        ("Energy compliance", f"CASE WHEN {e} <= {e_lim!r} THEN '{K.COMPLIANT}' ELSE '{K.NON_COMPLIANT}' END"),
        (f"Carbon limit ({ind})", f"'{c_lim:.2f} kg'"),
        ("Carbon compliance", f"CASE WHEN {carbon} <= {c_lim!r} THEN '{K.COMPLIANT}' ELSE '{K.NON_COMPLIANT}' END"),
        (K.REPORT_SECTION_ROI, "''"),
        ("Energy delta vs Golden (kWh)", f"printf('%+.3f', {delta3})"),
        ("Savings per batch (USD)", f"'$' || printf('%.2f', {S.rint(per, 2)})"),
        ("Annual savings (USD)", f"'$' || format('{{:,.2f}}', {S.rint(per + ' * ' + repr(float(K.DEFAULT_ANNUAL_BATCHES)), 2)})"),
        (K.REPORT_SECTION_RECS, "''"),
    ]
    parts = [f"SELECT f.Batch_ID, CAST({i + 1} AS BIGINT) AS Row_No, '{k}' AS KPI, {v} AS Value FROM features f CROSS JOIN gp g"
             for i, (k, v) in enumerate(rows)]
    parts.append(f"SELECT Batch_ID, CAST({len(rows)} + Rec_No AS BIGINT), 'Rec ' || CAST(Rec_No AS VARCHAR), Recommendation FROM recs WHERE Rec_No <= 5")
    return f"WITH {recs_ctes()}\n" + "\nUNION ALL\n".join(parts)


@query("kpi_report", _kpi_sql)
def q_kpi_report(spark, sf):
    """V8: the executive KPI report of every batch as (Row_No, KPI, Value) rows."""
    return kpi_rows(context.features(spark, sf), context.golden_profile(spark, sf))


def answer_columns(features, profile: dict):
    recs = C.recommendation_array(features, profile)
    on_target = []
    for o in PRIMARY_OBJECTIVES:
        g = F.lit(C._g(profile, o))
        ok = (F.col(o) >= g) if OBJECTIVE_DIRECTIONS[o] == "max" else (F.col(o) <= g)
        on_target.append(F.coalesce(ok, F.lit(False)).cast("int"))
    aligned = []
    for c in CONTROL_PARAMETERS:
        g = C._g(profile, c)
        ok = F.abs(F.col(c) - F.lit(g)) <= F.lit(0.05 * (abs(g) + 1e-6))
        aligned.append(F.coalesce(ok, F.lit(False)).cast("int"))
    roi = C.roi_columns(F.col("Total_Energy_kWh"), C._g(profile, "Total_Energy_kWh"), K.API_ENERGY_COST, K.API_ANNUAL_BATCHES)
    return features.select(
        "Batch_ID",
        F.lit("Balanced").alias("scenario"),
        F.size(recs).cast("bigint").alias("n_recommendations"),
        F.element_at(recs, 1).alias("first_recommendation"),
        sum(on_target, F.lit(0)).cast("bigint").alias("objectives_on_target"),
        sum(aligned, F.lit(0)).cast("bigint").alias("controls_aligned"),
        *[v.alias(k) for k, v in roi.items()],
    )


def _answer_sql() -> str:
    on = " + ".join(
        f"CAST(coalesce(f.{o} {'>=' if OBJECTIVE_DIRECTIONS[o] == 'max' else '<='} g.{o}, false) AS INTEGER)" for o in PRIMARY_OBJECTIVES
    )
    al = " + ".join(f"CAST(coalesce(abs(f.{c} - g.{c}) <= 0.05 * (abs(g.{c}) + 1e-6), false) AS INTEGER)" for c in CONTROL_PARAMETERS)
    per = f"greatest(0.0, (f.Total_Energy_kWh - g.Total_Energy_kWh) * {K.API_ENERGY_COST!r})"
    return f"""WITH {recs_ctes()},
ra AS (SELECT Batch_ID, count(*) AS n, min_by(Recommendation, Rec_No) AS first_rec FROM recs GROUP BY Batch_ID)
SELECT f.Batch_ID, 'Balanced' AS scenario, CAST(ra.n AS BIGINT) AS n_recommendations, ra.first_rec AS first_recommendation,
  CAST({on} AS BIGINT) AS objectives_on_target, CAST({al} AS BIGINT) AS controls_aligned,
  {S.rint('f.Total_Energy_kWh - g.Total_Energy_kWh', 3)} AS delta_energy_kwh, {S.rint(per, 2)} AS savings_per_batch_usd,
  {S.rint(per + ' * ' + repr(float(K.API_ANNUAL_BATCHES)), 2)} AS annual_savings_usd
FROM features f CROSS JOIN gp g JOIN ra ON ra.Batch_ID = f.Batch_ID"""


@query("batch_answer", _answer_sql)
def q_batch_answer(spark, sf):
    """V9: per batch, recommendations + comparison + ROI (API defaults), one
    projection (no shuffle); one batch is a pushed-down filter away."""
    return answer_columns(context.features(spark, sf), context.golden_profile(spark, sf))


@query("run_summary", lambda: f"""WITH {S.structured_ctes()}
SELECT 'structured' AS path, count(*) AS n_batches, min(Batch_ID) AS first_batch, max(Batch_ID) AS last_batch,
  count_if(Green_Zone = 'Green') AS n_green, count_if(Green_Zone = 'Yellow') AS n_yellow, count_if(Green_Zone = 'Red') AS n_red,
  {S.xavg('Eco_Efficiency_Score')} AS mean_eco FROM features""".replace("count_if(Green_Zone = 'Green')", "CAST(count_if(Green_Zone = 'Green') AS BIGINT)").replace("count_if(Green_Zone = 'Yellow')", "CAST(count_if(Green_Zone = 'Yellow') AS BIGINT)").replace("count_if(Green_Zone = 'Red')", "CAST(count_if(Green_Zone = 'Red') AS BIGINT)"))
def q_run_summary(spark, sf):
    """One-row run summary (the batch ids stay a table: kpi_features)."""
    f = context.features(spark, sf)
    return f.agg(
        F.lit("structured").alias("path"),
        F.count(F.lit(1)).alias("n_batches"),
        F.min("Batch_ID").alias("first_batch"),
        F.max("Batch_ID").alias("last_batch"),
        F.count_if(F.col("Green_Zone") == "Green").alias("n_green"),
        F.count_if(F.col("Green_Zone") == "Yellow").alias("n_yellow"),
        F.count_if(F.col("Green_Zone") == "Red").alias("n_red"),
        exact_avg("Eco_Efficiency_Score").alias("mean_eco"),
    )


REPORT_SCHEMA = ("path string, rows_production bigint, rows_process bigint, unique_batches bigint, missing_values_filled bigint, "
                 "outlier_points_clipped bigint, data_mode string, batch_strategy string, signal_coverage bigint")


@query("cleaning_report", lambda: _cleaning_sql())
def q_cleaning_report(spark, sf):
    """Cleaning report of both paths (true fill and clip counts)."""
    res = context.structured(spark, sf)
    merged = res.merged
    clipped = merged.agg(res.report["clip_counter"]).first()[0]
    srow = (
        "structured", production_batches(spark, sf).count(), process_readings(spark, sf).count(),
        res.features.select("Batch_ID").distinct().count(), int(res.report["missing_values_filled"]), int(clipped),
        "Full", "provided", 6,
    )
    ad = context.adaptive(spark, sf)
    r = ad.report
    arow = (
        "adaptive", int(r["rows_production"]), sensor_readings(spark, sf).count(), ad.features.select("Batch_ID").distinct().count(),
        int(r["missing_values_filled"]), 0, r["data_mode"], r["batch_strategy"], int(r["signal_coverage"]),
    )
    return spark.createDataFrame([srow, arow], REPORT_SCHEMA)


def _cleaning_sql() -> str:
    from batchlens.plans.sqlgen import AGG_COLS, MERGED_COLS, PROD_COLS

    st = S.structured_ctes()
    ad = S.adaptive_ctes()
    prod_nulls = " + ".join(f"n_{c}" for c in PROD_COLS)
    agg_nulls = " + ".join(f"n_{c}" for c in AGG_COLS)
    clip = " + ".join(
        f"count_if(q1_{c} IS NOT NULL AND abs(q3_{c} - q1_{c}) > 1e-8 AND (CAST({c} AS DOUBLE) < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR CAST({c} AS DOUBLE) > q3_{c} + 1.5 * (q3_{c} - q1_{c})))"
        for c in MERGED_COLS
    )
    fills = " + ".join(f"count_if({c} IS NULL)" for c in ["temperature_c", "power_kw", "throughput", "quality", "energy"])
    return f"""WITH {ad},
{st[st.index('production_batches AS'):]},
ad_missing AS (SELECT {fills} + 6 * count(*) AS m FROM r1)
SELECT 'structured' AS path, CAST((SELECT count(*) FROM production_batches) AS BIGINT) AS rows_production,
  CAST((SELECT count(*) FROM process_readings) AS BIGINT) AS rows_process,
  CAST((SELECT count(DISTINCT Batch_ID) FROM features) AS BIGINT) AS unique_batches,
  CAST((SELECT {prod_nulls} FROM p_med) + (SELECT {agg_nulls} FROM a_med) AS BIGINT) AS missing_values_filled,
  CAST((SELECT {clip} FROM merged CROSS JOIN iq) AS BIGINT) AS outlier_points_clipped,
  'Full' AS data_mode, 'provided' AS batch_strategy, CAST(6 AS BIGINT) AS signal_coverage
UNION ALL
SELECT 'adaptive', CAST(0 AS BIGINT), CAST((SELECT count(*) FROM sensor_readings) AS BIGINT),
  CAST((SELECT count(DISTINCT Batch_ID) FROM ad_features) AS BIGINT), CAST((SELECT m FROM ad_missing) AS BIGINT), CAST(0 AS BIGINT),
  'Partial', 'auto-generated', CAST(4 AS BIGINT)"""


def _route_sql() -> str:
    from batchlens.sources.tables import PROCESS_EXPRS, PRODUCTION_EXPRS

    names = lambda exprs: [e.split(" AS ")[-1].strip() for e in exprs]
    rate = lambda cols: f"CAST({' + '.join(f'count_if({c} IS NULL)' for c in cols)} AS DOUBLE) / (count(*) * {len(cols)}) <= 0.55"
    return f"""WITH {S.views('production_batches', 'process_readings')},
a AS (SELECT {rate(names(PRODUCTION_EXPRS))} AS ok FROM production_batches),
b AS (SELECT {rate(names(PROCESS_EXPRS))} AND count_if(Temperature_C < -50.0 OR Temperature_C > 300.0) = 0 AS ok FROM process_readings),
c AS (SELECT count(*) = {len(K.REQUIRED_PRODUCTION_COLUMNS)} AS have FROM (DESCRIBE SELECT * FROM production_batches)
  WHERE column_name IN ({', '.join(f"'{x}'" for x in K.REQUIRED_PRODUCTION_COLUMNS)}))
SELECT have AS structured_columns, have AS validation_passed, a.ok AND b.ok AS gate_passed,
  CASE WHEN have AND a.ok AND b.ok THEN 'structured' ELSE 'adaptive' END AS route FROM a, b, c"""


@query("route_choice", _route_sql)
def q_route_choice(spark, sf):
    """Which path the rule picks for the views (required generic names present, validation and every gate rule
    passed -> structured, else adaptive). The views carry the pharma vocabulary, so the rule says 'adaptive'."""
    r = pipeline.route(production_batches(spark, sf), process_readings(spark, sf))
    row = (r.structured_columns, r.validation_passed, r.gate_passed, r.name)
    return spark.createDataFrame([row], "structured_columns boolean, validation_passed boolean, gate_passed boolean, route string")


def _answer_rows_sql() -> str:
    from batchlens.plans.q_compare import _compare_sql, _gp_sql, _roi_sql

    compare = _compare_sql() if callable(_compare_sql) else _compare_sql
    roi = f"WITH {_gp_sql()}\n{_roi_sql(K.API_ENERGY_COST, K.API_ANNUAL_BATCHES)}"
    nothing = "CAST(NULL AS DOUBLE) AS Golden, CAST(NULL AS DOUBLE) AS Deviation, CAST(NULL AS DOUBLE) AS Deviation_Pct"
    items = "\nUNION ALL\n".join(
        f"SELECT Batch_ID, 'roi' AS Section, '{c}' AS Item, CAST({c} AS DOUBLE) AS Current, {nothing}, CAST(NULL AS VARCHAR) AS Text FROM roi" for c in ROI_ITEMS
    )
    return f"""WITH cmp AS ({compare}), rec AS (WITH {recs_ctes()} SELECT * FROM recs), roi AS ({roi})
SELECT Batch_ID, 'comparison' AS Section, Metric AS Item, Current, Golden, Deviation, Deviation_Pct, Status AS Text FROM cmp
UNION ALL
SELECT Batch_ID, 'recommendation', 'Rec ' || CAST(Rec_No AS VARCHAR), NULL, NULL, NULL, NULL, Recommendation FROM rec
UNION ALL
{items}"""


ROI_ITEMS = ("delta_energy_kwh", "savings_per_batch_usd", "annual_savings_usd")


@query("batch_answer_rows", _answer_rows_sql)
def q_batch_answer_rows(spark, sf):
    """V9 in full: for every batch the comparison of all metrics with the golden profile, all recommendations
    and the return on investment, as rows (Section, Item, ...). One batch is a filter on Batch_ID."""
    f, profile = context.features(spark, sf), context.golden_profile(spark, sf)
    none = F.lit(None).cast("double")
    empty = [none.alias(c) for c in ("Golden", "Deviation", "Deviation_Pct")]
    compared = C.compare_to_golden(f, profile).select(
        "Batch_ID", F.lit("comparison").alias("Section"), F.col("Metric").alias("Item"), "Current", "Golden", "Deviation", "Deviation_Pct", F.col("Status").alias("Text")
    )
    advice = C.recommendations(f, profile).select(
        "Batch_ID", F.lit("recommendation").alias("Section"), F.concat(F.lit("Rec "), F.col("Rec_No").cast("string")).alias("Item"), none.alias("Current"), *empty, F.col("Recommendation").alias("Text")
    )
    roi = C.roi_columns(F.col("Total_Energy_kWh"), C._g(profile, "Total_Energy_kWh"), K.API_ENERGY_COST, K.API_ANNUAL_BATCHES)
    items = F.array(*[F.struct(F.lit(c).alias("Item"), roi[c].cast("double").alias("Current")) for c in ROI_ITEMS])
    saved = f.select("Batch_ID", F.explode(items).alias("x")).select(
        "Batch_ID", F.lit("roi").alias("Section"), "x.Item", "x.Current", *empty, F.lit(None).cast("string").alias("Text")
    )
    return compared.unionByName(advice).unionByName(saved)


SCEN_INDEX = {n: i for i, n in enumerate(DEFAULT_SCENARIOS)}


def simulated_candidates(spark, sf):
    """L5 frame: one seeded random improvement per scenario signature."""
    f = context.features(spark, sf)
    top = golden.golden_signatures(f, ranking.build_targets(f, "Standard"), DEFAULT_SCENARIOS, 1)
    idx = F.create_map(*[x for n, i in SCEN_INDEX.items() for x in (F.lit(n), F.lit(i))])[F.col("scenario")]
    out = CA.random_candidates(top.withColumn("seed_idx", idx), "seed_idx")
    return out.select(
        "scenario", F.concat(F.lit("SIM_"), F.col("Batch_ID")).alias("Batch_ID"),
        *[F.col(c).alias(c[2:]) for c in out.columns if c.startswith("c_")],
    )


@query("random_candidates", lambda: f"WITH {rc_ctes()}\nSELECT * FROM rc")
def q_random_candidates(spark, sf):
    """One bounded random improvement per scenario signature (seeded)."""
    return simulated_candidates(spark, sf)


def rc_ctes() -> str:
    """CTE chain ending in ``rc`` (the simulated candidates) with ``top``
    (current signatures) and ``ost`` (objective ranges) along the way."""
    from batchlens.operators.candidates import LCG_A, LCG_C, LCG_M

    def u(draw, lo, hi):
        x = f"((s * {LCG_A} + {LCG_C + 7919 * draw}) % {LCG_M})"
        x = f"(({x} * {LCG_A} + {LCG_C}) % {LCG_M})"
        return f"({float(lo)!r} + (CAST({x} AS DOUBLE) / {float(LCG_M)!r}) * {float(hi - lo)!r})"

    scen_case = "CASE scenario " + " ".join(f"WHEN '{n}' THEN {i}" for n, i in SCEN_INDEX.items()) + " END"
    y = S.rint(f"coalesce(Yield_Percent, 85.0) + {u(1, 0.2, 1.2)}", 2)
    q = S.rint(f"coalesce(Quality_Score, 70.0) + {u(2, 0.4, 1.8)}", 2)
    p = S.rint(f"coalesce(Performance_Score, 60.0) + {u(3, 0.3, 1.5)}", 2)
    e = S.rint(f"coalesce(Total_Energy_kWh, 100.0) * (1.0 - {u(4, 0.025, 0.09)})", 3)
    dt = S.rint(f"greatest(1.0, 10.0 - {u(5, 0.5, 2.5)})", 2)
    dtemp = S.rint(f"80.0 - {u(6, 0.2, 1.8)}", 2)
    spd = S.rint(f"coalesce(Machine_Speed, 200.0) + {u(7, 1.0, 8.0)}", 2)
    return f"""{_gp_sql().split('gp AS')[0].rstrip().rstrip(',')},
{S.ranked_all_cte()},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY Scenario_Score DESC NULLS LAST, Batch_ID) AS rn FROM ranked) WHERE rn = 1),
c0 AS (SELECT scenario, Batch_ID, CAST({scen_case} AS BIGINT) + 42 AS s, Total_Energy_kWh AS g_e, Carbon_kg AS g_c,
  Yield_Percent, Quality_Score, Performance_Score, Total_Energy_kWh, Machine_Speed FROM top),
c1 AS (SELECT scenario, 'SIM_' || Batch_ID AS Batch_ID, g_e, g_c, {y} AS Yield_Percent, {q} AS Quality_Score, {p} AS Performance_Score,
  {e} AS Total_Energy_kWh, {dt} AS Drying_Time, {dtemp} AS Drying_Temp, {spd} AS Machine_Speed FROM c0),
c2 AS (SELECT c1.*, {S.rint('Total_Energy_kWh * 0.82', 3)} AS Carbon_kg FROM c1),
c3 AS (SELECT c2.* EXCLUDE (g_e, g_c), {S.rint("greatest(0.0, least(100.0, (0.40 * (Yield_Percent / 100.0) + 0.15 * (Quality_Score / 100.0) + 0.20 * greatest(0.0, 1.0 - Total_Energy_kWh / greatest(1.0, coalesce(g_e, 1.0))) + 0.15 * greatest(0.0, 1.0 - Carbon_kg / greatest(1.0, coalesce(g_c, 1.0))) + 0.10 * greatest(0.0, 1.0 - Drying_Time / greatest(1.0, Drying_Time))) * 100.0))", 2)} AS Eco_Efficiency_Score FROM c2),
rc AS (SELECT c3.*, CASE WHEN Eco_Efficiency_Score >= 70.0 THEN 'Green' WHEN Eco_Efficiency_Score >= 40.0 THEN 'Yellow' ELSE 'Red' END AS Green_Zone FROM c3)"""
