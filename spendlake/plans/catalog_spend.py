"""Registered spend questions and rollups."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from spendlake.functions.columns import dollars
from spendlake.operators import rollups, spend
from spendlake.plans.registry import query
from spendlake.session import run_dir
from spendlake.sources.driver_tables import Tables

# The range that holds every charge of the driver tables.
START, END, DAYS = "1995-01-01", "2001-12-31", 2557
SPAN = "charge_period_start >= TIMESTAMP '1995-01-01' AND charge_period_start < TIMESTAMP '2002-01-01'"
RECENT = "charge_period_start >= TIMESTAMP '1994-12-31' AND charge_period_end <= TIMESTAMP '2001-12-31'"


def S(expr: str, places: int = 4) -> str:
    return f"round(CAST(coalesce(sum({expr}), 0) AS DOUBLE), {places})"


def PCT(part: str, whole: str, places: int = 2) -> str:
    p, w = f"CAST({part} AS DOUBLE)", f"CAST({whole} AS DOUBLE)"
    return f"CASE WHEN {w} > 0 THEN round({p} / {w} * 100, {places}) ELSE 0.0 END"


@query("q1_cost_overview", f"""
SELECT provider_name, billing_account_id, billing_account_name,
  {S('effective_cost')} AS total_effective_cost, {S('list_cost')} AS total_list_cost,
  {S('billed_cost')} AS total_billed_cost,
  round(greatest(CAST(sum(list_cost) - sum(effective_cost) AS DOUBLE), 0), 4) AS savings_amount,
  {PCT('sum(list_cost) - sum(effective_cost)', 'sum(list_cost)')} AS savings_pct
FROM b WHERE {SPAN} GROUP BY ALL""")
def _(t: Tables):
    return spend.cost_overview(t.staged, START, END)


for _gran, _expr in (("daily", "charge_date"), ("weekly", "CAST(date_trunc('week', charge_date) AS DATE)"),
                     ("monthly", "CAST(date_trunc('month', charge_date) AS DATE)")):
    query(f"q2_cost_by_service_{_gran}", f"""
SELECT {_expr} AS charge_date, provider_name, service_name, service_category, region_id,
  {S('effective_cost')} AS effective_cost
FROM b WHERE {SPAN} GROUP BY ALL
ORDER BY charge_date DESC, effective_cost DESC, provider_name, service_name, service_category, region_id
LIMIT 500""")(lambda t, g=_gran: spend.cost_by_service(t.staged, START, END, granularity=g))


@query("q3_cost_by_team", f"""
SELECT tag_team AS team_tag, coalesce(tag_env, 'untagged') AS env_tag, provider_name, charge_date,
  {S('effective_cost')} AS effective_cost
FROM b WHERE tag_team IS NOT NULL AND {SPAN} GROUP BY ALL
ORDER BY effective_cost DESC, team_tag, env_tag, provider_name, charge_date LIMIT 1000""")
def _(t: Tables):
    return spend.cost_by_team(t.staged, START, END)


@query("q4_top_services", f"""
SELECT provider_name, service_name, service_category, {S('effective_cost')} AS total_cost,
  {S('list_cost')} AS list_cost, count(DISTINCT resource_id) AS resource_count,
  {PCT('greatest(sum(list_cost) - sum(effective_cost), 0)', 'sum(list_cost)')} AS waste_pct
FROM b WHERE {SPAN} GROUP BY ALL
ORDER BY total_cost DESC, provider_name, service_name, service_category LIMIT 10""")
def _(t: Tables):
    return spend.top_services(t.staged, START, END)


@query("q5_overview_by_service", f"""
SELECT provider_name, billing_account_id, service_name, CAST(grouping(provider_name) AS INTEGER) AS is_total,
  {S('effective_cost')} AS total_cost, {S('list_cost - effective_cost')} AS total_savings,
  sum(usage_quantity) AS total_usage, count(*) AS record_count
FROM b WHERE billing_period_start >= TIMESTAMP '1995-01-01' AND billing_period_end <= TIMESTAMP '2002-01-01'
GROUP BY GROUPING SETS ((provider_name, billing_account_id, service_name), ())""")
def _(t: Tables):
    return spend.overview_by_service(t.staged, START, "2002-01-01")


@query("q6_daily_trend", f"""
SELECT charge_date AS day, provider_name, {S('effective_cost')} AS cost, sum(usage_quantity) AS usage
FROM b GROUP BY ALL""")
def _(t: Tables):
    return spend.daily_trend(rollups.daily_costs_ext(t.staged), END, DAYS)


@query("q7_top_services_rollup", f"""
SELECT service_name, {S('effective_cost')} AS total_cost, {S('list_cost')} AS total_list_cost
FROM b GROUP BY ALL ORDER BY total_cost DESC, service_name LIMIT 10""")
def _(t: Tables):
    return spend.top_services_rollup(rollups.daily_costs_ext(t.staged), END, DAYS)


@query("q8_cost_by_tag", f"""
SELECT tag_project AS tag_value, {S('effective_cost')} AS total_cost, count(*) AS record_count
FROM b WHERE tag_project IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    return spend.cost_by_tag(t.staged, "project", START, END)


@query("q9_provider_spend", f"""
SELECT p.provider_name, {S('effective_cost')} AS total_cost, {S('list_cost - effective_cost')} AS total_savings,
  count(service_name) AS record_count, count(DISTINCT service_name) AS service_count,
  {DAYS} AS period_days, 'USD' AS currency
FROM (VALUES ('aws'), ('azure'), ('gcp')) p(provider_name)
LEFT JOIN (SELECT * FROM b WHERE {RECENT}) r USING (provider_name) GROUP BY ALL""")
def _(t: Tables):
    return spend.provider_spend(t.staged, END, DAYS)


@query("q10_service_breakdown", f"""
SELECT * FROM (SELECT provider_name, service_name, {S('effective_cost')} AS cost,
  round(sum(usage_quantity), 4) AS usage, count(*) AS records FROM b WHERE {RECENT} GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY provider_name ORDER BY cost DESC, service_name) <= 20""")
def _(t: Tables):
    return spend.service_breakdown(t.staged, END, DAYS)


@query("q11_provider_daily_trend", f"""
SELECT provider_name, charge_date AS date, {S('effective_cost')} AS cost FROM b WHERE {RECENT} GROUP BY ALL""")
def _(t: Tables):
    return spend.provider_daily_trend(t.staged, END, DAYS)


@query("q12_cost_by_region", f"""
SELECT provider_name, region_id AS region, {S('effective_cost')} AS cost, count(*) AS records
FROM b WHERE {RECENT} GROUP BY ALL""")
def _(t: Tables):
    return spend.cost_by_region(t.staged, END, DAYS)


@query("q13_high_cost_resources", f"""
SELECT resource_id, resource_name, service_name, region_id, {S('effective_cost')} AS monthly_cost,
  sum(usage_quantity) AS monthly_usage
FROM b GROUP BY ALL HAVING monthly_cost >= 200000
ORDER BY monthly_cost DESC, resource_id, resource_name, service_name, region_id LIMIT 100""")
def _(t: Tables):
    return spend.high_cost_resources(t.staged, END, min_cost=200000, days=DAYS)


@query("q19_panel_timeseries", f"""
SELECT epoch_ms(date_trunc('week', charge_period_start)) AS time, {S('effective_cost')} AS value,
  'cost.total' AS metric FROM b WHERE {SPAN} AND provider_name = 'aws' GROUP BY ALL""")
def _(t: Tables):
    return spend.panel_timeseries(t.staged, START, END, provider="aws", granularity="weekly")


@query("q19_panel_timeseries_coverage", f"""
SELECT epoch_ms(date_trunc('day', charge_period_start)) AS time,
  {PCT("sum(CASE WHEN commitment_discount_id IS NOT NULL THEN effective_cost ELSE 0 END)", "sum(effective_cost)")} AS value,
  'commitment.coverage_pct' AS metric FROM b WHERE {SPAN} GROUP BY 1""")
def _(t: Tables):
    return spend.panel_timeseries(t.staged, START, END, metric="commitment.coverage_pct")


@query("q20_panel_table", f"""
SELECT resource_type AS dimension, {S('effective_cost')} AS total_cost, {S('list_cost')} AS list_cost,
  count(*) AS row_count FROM b WHERE {SPAN} GROUP BY resource_type
ORDER BY total_cost DESC, dimension LIMIT 50""")
def _(t: Tables):
    return spend.panel_table(t.staged, START, END, group_by="resource_type")


@query("q21_spike_annotations", """
WITH s AS (SELECT epoch_ms(billing_period_start) AS time, service_name, provider_name, charge_description,
  CAST(effective_cost AS DOUBLE) AS effective_cost,
  round(CAST(effective_cost AS DOUBLE) - CAST(list_cost AS DOUBLE), 4) AS delta
 FROM b WHERE list_cost > 100 AND CAST(effective_cost AS DOUBLE) / CAST(list_cost AS DOUBLE) > 0.99
 ORDER BY effective_cost DESC, charge_description, time LIMIT 100)
SELECT time, concat('Cost spike: ', service_name) AS title,
  concat('Provider: ', provider_name, chr(10), 'Effective: $', printf('%.2f', effective_cost), chr(10),
         'Delta vs list: +$', printf('%.2f', delta)) AS text,
  concat('anomaly,', provider_name, ',', service_name) AS tags, charge_description, effective_cost, delta FROM s""")
def _(t: Tables):
    return spend.spike_annotations(t.staged, START, END, ratio=0.99)


@query("q22_daily_cost_points", f"""
SELECT provider_name, service_name, region_id, billing_account_id, {S('effective_cost')} AS total_cost
FROM b WHERE CAST(billing_period_start AS DATE) = DATE '1998-03-01' GROUP BY ALL HAVING total_cost > 0
ORDER BY total_cost DESC, provider_name, service_name, region_id, billing_account_id LIMIT 1000""")
def _(t: Tables):
    return spend.daily_cost_points(t.staged, "1998-03-01")


@lru_cache(maxsize=8)
def daily_rollup(t: Tables):
    """The stored daily rollup, as dashboards and monitors read it."""
    path = run_dir(t.spark, "daily-rollup")
    rollups.daily_costs_ext(t.staged).write.parquet(path)
    return t.spark.read.parquet(path)


@query("q23_dashboard_widgets", f"""
WITH d AS (SELECT provider_name, charge_date AS day, sum(effective_cost) AS cost FROM b GROUP BY ALL),
r AS (SELECT provider_name, day, round(CAST(cost AS DOUBLE), 4) AS cost,
  round(CAST(sum(cost) OVER (PARTITION BY provider_name ORDER BY day
     RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS DOUBLE), 4) AS rolling FROM d)
SELECT 'monthly_cost' AS widget, provider_name AS series, day, rolling AS value FROM r
UNION ALL SELECT 'provider_line', provider_name, day, cost FROM r
UNION ALL SELECT * FROM (SELECT 'top_services', service_name, CAST(NULL AS DATE), {S('effective_cost')} AS v
  FROM b GROUP BY service_name ORDER BY v DESC, service_name LIMIT 10)""")
def _(t: Tables):
    return spend.dashboard_widgets(daily_rollup(t))


# ── Rollups ───────────────────────────────────────────────────────────────

@query("a1_daily_cost", f"""
SELECT provider_name, billing_account_id, service_name, region_id, CAST(charge_period_start AS DATE) AS charge_date,
  billing_currency, {S('effective_cost')} AS total_effective, {S('list_cost')} AS total_list,
  {S('billed_cost')} AS total_billed FROM billing GROUP BY ALL""")
def _(t: Tables):
    return rollups.daily_cost(t.billing).withColumns(
        {c: dollars(c) for c in ("total_effective", "total_list", "total_billed")})


@query("a2_team_cost", f"""
SELECT provider_name, tag_team AS team_tag, tag_env AS env_tag, CAST(charge_period_start AS DATE) AS charge_date,
  {S('effective_cost')} AS total_effective FROM billing GROUP BY ALL""")
def _(t: Tables):
    return rollups.team_cost(t.billing).withColumn("total_effective", dollars("total_effective"))


@query("a3_daily_costs_ext", f"""
SELECT provider_name, billing_account_id, service_name, service_category, region_id,
  CAST(charge_period_start AS DATE) AS day, {S('effective_cost')} AS total_effective_cost,
  {S('list_cost')} AS total_list_cost, sum(usage_quantity) AS total_usage_quantity, count(*) AS row_count
FROM billing GROUP BY ALL""")
def _(t: Tables):
    return rollups.daily_costs_ext(t.billing).withColumns(
        {c: dollars(c) for c in ("total_effective_cost", "total_list_cost")})


@query("a4_monthly_services", f"""
SELECT provider_name, service_name, service_category, CAST(date_trunc('month', charge_period_start) AS DATE) AS month,
  {S('effective_cost')} AS total_cost, sum(usage_quantity) AS total_usage, count(*) AS record_count
FROM billing GROUP BY ALL""")
def _(t: Tables):
    return rollups.monthly_services(t.billing).withColumn("total_cost", dollars("total_cost"))


A5_SQL = f"""
SELECT provider_name, billing_account_id, billing_account_name, service_name, service_category, region_id,
  tag_team, tag_env, charge_date, billing_currency,
  {S('effective_cost')} AS total_effective_cost, {S('list_cost')} AS total_list_cost,
  {S('billed_cost')} AS total_billed_cost, {S('savings_amount')} AS total_savings,
  sum(usage_quantity) AS total_usage_quantity, CAST(NULL AS VARCHAR) AS usage_unit,
  count(DISTINCT resource_id) AS resource_count,
  count(*) FILTER (commitment_discount_type <> 'None') AS commitment_line_items
FROM b GROUP BY ALL"""


def rounded_mart(mart):
    return mart.withColumns({c: dollars(c) for c in (
        "total_effective_cost", "total_list_cost", "total_billed_cost", "total_savings")})


@query("a5_mart_daily_service", A5_SQL)
def _(t: Tables):
    return rounded_mart(rollups.mart_daily_service(t.staged))


@query("a7_slice_summary", " UNION ALL ".join(f"""
SELECT '{d}' AS dimension_key, coalesce({d}, '') AS dimension_value, {S('effective_cost')} AS total_effective_cost,
  {S('list_cost')} AS total_list_cost, {S('billed_cost')} AS total_billed_cost, count(*) AS record_count,
  {S('list_cost - effective_cost')} AS total_discount FROM b GROUP BY {d}"""
                                              for d in ("provider_name", "service_name", "region_id", "tag_team")))
def _(t: Tables):
    out = rollups.slice_summary(t.staged, ["provider_name", "service_name", "region_id", "tag_team"])
    return out.withColumns({c: dollars(c) for c in (
        "total_effective_cost", "total_list_cost", "total_billed_cost", "total_discount")})


@query("a8_merge_rollup", f"""
SELECT provider_name, billing_account_id, service_name, service_category, region_id, charge_date AS day,
  {S('effective_cost')} AS total_effective_cost, {S('list_cost')} AS total_list_cost,
  sum(usage_quantity) AS total_usage_quantity, count(*) AS row_count FROM b GROUP BY ALL""")
def _(t: Tables):
    keys = ["provider_name", "billing_account_id", "service_name", "service_category", "region_id", "day"]
    parts = [
        rollups.daily_costs_ext(t.staged.filter(F.col("charge_category") == "Usage")),
        rollups.daily_costs_ext(t.staged.filter(F.col("charge_category") != "Usage")),
    ]
    merged = rollups.merge_rollup(parts, keys, {
        "total_effective_cost": "sum", "total_list_cost": "sum", "total_usage_quantity": "sum", "row_count": "sum"})
    return merged.withColumns({c: dollars(c) for c in ("total_effective_cost", "total_list_cost")})
