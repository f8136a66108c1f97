"""Registered detectors and budget checks."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from spendlake.operators import budgets, detectors, spend
from spendlake.plans.analysis import find_insights
from spendlake.plans.catalog_spend import DAYS, END, PCT, RECENT, S, daily_rollup
from spendlake.plans.registry import query
from spendlake.sinks import metrics
from spendlake.sources.driver_tables import Tables

# Thresholds scaled to the amounts of the driver tables, so that each test keeps and drops rows.
LIMITS = {"idle": 150000, "gap": 10_000_000, "hybrid": 200000, "cud": 150000, "tag": 100000}

def flat(insights, with_id: bool = False, texts: bool = False):
    """The columns that the checks compare; ``texts`` adds what is written for people."""
    return insights.select(
        *(["insight_id"] if with_id else []),
        "agent", "provider", "category", "severity", "title", F.concat_ws(",", "resource_ids").alias("resource_id"),
        "service_name", "region", F.round("current_monthly_cost", 4).alias("current_monthly_cost"),
        F.round("projected_monthly_savings", 4).alias("projected_monthly_savings"), "confidence_score",
        "action_type", "risk_level", *(["description", "recommendation"] if texts else []))


def SHOW(agent, provider, category, severity, title, resource, service, region, cost, savings, confidence, action, risk, text=None, advice=None):
    return (f"{agent} AS agent, {provider} AS provider, {category} AS category, {severity} AS severity, {title} AS title, "
            f"{resource} AS resource_id, {service} AS service_name, {region} AS region, {cost} AS current_monthly_cost, "
            f"round({savings}, 4) AS projected_monthly_savings, CAST({confidence} AS DOUBLE) AS confidence_score, "
            f"{action} AS action_type, {risk} AS risk_level" + (f", {text} AS description, {advice} AS recommendation" if text else ""))


def USD(amount, places=2):
    return f"format('{{:,.{places}f}}', {amount})"


VM = "service_name = 'Virtual Machine'"
RES = "resource_id, resource_name, region_id"

IDLE_SQL = f"""SELECT {SHOW("'aws_cost_agent'", "'aws'", "'idle_resource'", "'high'",
  "concat('Potentially idle EC2: ', coalesce(resource_id, 'unknown'))", "coalesce(resource_id, '')", "'Virtual Machine'",
  "region_id", "monthly_cost", "monthly_cost * 0.8", 0.75, "'stop'", "'low'",
  "concat('EC2 ', resource_name, ' in ', region_id, ' has low usage (', format('{:.2f}', use), ' hrs/day) but costs $', format('{:.2f}', monthly_cost), '/month.')",
  f"concat('Worth up to $', {USD('monthly_cost * 0.8', 0)}, ' a month: switch the machine off once its owner agrees, or give it a smaller size.')")} FROM (
 SELECT {RES}, {S('effective_cost')} AS monthly_cost, avg(usage_quantity) AS use FROM b WHERE provider_name = 'aws' AND {VM} GROUP BY ALL
 HAVING monthly_cost > {LIMITS['idle']} AND avg(usage_quantity) < 2 AND stddev_pop(usage_quantity) < 1)"""

GAP_SQL = f"""SELECT {SHOW("'aws_cost_agent'", "'aws'", "'commitment_gap'", "'medium'",
  "concat('Commitment gap: ', service_name)", "''", "service_name", "CAST(NULL AS VARCHAR)", "monthly_cost",
  "monthly_cost * 0.35", 0.85, "'purchase-commitment'", "'low'",
  f"concat('$', {USD('monthly_cost')}, '/month on ', service_name, ' with no RIs/SPs. Potential 30-40% savings.')",
  f"concat('Commit to the share of ', service_name, ' that never stops; about $', {USD('monthly_cost * 0.35', 0)}, ' a month.')")} FROM (
 SELECT service_name, {S('effective_cost')} AS monthly_cost FROM b WHERE provider_name = 'aws'
 AND commitment_discount_id IS NULL AND service_name IN ('Virtual Machine', 'Relational Database') GROUP BY ALL
 HAVING monthly_cost > {LIMITS['gap']})"""

HYBRID_SQL = f"""SELECT {SHOW("'azure_cost_agent'", "'azure'", "'right_size'", "'medium'",
  "concat('AHUB opportunity: ', coalesce(resource_name, 'unknown'))", "coalesce(resource_id, '')", "'Virtual Machine'",
  "region_id", "monthly_cost", "monthly_cost * 0.4", 0.8, "'right-size'", "'low'",
  f"concat('Azure VM ', resource_name, ' costs $', {USD('monthly_cost')}, '/month. Enable Azure Hybrid Benefit for ~40% savings.')",
  f"concat('Report licences already paid for; about $', {USD('monthly_cost * 0.4', 0)}, ' a month.')")} FROM (
 SELECT {RES}, {S('effective_cost')} AS monthly_cost FROM b WHERE provider_name = 'azure' AND {VM} GROUP BY ALL
 HAVING monthly_cost > {LIMITS['hybrid']})"""

CUD_SQL = f"""SELECT {SHOW("'gcp_cost_agent'", "'gcp'", "'commitment_gap'", "'medium'",
  "concat('CUD gap: ', coalesce(resource_name, 'unknown'))", "coalesce(resource_id, '')", "'Virtual Machine'",
  "region_id", "monthly_cost", "monthly_cost * 0.3", 0.82, "'purchase-commitment'", "'low'",
  f"concat('GCE ', resource_name, ' in ', region_id, ' costs $', {USD('monthly_cost')}, '/month with no CUD. 1-year CUD saves ~28-37%.')",
  f"concat('Commit for a year if the machine is to stay; about $', {USD('monthly_cost * 0.3', 0)}, ' a month.')")} FROM (
 SELECT {RES}, {S('effective_cost')} AS monthly_cost FROM b WHERE provider_name = 'gcp' AND {VM}
 AND commitment_discount_id IS NULL GROUP BY ALL HAVING monthly_cost > {LIMITS['cud']})"""

TAG_COLS = "tag_team, tag_env, tag_project, tag_owner, k8s_namespace, k8s_cluster, k8s_workload, k8s_node"
VIOLATION_SQL = f"""SELECT *, (tag_team IS NULL)::INT + (tag_env IS NULL)::INT + (tag_project IS NULL)::INT
   + (tag_owner IS NULL)::INT + (bad_environment IS NOT NULL)::INT AS violations,
   CASE WHEN violations = 0 THEN 'none' WHEN violations <= 2 THEN 'low' WHEN violations <= 5 THEN 'medium'
   ELSE 'high' END AS severity,
   concat_ws(',', CASE WHEN tag_team IS NULL THEN 'team' END, CASE WHEN tag_env IS NULL THEN 'environment' END,
     CASE WHEN tag_project IS NULL THEN 'project' END, CASE WHEN tag_owner IS NULL THEN 'owner' END) AS missing
 FROM (SELECT provider_name, billing_account_id, resource_id, resource_type, {TAG_COLS},
   {S('effective_cost')} AS monthly_cost, CASE WHEN tag_env NOT IN ('development', 'staging', 'production', 'dev', 'prod')
   THEN tag_env END AS bad_environment
   FROM b WHERE resource_id IS NOT NULL GROUP BY ALL HAVING monthly_cost > {LIMITS['tag']})
 WHERE violations > 0"""

TAG_INSIGHT_SQL = f"""SELECT {SHOW("'tagging_agent'", "provider_name", "'tag_compliance'", "severity",
  "concat('Tag violation: ', resource_id)", "resource_id", "resource_type", "CAST(NULL AS VARCHAR)", "monthly_cost",
  "0.0", 0.95, "'tag'", "'low'",
  "concat('Resource ', resource_id, ' in account ', billing_account_id, ' is missing tags: ', CASE WHEN missing = '' THEN 'none' ELSE replace(missing, ',', ', ') END, '.')",
  "concat('Apply tags: ', replace(missing, ',', ', '), '.')")} FROM ({VIOLATION_SQL})"""

# The union of all resource-level findings, as the recommendation checks use it.
INSIGHTS_CTE = (f"ins AS ({IDLE_SQL} UNION ALL {GAP_SQL} UNION ALL {HYBRID_SQL} UNION ALL {CUD_SQL} "
                f"UNION ALL {TAG_INSIGHT_SQL})")


@lru_cache(maxsize=8)
def all_insights(t: Tables):
    """Stored once per set of tables, as an analysis run does before it ranks them."""
    return find_insights(t.staged, END, DAYS, thresholds=LIMITS)


@query("d1_idle_resources", f"""
SELECT * FROM (SELECT provider_name AS provider, resource_id, service_name, region_id AS region,
  {S('effective_cost')} AS total_cost, round(sum(usage_quantity), 4) AS total_usage, count(*) AS billing_days
  FROM b WHERE {RECENT} GROUP BY ALL HAVING total_cost >= 200000 AND total_usage < 1)""")
def _(t: Tables):
    return detectors.idle_resources(t.staged, END, 200000, days=DAYS)


@query("d1_idle_insights", f"""
WITH i AS (SELECT provider_name AS provider, resource_id, service_name, region_id, {S('effective_cost')} AS cost
  FROM b WHERE {RECENT} GROUP BY ALL HAVING cost >= 100 AND sum(usage_quantity) < 1),
n AS (SELECT provider, count(*) AS n, round(sum(cost), 4) AS cost FROM i GROUP BY provider)
SELECT {SHOW("concat(provider, '_cost_agent')", "provider", "'idle_resource'", "'medium'",
  "CASE WHEN provider = 'aws' THEN concat('Found ', n, ' potentially idle resources ($', format('{:,.2f}', cost), ')') "
  "ELSE concat(n, ' potentially idle ', CASE provider WHEN 'azure' THEN 'Azure' ELSE 'GCP' END, ' resources') END",
  "''", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "cost", "cost * 0.8", 0.75, "'stop'", "'medium'",
  f"concat('In this window $', {USD('cost')}, ' went to ', n, ' resources that did next to nothing.')",
  "CASE provider WHEN 'aws' THEN 'Review and stop/terminate idle resources after confirmation' WHEN 'azure' "
  "THEN 'Review idle VMs and disks, consider deallocation' ELSE 'Review and stop idle GCE instances' END")} FROM n""")
def _(t: Tables):
    return flat(detectors.idle_insights(detectors.idle_resources(t.staged, END, 100, days=DAYS)), texts=True)


@query("d2_idle_vms", IDLE_SQL + " ORDER BY current_monthly_cost DESC, resource_id, region LIMIT 20")
def _(t: Tables):
    return flat(detectors.idle_vms(t.staged, END, LIMITS["idle"], days=DAYS), texts=True)


@query("d3_aws_commitment_gap", GAP_SQL)
def _(t: Tables):
    return flat(detectors.aws_commitment_gap(t.staged, END, LIMITS["gap"], days=DAYS), texts=True)


@query("d4_azure_hybrid_benefit", HYBRID_SQL + " ORDER BY current_monthly_cost DESC, resource_id, region LIMIT 20")
def _(t: Tables):
    return flat(detectors.azure_hybrid_benefit(t.staged, END, LIMITS["hybrid"], days=DAYS), texts=True)


@query("d5_gcp_cud_gap", CUD_SQL + " ORDER BY current_monthly_cost DESC, resource_id, region LIMIT 20")
def _(t: Tables):
    return flat(detectors.gcp_cud_gap(t.staged, END, LIMITS["cud"], days=DAYS), texts=True)


_COMMITTED = "sum(CASE WHEN commitment_discount_id IS NOT NULL THEN effective_cost ELSE 0 END)"


@query("d6_commitment_coverage", f"""
SELECT provider_name AS provider, {S('effective_cost')} AS total_effective_cost, {S('list_cost')} AS total_list_cost,
  round(CAST({_COMMITTED} AS DOUBLE), 4) AS committed_cost,
  count(*) FILTER (commitment_discount_id IS NOT NULL) AS committed_records, count(*) AS total_records,
  {PCT(_COMMITTED, 'sum(effective_cost)')} AS commitment_coverage_pct,
  {PCT('sum(list_cost) - sum(effective_cost)', 'sum(list_cost)')} AS savings_rate_pct,
  CASE WHEN {PCT(_COMMITTED, 'sum(effective_cost)', 12)} < 70
    THEN round(CAST(sum(effective_cost) - {_COMMITTED} AS DOUBLE), 4) ELSE 0 END AS opportunity
FROM b WHERE {RECENT} GROUP BY ALL""")
def _(t: Tables):
    return detectors.commitment_coverage(t.staged, END, DAYS)


@query("d6_coverage_insights", f"""
WITH c AS (SELECT provider_name AS provider, {S('effective_cost')} AS cost, {PCT(_COMMITTED, 'sum(effective_cost)')} AS pct,
  round(CAST(sum(effective_cost) - {_COMMITTED} AS DOUBLE), 4) AS opportunity FROM b WHERE {RECENT} GROUP BY ALL)
SELECT {SHOW("concat(provider, '_cost_agent')", "provider", "'commitment_gap'", "'medium'",
  "concat(CASE provider WHEN 'aws' THEN 'Commitment coverage only ' WHEN 'azure' THEN 'Azure reservation coverage: ' "
  "ELSE 'CUD coverage: ' END, format('{:,.1f}', round(pct, 1)), '%')", "''", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)",
  "cost", "opportunity * CASE provider WHEN 'aws' THEN 0.3 ELSE 0.25 END", 0.8, "'purchase-commitment'", "'low'",
  f"concat('$', {USD('opportunity')}, ' could still be committed beyond ', format('{{:,.1f}}', round(pct, 1)), '% of the cost.')",
  "CASE provider WHEN 'aws' THEN 'Purchase Reserved Instances or Savings Plans for stable workloads' WHEN 'azure' "
  "THEN 'Purchase Azure Reservations for stable VM workloads' ELSE 'Purchase 1-year or 3-year CUDs for stable workloads' END")}
FROM c WHERE pct < 70""")
def _(t: Tables):
    return flat(detectors.coverage_insights(detectors.commitment_coverage(t.staged, END, DAYS)), texts=True)


TAG_COVERAGE_SQL = f"""SELECT provider_name AS provider, count(*) AS total_records,
  {PCT('count(tag_team)', 'count(*)')} AS team_tag_coverage_pct, {PCT('count(tag_env)', 'count(*)')} AS env_tag_coverage_pct,
  {PCT('count(tag_owner)', 'count(*)')} AS owner_tag_coverage_pct,
  count(*) FILTER (coalesce({TAG_COLS}) IS NULL) AS untagged_records,
  {S(f"CASE WHEN coalesce({TAG_COLS}) IS NULL THEN effective_cost ELSE 0 END")} AS untagged_cost
FROM b WHERE {RECENT} GROUP BY ALL"""


@query("d7_tag_coverage", TAG_COVERAGE_SQL)
def _(t: Tables):
    return detectors.tag_coverage(t.staged, END, DAYS)


@query("d7_tag_coverage_insights", f"""
SELECT {SHOW("concat(provider, '_cost_agent')", "provider", "'tag_compliance'", "'low'",
  "concat(CASE provider WHEN 'aws' THEN 'Tag compliance: ' WHEN 'azure' THEN 'Azure tag compliance: ' "
  "ELSE 'GCP label compliance: ' END, format('{:,.1f}', round(team_tag_coverage_pct, 1)), "
  "CASE provider WHEN 'aws' THEN '% have team tags' ELSE '%' END)", "''", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)",
  "CAST(NULL AS DOUBLE)", "0.0", 0.85, "'tag'", "'low'",
  f"concat(untagged_records, ' charges without any tag come to $', {USD('untagged_cost')}, '.')",
  "CASE provider WHEN 'aws' THEN 'Enforce tagging policy via AWS Organizations or OPA' WHEN 'azure' "
  "THEN 'Enforce Azure Policy for mandatory tags' ELSE 'Enforce labels via Organization Policy' END")} FROM ({TAG_COVERAGE_SQL}) WHERE team_tag_coverage_pct < 80""")
def _(t: Tables):
    return flat(detectors.tag_coverage_insights(detectors.tag_coverage(t.staged, END, DAYS)), texts=True)


def violations(t: Tables):
    return detectors.tag_violations(t.staged, END, DAYS, LIMITS["tag"])


@query("d8_tag_violations", f"""
SELECT provider_name, billing_account_id, resource_id, resource_type, missing AS missing_tags, bad_environment,
  monthly_cost, violations, severity, coalesce(k8s_node, '') AS node FROM ({VIOLATION_SQL})""")
def _(t: Tables):
    return violations(t).select(
        "provider_name", "billing_account_id", "resource_id", "resource_type",
        F.concat_ws(",", "missing_tags").alias("missing_tags"), "bad_environment", "monthly_cost",
        "violations", "severity", F.coalesce(F.col("tags")["k8s.node"], F.lit("")).alias("node"))


@query("d9_violation_severity", f"""
SELECT violations, severity, count(*) AS resources FROM ({VIOLATION_SQL}) GROUP BY ALL""")
def _(t: Tables):
    return violations(t).groupBy("violations", "severity").agg(F.count(F.lit(1)).alias("resources"))


@query("d10_tag_compliance_report", f"""
SELECT count(*) AS total_violations, round(sum(monthly_cost), 2) AS total_cost_at_risk,
  count(*) FILTER (severity = 'none') AS severity_none, count(*) FILTER (severity = 'low') AS severity_low,
  count(*) FILTER (severity = 'medium') AS severity_medium, count(*) FILTER (severity = 'high') AS severity_high
FROM ({VIOLATION_SQL})""")
def _(t: Tables):
    return detectors.tag_compliance_report(violations(t))


@query("d10_worst_violations", f"""
SELECT resource_id, missing AS missing_tags, monthly_cost, severity FROM ({VIOLATION_SQL})
ORDER BY monthly_cost DESC, provider_name, billing_account_id, resource_id LIMIT 20""")
def _(t: Tables):
    return detectors.worst_violations(violations(t))


@query("d11_spend_insights", f"""
WITH p AS (SELECT provider_name AS provider, CASE provider_name WHEN 'aws' THEN 'AWS' WHEN 'azure' THEN 'Azure' ELSE 'GCP' END AS label,
  {S('effective_cost')} AS cost, {S('list_cost - effective_cost')} AS savings, count(DISTINCT region_id) AS regions
  FROM b WHERE {RECENT} GROUP BY ALL),
s AS (SELECT * FROM (SELECT provider_name AS provider, CASE provider_name WHEN 'aws' THEN 'AWS' WHEN 'azure' THEN 'Azure' ELSE 'GCP' END AS label,
  service_name, {S('effective_cost')} AS cost FROM b WHERE {RECENT} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY provider ORDER BY cost DESC, service_name) = 1)
SELECT {SHOW("concat(provider, '_cost_agent')", "provider", "'general'", "'info'",
  "concat(label, ' Monthly Spend: $', format('{:,.2f}', cost))", "''", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)",
  "cost", "savings", 0.95, "'report'", "'low'")} FROM p
UNION ALL SELECT {SHOW("concat(provider, '_cost_agent')", "provider", "'general'", "'info'",
  "concat('Top ', label, ' Service: ', service_name, ' ($', format('{:,.2f}', cost), ')')", "''", "service_name",
  "CAST(NULL AS VARCHAR)", "cost", "0.0", 0.9, "'report'", "'low'")} FROM s
UNION ALL SELECT {SHOW("concat(provider, '_cost_agent')", "provider", "'general'", "'info'",
  "concat('Resources spread across ', regions, ' regions')", "''", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)",
  "CAST(NULL AS DOUBLE)", "0.0", 0.9, "'report'", "'low'")} FROM p WHERE regions > 3""")
def _(t: Tables):
    return flat(detectors.spend_insights(t.staged, END, DAYS))


@query("d12_inventory_insights", """
WITH m AS (SELECT count(*) FILTER (p_size < 10) AS stopped, count(*) FILTER (p_type = 'LARGE') AS old,
  string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) FILTER (p_type = 'LARGE') AS types FROM part)
SELECT category, title, text AS description, savings AS projected_monthly_savings FROM (
 SELECT 'idle_resource' AS category, concat(stopped, ' stopped EC2 instances may incur storage charges') AS title,
   CAST(stopped * 50 AS DOUBLE) AS savings, concat(stopped, ' machines are switched off and keep their disks.') AS text FROM m WHERE stopped > 0
 UNION ALL SELECT 'right_size', concat(old, ' EC2 instances using older generation types'), CAST(old * 30 AS DOUBLE),
   concat(old, ' machines are of a type that has a successor: ', types, '.') FROM m WHERE old > 0)""", billing=False)
def _(t: Tables):
    inventory = t.table("part").select(
        F.lit("ec2").alias("resource_type"), F.when(F.col("p_size") < 10, "stopped").otherwise("running").alias("state"),
        (F.col("p_type") == "LARGE").alias("old_generation"), F.col("p_brand").alias("instance_type"))
    return detectors.inventory_insights(inventory).select("category", "title", "description", "projected_monthly_savings")


@query("d13_native_recommendations", """
WITH r AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'azure' ELSE 'gcp' END AS provider, s_suppkey AS position, s_name AS title,
  concat('Advice on ', s_name) AS description, s_acctbal AS amount, s_suppkey % 5 AS kind FROM supplier
  QUALIFY row_number() OVER (PARTITION BY s_suppkey % 2 ORDER BY s_suppkey, s_name) <= 5)
SELECT provider, CASE provider WHEN 'azure' THEN 'general' ELSE 'idle_resource' END AS category,
  CASE provider WHEN 'azure' THEN concat('Azure Advisor: ', title) ELSE concat('GCP Recommender: ', description) END AS title,
  round(CASE WHEN kind = 0 THEN 0 WHEN provider = 'azure' THEN amount / 12 ELSE amount END, 4) AS projected_monthly_savings
FROM r""", billing=False)
def _(t: Tables):
    number = F.when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    recs = t.table("supplier").select(
        F.when(F.col("s_suppkey") % 2 == 0, "azure").otherwise("gcp").alias("provider"),
        F.col("s_suppkey").alias("position"), F.col("s_name").alias("title"),
        F.concat(F.lit("Advice on "), "s_name").alias("description"),
        number.alias("potential_savings"), number.alias("units"))
    return detectors.native_recommendations(recs).select(
        "provider", "category", "title", F.round("projected_monthly_savings", 4).alias("projected_monthly_savings"))


# ── Budgets ───────────────────────────────────────────────────────────────

# A budget per service: its average monthly cost, made tighter or wider by its name's length.
BUDGET_FACTOR = "(0.8 + length(service_name) * 0.03)"


def service_budgets(t: Tables):
    return t.staged.groupBy("service_name").agg(F.sum("effective_cost").cast("double").alias("total")).select(
        F.col("service_name").alias("budget_name"),
        F.expr(f"round(total / 83 * {BUDGET_FACTOR.replace('0.8', '0.8D').replace('0.03', '0.03D')}, 2)").alias("monthly_limit"))


BUDGET_CTE = f"""bud AS (SELECT service_name AS budget_name,
  round(CAST(sum(effective_cost) AS DOUBLE) / 83 * (CAST(0.8 AS DOUBLE) + length(service_name) * CAST(0.03 AS DOUBLE)), 2)
  AS monthly_limit FROM b GROUP BY service_name)"""


@query("d14_budget_alerts", f"""
WITH {BUDGET_CTE}, sp AS (SELECT service_name AS budget_name, CAST(sum(effective_cost) AS DOUBLE) AS spend FROM b
  WHERE CAST(billing_period_start AS DATE) = DATE '1998-05-01' GROUP BY ALL),
r AS (SELECT budget_name, monthly_limit, coalesce(spend, 0) AS spend, coalesce(spend, 0) / monthly_limit AS ratio
  FROM bud LEFT JOIN sp USING (budget_name))
SELECT budget_name, monthly_limit, round(spend, 2) AS current_spend, round(ratio * 100, 1) AS utilization_percent,
  CASE WHEN ratio >= 1 THEN 'breach' WHEN ratio >= 0.9 THEN 'critical' ELSE 'warning' END AS alert_level,
  round(greatest(0, spend - monthly_limit), 2) AS projected_overrun FROM r WHERE ratio >= 0.75""")
def _(t: Tables):
    return budgets.budget_alerts(t.staged, service_budgets(t), "1998-05-20")


@query("d15_scoped_budgets", """
WITH m AS (SELECT *, CAST(effective_cost AS DOUBLE) AS cost FROM b
  WHERE charge_date >= DATE '1998-05-01' AND charge_date <= DATE '1998-05-20'),
sc AS (SELECT 'account' AS scope_type, billing_account_id AS scope_value, charge_date, effective_cost FROM m
  UNION ALL SELECT 'service', service_name, charge_date, effective_cost FROM m
  UNION ALL SELECT 'team', tag_team, charge_date, effective_cost FROM m WHERE tag_team IS NOT NULL
  UNION ALL SELECT 'tag', concat('project=', tag_project), charge_date, effective_cost FROM m WHERE tag_project IS NOT NULL),
sp AS (SELECT scope_type, scope_value, 'daily' AS period_type, sum(CASE WHEN charge_date = DATE '1998-05-20' THEN effective_cost ELSE 0 END) AS spend FROM sc GROUP BY ALL
  UNION ALL SELECT scope_type, scope_value, 'weekly', sum(CASE WHEN charge_date >= DATE '1998-05-18' THEN effective_cost ELSE 0 END) FROM sc GROUP BY ALL
  UNION ALL SELECT scope_type, scope_value, 'monthly', sum(effective_cost) FROM sc GROUP BY ALL),
bd AS (SELECT concat(scope_type, ':', scope_value, ':', period_type) AS name, scope_type, scope_value, period_type,
  CASE period_type WHEN 'daily' THEN 20000.0 WHEN 'weekly' THEN 60000.0 ELSE 400000.0 END AS budget_amount
  FROM (SELECT DISTINCT scope_type, scope_value FROM (
    SELECT 'account' AS scope_type, billing_account_id AS scope_value FROM b UNION ALL SELECT 'service', service_name FROM b
    UNION ALL SELECT 'team', tag_team FROM b WHERE tag_team IS NOT NULL
    UNION ALL SELECT 'tag', concat('project=', tag_project) FROM b WHERE tag_project IS NOT NULL)),
  (VALUES ('daily'), ('weekly'), ('monthly')) v(period_type))
SELECT name, scope_type, scope_value, period_type, CAST(budget_amount AS DOUBLE) AS budget_amount,
  round(CAST(spend AS DOUBLE), 4) AS spend, CAST(th AS DOUBLE) AS threshold,
  round(CAST(spend AS DOUBLE) / CAST(budget_amount AS DOUBLE) * 100, 2) AS utilization_pct
FROM bd JOIN sp USING (scope_type, scope_value, period_type), (VALUES (0.5), (0.8), (1.0)) q(th)
WHERE CAST(spend AS DOUBLE) / CAST(budget_amount AS DOUBLE) >= CAST(th AS DOUBLE)""")
def _(t: Tables):
    scopes = F.array(
        F.struct(F.lit("account").alias("scope_type"), F.col("billing_account_id").alias("scope_value")),
        F.struct(F.lit("service").alias("scope_type"), F.col("service_name").alias("scope_value")),
        F.struct(F.lit("team").alias("scope_type"), F.col("tag_team").alias("scope_value")),
        F.struct(F.lit("tag").alias("scope_type"), F.concat(F.lit("project="), "tag_project").alias("scope_value")))
    wanted = t.staged.select(F.inline(scopes)).filter("scope_value IS NOT NULL").distinct().select(
        "scope_type", "scope_value", F.explode(F.array(*[F.lit(p) for p in ("daily", "weekly", "monthly")])).alias("period_type"))
    plans = wanted.select(
        F.concat_ws(":", "scope_type", "scope_value", "period_type").alias("name"), "scope_type", "scope_value", "period_type",
        F.when(F.col("period_type") == "daily", 20000.0).when(F.col("period_type") == "weekly", 60000.0)
        .otherwise(400000.0).alias("budget_amount"),
        F.array(F.lit(0.5), F.lit(0.8), F.lit(1.0)).alias("thresholds"), F.lit(True).alias("is_active"))
    return budgets.scoped_budgets(t.staged, plans, "1998-05-20")


@query("d16_monitor_thresholds", f"""
WITH bd AS (SELECT concat('m-', service_name) AS name, '*' AS provider, service_name AS service,
    CAST(sum(effective_cost) AS DOUBLE) / 60 AS monthly FROM b GROUP BY service_name
  UNION ALL SELECT concat('p-', provider_name), provider_name, '*', CAST(sum(effective_cost) AS DOUBLE) / 60 FROM b GROUP BY provider_name
  UNION ALL SELECT 'all', '*', '*', CAST(sum(effective_cost) AS DOUBLE) / 60 FROM b),
d AS (SELECT charge_date AS day, '*' AS provider, service_name AS service, {S('effective_cost')} AS daily_cost FROM b GROUP BY ALL
  UNION ALL SELECT charge_date, provider_name, '*', {S('effective_cost')} FROM b GROUP BY ALL
  UNION ALL SELECT charge_date, '*', '*', {S('effective_cost')} FROM b GROUP BY ALL)
SELECT name, provider, service, day, daily_cost, round(monthly / 30, 6) AS critical, round(monthly / 30 * 0.8, 6) AS warning,
  CASE WHEN daily_cost > monthly / 30 THEN 'critical' ELSE 'warning' END AS level
FROM bd JOIN d USING (provider, service) WHERE daily_cost > monthly / 30 * CAST(0.8 AS DOUBLE)""")
def _(t: Tables):
    amount = (F.sum("effective_cost").cast("double") / 60).alias("monthly_threshold")
    none = F.lit(None).cast("string")
    plans = (
        t.staged.groupBy("service_name").agg(amount).select(
            F.concat(F.lit("m-"), "service_name").alias("name"), none.alias("provider"),
            F.col("service_name").alias("service"), "monthly_threshold")
        .unionByName(t.staged.groupBy("provider_name").agg(amount).select(
            F.concat(F.lit("p-"), "provider_name").alias("name"), F.col("provider_name").alias("provider"),
            none.alias("service"), "monthly_threshold"))
        .unionByName(t.staged.agg(amount).select(
            F.lit("all").alias("name"), none.alias("provider"), none.alias("service"), "monthly_threshold"))
    )
    return budgets.monitor_thresholds(daily_rollup(t), plans)


@query("s12_savings_points", f"""
WITH {INSIGHTS_CTE}
SELECT 'finops.savings.potential' AS metric, projected_monthly_savings AS value,
  concat('agent:', agent, ',provider:', provider, ',severity:', severity, ',action_type:', action_type, ',source:finops') AS tags,
  3 AS type FROM ins WHERE projected_monthly_savings > 0""")
def _(t: Tables):
    return metrics.savings_points(all_insights(t)).select(
        "metric", "value", F.concat_ws(",", "tags").alias("tags"), "type")


@query("q23_savings_by_agent", f"""
WITH {INSIGHTS_CTE}
SELECT agent, round(sum(projected_monthly_savings), 2) AS savings, count(*) AS insights FROM ins
WHERE projected_monthly_savings > 0 GROUP BY ALL""")
def _(t: Tables):
    return spend.savings_by_agent(all_insights(t))
