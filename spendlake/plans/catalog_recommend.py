"""Registered recommendation and policy operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlake.operators import recommend
from spendlake.plans.analysis import analyse, every_insight
from spendlake.plans.catalog_detectors import (
    CUD_SQL, GAP_SQL, HYBRID_SQL, IDLE_SQL, INSIGHTS_CTE, LIMITS, SHOW, TAG_INSIGHT_SQL, all_insights, flat,
)
from spendlake.plans.catalog_series import FIT_CTE, series_cte
from spendlake.plans.catalog_spend import DAYS, END
from spendlake.plans.catalog_staging import ACTIONS_CTE, actions
from spendlake.plans.registry import ORACLES, query
from spendlake.sources.driver_tables import Tables

# The insight id, as SQL, and the table every check starts from.
ID = ("sha256(concat_ws('|', agent, provider, category, title, resource_id, coalesce(service_name, ''), coalesce(region, '')))")
IN = f"{INSIGHTS_CTE}, ii AS (SELECT *, {ID} AS insight_id FROM ins)"
ORDER = "projected_monthly_savings DESC NULLS LAST, title, insight_id"


def D(expr: str) -> str:
    return f"round(CAST(sum(CAST({expr} AS DECIMAL(28,6))) AS DOUBLE), 2)"


def risk(col: str) -> str:
    return f"CASE {col} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"


TITLE = "CASE category WHEN 'idle_resource' THEN 'Idle Resource' WHEN 'commitment_gap' THEN 'Commitment Gap' WHEN 'right_size' THEN 'Right Size' WHEN 'general' THEN 'General' ELSE 'Tag Compliance' END"


def recs_cte(keys: str, source: str = "ii", name: str = "rc") -> str:
    return f"""{name}_t AS (SELECT {keys}, count(*) AS n, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers,
  {D('projected_monthly_savings')} AS savings, max({risk('risk_level')}) AS rk FROM {source} GROUP BY {keys}),
{name}_l AS (SELECT {keys}, string_agg(concat('- ', title), chr(10) ORDER BY r) AS lines FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ORDER}) AS r FROM {source}) WHERE r <= 3 GROUP BY {keys}),
{name} AS (SELECT sha256(concat(category, '|', providers)) AS recommendation_id, concat({TITLE}, ': ', n, ' findings') AS title,
  concat(lines, CASE WHEN n > 3 THEN concat(chr(10), '- ... and ', n - 3, ' more') ELSE '' END) AS description,
  category, providers, n AS findings, savings AS total_projected_monthly_savings,
  CASE category WHEN 'idle_resource' THEN 'low' WHEN 'tag_compliance' THEN 'low' ELSE 'medium' END AS implementation_effort,
  CASE rk WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS risk_level, rk >= 2 AS requires_approval
  FROM {name}_t JOIN {name}_l USING ({keys}))"""


def shown(recs):
    return recs.withColumn("providers", F.concat_ws(",", "providers")).drop("actions")


@query("r1_union_insights", f"""
WITH {IN} SELECT insight_id, agent, provider, category, severity, title, resource_id, service_name, region,
  current_monthly_cost, projected_monthly_savings, confidence_score, action_type, risk_level FROM ii""")
def _(t: Tables):
    return flat(all_insights(t), with_id=True)


DEDUP = f"SELECT * FROM ii QUALIFY row_number() OVER (PARTITION BY provider, category, coalesce(nullif(resource_id, ''), title) ORDER BY {ORDER}) = 1"


@query("r2_dedup_insights", f"WITH {IN} SELECT insight_id, provider, category, title, region, projected_monthly_savings FROM ({DEDUP})")
def _(t: Tables):
    return recommend.dedup_insights(all_insights(t)).select(
        "insight_id", "provider", "category", "title", "region",
        F.round("projected_monthly_savings", 4).alias("projected_monthly_savings"))


@query("r2_dedup_insights_by_action", f"""
WITH {IN} SELECT insight_id, provider, action_type, title, region FROM ii
QUALIFY row_number() OVER (PARTITION BY provider, coalesce(nullif(resource_id, ''), 'global'), action_type ORDER BY {ORDER}) = 1""")
def _(t: Tables):
    return recommend.dedup_insights(all_insights(t), "action").select(
        "insight_id", "provider", "action_type", "title", "region")


@query("r3_recommend", f"WITH {IN}, du AS ({DEDUP}), {recs_cte('category', 'du')} SELECT * FROM rc")
def _(t: Tables):
    return shown(recommend.recommend(recommend.dedup_insights(all_insights(t))))


_STEPS = " UNION ALL ".join(
    f"SELECT '{c}' AS category, '{chr(10).join(s)}' AS actions" for c, s in recommend.ACTION_STEPS.items())


@query("r4_action_steps", f"""
WITH {IN}, st AS ({_STEPS}) SELECT category, actions, count(*) AS insights FROM ii JOIN st USING (category) GROUP BY ALL""")
def _(t: Tables):
    counted = all_insights(t).groupBy("category").agg(F.count(F.lit(1)).alias("insights"))
    return recommend.with_steps(counted).withColumn("actions", F.concat_ws("\n", "actions"))


@query("r5_prioritise", f"""
WITH {IN}, {recs_cte('category, provider')} SELECT recommendation_id, title, providers, risk_level, total_projected_monthly_savings,
  round(least(total_projected_monthly_savings, 100000) * CASE risk_level WHEN 'low' THEN 1.0 WHEN 'medium' THEN 0.7
    WHEN 'high' THEN 0.4 ELSE 0.1 END, 2) AS priority_score FROM rc""")
def _(t: Tables):
    return shown(recommend.prioritise(recommend.recommend(all_insights(t), per_provider=True))).select(
        "recommendation_id", "title", "providers", "risk_level", "total_projected_monthly_savings", "priority_score")


@query("r6_roi", f"""
WITH {IN}, {recs_cte('category, provider')}, m AS (SELECT recommendation_id, total_projected_monthly_savings AS m FROM rc)
SELECT recommendation_id, round(m, 2) AS monthly_savings, round(m * 12, 2) AS annual_savings, CAST(400 AS DOUBLE) AS implementation_cost,
  CASE WHEN m > 0 THEN round(400 / m, 2) END AS payback_months, round((m * 12 - 400) / 400 * 100, 2) AS roi_percent FROM m""")
def _(t: Tables):
    return recommend.roi(recommend.recommend(all_insights(t), per_provider=True))


# Tag findings counted as right-sizing, so that one category spans all three clouds.
CROSS = """x AS (SELECT * REPLACE (CASE WHEN category = 'tag_compliance' THEN 'right_size' ELSE category END AS category) FROM ii)"""


@query("r7_conflicts", f"""
WITH {IN}, {CROSS}, {recs_cte('category, provider', 'x')},
s AS (SELECT category, providers AS k, count(*) AS n, min(recommendation_id) AS first_id FROM rc
  WHERE category IN ('right_size', 'idle_resource') GROUP BY ALL)
SELECT 'cross_cloud_similarity' AS type, a.category, a.k AS providers_a, b.k AS providers_b,
  concat('Similar ', a.category, ' recommendations across ', a.k, ' and ', b.k) AS description,
  a.first_id AS recommendation_a, b.first_id AS recommendation_b, a.n * b.n AS pairs
FROM s a JOIN s b ON a.category = b.category AND a.k < b.k""")
def _(t: Tables):
    crossed = all_insights(t).withColumn(
        "category", F.when(F.col("category") == "tag_compliance", "right_size").otherwise(F.col("category")))
    return recommend.conflicts(recommend.recommend(crossed, per_provider=True))


@query("r8_synthesise", f"""
WITH {IN}, g AS (SELECT category, count(*) AS n, count(DISTINCT provider) AS c, {D('projected_monthly_savings')} AS s FROM ii GROUP BY category),
l AS (SELECT category, string_agg(concat('- ', upper(provider), ': ', title), chr(10) ORDER BY r) AS lines FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY {ORDER}) AS r FROM ii) WHERE r <= 3 GROUP BY category),
v AS (SELECT string_agg(concat('- ', upper(provider), ': Coverage N/A%'), chr(10) ORDER BY provider) AS cov
  FROM (SELECT DISTINCT provider FROM ii WHERE category = 'commitment_gap'))
SELECT category, n AS findings, CASE category WHEN 'tag_compliance' THEN 0 ELSE s END AS total_projected_monthly_savings,
  CASE category WHEN 'idle_resource' THEN concat('Eliminate ', n, ' idle resources across ', c, ' clouds')
    WHEN 'commitment_gap' THEN concat('Increase commitment coverage across ', c, ' clouds')
    WHEN 'right_size' THEN concat('Right-size ', n, ' over-provisioned resources')
    ELSE 'Improve tagging compliance (0% coverage)' END AS title,
  CASE category WHEN 'idle_resource' THEN concat('$', format('{{:,.2f}}', s), ' a month goes to ', n, ' findings of idleness:', chr(10), lines)
    WHEN 'commitment_gap' THEN concat('Committing more would save about $', format('{{:,.2f}}', s), ' a month. So far:', chr(10), cov)
    WHEN 'right_size' THEN concat(n, ' resources could be smaller, worth $', format('{{:,.2f}}', s), ' a month.')
    ELSE concat(n, ' findings on tags in ', c, ' clouds.') END AS description,
  CASE WHEN category IN ('idle_resource', 'tag_compliance') THEN 'low' ELSE 'medium' END AS implementation_effort,
  CASE category WHEN 'right_size' THEN 'medium' ELSE 'low' END AS risk_level, category <> 'tag_compliance' AS requires_approval
FROM g JOIN l USING (category), v""")
def _(t: Tables):
    return recommend.synthesise(all_insights(t)).drop("recommendation_id", "providers", "actions")


GATE = """CASE WHEN action_type = 'delete' THEN 'Delete actions permanently blocked'
  WHEN action_type = 'stop' THEN 'Stop actions require approval'
  WHEN action_type = 'right-size' AND risk_level = 'high' THEN 'High-risk right-sizing requires approval' END"""


@query("r9_policy_gate", f"""
WITH {IN} SELECT provider, action_type, risk_level, {GATE} AS reason, reason IS NULL AS allowed, count(*) AS insights FROM ii GROUP BY ALL""")
def _(t: Tables):
    return recommend.policy_gate(all_insights(t)).groupBy("provider", "action_type", "risk_level", "reason", "allowed").agg(
        F.count(F.lit(1)).alias("insights"))


@query("r10_policy_rules", f"""
WITH {ACTIONS_CTE}, d AS (SELECT *, action_type IN ('stop', 'terminate', 'delete', 'detach') AS destructive FROM act),
r AS (SELECT *, concat_ws('; ',
  CASE WHEN destructive AND environment IN ('production', 'prod', 'live') AND NOT approved
    THEN concat(action_type, ' on ', environment, ' requires explicit approval') END,
  CASE WHEN action_type = 'delete' THEN 'Delete actions permanently blocked' END,
  CASE WHEN action_type = 'right-size' AND risk_level = 'high' AND NOT approved THEN 'High-risk right-sizing requires human approval' END,
  CASE WHEN destructive AND projected_monthly_savings < 50 THEN 'Destructive action denied: projected savings below $50/month threshold' END) AS deny FROM d)
SELECT action_id, deny, action_type IN ('investigate', 'report', 'tag', 'purchase-commitment') OR (approved AND approved_by <> '')
  OR deny = '' AS allow FROM r""", billing=False)
def _(t: Tables):
    return recommend.policy_rules(actions(t)).select("action_id", F.concat_ws("; ", "deny").alias("deny"), "allow")


@query("r11_run_summary", f"""
WITH {IN} SELECT count(*) AS insights, {D('projected_monthly_savings')} AS total_projected_monthly_savings,
  {D('projected_monthly_savings * 12')} AS total_projected_annual_savings,
  count(*) FILTER (agent <> 'aws_cost_agent' OR category <> 'commitment_gap') AS total_affected_resources,
  count(*) FILTER ({GATE} IS NOT NULL) AS policy_violations, bool_or(severity IN ('critical', 'high')) AS requires_approval FROM ii""")
def _(t: Tables):
    return recommend.run_summary(all_insights(t))


@query("r11_policy_violations", f"WITH {IN} SELECT insight_id, concat(insight_id, ': ', {GATE}) AS violation FROM ii WHERE {GATE} IS NOT NULL")
def _(t: Tables):
    return recommend.policy_violations(all_insights(t))


@query("r12_list_insights", f"""
WITH {IN} SELECT insight_id, provider, category, title, region, projected_monthly_savings FROM ii
WHERE provider = 'azure' AND severity = 'medium' ORDER BY {ORDER} LIMIT 100""")
def _(t: Tables):
    return recommend.list_insights(all_insights(t), "azure", severity="medium").select(
        "insight_id", "provider", "category", "title", "region",
        F.round("projected_monthly_savings", 4).alias("projected_monthly_savings"))


@query("r13_report_sections", f"""
WITH {IN}, {recs_cte('category')}
SELECT 'summary' AS section, 1 AS position, 'total_insights' AS name, CAST(count(*) AS DOUBLE) AS value FROM ii
UNION ALL SELECT 'summary', 2, 'recommendations', CAST(count(*) AS DOUBLE) FROM rc
UNION ALL SELECT 'summary', 3, 'total_projected_monthly_savings', round(sum(total_projected_monthly_savings), 2) FROM rc
UNION ALL SELECT 'recommendation', CAST(row_number() OVER (ORDER BY total_projected_monthly_savings DESC, title) AS INTEGER), title,
  round(total_projected_monthly_savings, 2) FROM rc
UNION ALL SELECT 'provider', 0, upper(provider), CAST(count(*) AS DOUBLE) FROM ii GROUP BY provider""")
def _(t: Tables):
    rows = all_insights(t)
    return recommend.report_sections(rows, recommend.recommend(rows))


# The findings of every detector in one layout: what a run over all of them has to rank.
_COLUMNS = ("agent, provider, category, severity, title, resource_id, service_name, region, current_monthly_cost, projected_monthly_savings, "
            "confidence_score, action_type, risk_level")
_EVERY = ["d1_idle_insights", "d6_coverage_insights", "d7_tag_coverage_insights", "d11_spend_insights"]
_ANOMALIES = f"""SELECT {SHOW("'anomaly_agent'", "key", "'general'",
  "CASE WHEN CASE WHEN yhat > 0 THEN abs(y - yhat) / yhat * 100 ELSE 0 END > 50 THEN 'critical' ELSE 'high' END",
  "concat('Cost anomaly detected: ', upper(key))", "CAST(ds AS VARCHAR)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "y", "0.0", 0.95,
  "'investigate'", "'high'")} FROM fit WHERE y > yhat + 1.96 * sigma OR y < yhat - 1.96 * sigma"""
_EVERY_SQL = "\nUNION ALL ".join(
    f"SELECT {_COLUMNS} FROM ({sql})"
    for sql in (*(ORACLES[n] for n in _EVERY), IDLE_SQL, GAP_SQL, HYBRID_SQL, CUD_SQL, TAG_INSIGHT_SQL, _ANOMALIES))
EVERY = f"{series_cte('provider_name')}, {FIT_CTE}, ins AS ({_EVERY_SQL}), ii AS (SELECT *, {ID} AS insight_id FROM ins)"


@query("r1_every_insight", f"""
WITH {EVERY}
SELECT agent, provider, category, severity, count(*) AS insights, count(DISTINCT title) AS titles, round(sum(projected_monthly_savings), 2) AS savings
FROM ii GROUP BY ALL""")
def _(t: Tables):
    rows = every_insight(t.staged, END, DAYS, LIMITS, idle_cost=100)
    return rows.groupBy("agent", "provider", "category", "severity").agg(
        F.count(F.lit(1)).alias("insights"), F.count_distinct("title").alias("titles"),
        F.round(F.sum(F.round("projected_monthly_savings", 4)), 2).alias("savings"))


@query("e3_analysis_run", f"""
WITH {EVERY}, du AS ({DEDUP}), {recs_cte('category', 'du')}
SELECT category, title, total_projected_monthly_savings, risk_level, round(least(total_projected_monthly_savings, 100000)
  * CASE risk_level WHEN 'low' THEN 1.0 WHEN 'medium' THEN 0.7 WHEN 'high' THEN 0.4 ELSE 0.1 END, 2) AS priority_score FROM rc""")
def _(t: Tables):
    """All detectors with their defaults but for the thresholds; the resource findings handed in again count once."""
    run = analyse(t.staged, END, DAYS, thresholds=LIMITS, extra=[all_insights(t)], idle_cost=100)
    return run.recommendations.select("category", "title", "total_projected_monthly_savings", "risk_level", "priority_score")
