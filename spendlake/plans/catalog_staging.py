"""Registered cleaning steps, exports, cluster allocation and audit queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from spendlake import schema
from spendlake.functions import lookups
from spendlake.functions.columns import dollars
from spendlake.operators import audit, kubernetes, rollups, staging
from spendlake.plans.catalog_spend import DAYS, END, START, S
from spendlake.plans.registry import query
from spendlake.session import run_dir
from spendlake.sinks import exports, metrics
from spendlake.sources import billing_table
from spendlake.sources.driver_tables import Tables


@query("t1_stage_billing", """
SELECT provider_name, sub_account_id, charge_date, charge_month, resource_id, region_id, charge_description,
  CAST(effective_cost AS DOUBLE) AS effective_cost, CAST(list_cost AS DOUBLE) AS list_cost,
  commitment_discount_id, tag_team, tag_env, tag_project, CAST(NULL AS VARCHAR) AS tag_cost_center,
  CAST(savings_amount AS DOUBLE) AS savings_amount, round(savings_pct, 6) AS savings_pct FROM b""")
def _(t: Tables):
    return t.staged.select(
        "provider_name", "sub_account_id", "charge_date", "charge_month", "resource_id", "region_id",
        "charge_description", F.col("effective_cost").cast("double").alias("effective_cost"),
        F.col("list_cost").cast("double").alias("list_cost"), "commitment_discount_id",
        "tag_team", "tag_env", "tag_project", "tag_cost_center",
        F.col("savings_amount").cast("double").alias("savings_amount"),
        F.round("savings_pct", 6).alias("savings_pct"))


# The provider's own name for each service of the view, the same in both engines.
RAW_SERVICE = """CASE provider_name
  WHEN 'aws' THEN CASE service_name WHEN 'Virtual Machine' THEN 'Amazon Elastic Compute Cloud - Compute'
    WHEN 'Relational Database' THEN 'Amazon Relational Database Service'
    WHEN 'Object Storage' THEN 'Amazon Simple Storage Service'
    WHEN 'Kubernetes' THEN 'Amazon Elastic Kubernetes Service'
    WHEN 'Serverless Function' THEN 'AWS Lambda' ELSE 'Amazon CloudFront' END
  WHEN 'azure' THEN CASE service_name WHEN 'Virtual Machine' THEN 'Virtual Machines'
    WHEN 'Relational Database' THEN 'SQL Database' WHEN 'Object Storage' THEN 'Storage'
    WHEN 'Kubernetes' THEN 'Azure Kubernetes Service'
    WHEN 'Serverless Function' THEN 'Azure Functions' ELSE 'Front Door' END
  ELSE CASE service_name WHEN 'Virtual Machine' THEN 'Compute Engine'
    WHEN 'Relational Database' THEN 'Cloud SQL' WHEN 'Object Storage' THEN 'Cloud Storage'
    WHEN 'Kubernetes' THEN 'Google Kubernetes Engine'
    WHEN 'Serverless Function' THEN 'Cloud Functions' ELSE 'Cloud CDN' END END"""


def _values(tables) -> str:
    return ", ".join(f"('{p}', '{k}', '{v}')" for p, table in tables for k, v in table.items())


@query("t2_map_service", f"""
WITH dim(p, raw, name) AS (VALUES {_values((("aws", lookups.AWS_SERVICES), ("azure", lookups.AZURE_SERVICES),
                                            ("gcp", lookups.GCP_SERVICES)))}),
r AS (SELECT provider_name, {RAW_SERVICE} AS source_service, effective_cost FROM billing),
n AS (SELECT provider_name, source_service, coalesce(name, source_service) AS service_name, effective_cost
  FROM r LEFT JOIN dim ON p = provider_name AND raw = source_service)
SELECT provider_name, source_service, service_name,
  CASE WHEN provider_name = 'aws' THEN CASE
      WHEN service_name IN ('Virtual Machine', 'Serverless Function', 'Container Orchestration') THEN 'Compute'
      WHEN service_name IN ('Object Storage', 'Block Storage', 'File Storage', 'Backup') THEN 'Storage'
      WHEN service_name IN ('Relational Database', 'NoSQL Database', 'Cache', 'Data Warehouse') THEN 'Database'
      WHEN service_name IN ('CDN', 'DNS', 'Load Balancer', 'VPN') THEN 'Networking' ELSE 'Other' END
    WHEN service_name LIKE '%Virtual Machine%' THEN 'Compute'
    WHEN service_name LIKE '%Storage%' THEN 'Storage' WHEN service_name LIKE '%Database%' THEN 'Database'
    WHEN provider_name = 'gcp' AND (service_name LIKE '%CDN%' OR service_name LIKE '%DNS%'
      OR service_name LIKE '%Load Balancer%') THEN 'Networking'
    ELSE 'Other' END AS service_category,
  count(*) AS rows, {S('effective_cost')} AS cost FROM n GROUP BY ALL""")
def _(t: Tables):
    raw = t.billing.withColumn("source_service", F.expr(RAW_SERVICE)).drop("service_name", "service_category")
    return staging.map_service(raw, "source_service").groupBy(
        "provider_name", "source_service", "service_name", "service_category").agg(
        F.count(F.lit(1)).alias("rows"), dollars(F.sum("effective_cost")).alias("cost"))


@query("t2_map_category", f"""
WITH dim(p, raw, category) AS (VALUES {_values((("aws", lookups.AWS_CATEGORIES), ("azure", lookups.AZURE_CATEGORIES),
                                                ("gcp", lookups.GCP_CATEGORIES)))}),
r AS (SELECT provider_name, {RAW_SERVICE} AS service_name, effective_cost FROM billing)
SELECT provider_name, service_name, coalesce(category, 'Other') AS service_category, count(*) AS rows
FROM r LEFT JOIN dim ON p = provider_name AND raw = service_name GROUP BY ALL""")
def _(t: Tables):
    raw = t.billing.withColumn("service_name", F.expr(RAW_SERVICE))
    return staging.map_category(raw).groupBy("provider_name", "service_name", "service_category").agg(
        F.count(F.lit(1)).alias("rows"))


# A usage type or pricing model per charge, the same in both engines.
HINT = """CASE WHEN provider_name = 'gcp' THEN CASE WHEN commitment_discount_type = 'Reserved' THEN 'CUD' ELSE 'NONE' END
  WHEN commitment_discount_type = 'Reserved' THEN CASE WHEN usage_quantity > 25 THEN 'SavingsPlanUsage:Box'
    WHEN provider_name = 'azure' THEN 'Reservation' ELSE 'USE1-ReservedUsage' END
  WHEN usage_quantity < 10 THEN 'USE1-SpotUsage:m5' ELSE 'BoxUsage:m5.large' END"""


@query("t3_infer_pricing", f"""
WITH h AS (SELECT provider_name, {HINT} AS usage_type FROM billing)
SELECT provider_name, usage_type,
  CASE WHEN provider_name = 'gcp' THEN CASE WHEN usage_type ILIKE '%cud%' THEN 'Commitment-Based' ELSE 'On-Demand' END
    WHEN usage_type ILIKE '%reserved%' OR (provider_name = 'azure' AND usage_type ILIKE '%reservation%') THEN 'Commitment-Based'
    WHEN provider_name = 'aws' AND usage_type ILIKE '%savingsplan%' THEN 'Commitment-Based'
    WHEN usage_type ILIKE '%spot%' THEN 'Dynamic' ELSE 'On-Demand' END AS pricing_category,
  CASE WHEN provider_name = 'gcp' THEN CASE WHEN usage_type ILIKE '%cud%' THEN 'Committed Use' ELSE 'None' END
    WHEN usage_type ILIKE '%reserved%' OR (provider_name = 'azure' AND usage_type ILIKE '%reservation%') THEN 'Reserved'
    WHEN provider_name = 'aws' AND usage_type ILIKE '%savingsplan%' THEN 'Savings Plan' ELSE 'None' END AS commitment_discount_type,
  count(*) AS rows FROM h GROUP BY ALL""")
def _(t: Tables):
    return staging.infer_pricing(t.billing.withColumn("usage_type", F.expr(HINT))).groupBy(
        "provider_name", "usage_type", "pricing_category", "commitment_discount_type").agg(
        F.count(F.lit(1)).alias("rows"))


@query("t4_derive_periods", """
SELECT CAST(date_trunc('month', charge_period_start) AS DATE) AS billing_period_start,
  CAST(date_trunc('month', charge_period_start) + INTERVAL 1 MONTH AS DATE) AS billing_period_end,
  count(*) AS rows, CAST(min(charge_period_start) AS DATE) AS first_charge, CAST(max(charge_period_start) AS DATE) AS last_charge
FROM billing GROUP BY ALL""")
def _(t: Tables):
    rows = staging.derive_periods(t.billing.drop("billing_period_start", "billing_period_end"))
    return rows.groupBy(F.to_date("billing_period_start").alias("billing_period_start"),
                        F.to_date("billing_period_end").alias("billing_period_end")).agg(
        F.count(F.lit(1)).alias("rows"), F.to_date(F.min("charge_period_start")).alias("first_charge"),
        F.to_date(F.max("charge_period_start")).alias("last_charge"))


# Charges broken in known ways, so that rules both pass and fail.
BROKEN = {
    "charge_category": "CASE WHEN charge_category = 'Credit' AND usage_quantity > 40 THEN 'Usage' ELSE charge_category END",
    "provider_name": "CASE WHEN usage_quantity = 3 THEN 'oracle' WHEN usage_quantity = 4 THEN upper(provider_name) ELSE provider_name END",
    "billing_currency": "CASE WHEN usage_quantity = 5 THEN 'US' WHEN usage_quantity = 6 THEN 'usd' ELSE billing_currency END",
    "charge_period_end": "CASE WHEN usage_quantity = 7 THEN charge_period_start ELSE charge_period_end END",
    "usage_quantity": "CASE WHEN usage_quantity = 8 THEN -1 ELSE usage_quantity END",
}


@query("t5_validate", f"""
WITH x AS (SELECT * REPLACE ({", ".join(f"{e} AS {c}" for c, e in BROKEN.items())}) FROM billing),
v AS (SELECT *, concat_ws(',',
  CASE WHEN NOT billing_period_start < billing_period_end THEN 'billing_period_order' END,
  CASE WHEN NOT charge_period_start < charge_period_end THEN 'charge_period_order' END,
  CASE WHEN lower(provider_name) NOT IN ('aws', 'azure', 'gcp') THEN 'provider' END,
  CASE WHEN list_cost < 0 THEN 'negative_list_cost' END,
  CASE WHEN usage_quantity < 0 THEN 'negative_usage' END,
  CASE WHEN effective_cost < 0 AND charge_category NOT IN ('Credit', 'Adjustment') THEN 'negative_effective_cost' END,
  CASE WHEN length(billing_currency) <> 3 THEN 'currency' END) AS violations FROM x)
SELECT violations, CASE WHEN violations = '' THEN lower(provider_name) ELSE provider_name END AS provider_name,
  CASE WHEN violations = '' THEN upper(billing_currency) ELSE billing_currency END AS billing_currency,
  count(*) AS rows FROM v GROUP BY ALL""")
def _(t: Tables):
    broken = t.billing.select(*[
        F.expr(BROKEN[c]).cast(t.billing.schema[c].dataType).alias(c) if c in BROKEN else F.col(c)
        for c in t.billing.columns])
    return staging.mark(broken).groupBy(
        F.concat_ws(",", "violations").alias("violations"), "provider_name", "billing_currency").agg(F.count(F.lit(1)).alias("rows"))


@query("t6_normalise_tags", """
SELECT coalesce(tag_team, '') AS team, coalesce(tag_project, '') AS project, count(*) AS rows FROM b GROUP BY ALL""")
def _(t: Tables):
    upper = t.staged.withColumn("tags", F.to_json(F.transform_keys("tags", lambda k, v: F.upper(k))))
    return staging.normalise_tags(upper).groupBy(
        F.coalesce(F.col("tags")["team"], F.lit("")).alias("team"),
        F.coalesce(F.col("tags")["project"], F.lit("")).alias("project")).agg(F.count(F.lit(1)).alias("rows"))


@query("t7_tag_accessors", f"""
SELECT tag_team AS team, tag_env AS environment, count(*) AS rows, {S('effective_cost')} AS cost FROM b GROUP BY ALL""")
def _(t: Tables):
    return staging.tag_accessors(t.staged).groupBy("team", "environment").agg(
        F.count(F.lit(1)).alias("rows"), dollars(F.sum("effective_cost")).alias("cost"))


@query("t8_discounts", """
SELECT charge_description, charge_category, CAST(list_cost - effective_cost AS DOUBLE) AS discount_amount,
  CASE WHEN list_cost <> 0 THEN round(CAST(list_cost - effective_cost AS DOUBLE) / CAST(list_cost AS DOUBLE) * 100, 2)
  ELSE 0 END AS discount_percentage FROM billing""")
def _(t: Tables):
    return staging.discounts(t.billing).select(
        "charge_description", "charge_category", F.col("discount_amount").cast("double").alias("discount_amount"),
        "discount_percentage")


# Charges with gaps, so that the source tests have something to count.
GAPS = {
    "provider_name": "CASE WHEN usage_quantity = 3 THEN 'oracle' WHEN usage_quantity = 4 THEN NULL ELSE provider_name END",
    "service_name": "CASE WHEN usage_quantity = 5 THEN NULL ELSE service_name END",
}


@query("t9_source_tests", f"""
WITH x AS (SELECT * REPLACE ({", ".join(f"{e} AS {c}" for c, e in GAPS.items())}) FROM billing),
c AS (SELECT count(*) AS n, count(*) FILTER (provider_name IS NULL) AS p0,
  count(*) FILTER (provider_name NOT IN ('aws', 'azure', 'gcp')) AS p1,
  count(*) FILTER (billing_account_id IS NULL) AS a0, count(*) FILTER (effective_cost IS NULL) AS e0,
  count(*) FILTER (charge_period_start IS NULL) AS c0, count(*) FILTER (service_name IS NULL) AS s0 FROM x)
SELECT n AS row_count, unnest(['not_null_provider_name', 'accepted_values_provider_name', 'not_null_billing_account_id',
  'not_null_effective_cost', 'not_null_charge_period_start', 'not_null_service_name']) AS test,
  unnest([p0, p1, a0, e0, c0, s0]) AS failures FROM c""")
def _(t: Tables):
    gaps = t.billing.withColumns({c: F.expr(e) for c, e in GAPS.items()})
    return staging.source_tests(gaps)


# Every charge is sent a second time: later and corrected, or late and stale.
RESENT = """SELECT * FROM billing UNION ALL BY NAME
SELECT * REPLACE (cs_ingested_at + CASE WHEN usage_quantity > 25 THEN INTERVAL 1 DAY ELSE -INTERVAL 1 DAY END AS cs_ingested_at,
  CAST(effective_cost + 1 AS DECIMAL(18,6)) AS effective_cost) FROM billing"""


def resent(t: Tables):
    shift = F.when(F.col("usage_quantity") > 25, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("-INTERVAL 1 DAY"))
    again = t.billing.withColumns({
        "cs_ingested_at": F.col("cs_ingested_at") + shift,
        "effective_cost": (F.col("effective_cost") + 1).cast(schema.MONEY)})
    return t.billing.unionByName(again)


@query("t10_dedup_latest", f"""
WITH x AS ({RESENT})
SELECT charge_description, CAST(effective_cost AS DOUBLE) AS effective_cost, CAST(cs_ingested_at AS DATE) AS ingested
FROM x QUALIFY row_number() OVER (PARTITION BY {", ".join(schema.CHARGE_KEY)}
  ORDER BY cs_ingested_at DESC, effective_cost DESC) = 1""")
def _(t: Tables):
    return staging.dedup_latest(resent(t)).select(
        "charge_description", F.col("effective_cost").cast("double").alias("effective_cost"),
        F.to_date("cs_ingested_at").alias("ingested"))


@query("t11_retain", """
SELECT charge_month, count(*) AS rows, min(charge_date) AS first_day FROM b
WHERE charge_period_start >= TIMESTAMP '2001-07-01' - INTERVAL 18 MONTH GROUP BY ALL""")
def _(t: Tables):
    return staging.retain(t.staged, "2001-07-01").groupBy("charge_month").agg(
        F.count(F.lit(1)).alias("rows"), F.min("charge_date").alias("first_day"))


@query("t12_filter_billing", f"""
SELECT provider_name, service_name, region_id, count(*) AS rows, {S('effective_cost')} AS cost FROM b
WHERE charge_period_start >= TIMESTAMP '1995-01-01' AND charge_period_start < TIMESTAMP '2002-01-01'
  AND provider_name IN ('aws', 'gcp') AND region_id IN ('asia', 'europe') AND tag_env = 'production' GROUP BY ALL""")
def _(t: Tables):
    rows = staging.filter_billing(t.staged, START, END, ["AWS", "gcp"], regions=["asia", "europe"],
                                  tags={"environment": "production"})
    return rows.groupBy("provider_name", "service_name", "region_id").agg(
        F.count(F.lit(1)).alias("rows"), dollars(F.sum("effective_cost")).alias("cost"))


# ── Table, exports, metrics ───────────────────────────────────────────────

@query("s1_billing_table", f"""
SELECT CAST(year(charge_period_start) * 100 + month(charge_period_start) AS INTEGER) AS charge_month, provider_name,
  count(*) AS rows, {S('effective_cost')} AS cost, count(*) FILTER (tag_team <> '') AS with_team FROM billing
WHERE charge_period_start >= TIMESTAMP '1996-03-10' AND charge_period_start < TIMESTAMP '2001-05-06' GROUP BY ALL""")
def _(t: Tables):
    path = run_dir(t.spark, "billing-table")
    billing_table.write_billing(t.billing, path)
    rows = billing_table.read_billing(t.spark, path, "1996-03-10", "2001-05-05")
    return rows.groupBy("charge_month", "provider_name").agg(
        F.count(F.lit(1)).alias("rows"), dollars(F.sum("effective_cost")).alias("cost"),
        F.count_if(F.col("tags")["team"].isNotNull()).alias("with_team"))


@query("s9_export_focus", """
SELECT billing_account_id AS BillingAccountId, strftime(billing_period_start, '%Y-%m-%dT%H:%M:%S') AS BillingPeriodStart,
  strftime(charge_period_end, '%Y-%m-%dT%H:%M:%S') AS ChargePeriodEnd, charge_description AS ChargeDescription,
  service_name AS ServiceName, region_id AS RegionId, provider_name AS Provider,
  CAST(list_cost AS DOUBLE) AS ListCost, CAST(effective_cost AS DOUBLE) AS EffectiveCost,
  CAST(billed_cost AS DOUBLE) AS BilledCost, usage_quantity AS UsageQuantity, commitment_discount_id AS CommitmentDiscountId,
  billing_account_name AS BillingAccountName, strftime(billing_period_end, '%Y-%m-%dT%H:%M:%S') AS BillingPeriodEnd,
  strftime(charge_period_start, '%Y-%m-%dT%H:%M:%S') AS ChargePeriodStart, charge_category AS ChargeCategory, service_category AS ServiceCategory,
  resource_id AS ResourceId, resource_name AS ResourceName, resource_type AS ResourceType, provider_name AS InvoiceIssuerName,
  commitment_discount_type AS CommitmentDiscountType, tag_team AS Team, tag_owner AS Owner
FROM b WHERE billing_period_start >= TIMESTAMP '1995-01-01' AND billing_period_start < TIMESTAMP '2002-01-01'
""")
def _(t: Tables):
    rows = exports.typed_cells(exports.export_rows(t.staged, START, END))
    return rows.select("BillingAccountId", "BillingPeriodStart", "ChargePeriodEnd", "ChargeDescription", "ServiceName",
                       "RegionId", "Provider", "ListCost", "EffectiveCost", "BilledCost", "UsageQuantity",
                       "CommitmentDiscountId", "BillingAccountName", "BillingPeriodEnd", "ChargePeriodStart", "ChargeCategory",
                       "ServiceCategory", "ResourceId", "ResourceName", "ResourceType", "InvoiceIssuerName", "CommitmentDiscountType",
                       F.get_json_object("Tags", "$.team").alias("Team"), F.get_json_object("Tags", "$.owner").alias("Owner"))


@query("s9_export_files", f"""
SELECT 'csv' AS format, count(*) AS rows, {S('effective_cost')} AS cost FROM b
UNION ALL SELECT 'jsonl', count(*), {S('effective_cost')} FROM b
UNION ALL SELECT 'parquet', count(*), {S('effective_cost')} FROM b""")
def _(t: Tables):
    out = None
    for fmt in ("csv", "jsonl", "parquet"):
        path = run_dir(t.spark, f"export-{fmt}")
        exports.export_focus(t.staged, fmt, path, START, END, limit=None)
        reader = {"csv": lambda p: t.spark.read.option("header", True).csv(p),
                  "jsonl": lambda p: t.spark.read.schema("EffectiveCost double").json(p),
                  "parquet": lambda p: t.spark.read.parquet(p)}[fmt]
        part = reader(path).agg(F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("rows"),
                                F.round(F.sum(F.col("EffectiveCost").cast("decimal(18,6)")).cast("double"), 4).alias("cost"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s10_bi_semantic_view", f"""
SELECT provider_name AS provider, service_name, strftime(billing_period_start, '%Y-%m') AS MonthYear,
  {S('effective_cost')} AS total_effective_cost, {S('list_cost')} AS total_list_cost,
  CAST(sum(effective_cost) AS DOUBLE) / count(effective_cost) AS avg_effective_cost, sum(usage_quantity) AS total_usage_quantity,
  count(DISTINCT resource_id) AS resource_count FROM b GROUP BY ALL""")
def _(t: Tables):
    return exports.bi_measures(exports.bi_semantic_view(t.staged), ["provider", "service_name", "MonthYear"])


@query("s11_metric_points", f"""
WITH d AS (SELECT provider_name, service_name, region_id, billing_account_id, {S('effective_cost')} AS value
  FROM b GROUP BY ALL HAVING value > 0),
p AS (SELECT *, concat_ws('|', provider_name, service_name, region_id, billing_account_id) AS k FROM d),
m AS (SELECT 'finops.cost.daily' AS metric, k, value, concat('provider:', provider_name, ',service:', service_name,
    ',region:', region_id, ',account:', billing_account_id, ',source:finops') AS tags FROM p
  UNION ALL SELECT 'finops.cost.by_service', k, value, concat('service:', service_name, ',source:finops') FROM p
  UNION ALL SELECT 'finops.cost.by_provider', k, value, concat('provider:', provider_name, ',source:finops') FROM p
  UNION ALL SELECT 'finops.cost.by_region', k, value, concat('region:', region_id, ',source:finops') FROM p),
n AS (SELECT metric, tags, value, 3 AS type, concat(metric, '|', k) AS point_key FROM m)
SELECT *, (row_number() OVER (ORDER BY point_key) - 1) // 500 AS batch_id FROM n""")
def _(t: Tables):
    daily = t.staged.groupBy("provider_name", "service_name", "region_id", "billing_account_id").agg(
        dollars(F.sum("effective_cost")).alias("total_cost")).filter("total_cost > 0")
    return metrics.metric_points(daily).withColumn("tags", F.concat_ws(",", "tags"))


# ── Clusters ──────────────────────────────────────────────────────────────

K8S_NS = f"""SELECT k8s_namespace AS namespace, coalesce(k8s_cluster, '') AS cluster, {S('effective_cost')} AS total_cost,
  count(DISTINCT resource_id) AS resource_count, CAST(min(billing_period_start) AS DATE) AS window_start,
  CAST(max(billing_period_start) AS DATE) AS window_end
  FROM b WHERE k8s_namespace IS NOT NULL GROUP BY ALL"""


@query("q14_k8s_namespaces", f"""
WITH n AS ({K8S_NS})
SELECT *, round(total_cost / {DAYS}, 6) AS daily_cost, round(total_cost / {DAYS} * 30, 4) AS monthly_cost FROM n""")
def _(t: Tables):
    return kubernetes.namespaces(t.staged, END, days=DAYS)


@query("q15_k8s_workloads", f"""
SELECT k8s_workload AS workload, k8s_namespace AS namespace, k8s_cluster AS cluster, '' AS workload_type,
  {S('effective_cost')} AS total_cost, sum(usage_quantity) AS cpu_hours, count(DISTINCT resource_id) AS pod_count
FROM b WHERE k8s_workload IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    return kubernetes.workloads(t.staged, END, days=DAYS)


@query("q16_k8s_nodes", f"""
SELECT k8s_node AS node, k8s_cluster AS cluster, resource_type AS instance_type, {S('effective_cost')} AS node_cost,
  {S('list_cost')} AS on_demand_cost, count(DISTINCT resource_id) AS pod_count
FROM b WHERE k8s_node IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    return kubernetes.nodes(t.staged, END, days=DAYS)


@query("q17_allocation", f"""
WITH w AS (SELECT k8s_workload AS name, k8s_cluster AS cluster, k8s_namespace AS namespace,
  sum(usage_quantity) AS "cpuCoreHours", {S('effective_cost')} AS "totalCost"
  FROM b WHERE k8s_workload IS NOT NULL GROUP BY ALL)
SELECT *, round("totalCost" * 0.6, 4) AS "cpuCost", round("totalCost" * 0.3, 4) AS "ramCost",
  round("totalCost" * 0.1, 4) AS "pvCost" FROM w""")
def _(t: Tables):
    return kubernetes.allocation(t.staged, END, window=f"{DAYS}d", aggregate="workload")


@query("q18_allocation_summary", f"""
WITH n AS ({K8S_NS})
SELECT round(sum(total_cost), 2) AS total_cost, count(*) AS namespace_count, '{DAYS}d' AS window, 'all' AS cluster,
  (SELECT string_agg(concat(namespace, '@', cluster), ',' ORDER BY total_cost DESC, namespace, cluster)
   FROM (SELECT * FROM n ORDER BY total_cost DESC, namespace, cluster LIMIT 5)) AS top_namespaces FROM n""")
def _(t: Tables):
    return kubernetes.allocation_summary(t.staged, END, window=f"{DAYS}d")


# ── Audit ─────────────────────────────────────────────────────────────────

AUDIT_CTE = """ae AS (SELECT printf('evt-%010d', event_id) AS event_id, event_type,
  concat('user-', user_id) AS actor_id, concat('res-', user_id % 40) AS resource_id,
  CASE WHEN user_id % 2 = 0 THEN 'aws' ELSE 'gcp' END AS provider,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, ts AS timestamp, props FROM events)"""


@query("q24_audit_query", f"""
WITH {AUDIT_CTE} SELECT event_id, event_type, actor_id, outcome, epoch_us(timestamp) AS at_us FROM ae
WHERE event_type = 'error' AND outcome = 'failure' ORDER BY timestamp DESC, event_id LIMIT 100 OFFSET 50""", billing=False)
def _(t: Tables):
    page = audit.audit_query(audit.audit_events(t.events), "error", outcome="failure", limit=100, offset=50)
    return page.select("event_id", "event_type", "actor_id", "outcome", F.unix_micros("timestamp").alias("at_us"))


@query("q24_audit_total", f"WITH {AUDIT_CTE} SELECT count(*) AS total FROM ae WHERE outcome = 'success'", billing=False)
def _(t: Tables):
    return audit.audit_total(audit.audit_events(t.events), outcome="success")


@query("q26_audit_history", f"""
WITH {AUDIT_CTE} SELECT resource_id, event_id, event_type, epoch_us(timestamp) AS at_us FROM ae
QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY timestamp DESC, event_id) <= 20""", billing=False)
def _(t: Tables):
    rows = audit.latest_per_resource(audit.audit_events(t.events), 20)
    return rows.select("resource_id", "event_id", "event_type", F.unix_micros("timestamp").alias("at_us"))


@query("q26_audit_history_one", f"""
WITH {AUDIT_CTE} SELECT event_id, event_type, epoch_us(timestamp) AS at_us FROM ae
WHERE resource_id = 'res-7' ORDER BY timestamp DESC, event_id LIMIT 100""", billing=False)
def _(t: Tables):
    rows = audit.audit_history(audit.audit_events(t.events), "res-7")
    return rows.select("event_id", "event_type", F.unix_micros("timestamp").alias("at_us"))


for _dest, _size in audit.LOG_BATCH.items():
    query(f"s15_audit_log_payloads_{_dest}", f"""
WITH {AUDIT_CTE} SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // {_size} AS batch_id,
  {"epoch(date_trunc('second', timestamp))::BIGINT" if _dest == "splunk" else "severity"} AS probe,
  event_type FROM ae""", billing=False)(lambda t, d=_dest: audit.audit_log_payloads(
        audit.audit_events(t.events), d).select(
        "event_id", "batch_id",
        (F.get_json_object("payload", "$.time").cast("bigint") if d == "splunk"
         else F.get_json_object("payload", "$.status")).alias("probe"),
        F.get_json_object(F.get_json_object("payload", "$.event" if d == "splunk" else "$.message"),
                          "$.event_type").alias("event_type")))


@query("s14_audit_cloudtrail", f"""
WITH {AUDIT_CTE} SELECT CAST(timestamp AS DATE) AS day, count(*) AS records, (count(*) + 6) // 7 AS documents,
  count(*) FILTER (outcome <> 'success') AS errors FROM ae GROUP BY ALL""", billing=False)
def _(t: Tables):
    path = run_dir(t.spark, "cloudtrail")
    exports.write_audit_cloudtrail(audit.audit_events(t.events), path, chunk=7)
    docs = t.spark.read.schema("Records array<struct<eventID:string,errorCode:string>>, year int, month int, day int").json(path)
    return docs.groupBy(F.make_date("year", "month", "day").alias("day")).agg(
        F.sum(F.size("Records")).alias("records"), F.count(F.lit(1)).alias("documents"),
        F.sum(F.size(F.filter("Records", lambda r: r["errorCode"].isNotNull()))).alias("errors"))


@query("s13_audit_jsonl", f"""
WITH {AUDIT_CTE} SELECT event_type, outcome, count(*) AS rows, count(DISTINCT event_id) AS ids,
  sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_sum FROM ae GROUP BY ALL""", billing=False)
def _(t: Tables):
    path = run_dir(t.spark, "audit-jsonl")
    events = audit.audit_events(t.events)
    exports.write_audit_jsonl(events.filter(F.col("outcome") == "failure"), path, compress=True)
    exports.write_audit_jsonl(events.filter(F.col("outcome") != "failure"), path, compress=True)
    back = t.spark.read.schema("event_id string, event_type string, outcome string, details map<string,string>").json(path)
    return back.groupBy("event_type", "outcome").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"),
        F.sum(F.col("details")["k"].cast("bigint")).alias("k_sum"))


# Approval requests derived from orders: the order date is the request date.
ACTIONS_SQL = """SELECT concat('act-', CAST(o_orderkey AS VARCHAR(20))) AS action_id,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'rejected' END AS status,
  CASE o_custkey % 3 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' ELSE 'development' END AS environment,
  CASE o_custkey % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'right-size' WHEN 2 THEN 'delete' ELSE 'tag' END AS action_type,
  CASE o_custkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN o_custkey % 7 = 0 THEN 'approver' ELSE '' END AS approved_by,
  o_custkey % 7 = 0 AS approved,
  o_totalprice / 1000 AS projected_monthly_savings,
  CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS expires_at,
  CAST(o_orderdate + INTERVAL '2' DAY AS TIMESTAMP) AS executed_at
FROM {orders}"""
ACTIONS_CTE = "act AS (" + ACTIONS_SQL.format(orders="orders") + ")"


def actions(t: Tables):
    return t.spark.sql(ACTIONS_SQL, orders=t.table("orders"))


@query("q25_pending_approvals", f"""
WITH {ACTIONS_CTE} SELECT action_id, environment, CAST(created_at AS DATE) AS created,
  created_at + INTERVAL 7 DAY < TIMESTAMP '1998-01-01' AS expired FROM act
WHERE status = 'pending' AND environment = 'production'""", billing=False)
def _(t: Tables):
    return audit.pending_approvals(actions(t), "1998-01-01", "production").select(
        "action_id", "environment", F.to_date("created_at").alias("created"), "expired")


@query("r14_action_outcomes", f"""
WITH {ACTIONS_CTE} SELECT status, environment, status IN ('completed', 'failed', 'rolled_back', 'rejected') AS is_terminal,
  environment = 'production' AS requires_human_approval,
  status = 'completed' AND TIMESTAMP '1998-01-01' <= executed_at + INTERVAL 7 DAY AS rollback_available, count(*) AS rows
FROM act GROUP BY ALL""", billing=False)
def _(t: Tables):
    return audit.action_outcomes(actions(t), "1998-01-01").groupBy(
        "status", "environment", "is_terminal", "requires_human_approval", "rollback_available").agg(
        F.count(F.lit(1)).alias("rows"))


@query("a6_refresh_mart", f"""
SELECT charge_month, count(*) AS grains, {S('total_effective_cost')} AS cost, sum(resource_count) AS resources FROM
 (SELECT charge_month, provider_name, billing_account_id, billing_account_name, service_name, service_category, region_id,
  tag_team, tag_env, charge_date, billing_currency, sum(effective_cost) AS total_effective_cost,
  count(DISTINCT resource_id) AS resource_count FROM b GROUP BY ALL) GROUP BY charge_month""")
def _(t: Tables):
    """The mart made without one, up to mid-1998 and with days that are wrong or should be empty; then brought up to date."""
    path = run_dir(t.spark, "mart")
    early = t.staged.filter(F.col("charge_date") < "1998-06-15")
    odd = F.col("charge_date").isin([date(1996, 2, 3), date(1997, 5, 6)])
    other = t.staged.filter(F.col("charge_date") == "1999-01-01").withColumns({
        "charge_date": F.lit("1991-07-01").cast("date"), "charge_period_start": F.lit("1991-07-01").cast("timestamp"), "charge_month": F.lit(199107)})
    rollups.refresh_mart(early.filter(~odd).unionByName(other), path)
    rollups.refresh_mart(t.staged, path, lookback_days=3)
    rollups.refresh_mart(t.staged, path, days=[date(1996, 2, 3), date(1997, 5, 6), date(1991, 7, 1)])
    return t.spark.read.parquet(path).groupBy("charge_month").agg(
        F.count(F.lit(1)).alias("grains"), dollars(F.sum("total_effective_cost")).alias("cost"),
        F.sum("resource_count").alias("resources"))
