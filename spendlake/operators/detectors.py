"""Cost detectors. Each returns rows of the common insight layout, or the figures behind them.

Providers are a group key: one plan serves all three, with no loop over them.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake import schema
from spendlake.functions.columns import absent, amount, dollars, maybe_in, present, share_pct, sum_dollars
from spendlake.operators.spend import (
    cost_by_region, provider_spend, recent, recent_periods, service_breakdown, top_per,
)

# Savings assumed per finding, and the limits that define one.
IDLE_SAVINGS = 0.80
COMMITMENT_SAVINGS = 0.35
HYBRID_SAVINGS = 0.40
CUD_SAVINGS = 0.30
COVERAGE_TARGET_PCT = 70
COVERAGE_SAVINGS = {"aws": 0.30, "azure": 0.25, "gcp": 0.25}
TAG_TARGET_PCT = 80
STOPPED_SAVINGS = 50.0
OLD_GENERATION_SAVINGS = 30.0

# Texts of insights; %s and %d stand for figures.
IDLE_FOUND = "Found %d potentially idle resources ($%s)"
IDLE_OTHERS = "%d potentially idle %s resources"
IDLE_ADVICE = {
    "aws": "Review and stop/terminate idle resources after confirmation",
    "azure": "Review idle VMs and disks, consider deallocation",
    "gcp": "Review and stop idle GCE instances",
}
IDLE_VM_TITLE = "Potentially idle EC2: %s"
IDLE_VM_TEXT = "EC2 %s in %s has low usage (%.2f hrs/day) but costs $%.2f/month."
GAP_TITLE = "Commitment gap: %s"
GAP_TEXT = "$%s/month on %s with no RIs/SPs. Potential 30-40%% savings."
HYBRID_TITLE = "AHUB opportunity: %s"
HYBRID_TEXT = "Azure VM %s costs $%s/month. Enable Azure Hybrid Benefit for ~40%% savings."
CUD_TITLE = "CUD gap: %s"
CUD_TEXT = "GCE %s in %s costs $%s/month with no CUD. 1-year CUD saves ~28-37%%."
COVERAGE_TITLE = {
    "aws": "Commitment coverage only ",
    "azure": "Azure reservation coverage: ",
    "gcp": "CUD coverage: ",
}
COVERAGE_ADVICE = {
    "aws": "Purchase Reserved Instances or Savings Plans for stable workloads",
    "azure": "Purchase Azure Reservations for stable VM workloads",
    "gcp": "Purchase 1-year or 3-year CUDs for stable workloads",
}
TAG_TITLE = {
    "aws": "Tag compliance: ",
    "azure": "Azure tag compliance: ",
    "gcp": "GCP label compliance: ",
}
TAG_ADVICE = {
    "aws": "Enforce tagging policy via AWS Organizations or OPA",
    "azure": "Enforce Azure Policy for mandatory tags",
    "gcp": "Enforce labels via Organization Policy",
}
VIOLATION_TITLE = "Tag violation: %s"
VIOLATION_TEXT = "Resource %s in account %s is missing tags: %s."
SPEND_TITLE = "%s Monthly Spend: $%s"
TOP_SERVICE_TITLE = "Top %s Service: %s ($%s)"
REGIONS_TITLE = "Resources spread across %d regions"
STOPPED_TITLE = "%d stopped EC2 instances may incur storage charges"
STOPPED_ADVICE = "Snapshot and terminate stopped instances after validation"
OLD_TITLE = "%d EC2 instances using older generation types"
OLD_ADVICE = "Plan migration to current generation instance families"
ADVISOR_TITLE = "Azure Advisor: %s"
RECOMMENDER_TITLE = "GCP Recommender: %s"

# How a provider is named in texts.
PROVIDER_LABELS = {"aws": "AWS", "azure": "Azure", "gcp": "GCP"}


def _per_provider(values: dict[str, object], provider: str = "provider") -> Column:
    col = None
    for name, value in values.items():
        test = F.col(provider) == name
        value = value if isinstance(value, Column) else F.lit(value)
        col = F.when(test, value) if col is None else col.when(test, value)
    return col


def provider_label(provider: str = "provider") -> Column:
    return F.coalesce(_per_provider(PROVIDER_LABELS, provider), F.col(provider))


ID_PARTS = ["agent", "provider", "category", "title", "resource_ids", "service_name", "region"]


def insight_id(columns: dict[str, Column] | None = None) -> Column:
    """An id from what the insight is about, so that a rerun finds the same one."""
    columns = columns if columns is not None else {p: F.col(p) for p in ID_PARTS}

    def text(part: str) -> Column:
        if part not in columns:
            return F.lit("")
        return F.concat_ws(",", columns[part]) if part == "resource_ids" else F.coalesce(
            columns[part].cast("string"), F.lit(""))

    parts = [text(p) for p in ID_PARTS]
    return F.sha2(F.concat_ws("|", *parts), 256)


def as_insights(df: DataFrame, **values: Column | str | float | bool) -> DataFrame:
    """Rows in the insight layout; keyword values are columns or literals.

    All of it is one projection, so that a top-k below stays a top-k in the plan.
    """
    columns = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    columns.setdefault("status", F.lit("open"))
    columns.setdefault("projected_monthly_savings", F.lit(0.0))
    columns["projected_annual_savings"] = columns["projected_monthly_savings"] * 12
    columns["insight_id"] = insight_id(columns)
    return df.select(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.INSIGHT_SCHEMA.fields
    ])


def _limited(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


# ── Idle resources ────────────────────────────────────────────────────────

def idle_resources(b: DataFrame, as_of, min_cost: float = 10.0, max_usage: float = 1.0,
                   days: int = 14, limit: int | None = None) -> DataFrame:
    """Resources that cost something and do next to nothing; the dearest per provider."""
    rows = (
        recent(b, as_of, days)
        .groupBy(F.col("provider_name").alias("provider"), "resource_id", "service_name",
                 F.col("region_id").alias("region"))
        .agg(
            sum_dollars("effective_cost").alias("total_cost"),
            F.round(F.sum("usage_quantity"), 4).alias("total_usage"),
            F.count(F.lit(1)).alias("billing_days"),
        )
        .filter((F.col("total_cost") >= min_cost) & (F.col("total_usage") < max_usage))
    )
    if limit is None:
        return rows
    return top_per(rows, ["provider"], [F.desc("total_cost"), F.asc_nulls_last("resource_id"),
                                        F.asc("service_name"), F.asc("region")], limit)


def idle_insights(idle: DataFrame) -> DataFrame:
    """One insight per provider over its idle resources."""
    totals = idle.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("total_cost"), 4).alias("cost"))
    cost = F.col("cost")
    return as_insights(
        totals,
        agent=F.concat("provider", F.lit("_cost_agent")), provider=F.col("provider"),
        category="idle_resource", severity="medium",
        title=F.when(F.col("provider") == "aws", F.format_string(IDLE_FOUND, "n", amount(cost)))
        .otherwise(F.format_string(IDLE_OTHERS, "n", provider_label())),
        description=F.format_string("In this window $%s went to %d resources that did next to nothing.", amount(cost), "n"),
        current_monthly_cost=cost, projected_monthly_savings=cost * IDLE_SAVINGS,
        confidence_score=0.75, risk_level="medium", action_required=True,
        recommendation=_per_provider(IDLE_ADVICE),
        action_type="stop",
    )


def _vm_resources(b: DataFrame, provider: str, as_of, days: int) -> DataFrame:
    return recent_periods(b, as_of, days).filter(
        (F.col("provider_name") == provider) & (F.col("service_name") == "Virtual Machine"))




def _dearest(df: DataFrame, limit: int | None) -> DataFrame:
    return _limited(df, [F.desc("monthly_cost"), F.asc_nulls_last("resource_id"),
                         F.asc("resource_name"), F.asc("region_id")], limit)


def idle_vms(b: DataFrame, as_of, min_cost: float = 50, max_usage: float = 2, max_deviation: float = 1,
             days: int = 30, limit: int | None = 20) -> DataFrame:
    """Virtual machines with a low and steady usage."""
    rows = _vm_resources(b, "aws", as_of, days).groupBy("resource_id", "resource_name", "region_id").agg(
        sum_dollars("effective_cost").alias("monthly_cost"),
        F.avg("usage_quantity").alias("avg_usage"),
        F.stddev_pop("usage_quantity").alias("usage_deviation"),
    ).filter((F.col("monthly_cost") > min_cost) & (F.col("avg_usage") < max_usage)
             & (F.col("usage_deviation") < max_deviation))
    cost = F.col("monthly_cost")
    return as_insights(
        _dearest(rows, limit),
        agent="aws_cost_agent", provider="aws", category="idle_resource", severity="high",
        title=F.format_string(IDLE_VM_TITLE, F.coalesce("resource_id", F.lit("unknown"))),
        description=F.format_string(IDLE_VM_TEXT, "resource_name", "region_id", "avg_usage", "monthly_cost"),
        resource_ids=F.array(F.coalesce("resource_id", F.lit(""))), service_name="Virtual Machine",
        region=F.col("region_id"), current_monthly_cost=cost,
        projected_monthly_savings=F.round(cost * IDLE_SAVINGS, 4), confidence_score=0.75,
        recommendation=F.format_string(
            "Worth up to $%s a month: switch the machine off once its owner agrees, or give it a smaller size.", amount(cost * IDLE_SAVINGS, 0)),
        action_type="stop", risk_level="low", action_required=True,
    )


# ── Commitments ───────────────────────────────────────────────────────────

def aws_commitment_gap(b: DataFrame, as_of, min_cost: float = 500, days: int = 30) -> DataFrame:
    """Steady services that run without any commitment."""
    rows = (
        recent_periods(b, as_of, days)
        .filter((F.col("provider_name") == "aws") & absent("commitment_discount_id")
                & F.col("service_name").isin("Virtual Machine", "Relational Database"))
        .groupBy("service_name").agg(sum_dollars("effective_cost").alias("monthly_cost"))
        .filter(F.col("monthly_cost") > min_cost)
    )
    cost = F.col("monthly_cost")
    return as_insights(
        rows,
        agent="aws_cost_agent", provider="aws", category="commitment_gap", severity="medium",
        title=F.format_string(GAP_TITLE, "service_name"),
        description=F.format_string(GAP_TEXT, amount(cost), "service_name"),
        service_name=F.col("service_name"), current_monthly_cost=cost,
        projected_monthly_savings=F.round(cost * COMMITMENT_SAVINGS, 4), confidence_score=0.85,
        recommendation=F.format_string(
            "Commit to the share of %s that never stops; about $%s a month.", "service_name", amount(cost * COMMITMENT_SAVINGS, 0)),
        action_type="purchase-commitment", risk_level="low", action_required=True,
    )


def _vm_savings(b: DataFrame, as_of, provider: str, min_cost: float, days: int, limit: int | None,
                uncommitted: bool = False) -> DataFrame:
    rows = _vm_resources(b, provider, as_of, days)
    if uncommitted:
        rows = rows.filter(absent("commitment_discount_id"))
    per_resource = rows.groupBy("resource_id", "resource_name", "region_id").agg(
        sum_dollars("effective_cost").alias("monthly_cost")).filter(F.col("monthly_cost") > min_cost)
    return _dearest(per_resource, limit)


def azure_hybrid_benefit(b: DataFrame, as_of, min_cost: float = 100, days: int = 30,
                         limit: int | None = 20) -> DataFrame:
    cost = F.col("monthly_cost")
    return as_insights(
        _vm_savings(b, as_of, "azure", min_cost, days, limit),
        agent="azure_cost_agent", provider="azure", category="right_size", severity="medium",
        title=F.format_string(HYBRID_TITLE, F.coalesce("resource_name", F.lit("unknown"))),
        description=F.format_string(HYBRID_TEXT, "resource_name", amount(cost)),
        resource_ids=F.array(F.coalesce("resource_id", F.lit(""))), service_name="Virtual Machine",
        region=F.col("region_id"), current_monthly_cost=cost,
        projected_monthly_savings=F.round(cost * HYBRID_SAVINGS, 4), confidence_score=0.80,
        recommendation=F.format_string("Report licences already paid for; about $%s a month.", amount(cost * HYBRID_SAVINGS, 0)),
        action_type="right-size", risk_level="low", action_required=True,
    )


def gcp_cud_gap(b: DataFrame, as_of, min_cost: float = 200, days: int = 30, limit: int | None = 20) -> DataFrame:
    cost = F.col("monthly_cost")
    return as_insights(
        _vm_savings(b, as_of, "gcp", min_cost, days, limit, uncommitted=True),
        agent="gcp_cost_agent", provider="gcp", category="commitment_gap", severity="medium",
        title=F.format_string(CUD_TITLE, F.coalesce("resource_name", F.lit("unknown"))),
        description=F.format_string(CUD_TEXT, "resource_name", "region_id", amount(cost)),
        resource_ids=F.array(F.coalesce("resource_id", F.lit(""))), service_name="Virtual Machine",
        region=F.col("region_id"), current_monthly_cost=cost,
        projected_monthly_savings=F.round(cost * CUD_SAVINGS, 4), confidence_score=0.82,
        recommendation=F.format_string("Commit for a year if the machine is to stay; about $%s a month.", amount(cost * CUD_SAVINGS, 0)),
        action_type="purchase-commitment", risk_level="low", action_required=True,
    )


def commitment_coverage(b: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Committed share of the cost, and what could still be committed below 70 %."""
    eff, lst = F.sum("effective_cost"), F.sum("list_cost")
    committed = F.sum(F.when(present("commitment_discount_id"), F.col("effective_cost"))
                      .otherwise(F.lit(0).cast("decimal(18,6)")))
    pct = share_pct(committed, eff, 12)
    return recent(b, as_of, days).groupBy(F.col("provider_name").alias("provider")).agg(
        dollars(eff).alias("total_effective_cost"),
        dollars(lst).alias("total_list_cost"),
        dollars(committed).alias("committed_cost"),
        F.count_if(present("commitment_discount_id")).alias("committed_records"),
        F.count(F.lit(1)).alias("total_records"),
        F.round(pct, 2).alias("commitment_coverage_pct"),
        share_pct(lst - eff, lst).alias("savings_rate_pct"),
        F.when(pct < COVERAGE_TARGET_PCT, dollars(eff - committed)).otherwise(F.lit(0.0)).alias("opportunity"),
    )


def coverage_insights(coverage: DataFrame) -> DataFrame:
    low = coverage.filter(F.col("commitment_coverage_pct") < COVERAGE_TARGET_PCT)
    pct = amount("commitment_coverage_pct", 1)
    return as_insights(
        low,
        agent=F.concat("provider", F.lit("_cost_agent")), provider=F.col("provider"),
        category="commitment_gap", severity="medium",
        title=F.concat(_per_provider(COVERAGE_TITLE), pct, F.lit("%")),
        description=F.concat(F.lit("$"), amount("opportunity"), F.lit(" could still be committed beyond "), pct, F.lit("% of the cost.")),
        current_monthly_cost=F.col("total_effective_cost"),
        projected_monthly_savings=F.round(F.col("opportunity") * _per_provider(COVERAGE_SAVINGS), 4),
        confidence_score=0.8, risk_level="low", action_required=True,
        recommendation=_per_provider(COVERAGE_ADVICE),
        action_type="purchase-commitment", coverage_pct=F.col("commitment_coverage_pct"),
    )


# ── Tags ──────────────────────────────────────────────────────────────────

def tag_coverage(b: DataFrame, as_of, days: int = 30) -> DataFrame:
    total = F.count(F.lit(1))

    def share(key: str) -> Column:
        return share_pct(F.count_if(F.map_contains_key("tags", F.lit(key))), total)

    return recent(b, as_of, days).groupBy(F.col("provider_name").alias("provider")).agg(
        total.alias("total_records"),
        share("team").alias("team_tag_coverage_pct"),
        share("environment").alias("env_tag_coverage_pct"),
        share("owner").alias("owner_tag_coverage_pct"),
        F.count_if(F.coalesce(F.size("tags"), F.lit(0)) == 0).alias("untagged_records"),
        dollars(F.sum(F.when(F.coalesce(F.size("tags"), F.lit(0)) == 0, F.col("effective_cost"))
                      .otherwise(F.lit(0).cast("decimal(18,6)")))).alias("untagged_cost"),
    )


def tag_coverage_insights(coverage: DataFrame) -> DataFrame:
    pct = amount("team_tag_coverage_pct", 1)
    return as_insights(
        coverage.filter(F.col("team_tag_coverage_pct") < TAG_TARGET_PCT),
        agent=F.concat("provider", F.lit("_cost_agent")), provider=F.col("provider"),
        category="tag_compliance", severity="low",
        title=F.concat(_per_provider(TAG_TITLE), pct,
                       F.when(F.col("provider") == "aws", "% have team tags").otherwise("%")),
        description=F.format_string("%d charges without any tag come to $%s.", "untagged_records", amount("untagged_cost")),
        confidence_score=0.85, risk_level="low", action_required=True,
        recommendation=_per_provider(TAG_ADVICE),
        action_type="tag", coverage_pct=F.col("team_tag_coverage_pct"),
    )


def violation_severity(number: Column) -> Column:
    return (
        F.when(number == 0, "none").when(number <= 2, "low").when(number <= 5, "medium").otherwise("high")
    )


def tag_violations(b: DataFrame, as_of, days: int = 30, min_cost: float = 1.0,
                   limit: int | None = None) -> DataFrame:
    """Resources that miss required tags or carry a bad environment value."""
    resources = (
        recent_periods(b, as_of, days).filter(present("resource_id"))
        .groupBy("provider_name", "billing_account_id", "resource_id", "resource_type", "tags")
        .agg(sum_dollars("effective_cost").alias("monthly_cost"))
        .filter(F.col("monthly_cost") > min_cost)
    )
    tie = [F.desc("monthly_cost"), F.asc("provider_name"), F.asc("billing_account_id"),
           F.asc("resource_id"), F.asc("resource_type"), F.asc(F.to_json("tags"))]
    lowered = F.transform_keys("tags", lambda k, v: F.lower(k))
    required = F.array(*[F.lit(t) for t in schema.REQUIRED_TAGS])
    environment = F.coalesce(F.col("t")["environment"], F.lit(""))
    return (
        _limited(resources, tie, limit)
        .withColumn("t", lowered)
        .withColumns({
            "missing_tags": F.filter(required, lambda k: F.coalesce(F.col("t")[k], F.lit("")) == ""),
            "bad_environment": F.when((environment != "") & ~environment.isin(schema.ENVIRONMENT_VALUES), environment),
        })
        .drop("t")
        # Tied to the aggregate, so that this test is not pushed below it and run per charge.
        .withColumn("violations", F.when(
            F.col("monthly_cost") > min_cost,
            F.size("missing_tags") + F.col("bad_environment").isNotNull().cast("int")))
        .filter(F.col("violations") > 0)
        .withColumn("severity", violation_severity(F.col("violations")))
    )


def violation_insights(violations: DataFrame) -> DataFrame:
    missing = F.when(F.size("missing_tags") > 0, F.concat_ws(", ", "missing_tags")).otherwise("none")
    return as_insights(
        violations,
        agent="tagging_agent", provider=F.col("provider_name"), category="tag_compliance",
        severity=F.when(F.col("severity") == "none", "info").otherwise(F.col("severity")),
        title=F.format_string(VIOLATION_TITLE, "resource_id"),
        description=F.format_string(VIOLATION_TEXT, "resource_id", "billing_account_id", missing),
        resource_ids=F.array("resource_id"), service_name=F.col("resource_type"),
        current_monthly_cost=F.col("monthly_cost"), projected_monthly_savings=0.0, confidence_score=0.95,
        recommendation=F.concat(F.lit("Apply tags: "), F.concat_ws(", ", "missing_tags"), F.lit(".")),
        action_type="tag", risk_level="low", action_required=True,
    )


def dear_resources(b: DataFrame, as_of, days: int, min_cost: float) -> DataFrame:
    """The charges of resources that may cost more than ``min_cost`` under one set of tags: their whole cost, credits left out, does.

    Nearly every charge is a group of its own in ``tag_violations``. Here a group is a hash and a sum; with its names and tags it moves
    only if it can be a finding. Reads ``b`` twice.
    """
    window = recent_periods(b, as_of, days).filter(present("resource_id"))
    key = F.xxhash64("provider_name", "billing_account_id", "resource_id", "resource_type")
    costs = F.sum(F.greatest("effective_cost", F.lit(0).cast("decimal(18,6)")))
    # A cost is rounded to four places before it is compared.
    dear = window.groupBy(key.alias("_key")).agg(costs.alias("_cost")).filter(F.col("_cost").cast("double") > min_cost - 0.001)
    return maybe_in(window, key, dear.select("_key"))


def tag_compliance_report(violations: DataFrame) -> DataFrame:
    """One row: number, cost at risk and how many of each severity."""
    return violations.agg(
        F.count(F.lit(1)).alias("total_violations"),
        F.round(F.coalesce(F.sum("monthly_cost"), F.lit(0.0)), 2).alias("total_cost_at_risk"),
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in ("none", "low", "medium", "high")],
    )


def worst_violations(violations: DataFrame, n: int = 20) -> DataFrame:
    return violations.orderBy(
        F.desc("monthly_cost"), "provider_name", "billing_account_id", "resource_id", F.to_json("tags")
    ).limit(n).select("resource_id", F.concat_ws(",", "missing_tags").alias("missing_tags"),
                      "monthly_cost", "severity")


# ── General insights ──────────────────────────────────────────────────────

def spend_insights(b: DataFrame, as_of, days: int = 30, many_regions: int = 3) -> DataFrame:
    """Spend headline and top service per provider, and a note on wide regional spread."""
    spend = provider_spend(b, as_of, days).filter(F.col("record_count") > 0).withColumnRenamed(
        "provider_name", "provider")
    agent = F.concat("provider", F.lit("_cost_agent"))
    common = {"agent": agent, "provider": F.col("provider"), "category": "general", "severity": "info",
              "risk_level": "low", "action_type": "report", "action_required": False}
    headline = as_insights(
        spend, **common,
        title=F.format_string(SPEND_TITLE, provider_label(), amount("total_cost")),
        description=F.concat(provider_label(), F.lit(f" spend for last {days} days: $"), amount("total_cost"),
                             F.lit(" across "), F.col("service_count").cast("string"), F.lit(" services.")),
        current_monthly_cost=F.col("total_cost"), projected_monthly_savings=F.col("total_savings"),
        confidence_score=0.95)
    top = service_breakdown(b, as_of, days, 1).withColumnRenamed("provider_name", "provider")
    service = as_insights(
        top, **common,
        title=F.format_string(TOP_SERVICE_TITLE, provider_label(), "service_name", amount("cost")),
        description=F.concat(F.lit("Highest spend: "), F.col("service_name"), F.lit(" at $"), amount("cost")),
        service_name=F.col("service_name"), current_monthly_cost=F.col("cost"), confidence_score=0.9)
    spread = cost_by_region(b, as_of, days).groupBy(F.col("provider_name").alias("provider")).agg(
        F.count(F.lit(1)).alias("regions")).filter(F.col("regions") > many_regions)
    regional = as_insights(
        spread, **common,
        title=F.format_string(REGIONS_TITLE, "regions"),
        description=F.concat(F.lit("Costs distributed across "), F.col("regions").cast("string"), F.lit(" regions.")),
        confidence_score=0.9)
    return union_insights(headline, service, regional)


def inventory_insights(inventory: DataFrame) -> DataFrame:
    """Stopped and old-generation machines of the AWS inventory."""
    machines = inventory.filter(F.col("resource_type") == "ec2").agg(
        F.count_if(F.col("state") == "stopped").alias("stopped"),
        F.count_if(F.col("old_generation")).alias("old"),
        F.concat_ws(", ", F.array_sort(F.collect_set(F.when(F.col("old_generation"), F.col("instance_type"))))).alias("types"),
    )
    stopped, old = F.col("stopped"), F.col("old")
    common = {"agent": "aws_cost_agent", "provider": "aws", "action_required": True}
    halted = as_insights(
        machines.filter(stopped > 0), **common, category="idle_resource", severity="low",
        title=F.format_string(STOPPED_TITLE, stopped),
        description=F.format_string("%d machines are switched off and keep their disks.", stopped),
        projected_monthly_savings=stopped * STOPPED_SAVINGS, confidence_score=0.7, risk_level="low",
        recommendation=STOPPED_ADVICE, action_type="stop")
    outdated = as_insights(
        machines.filter(old > 0), **common, category="right_size", severity="medium",
        title=F.format_string(OLD_TITLE, old),
        description=F.format_string("%d machines are of a type that has a successor: %s.", old, "types"),
        projected_monthly_savings=old * OLD_GENERATION_SAVINGS, confidence_score=0.75, risk_level="medium",
        recommendation=OLD_ADVICE, action_type="right-size")
    return union_insights(halted, outdated)


def native_recommendations(recs: DataFrame, per_provider: int = 5) -> DataFrame:
    """The first advice rows of each provider as insights; unreadable savings count as 0."""
    first = top_per(recs, ["provider"], [F.asc("position"), F.asc("title")], per_provider)
    azure = F.col("provider") == "azure"
    return as_insights(
        first,
        agent=F.concat("provider", F.lit("_cost_agent")), provider=F.col("provider"),
        category=F.when(azure, "general").otherwise("idle_resource"), severity="low",
        title=F.when(azure, F.format_string(ADVISOR_TITLE, F.coalesce("title", F.lit("Recommendation"))))
        .otherwise(F.format_string(RECOMMENDER_TITLE, F.substring("description", 1, 80))),
        description=F.col("description"),
        projected_monthly_savings=F.when(azure, F.coalesce(F.col("potential_savings").try_cast("double"), F.lit(0.0)) / 12)
        .otherwise(F.coalesce(F.col("units").try_cast("double"), F.lit(0.0))),
        confidence_score=0.7, risk_level="low", action_required=True, action_type="investigate",
    )


def union_insights(*parts: DataFrame) -> DataFrame:
    """All detector outputs as one table."""
    both = schema.conform_insights(parts[0])
    for part in parts[1:]:
        both = both.unionByName(schema.conform_insights(part))
    return both


def resource_insights(b: DataFrame, as_of, days: int = 30, limit: int | None = None,
                      thresholds: dict[str, float] | None = None) -> DataFrame:
    """Every resource-level finding of the three providers and of the tag scan."""
    t = {"idle": 50, "gap": 500, "hybrid": 100, "cud": 200, "tag": 1.0, **(thresholds or {})}
    return union_insights(
        idle_vms(b, as_of, t["idle"], days=days, limit=limit),
        aws_commitment_gap(b, as_of, t["gap"], days=days),
        azure_hybrid_benefit(b, as_of, t["hybrid"], days=days, limit=limit),
        gcp_cud_gap(b, as_of, t["cud"], days=days, limit=limit),
        violation_insights(tag_violations(dear_resources(b, as_of, days, t["tag"]), as_of, days, t["tag"], limit=limit)),
    )


