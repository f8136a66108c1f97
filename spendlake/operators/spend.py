"""Spend questions: overviews, breakdowns, trends, panels."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.columns import (
    as_date, bucket, day_of, days_before, local_table, present, share_pct, sum_dollars, tag,
)
from spendlake.operators.staging import filter_billing, month_range
from spendlake import schema


def at_midnight(day: date | str) -> Column:
    return F.lit(as_date(day)).cast("timestamp")


def recent(b: DataFrame, as_of: date | str, days: int) -> DataFrame:
    """Charges that begin and end inside the last ``days`` days."""
    start = days_before(as_of, days)
    tests = (F.col("charge_period_start") >= at_midnight(start)) & (F.col("charge_period_end") <= at_midnight(as_of))
    for test in month_range(b, start, as_of):
        tests = tests & test
    return b.filter(tests)


def recent_periods(b: DataFrame, as_of: date | str, days: int) -> DataFrame:
    """Charges whose billing period begins inside the last ``days`` days."""
    start = days_before(as_of, days)
    tests = F.col("billing_period_start") >= at_midnight(start)
    if "charge_month" in b.columns:
        # A charge may precede its invoice month, so prune a month generously.
        floor = (start.replace(day=1) - timedelta(days=1)).replace(day=1)
        tests = tests & (F.col("charge_month") >= floor.year * 100 + floor.month)
    return b.filter(tests)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key. The rank filter is applied before the shuffle too."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n).drop("_rank")


def cost_overview(b: DataFrame, start, end, provider: str | None = None) -> DataFrame:
    eff, lst = F.sum("effective_cost"), F.sum("list_cost")
    return (
        filter_billing(b, start, end, provider)
        .groupBy("provider_name", "billing_account_id", "billing_account_name")
        .agg(
            sum_dollars("effective_cost").alias("total_effective_cost"),
            sum_dollars("list_cost").alias("total_list_cost"),
            sum_dollars("billed_cost").alias("total_billed_cost"),
            F.round(F.greatest((lst - eff).cast("double"), F.lit(0.0)), 4).alias("savings_amount"),
            share_pct(lst - eff, lst).alias("savings_pct"),
        )
        .orderBy(F.desc("total_effective_cost"), "provider_name", "billing_account_id")
    )


def cost_by_service(b: DataFrame, start, end, provider=None, service=None,
                    granularity: str = "daily", limit: int = 500) -> DataFrame:
    return (
        filter_billing(b, start, end, provider, services=service)
        .groupBy(bucket(granularity, "charge_period_start").alias("charge_date"),
                 "provider_name", "service_name", "service_category", "region_id")
        .agg(sum_dollars("effective_cost").alias("effective_cost"))
        .orderBy(F.desc("charge_date"), F.desc("effective_cost"),
                 "provider_name", "service_name", "service_category", "region_id")
        .limit(limit)
    )


def cost_by_team(b: DataFrame, start, end, provider=None, limit: int = 1000) -> DataFrame:
    return (
        filter_billing(b, start, end, provider)
        .filter(tag("team") != "")
        .groupBy(
            tag("team").alias("team_tag"),
            F.coalesce(F.nullif(tag("env"), F.lit("")), F.lit("untagged")).alias("env_tag"),
            "provider_name", day_of("charge_period_start").alias("charge_date"))
        .agg(sum_dollars("effective_cost").alias("effective_cost"))
        .orderBy(F.desc("effective_cost"), "team_tag", "env_tag", "provider_name", "charge_date")
        .limit(limit)
    )


def top_services(b: DataFrame, start, end, provider=None, n: int = 10) -> DataFrame:
    eff, lst = F.sum("effective_cost"), F.sum("list_cost")
    return (
        filter_billing(b, start, end, provider)
        .groupBy("provider_name", "service_name", "service_category")
        .agg(
            sum_dollars("effective_cost").alias("total_cost"),
            sum_dollars("list_cost").alias("list_cost"),
            F.count_distinct("resource_id").alias("resource_count"),
            share_pct(F.greatest(lst - eff, F.lit(0).cast("decimal(18,6)")), lst).alias("waste_pct"),
        )
        .orderBy(F.desc("total_cost"), "provider_name", "service_name", "service_category")
        .limit(n)
    )


def overview_by_service(b: DataFrame, start=None, end=None, provider=None) -> DataFrame:
    """Per provider, account and service, with a grand total row (``is_total`` = 1)."""
    rows = filter_billing(b, providers=provider)
    for test in month_range(b, start, end, 1):
        rows = rows.filter(test)
    if start is not None:
        rows = rows.filter(F.col("billing_period_start") >= at_midnight(start))
    if end is not None:
        rows = rows.filter(F.col("billing_period_end") <= at_midnight(end))
    keys = [F.col(c) for c in ("provider_name", "billing_account_id", "service_name")]
    return rows.groupingSets([keys, []], *keys).agg(
        F.grouping("provider_name").cast("int").alias("is_total"),
        sum_dollars("effective_cost").alias("total_cost"),
        F.round(F.coalesce(F.sum(F.col("list_cost") - F.col("effective_cost")), F.lit(0)).cast("double"), 4)
        .alias("total_savings"),
        F.sum("usage_quantity").alias("total_usage"),
        F.count(F.lit(1)).alias("record_count"),
    )


def daily_trend(rollup: DataFrame, as_of, days: int = 30, provider=None) -> DataFrame:
    """Day by provider from the daily rollup rather than from the billing table."""
    return (
        filter_billing(rollup, providers=provider)
        .filter(F.col("day") >= F.lit(days_before(as_of, days)))
        .groupBy("day", "provider_name")
        .agg(sum_dollars("total_effective_cost").alias("cost"), F.sum("total_usage_quantity").alias("usage"))
        .orderBy("day", "provider_name")
    )


def top_services_rollup(rollup: DataFrame, as_of, days: int = 30, provider=None, limit: int = 10) -> DataFrame:
    return (
        filter_billing(rollup, providers=provider)
        .filter(F.col("day") >= F.lit(days_before(as_of, days)))
        .groupBy("service_name")
        .agg(sum_dollars("total_effective_cost").alias("total_cost"),
             sum_dollars("total_list_cost").alias("total_list_cost"))
        .orderBy(F.desc("total_cost"), "service_name")
        .limit(limit)
    )


def cost_by_tag(b: DataFrame, key: str, start=None, end=None, provider=None) -> DataFrame:
    """Cost per value of any tag; untagged charges are left out."""
    return (
        filter_billing(b, start, end, provider)
        .filter(tag(key) != "")
        .groupBy(tag(key).alias("tag_value"))
        .agg(sum_dollars("effective_cost").alias("total_cost"), F.count(F.lit(1)).alias("record_count"))
        .orderBy(F.desc("total_cost"), "tag_value")
    )


def provider_spend(b: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Totals per provider; a provider without charges gets a row of zeros."""
    totals = (
        recent(b, as_of, days).groupBy("provider_name").agg(
            sum_dollars("effective_cost").alias("total_cost"),
            F.round(F.sum(F.col("list_cost") - F.col("effective_cost")).cast("double"), 4).alias("total_savings"),
            F.count(F.lit(1)).alias("record_count"),
            F.count_distinct("service_name").alias("service_count"),
        )
    )
    providers = local_table(b.sparkSession, ["provider_name"], [(p,) for p in schema.PROVIDERS])
    return (
        providers.join(totals, "provider_name", "left")
        .na.fill(0.0, ["total_cost", "total_savings"]).na.fill(0, ["record_count", "service_count"])
        .withColumns({"period_days": F.lit(days), "currency": F.lit("USD")})
    )


def service_breakdown(b: DataFrame, as_of, days: int = 30, limit: int = 20) -> DataFrame:
    """The ``limit`` dearest services of each provider."""
    per_service = (
        recent(b, as_of, days).groupBy("provider_name", "service_name").agg(
            sum_dollars("effective_cost").alias("cost"),
            F.round(F.sum("usage_quantity"), 4).alias("usage"),
            F.count(F.lit(1)).alias("records"),
        )
    )
    return top_per(per_service, ["provider_name"], [F.desc("cost"), F.asc("service_name")], limit)


def provider_daily_trend(b: DataFrame, as_of, days: int = 30) -> DataFrame:
    return (
        recent(b, as_of, days)
        .groupBy("provider_name", day_of("charge_period_start").alias("date"))
        .agg(sum_dollars("effective_cost").alias("cost"))
        .orderBy("provider_name", "date")
    )


def cost_by_region(b: DataFrame, as_of, days: int = 30) -> DataFrame:
    return (
        recent(b, as_of, days).groupBy("provider_name", F.col("region_id").alias("region"))
        .agg(sum_dollars("effective_cost").alias("cost"), F.count(F.lit(1)).alias("records"))
        .orderBy("provider_name", F.desc("cost"), "region")
    )


def high_cost_resources(b: DataFrame, as_of, provider=None, min_cost: float = 10.0,
                        service=None, region=None, days: int = 30, limit: int = 100) -> DataFrame:
    return (
        filter_billing(recent_periods(b, as_of, days), providers=provider, services=service, regions=region)
        .groupBy("resource_id", "resource_name", "service_name", "region_id")
        .agg(sum_dollars("effective_cost").alias("monthly_cost"), F.sum("usage_quantity").alias("monthly_usage"))
        .filter(F.col("monthly_cost") >= min_cost)
        .orderBy(F.desc("monthly_cost"), "resource_id", "resource_name", "service_name", "region_id")
        .limit(limit)
    )


# ── Dashboard panels ──────────────────────────────────────────────────────

def panel_timeseries(b: DataFrame, start, end, metric: str = "cost.total", provider=None, service=None,
                     region=None, granularity: str = "daily", at: str = "charge_period_start") -> DataFrame:
    """One value per time bucket, with the bucket as epoch milliseconds.

    ``commitment.coverage_pct`` plots the committed share; every other metric plots cost.
    """
    if metric == "commitment.coverage_pct":
        value = share_pct(F.sum(F.when(present("commitment_discount_id"), F.col("effective_cost"))
                                .otherwise(F.lit(0).cast("decimal(18,6)"))), F.sum("effective_cost"))
    else:
        value = sum_dollars("effective_cost")
    return (
        filter_billing(b, start, end, provider, services=service, regions=region, at=at)
        .groupBy(F.date_trunc({"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}[granularity],
                              F.col(at)).alias("bucket"))
        .agg(value.alias("value"))
        .select(F.unix_millis("bucket").alias("time"), "value", F.lit(metric).alias("metric"))
        .orderBy("time")
    )


# Dimensions a table panel may group by.
PANEL_DIMENSIONS = ["service_name", "provider_name", "region_id", "billing_account_id", "resource_type"]


def panel_table(b: DataFrame, start, end, group_by: str = "service_name", limit: int = 50,
                at: str = "charge_period_start") -> DataFrame:
    dimension = "provider_name" if group_by == "provider" else group_by
    if dimension not in PANEL_DIMENSIONS:
        dimension = "service_name"
    return (
        filter_billing(b, start, end, at=at)
        .groupBy(F.col(dimension).alias("dimension"))
        .agg(sum_dollars("effective_cost").alias("total_cost"), sum_dollars("list_cost").alias("list_cost"),
             F.count(F.lit(1)).alias("row_count"))
        .orderBy(F.desc("total_cost"), "dimension")
        .limit(limit)
    )


# Title and text of an annotation.
SPIKE_TITLE = "Cost spike: %s"
SPIKE_TEXT = "Provider: %s\nEffective: $%.2f\nDelta vs list: +$%.2f"


def spike_annotations(b: DataFrame, start, end, ratio: float = 1.3, min_list: float = 100, limit: int = 100,
                      at: str = "billing_period_start") -> DataFrame:
    """Charges far above their list price, as chart annotations."""
    eff, lst = F.col("effective_cost").cast("double"), F.col("list_cost").cast("double")
    return (
        filter_billing(b, start, end, at=at)
        .filter((F.try_divide(eff, lst) > ratio) & (lst > min_list))
        .select(F.unix_millis(at).alias("time"), "service_name", "provider_name",
                "charge_description", eff.alias("effective_cost"), F.round(eff - lst, 4).alias("delta"))
        .orderBy(F.desc("effective_cost"), "charge_description", "time")
        .limit(limit)
        .select(
            "time",
            F.format_string(SPIKE_TITLE, F.coalesce("service_name", F.lit("Unknown"))).alias("title"),
            F.format_string(SPIKE_TEXT, "provider_name", "effective_cost", "delta").alias("text"),
            F.concat_ws(",", F.lit("anomaly"), "provider_name", "service_name").alias("tags"),
            "charge_description", "effective_cost", "delta",
        )
    )


def daily_cost_points(b: DataFrame, day, providers=None, limit: int = 1000) -> DataFrame:
    """Cost per provider, service, region and account on one billing day."""
    return (
        filter_billing(b, day, day, providers, at="billing_period_start")
        .groupBy("provider_name", "service_name", "region_id", "billing_account_id")
        .agg(sum_dollars("effective_cost").alias("total_cost"))
        .filter(F.col("total_cost") > 0)
        .orderBy(F.desc("total_cost"), "provider_name", "service_name", "region_id", "billing_account_id")
        .limit(limit)
    )


def rolling_month(b: DataFrame) -> DataFrame:
    """Daily cost per provider with its 30-day rolling sum.

    The window runs over daily sums, so its partitions hold one row per day.
    """
    return _rolling(b.groupBy("provider_name", day_of("charge_period_start").alias("day")).agg(F.sum("effective_cost").alias("cost")))


def _rolling(daily: DataFrame) -> DataFrame:
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    last30 = Window.partitionBy("provider_name").orderBy(number).rangeBetween(-29, 0)
    return daily.select(
        "provider_name", "day", F.round(F.col("cost").cast("double"), 4).alias("cost"),
        F.round(F.sum("cost").over(last30).cast("double"), 4).alias("rolling_30d"))


def daily_total(b: DataFrame) -> DataFrame:
    return b.groupBy(day_of("charge_period_start").alias("day")).agg(sum_dollars("effective_cost").alias("cost"))


def savings_by_agent(insights: DataFrame) -> DataFrame:
    return (
        insights.filter(F.col("projected_monthly_savings") > 0).groupBy("agent")
        .agg(F.round(F.sum("projected_monthly_savings"), 2).alias("savings"), F.count(F.lit(1)).alias("insights"))
        .orderBy(F.desc("savings"), "agent")
    )


def dashboard_widgets(daily: DataFrame, top: int = 10, start=None, end=None) -> DataFrame:
    """The dashboard's widgets in one long table: (widget, series, day, value), from the daily rollup (``rollups.daily_costs_ext``).

    With a range, only its days are used, and those that the first days' rolling sums look back to.
    """
    def within(rows: DataFrame, first, last) -> DataFrame:
        tests = ([F.col("day") >= F.lit(first)] if first is not None else []) + ([F.col("day") <= F.lit(last)] if last is not None else [])
        return rows.filter(reduce(lambda x, y: x & y, tests)) if tests else rows

    first, last = (None if d is None else as_date(d) for d in (start, end))
    looked = within(daily, None if first is None else first - timedelta(days=29), last)
    rolling = within(_rolling(looked.groupBy("provider_name", "day").agg(F.sum("total_effective_cost").alias("cost"))), first, last)
    monthly = rolling.select(F.lit("monthly_cost").alias("widget"), F.col("provider_name").alias("series"),
                             "day", F.col("rolling_30d").alias("value"))
    lines = rolling.select(F.lit("provider_line").alias("widget"), F.col("provider_name").alias("series"),
                           "day", F.col("cost").alias("value"))
    toplist = (
        within(daily, first, last).groupBy("service_name").agg(sum_dollars("total_effective_cost").alias("value"))
        .orderBy(F.desc("value"), "service_name").limit(top)
        .select(F.lit("top_services").alias("widget"), F.col("service_name").alias("series"),
                F.lit(None).cast("date").alias("day"), "value")
    )
    return monthly.unionByName(lines).unionByName(toplist)
