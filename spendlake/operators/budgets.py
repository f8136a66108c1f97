"""Budgets against month-to-date, scoped and daily spend."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.columns import as_date, day_of, dollars, present, sum_dollars
from spendlake.operators.spend import recent_periods
from spendlake.operators.staging import filter_billing

# Utilisation at which an alert of each level starts.
LEVELS = {"breach": 1.00, "critical": 0.90, "warning": 0.75}
WARNING_SHARE = 0.8


def budget_alerts(b: DataFrame, budgets: DataFrame, as_of, levels: dict[str, float] | None = None) -> DataFrame:
    """Budgets per service (budget_name, monthly_limit) that the current month uses up."""
    levels = {**LEVELS, **(levels or {})}
    first = as_date(as_of).replace(day=1)
    following = (first + timedelta(days=32)).replace(day=1)
    spend = (
        recent_periods(b, first, 0)
        .filter(F.col("billing_period_start") < F.lit(following).cast("timestamp"))
        .groupBy(F.col("service_name").alias("budget_name"))
        .agg(F.sum("effective_cost").cast("double").alias("spend"))
    )
    joined = budgets.join(spend, "budget_name", "left").withColumn("spend", F.coalesce("spend", F.lit(0.0)))
    limit = F.col("monthly_limit").cast("double")
    ratio = F.when(limit > 0, F.try_divide(F.col("spend"), limit)).otherwise(F.lit(0.0))
    level = (
        F.when(ratio >= levels["breach"], "breach")
        .when(ratio >= levels["critical"], "critical")
        .when(ratio >= levels["warning"], "warning")
    )
    return joined.withColumn("alert_level", level).filter(F.col("alert_level").isNotNull()).select(
        "budget_name", limit.alias("monthly_limit"), F.round("spend", 2).alias("current_spend"),
        F.round(ratio * 100, 1).alias("utilization_percent"), "alert_level",
        F.round(F.greatest(F.lit(0.0), F.col("spend") - limit), 2).alias("projected_overrun"),
    )


def scoped_spend(b: DataFrame, as_of) -> DataFrame:
    """Spend per scope and period up to ``as_of``: (scope_type, scope_value, period_type, spend).

    Every charge of the running month or week counts for its account, its
    service, its team and each of its tags (``key=value``).
    """
    today = F.lit(as_date(as_of))
    week, month = F.date_trunc("week", today).cast("date"), F.trunc(today, "month")
    day = day_of("charge_period_start")
    first = min(as_date(as_of) - timedelta(days=as_date(as_of).weekday()), as_date(as_of).replace(day=1))
    running = filter_billing(b, first, as_of)

    def scope(kind: str, value):
        return F.struct(F.lit(kind).alias("scope_type"), value.alias("scope_value"))

    scopes = F.concat(
        F.array(scope("account", F.col("billing_account_id")), scope("service", F.col("service_name")),
                scope("team", F.coalesce(F.col("tags")["team"], F.lit("")))),
        F.transform(F.map_entries("tags"), lambda e: F.struct(
            F.lit("tag").alias("scope_type"), F.concat(e["key"], F.lit("="), e["value"]).alias("scope_value"))),
    )
    zero = F.lit(0).cast("decimal(18,6)")
    since = {"daily": today, "weekly": week, "monthly": month}
    return (
        running.select(day.alias("day"), "effective_cost", F.explode(scopes).alias("s"))
        .filter(present("s.scope_value"))
        .groupBy("s.scope_type", "s.scope_value")
        .agg(*[F.sum(F.when(F.col("day") >= first, F.col("effective_cost")).otherwise(zero)).alias(period)
               for period, first in since.items()])
        .selectExpr("scope_type", "scope_value",
                    "stack(3, 'daily', daily, 'weekly', weekly, 'monthly', monthly) AS (period_type, spend)")
    )


def scoped_budgets(b: DataFrame, budgets: DataFrame, as_of) -> DataFrame:
    """Thresholds reached by active budgets (name, scope, period, amount, thresholds)."""
    spend = scoped_spend(b, as_of)
    keys = ["scope_type", "scope_value", "period_type"]
    used = F.try_divide(F.col("spend").cast("double"), F.col("budget_amount").cast("double"))
    return (
        budgets.filter("is_active").join(spend, keys)
        .withColumn("threshold", F.explode("thresholds"))
        .withColumn("utilization", used)
        .filter(F.col("utilization") >= F.col("threshold"))
        .select("name", *keys, F.col("budget_amount").cast("double").alias("budget_amount"),
                dollars("spend").alias("spend"), "threshold",
                F.round(F.col("utilization") * 100, 2).alias("utilization_pct"))
    )


def monitor_thresholds(daily: DataFrame, budgets: DataFrame, start=None, end=None) -> DataFrame:
    """Days of the daily rollup (``rollups.daily_costs_ext``) whose cost passes a budget's daily share: critical above it, warning above 80 % of it.

    Budgets name a provider and a service; a NULL stands for all of them.
    """
    keys = [F.col("provider_name"), F.col("service_name")]
    for test in ([F.col("day") >= F.lit(as_date(start))] if start is not None else []) + (
            [F.col("day") <= F.lit(as_date(end))] if end is not None else []):
        daily = daily.filter(test)
    daily = (
        daily.groupingSets([["day", "provider_name", "service_name"], ["day", "provider_name"],
                       ["day", "service_name"], ["day"]], "day", *keys)
        .agg(
            F.when(F.grouping("provider_name") == 1, "*").otherwise(F.col("provider_name")).alias("provider"),
            F.when(F.grouping("service_name") == 1, "*").otherwise(F.col("service_name")).alias("service"),
            sum_dollars("total_effective_cost").alias("daily_cost"),
        )
        .select("day", "provider", "service", "daily_cost")
    )
    critical = F.col("monthly_threshold").cast("double") / 30
    wanted = budgets.select(
        "name", F.coalesce("provider", F.lit("*")).alias("provider"), F.coalesce("service", F.lit("*")).alias("service"),
        critical.alias("critical"), (critical * WARNING_SHARE).alias("warning"))
    return (
        wanted.join(daily, ["provider", "service"])
        .filter(F.col("daily_cost") > F.col("warning"))
        .select("name", "provider", "service", "day", "daily_cost",
                F.round("critical", 6).alias("critical"), F.round("warning", 6).alias("warning"),
                F.when(F.col("daily_cost") > F.col("critical"), "critical").otherwise("warning").alias("level"))
    )
