"""The analysis run: detectors over one scan, then ranking, policy and report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.columns import days_before
from spendlake.operators import detectors, recommend, series
from spendlake.operators.staging import month_range
from spendlake.session import run_dir

# What the resource-level detectors read.
DETECTOR_COLUMNS = [
    "provider_name", "billing_account_id", "resource_id", "resource_name", "resource_type", "region_id",
    "service_name", "billing_period_start", "charge_month", "effective_cost", "usage_quantity",
    "commitment_discount_id", "tags",
]

# What the other detectors read besides.
MORE_COLUMNS = ["charge_period_start", "charge_period_end", "list_cost", "savings_amount"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, and safe from lost executors."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def find_insights(b: DataFrame, as_of, days: int = 30, limit: int | None = None,
                  thresholds: dict[str, float] | None = None) -> DataFrame:
    """All resource-level insights. The detectors share one pruned copy of the window they look at, in files."""
    window = stored(detectors.recent_periods(b, as_of, days).select(*DETECTOR_COLUMNS), "insight-window")
    return stored(detectors.resource_insights(window, as_of, days, limit, thresholds), "insights")


def _charges_since(b: DataFrame, as_of, days: int) -> DataFrame:
    """What any detector reads of the last ``days`` days, in files: charges that begin in them, or whose billing period does."""
    start = days_before(as_of, days)
    midnight = F.lit(start).cast("timestamp")
    recent = b.filter((F.col("billing_period_start") >= midnight) | (F.col("charge_period_start") >= midnight))
    for test in month_range(b, start, None, slack=1):
        recent = recent.filter(test)
    return stored(recent.select(*DETECTOR_COLUMNS, *MORE_COLUMNS), "insight-charges")


def every_insight(b: DataFrame, as_of, days: int = 30, thresholds: dict[str, float] | None = None,
                  inventory: DataFrame | None = None, advice: DataFrame | None = None, plans: DataFrame | None = None,
                  idle_cost: float = 10.0, level: float = 0.95, horizon: int = 90, series_days: int = 180) -> DataFrame:
    """The findings of every detector as one table, none cut.

    Resource findings, idle resources, commitment and tag coverage, general spend, anomalies of the providers' daily cost,
    and, where their inputs are given, the inventory, the providers' own advice, and forecasts above ``plans`` (key, budget). The billing
    table is read once.
    """
    since = max(days, series_days)
    b = _charges_since(b, as_of, since)
    parts = [
        stored(detectors.resource_insights(b, as_of, days, None, thresholds), "insights"),
        detectors.idle_insights(detectors.idle_resources(b, as_of, idle_cost, days=days)),
        detectors.coverage_insights(detectors.commitment_coverage(b, as_of, days)),
        detectors.tag_coverage_insights(detectors.tag_coverage(b, as_of, days)),
        detectors.spend_insights(b, as_of, days),
        series.anomaly_insights(series.interval_anomalies(series.cost_series(b, "total", as_of, since), level), F.col("key")),
    ]
    if inventory is not None:
        parts.append(detectors.inventory_insights(inventory))
    if advice is not None:
        parts.append(detectors.native_recommendations(advice))
    if plans is not None:
        totals = series.forecast_totals(series.forecast(series.cost_series(b, "service", as_of, since), horizon, level))
        parts.append(series.breach_insights(series.forecast_breaches(totals, plans), horizon))
    return detectors.union_insights(*parts)


@dataclass
class Analysis:
    insights: DataFrame
    recommendations: DataFrame
    unified: DataFrame
    decisions: DataFrame
    summary: DataFrame
    report: DataFrame


def analyse(b: DataFrame, as_of, days: int = 30, thresholds: dict[str, float] | None = None, extra: list[DataFrame] | None = None,
            **inputs) -> Analysis:
    """The whole run over a staged billing table: every detector's findings are merged, ranked and checked.

    ``inputs`` go to ``every_insight`` (inventory, advice, plans, ...); ``extra`` adds insights of other detectors. An insight that is found
    twice, here and in ``extra``, counts once.
    """
    found = every_insight(b, as_of, days, thresholds, **inputs)
    if extra:
        found = detectors.union_insights(found, *extra).dropDuplicates(["insight_id"])
    unique = stored(recommend.dedup_insights(found), "unique-insights")
    recs = recommend.prioritise(recommend.recommend(unique))
    return Analysis(
        insights=unique.orderBy(F.desc("projected_monthly_savings"), "insight_id"),
        recommendations=recs,
        unified=recommend.synthesise(unique),
        decisions=recommend.policy_gate(unique),
        summary=recommend.run_summary(unique),
        report=recommend.report_sections(unique, recs),
    )
