"""Gauge points for a metrics back end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.operators.audit import batch_ids

# Points per request, and the code of a gauge.
METRIC_BATCH = 500
GAUGE = 3


def _label(key: str, column: str) -> Column:
    return F.concat(F.lit(f"{key}:"), F.coalesce(column, F.lit("unknown")))


def metric_points(daily: DataFrame, prefix: str = "finops", source: str = "source:finops") -> DataFrame:
    """Four gauges per cost row: the row itself, its service, provider and region."""
    tail = F.lit(source)
    points = F.array(
        F.struct(F.lit(f"{prefix}.cost.daily").alias("metric"), F.array(
            _label("provider", "provider_name"), _label("service", "service_name"),
            _label("region", "region_id"), _label("account", "billing_account_id"), tail).alias("tags")),
        F.struct(F.lit(f"{prefix}.cost.by_service").alias("metric"),
                 F.array(_label("service", "service_name"), tail).alias("tags")),
        F.struct(F.lit(f"{prefix}.cost.by_provider").alias("metric"),
                 F.array(_label("provider", "provider_name"), tail).alias("tags")),
        F.struct(F.lit(f"{prefix}.cost.by_region").alias("metric"),
                 F.array(_label("region", "region_id"), tail).alias("tags")),
    )
    rows = daily.select(
        F.concat_ws("|", "provider_name", "service_name", "region_id", "billing_account_id").alias("row_key"),
        F.col("total_cost").alias("value"), F.explode(points).alias("point"),
    ).select(
        F.concat_ws("|", "point.metric", "row_key").alias("point_key"), "point.metric", "point.tags",
        "value", F.lit(GAUGE).alias("type"),
    )
    return batch_ids(rows, "point_key", METRIC_BATCH)


def savings_points(insights: DataFrame, prefix: str = "finops", source: str = "source:finops") -> DataFrame:
    """One gauge per insight that saves something."""
    return insights.filter(F.col("projected_monthly_savings") > 0).select(
        F.lit(f"{prefix}.savings.potential").alias("metric"),
        F.col("projected_monthly_savings").alias("value"),
        F.array(_label("agent", "agent"), _label("provider", "provider"),
                F.concat(F.lit("severity:"), F.coalesce("severity", F.lit("info"))),
                _label("action_type", "action_type"), F.lit(source)).alias("tags"),
        F.lit(GAUGE).alias("type"),
        "insight_id",
    )
