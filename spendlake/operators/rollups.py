"""Stored aggregates: daily and monthly rollups, and their upkeep."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.columns import day_of, month_number, tag
from spendlake.session import run_dir

# Rollup columns that can be merged by adding, by maximum and by minimum.
# Distinct counts cannot be merged and are never in this list.
_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def daily_cost(billing: DataFrame) -> DataFrame:
    return billing.groupBy(
        "provider_name", "billing_account_id", "service_name", "region_id",
        day_of("charge_period_start").alias("charge_date"), "billing_currency",
    ).agg(
        F.sum("effective_cost").alias("total_effective"),
        F.sum("list_cost").alias("total_list"),
        F.sum("billed_cost").alias("total_billed"),
    )


def team_cost(billing: DataFrame) -> DataFrame:
    return billing.groupBy(
        "provider_name", tag("team").alias("team_tag"), tag("env").alias("env_tag"),
        day_of("charge_period_start").alias("charge_date"),
    ).agg(F.sum("effective_cost").alias("total_effective"))


def daily_costs_ext(billing: DataFrame) -> DataFrame:
    return billing.groupBy(
        "provider_name", "billing_account_id", "service_name", "service_category", "region_id",
        day_of("charge_period_start").alias("day"),
    ).agg(
        F.sum("effective_cost").alias("total_effective_cost"),
        F.sum("list_cost").alias("total_list_cost"),
        F.sum("usage_quantity").alias("total_usage_quantity"),
        F.count(F.lit(1)).alias("row_count"),
    )


def monthly_services(billing: DataFrame) -> DataFrame:
    return billing.groupBy(
        "provider_name", "service_name", "service_category",
        F.date_trunc("month", "charge_period_start").cast("date").alias("month"),
    ).agg(
        F.sum("effective_cost").alias("total_cost"),
        F.sum("usage_quantity").alias("total_usage"),
        F.count(F.lit(1)).alias("record_count"),
    )


MART_GRAIN = [
    "provider_name", "billing_account_id", "billing_account_name", "service_name",
    "service_category", "region_id", "tag_team", "tag_env", "charge_date", "billing_currency",
]


def mart_daily_service(b: DataFrame) -> DataFrame:
    """The dashboard mart over staged rows. One distinct count, so one extra exchange."""
    return b.groupBy(*MART_GRAIN).agg(
        F.sum("effective_cost").alias("total_effective_cost"),
        F.sum("list_cost").alias("total_list_cost"),
        F.sum("billed_cost").alias("total_billed_cost"),
        F.sum("savings_amount").alias("total_savings"),
        F.sum("usage_quantity").alias("total_usage_quantity"),
        F.max("usage_unit").alias("usage_unit"),
        F.count_distinct("resource_id").alias("resource_count"),
        F.count_if(F.col("commitment_discount_type") != "None").alias("commitment_line_items"),
    )


def write_mart(mart: DataFrame, path: str) -> None:
    """Write the mart by month, replacing only the months in hand."""
    (
        mart.withColumn("charge_month", month_number("charge_date"))
        .hint("rebalance", "charge_month")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("charge_month").parquet(path)
    )


def _stored_mart(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def refresh_days(b: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], days: list[date]) -> None:
    """Rebuild the given days of a stored rollup, and no others.

    Of the billing table only these days are read (their months by partition, the days by the times in the files), so a distinct count is
    right without what other days hold. The rest of a touched month comes from the rollup itself, which is small. A day without charges
    loses its rows, a month without any day its content. Without a stored rollup the days are its first.
    """
    if not days:
        return
    spark = b.sparkSession
    touched = sorted({d.year * 100 + d.month for d in days})
    charged = day_of("charge_period_start").isin(days)
    times = F.col("charge_period_start").between(F.lit(min(days)).cast("timestamp"), F.lit(max(days) + timedelta(days=1)).cast("timestamp"))
    fresh = build(b.filter(F.col("charge_month").isin(touched) & times & charged) if "charge_month" in b.columns else b.filter(times & charged))
    old = _stored_mart(spark, path)
    if old is not None:
        kept = old.filter(F.col("charge_month").isin(touched) & ~F.col("charge_date").isin(days)).drop("charge_month")
        fresh = fresh.unionByName(kept)
    # Written beside the rollup first: its own months are read while the new ones are made.
    beside = run_dir(spark, "rollup-days")
    fresh.write.parquet(beside)
    rows = spark.read.schema(fresh.schema).parquet(beside)
    left = {r[0] for r in rows.select(month_number("charge_date")).distinct().collect()}
    write_mart(rows, path)
    for month in touched:
        if month not in left and old is not None:
            rows.filter(F.lit(False)).coalesce(1).write.mode("overwrite").parquet(f"{path}/charge_month={month}")


def refresh_mart(b: DataFrame, path: str, lookback_days: int = 3, days: list[date] | None = None) -> date | None:
    """Bring the mart up to date and return the first day that was rebuilt.

    Rebuilt are the given ``days``, or all from the mart's last day on, less a lookback for late rows. Only the newest month of the mart is
    read to find that day. Without a mart all of it is built.
    """
    spark = b.sparkSession
    old = _stored_mart(spark, path)
    if old is None and days is None:
        write_mart(mart_daily_service(b), path)
        return None
    if days is None:
        month = old.agg(F.max("charge_month")).first()[0]  # of the folders' names
        newest = None
        while month is not None and newest is None:  # an emptied month holds no day
            newest = old.filter(F.col("charge_month") == month).agg(F.max("charge_date")).first()[0]
            month = old.filter(F.col("charge_month") < month).agg(F.max("charge_month")).first()[0]
        since = (newest or date(1970, 1, 1)) - timedelta(days=lookback_days if newest else 0)
        start = F.lit(since).cast("timestamp")
        recent = b.filter((F.col("charge_month") >= since.year * 100 + since.month) & (F.col("charge_period_start") >= start))
        held = old.filter((F.col("charge_month") >= since.year * 100 + since.month) & (F.col("charge_date") >= since))
        days = sorted({r[0] for r in recent.select(day_of("charge_period_start")).distinct().collect()}
                      | {r[0] for r in held.select("charge_date").distinct().collect()})
    refresh_days(b, path, mart_daily_service, days)
    return min(days, default=None)


def slice_summary(b: DataFrame, dims: list[str]) -> DataFrame:
    """Totals per value of each dimension, all dimensions in one pass of grouping sets."""
    cols = [F.col(d) for d in dims]
    key: Column = F.coalesce(*[
        F.when(F.grouping(d) == 0, F.lit(d)) for d in dims
    ])
    value: Column = F.coalesce(*[
        F.when(F.grouping(d) == 0, F.coalesce(F.col(d).cast("string"), F.lit(""))) for d in dims
    ])
    return (
        b.groupingSets([[c] for c in cols], *cols)
        .agg(
            key.alias("dimension_key"),
            value.alias("dimension_value"),
            F.sum("effective_cost").alias("total_effective_cost"),
            F.sum("list_cost").alias("total_list_cost"),
            F.sum("billed_cost").alias("total_billed_cost"),
            F.count(F.lit(1)).alias("record_count"),
        )
        .withColumn("total_discount", F.col("total_list_cost") - F.col("total_effective_cost"))
        .drop(*dims)
    )


def merge_rollup(parts: list[DataFrame], keys: list[str], measures: dict[str, str]) -> DataFrame:
    """Combine partial rollups of several loads; ``measures`` names how each column merges."""
    unknown = set(measures.values()) - set(_MERGE)
    if unknown:
        raise ValueError(f"cannot merge by {sorted(unknown)}")
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(*keys).agg(*[_MERGE[how](c).alias(c) for c, how in measures.items()])


