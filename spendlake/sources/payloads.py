"""Provider payloads to FOCUS rows. Schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake import schema
from spendlake.functions import lookups
from spendlake.operators.staging import commitment_type, derive_periods, map_category, map_service, pricing_category

_AMOUNT = "struct<Amount:string,Unit:string>"
AWS_SCHEMA = (
    "ResultsByTime array<struct<TimePeriod:struct<Start:string,End:string>,"
    "Groups:array<struct<Keys:array<string>,"
    f"Metrics:struct<BlendedCost:{_AMOUNT},UnblendedCost:{_AMOUNT},UsageQuantity:{_AMOUNT}>>>>>"
)
AZURE_SCHEMA = "columns array<struct<name:string>>, rows array<array<string>>"
GCP_SCHEMA = (
    "billing_account_id string, project struct<id:string,name:string>, service struct<description:string>,"
    "sku struct<description:string>, location struct<location:string,region:string>,"
    "usage_start_time timestamp, usage_end_time timestamp, cost decimal(18,6), cost_type string,"
    "usage struct<amount:double,unit:string>, credits array<struct<type:string,amount:decimal(18,6)>>,"
    "labels array<struct<key:string,value:string>>, invoice struct<month:string>"
)

# Credit types that mark a commitment, and the sustained-use credit.
GCP_COMMITMENT_CREDITS = ["COMMITTED_USAGE_DISCOUNT", "COMMITTED_USAGE_DISCOUNT_DOLLAR_BASE"]
GCP_SUSTAINED_CREDIT = "SUSTAINED_USAGE_DISCOUNT"

# What the four keys of an AWS cost group stand for.
AWS_KEYS = ("service", "account", "region", "usage_type")


def read_payloads(spark: SparkSession, path: str, payload_schema: str) -> DataFrame:
    """Payload documents, one per line."""
    return spark.read.schema(payload_schema).json(path)


def _money(col: Column) -> Column:
    return F.coalesce(col.try_cast(schema.MONEY), F.lit(0).cast(schema.MONEY))


def _finish(rows: DataFrame, provider: str, hint: str) -> DataFrame:
    """The columns every provider fills the same way."""
    region = F.col("region_id")
    if provider == "aws":
        region = F.coalesce(F.create_map(*[F.lit(v) for pair in lookups.AWS_REGIONS.items() for v in pair])[region], region)
    rows = derive_periods(rows.withColumns({
        "provider_name": F.lit(provider),
        "charge_category": F.lit("Usage"),
        "charge_frequency": F.lit("Usage-Based"),
        "region_name": F.coalesce("region_name", region) if "region_name" in rows.columns else region,
        "publisher_name": F.lit(lookups.PUBLISHERS[provider]),
        "billing_currency": F.lit("USD"),
    }))
    rows = rows.withColumns({
        "pricing_category": pricing_category(hint),
        "commitment_discount_type": commitment_type(hint),
    })
    if "tags" not in rows.columns:
        rows = rows.withColumn("tags", F.create_map().cast(schema.TAGS))
    return schema.conform(map_category(rows))


def normalised(rows: DataFrame) -> DataFrame:
    """Parsed rows with the normalised service names and categories that the detectors look for.

    The parsers keep the provider's own names, as they reported them.
    """
    return schema.conform(map_service(rows))


def aws_to_focus(raw: DataFrame, account_id: str, account_name: str = "",
                 keys: tuple[str, ...] = AWS_KEYS) -> DataFrame:
    """Cost groups by time period to charges; groups that cost nothing are skipped.

    ``keys`` says what the group keys are; requests by service and region only
    pass ``("service", "region")``.
    """
    groups = raw.select(F.explode("ResultsByTime").alias("period")).select(
        F.col("period.TimePeriod").alias("time"), F.explode("period.Groups").alias("g"))

    def key(name: str, default: str) -> Column:
        if name not in keys:
            return F.lit(default)
        return F.coalesce(F.get("g.Keys", F.lit(keys.index(name))), F.lit(default))

    blended, unblended = _money(F.col("g.Metrics.BlendedCost.Amount")), _money(F.col("g.Metrics.UnblendedCost.Amount"))
    rows = groups.select(
        F.lit(account_id).alias("billing_account_id"),
        F.lit(account_name or account_id).alias("billing_account_name"),
        key("account", account_id).alias("sub_account_id"),
        F.col("time.Start").cast("timestamp").alias("charge_period_start"),
        F.col("time.End").cast("timestamp").alias("charge_period_end"),
        key("service", "Unknown").alias("service_name"),
        key("region", "").alias("region_id"),
        key("usage_type", "").alias("usage_type"),
        blended.alias("billed_cost"), unblended.alias("effective_cost"), unblended.alias("list_cost"),
        F.col("g.Metrics.UsageQuantity.Amount").try_cast("double").alias("usage_quantity"),
        F.nullif("g.Metrics.UsageQuantity.Unit", F.lit("")).alias("usage_unit"),
    ).filter((F.col("billed_cost") != 0) | (F.col("effective_cost") != 0))
    rows = rows.withColumns({
        "sub_account_name": F.col("sub_account_id"),
        "charge_description": F.concat_ws(" · ", "service_name", "usage_type"),
    })
    return _finish(rows, "aws", "usage_type")


def azure_to_focus(raw: DataFrame, subscription_id: str, account_name: str = "") -> DataFrame:
    """A column list and row arrays to charges of one day each; rows without cost are skipped."""
    named = raw.select(
        F.transform("columns", lambda c: c["name"]).alias("names"), F.explode("rows").alias("cells"),
    ).select(F.map_from_arrays("names", "cells").alias("r"))

    def cell(name: str, default: str | None = "") -> Column:
        value = F.col("r")[name]
        return value if default is None else F.coalesce(value, F.lit(default))

    day = F.coalesce(
        F.try_to_date(cell("UsageDate", None), "yyyyMMdd"), F.try_to_date(cell("UsageDate", None), "yyyy-MM-dd"))
    rows = named.select(
        F.lit(subscription_id).alias("billing_account_id"),
        F.lit(account_name or subscription_id).alias("billing_account_name"),
        cell("ResourceGroupName").alias("sub_account_id"), cell("ResourceGroupName").alias("sub_account_name"),
        day.cast("timestamp").alias("charge_period_start"),
        F.date_add(day, 1).cast("timestamp").alias("charge_period_end"),
        cell("ServiceName", "Unknown").alias("service_name"),
        cell("ResourceLocation").alias("region_id"),
        F.concat_ws(" · ", cell("ServiceName", "Unknown"), cell("MeterCategory")).alias("charge_description"),
        _money(cell("Cost", None)).alias("billed_cost"), _money(cell("Cost", None)).alias("effective_cost"),
        _money(cell("CostUSD", None)).alias("list_cost"),
        cell("UsageQuantity", None).try_cast("double").alias("usage_quantity"),
        cell("PricingModel", "OnDemand").alias("pricing_model"),
        F.nullif(cell("ReservationId"), F.lit("")).alias("commitment_discount_id"),
    ).filter(F.col("billed_cost") != 0)
    done = _finish(rows, "azure", "pricing_model")
    return done.withColumn(
        "commitment_discount_type",
        F.when(F.col("commitment_discount_id").isNotNull(), "Reserved").otherwise("None"))


def gcp_to_focus(export: DataFrame, start=None, end=None) -> DataFrame:
    """Usage rows grouped by project, service, SKU, region and time; credits (negative) reduce the cost."""
    rows = export.filter(F.col("cost_type") == "regular")
    if start is not None:
        rows = rows.filter(F.col("usage_start_time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("usage_start_time") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    credits = F.coalesce("credits", F.array().cast("array<struct<type:string,amount:decimal(18,6)>>"))
    zero = F.lit(0).cast(schema.MONEY)
    credit = F.aggregate(
        credits, zero, lambda acc, c: (acc + F.coalesce(c["amount"], zero)).cast(schema.MONEY))
    discount = (
        F.when(F.exists(credits, lambda c: c["type"].isin(GCP_COMMITMENT_CREDITS)), "CUD")
        .when(F.exists(credits, lambda c: c["type"] == GCP_SUSTAINED_CREDIT), "SUD")
        .otherwise("NONE")
    )
    labels = F.to_json(F.map_from_entries(F.coalesce("labels", F.array().cast("array<struct<key:string,value:string>>"))))
    grouped = (
        rows.select(
            F.col("billing_account_id"), F.col("project.id").alias("project_id"), F.col("project.name").alias("project_name"),
            F.coalesce("service.description", F.lit("Unknown")).alias("service_name"),
            F.coalesce("sku.description", F.lit("")).alias("sku"),
            F.coalesce("location.region", "location.location", F.lit("")).alias("region_id"),
            "usage_start_time", "usage_end_time", "cost", credit.alias("credit"),
            F.col("usage.amount").alias("amount"), F.col("usage.unit").alias("unit"),
            discount.alias("discount"), labels.alias("labels"))
        .groupBy("billing_account_id", "project_id", "project_name", "service_name", "sku", "region_id",
                 "usage_start_time", "usage_end_time")
        .agg(
            F.sum("cost").alias("billed"), F.sum("credit").alias("credit"), F.sum("amount").alias("usage_quantity"),
            F.max("unit").alias("usage_unit"), F.max("discount").alias("discount_type"), F.max("labels").alias("labels"))
        .filter(F.col("billed") != 0)
    )
    shaped = grouped.select(
        "billing_account_id", F.col("billing_account_id").alias("billing_account_name"),
        F.col("project_id").alias("sub_account_id"), F.coalesce("project_name", "project_id").alias("sub_account_name"),
        F.col("usage_start_time").alias("charge_period_start"), F.col("usage_end_time").alias("charge_period_end"),
        "service_name", "region_id", F.concat_ws(" · ", "service_name", "sku").alias("charge_description"),
        F.col("billed").cast(schema.MONEY).alias("billed_cost"),
        (F.col("billed") + F.col("credit")).cast(schema.MONEY).alias("effective_cost"),
        F.col("billed").cast(schema.MONEY).alias("list_cost"), "usage_quantity", "usage_unit", "discount_type",
        F.from_json("labels", schema.TAGS).alias("tags"))
    return _finish(shaped, "gcp", "discount_type")
