"""The FOCUS 1.0 billing table and the other fixed record layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 6)
TAGS = T.MapType(T.StringType(), T.StringType())

# FOCUS column names, stored name -> published name, in table order.
FOCUS_NAMES = {
    "provider_name": "ProviderName",
    "billing_account_id": "BillingAccountId",
    "billing_account_name": "BillingAccountName",
    "sub_account_id": "SubAccountId",
    "sub_account_name": "SubAccountName",
    "billing_period_start": "BillingPeriodStart",
    "billing_period_end": "BillingPeriodEnd",
    "charge_period_start": "ChargePeriodStart",
    "charge_period_end": "ChargePeriodEnd",
    "charge_category": "ChargeCategory",
    "charge_frequency": "ChargeFrequency",
    "charge_description": "ChargeDescription",
    "resource_id": "ResourceId",
    "resource_name": "ResourceName",
    "resource_type": "ResourceType",
    "region_id": "RegionId",
    "region_name": "RegionName",
    "availability_zone": "AvailabilityZone",
    "service_name": "ServiceName",
    "service_category": "ServiceCategory",
    "publisher_name": "PublisherName",
    "billed_cost": "BilledCost",
    "effective_cost": "EffectiveCost",
    "list_cost": "ListCost",
    "list_unit_price": "ListUnitPrice",
    "contracted_cost": "ContractedCost",
    "contracted_unit_price": "ContractedUnitPrice",
    "billing_currency": "BillingCurrency",
    "usage_quantity": "UsageQuantity",
    "usage_unit": "UsageUnit",
    "pricing_quantity": "PricingQuantity",
    "pricing_unit": "PricingUnit",
    "pricing_category": "PricingCategory",
    "commitment_discount_id": "CommitmentDiscountId",
    "commitment_discount_name": "CommitmentDiscountName",
    "commitment_discount_type": "CommitmentDiscountType",
    "commitment_discount_status": "CommitmentDiscountStatus",
    "tags": "Tags",
    "cs_ingested_at": "IngestedAt",
}

_MONEY_COLUMNS = {
    "billed_cost", "effective_cost", "list_cost",
    "list_unit_price", "contracted_cost", "contracted_unit_price",
}
_TIME_COLUMNS = {
    "billing_period_start", "billing_period_end",
    "charge_period_start", "charge_period_end", "cs_ingested_at",
}
_NUMBER_COLUMNS = {"usage_quantity", "pricing_quantity"}
_REQUIRED = {
    "provider_name", "billing_account_id", "service_name",
    "billing_period_start", "billing_period_end", "charge_period_start", "charge_period_end",
    "billed_cost", "effective_cost", "list_cost",
}


def _type_of(name: str) -> T.DataType:
    if name in _MONEY_COLUMNS:
        return MONEY
    if name in _TIME_COLUMNS:
        return T.TimestampType()
    if name in _NUMBER_COLUMNS:
        return T.DoubleType()
    if name == "tags":
        return TAGS
    return T.StringType()


BILLING_SCHEMA = T.StructType(
    [T.StructField(name, _type_of(name), name not in _REQUIRED) for name in FOCUS_NAMES]
)

# What identifies one charge. Wider than account, service, resource and time
# alone: rows of one day may differ only in sub-account, region or usage type.
CHARGE_KEY = [
    "provider_name", "billing_account_id", "sub_account_id", "charge_period_start",
    "service_name", "resource_id", "region_id", "charge_category",
    "charge_description", "billing_currency",
]

INSIGHT_SCHEMA = T.StructType([
    T.StructField("insight_id", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("resource_ids", T.ArrayType(T.StringType())),
    T.StructField("service_name", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("current_monthly_cost", T.DoubleType()),
    T.StructField("projected_monthly_savings", T.DoubleType()),
    T.StructField("projected_annual_savings", T.DoubleType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("action_type", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("action_required", T.BooleanType()),
    T.StructField("coverage_pct", T.DoubleType()),
])

# Accepted codes.
PROVIDERS = ["aws", "azure", "gcp"]
CHARGE_CATEGORIES = ["Usage", "Tax", "Credit", "Adjustment", "Purchase"]
RISK_LEVELS = ["low", "medium", "high", "critical"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]
REQUIRED_TAGS = ["team", "environment", "project", "owner"]
ENVIRONMENT_VALUES = ["development", "staging", "production", "dev", "prod"]


def conform(df: DataFrame) -> DataFrame:
    """Select the FOCUS columns in order, filling absent ones with typed nulls.

    Columns with a published (Pascal case) name are accepted too.
    """
    have = set(df.columns)
    cols = []
    for field in BILLING_SCHEMA.fields:
        published = FOCUS_NAMES[field.name]
        if field.name in have:
            col = F.col(field.name)
        elif published in have:
            col = F.col(published)
        else:
            col = F.lit(None)
        cols.append(col.cast(field.dataType).alias(field.name))
    return df.select(*cols)


def conform_insights(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in INSIGHT_SCHEMA.fields
    ])
