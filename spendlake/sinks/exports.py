"""FOCUS exports, the BI view and audit files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.columns import sum_dollars
from spendlake.operators.audit import audit_cloudtrail, event_json
from spendlake.operators.staging import filter_billing

# Published column -> stored column, in export order.
EXPORT_COLUMNS = {
    "BillingAccountId": "billing_account_id",
    "BillingAccountName": "billing_account_name",
    "BillingPeriodStart": "billing_period_start",
    "BillingPeriodEnd": "billing_period_end",
    "ChargePeriodStart": "charge_period_start",
    "ChargePeriodEnd": "charge_period_end",
    "ChargeCategory": "charge_category",
    "ChargeDescription": "charge_description",
    "ChargeFrequency": "charge_frequency",
    "ServiceName": "service_name",
    "ServiceCategory": "service_category",
    "ResourceId": "resource_id",
    "ResourceName": "resource_name",
    "ResourceType": "resource_type",
    "RegionId": "region_id",
    "RegionName": "region_name",
    "AvailabilityZone": "availability_zone",
    "Provider": "provider_name",
    "PublisherName": "publisher_name",
    "InvoiceIssuerName": "provider_name",
    "ListCost": "list_cost",
    "ListUnitPrice": "list_unit_price",
    "EffectiveCost": "effective_cost",
    "BilledCost": "billed_cost",
    "ContractedCost": "contracted_cost",
    "ContractedUnitPrice": "contracted_unit_price",
    "UsageQuantity": "usage_quantity",
    "UsageUnit": "usage_unit",
    "CommitmentDiscountId": "commitment_discount_id",
    "CommitmentDiscountName": "commitment_discount_name",
    "CommitmentDiscountType": "commitment_discount_type",
    "CommitmentDiscountCategory": "commitment_discount_status",
    "Tags": "tags",
}
FORMATS = {"csv", "parquet", "jsonl"}
#: Rows of one packed text file, which one task reads.
FILE_ROWS = 250_000


def export_rows(b: DataFrame, start, end, accounts=None, providers=None, services=None, regions=None,
                limit: int | None = None) -> DataFrame:
    """The export's rows, latest billing period and highest cost first.

    ``limit`` is the export's own row limit; ``None`` exports everything,
    unsorted, with no single-task merge.
    """
    rows = filter_billing(b, start, end, providers, accounts, services, regions, at="billing_period_start")
    if limit is not None:
        rows = rows.orderBy(F.desc("billing_period_start"), F.desc("effective_cost"),
                            "charge_description", "charge_period_start").limit(limit)
    return rows.select(*[F.col(stored).alias(name) for name, stored in EXPORT_COLUMNS.items()])


def typed_cells(rows: DataFrame) -> DataFrame:
    """Cells as the text formats carry them: numbers, ISO times, tags as JSON text."""
    cells = []
    for field in rows.schema.fields:
        col = F.col(field.name)
        kind = field.dataType.typeName()
        if kind == "decimal":
            col = col.cast("double")
        elif kind == "timestamp":
            col = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "map":
            col = F.to_json(col)
        cells.append(col.alias(field.name))
    return rows.select(*cells)


def export_focus(b: DataFrame, fmt: str, path: str, start, end, accounts=None, providers=None,
                 services=None, regions=None, limit: int | None = None, compress: bool = True) -> None:
    """Write the export's rows as files. The text formats are packed by gzip unless told otherwise."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    rows = export_rows(b, start, end, accounts, providers, services, regions, limit)
    if limit is None:  # rows of a day are alike and pack well: each task sorts its own
        rows = rows.sortWithinPartitions("ChargePeriodStart", "ResourceId")
    if fmt == "parquet":
        rows.write.mode("overwrite").option("compression", "snappy").parquet(path)
        return
    writer = typed_cells(rows).write.mode("overwrite").option("compression", "gzip" if compress else "none")
    if compress:
        writer = writer.option("maxRecordsPerFile", FILE_ROWS)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def bi_semantic_view(b: DataFrame) -> DataFrame:
    """Row-level view for BI tools, with the two computed columns."""
    return b.select(
        "billing_account_id", F.col("provider_name").alias("provider"), "service_name", "resource_id",
        "region_id", "charge_category", F.col("billing_period_start").cast("date").alias("billing_period_start"),
        "effective_cost", "list_cost", "usage_quantity",
        F.date_format("billing_period_start", "yyyy-MM").alias("MonthYear"),
        F.when(F.col("list_cost") > 0, F.try_divide(
            (F.col("list_cost") - F.col("effective_cost")).cast("double"), F.col("list_cost").cast("double"))
        ).otherwise(F.lit(0.0)).alias("DiscountPct"),
    )


def bi_measures(view: DataFrame, dimensions: list[str]) -> DataFrame:
    """The view's measures by any of its dimensions."""
    return view.groupBy(*dimensions).agg(
        sum_dollars("effective_cost").alias("total_effective_cost"),
        sum_dollars("list_cost").alias("total_list_cost"),
        F.try_divide(F.sum("effective_cost").cast("double"), F.count("effective_cost")).alias("avg_effective_cost"),
        F.sum("usage_quantity").alias("total_usage_quantity"),
        F.count_distinct("resource_id").alias("resource_count"),
    )


def write_audit_jsonl(events: DataFrame, path: str, append: bool = True, compress: bool = False) -> None:
    """One JSON object per line, added to what the folder holds."""
    (
        events.select(event_json().alias("value"))
        .write.mode("append" if append else "overwrite")
        .option("compression", "gzip" if compress else "none").text(path)
    )


def write_audit_cloudtrail(events: DataFrame, path: str, chunk: int = 1000, compress: bool = True) -> None:
    """``Records`` documents below year/month/day folders."""
    (
        audit_cloudtrail(events, chunk).drop("part")
        .write.mode("append").partitionBy("year", "month", "day")
        .option("compression", "gzip" if compress else "none").json(path)
    )
