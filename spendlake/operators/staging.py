"""Cleaning, validation and normalisation of billing rows."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake import schema
from spendlake.functions import lookups
from spendlake.functions.columns import (
    blank_to_null, as_date, day_of, month_number, present, tag,
)


def stage_billing(raw: DataFrame) -> DataFrame:
    """Analysis-ready rows: trimmed, blanks as NULL, credits clipped at 0, taxes dropped.

    The filter looks at the raw cost; savings are taken against the clipped one.
    """
    clipped = F.greatest("effective_cost", F.lit(0).cast("decimal(18,6)"))
    kept = raw.filter(
        ((F.col("billed_cost") != 0) | (F.col("effective_cost") != 0))
        & (F.col("charge_category") != "Tax")
    )
    return (
        kept.withColumns({
            "sub_account_id": blank_to_null("sub_account_id"),
            "sub_account_name": blank_to_null("sub_account_name"),
            "resource_id": blank_to_null("resource_id"),
            "resource_name": blank_to_null("resource_name"),
            "resource_type": blank_to_null("resource_type"),
            "region_id": F.nullif(F.lower(F.trim("region_id")), F.lit("")),
            "region_name": F.nullif(F.lower(F.trim("region_name")), F.lit("")),
            "commitment_discount_id": F.nullif("commitment_discount_id", F.lit("")),
            "charge_date": day_of("charge_period_start"),
            # The stored table's partition column is kept, so that filters on it still prune.
            "charge_month": F.col("charge_month") if "charge_month" in raw.columns
            else month_number("charge_period_start"),
            "effective_cost": clipped.cast(schema.MONEY),
            "tag_team": F.col("tags")["team"],
            "tag_env": F.col("tags")["env"],
            "tag_project": F.col("tags")["project"],
            "tag_cost_center": F.col("tags")["cost-center"],
        })
        .withColumn(
            "savings_amount",
            F.greatest(F.col("list_cost") - F.col("effective_cost"), F.lit(0).cast("decimal(18,6)"))
            .cast(schema.MONEY),
        )
        .withColumn(
            "savings_pct",
            F.when(F.col("list_cost") > 0,
                   F.try_divide(F.col("savings_amount").cast("double"), F.col("list_cost").cast("double")) * 100)
            .otherwise(F.lit(0.0)),
        )
    )


def map_category(df: DataFrame) -> DataFrame:
    """``service_category`` from the provider's own service name, ``Other`` if unknown."""
    dim = lookups.category_dim(df.sparkSession)
    return (
        df.drop("service_category")
        .join(F.broadcast(dim), ["provider_name", "service_name"], "left")
        .withColumn("service_category", F.coalesce("service_category", F.lit("Other")))
    )


def map_service(df: DataFrame, source: str = "service_name") -> DataFrame:
    """Normalised ``service_name`` and its category from the provider's service name.

    A name outside the lookup is kept as it is.
    """
    dim = lookups.service_dim(df.sparkSession).select(
        "provider_name", F.col("source_service").alias(source), F.col("service_name").alias("_service"))
    joined = df.join(F.broadcast(dim), ["provider_name", source], "left")
    named = joined.withColumn("_service", F.coalesce("_service", source))
    return (
        named.withColumn("service_category", lookups.infer_category("provider_name", "_service"))
        .withColumn("service_name", F.col("_service"))
        .drop("_service")
    )


def _hint(hint: str) -> Column:
    return F.lower(F.coalesce(F.col(hint), F.lit("")))


def _is_reserved(hint: str, provider: str) -> Column:
    h = _hint(hint)
    return h.contains("reserved") | ((F.col(provider) == "azure") & h.contains("reservation"))


def pricing_category(hint: str, provider: str = "provider_name") -> Column:
    """Pricing category from a usage type, pricing model or discount type; first match wins."""
    h, p = _hint(hint), F.col(provider)
    return (
        F.when(p == "gcp", F.when(h.contains("cud"), "Commitment-Based").otherwise("On-Demand"))
        .when(_is_reserved(hint, provider), "Commitment-Based")
        .when((p == "aws") & h.contains("savingsplan"), "Commitment-Based")
        .when(h.contains("spot"), "Dynamic")
        .otherwise("On-Demand")
    )


def commitment_type(hint: str, provider: str = "provider_name") -> Column:
    h, p = _hint(hint), F.col(provider)
    return (
        F.when(p == "gcp", F.when(h.contains("cud"), "Committed Use").otherwise("None"))
        .when(_is_reserved(hint, provider), "Reserved")
        .when((p == "aws") & h.contains("savingsplan"), "Savings Plan")
        .otherwise("None")
    )


def infer_pricing(df: DataFrame, hint: str = "usage_type") -> DataFrame:
    return df.withColumns({
        "pricing_category": pricing_category(hint),
        "commitment_discount_type": commitment_type(hint),
    })


def derive_periods(df: DataFrame, at: str = "charge_period_start") -> DataFrame:
    """UTC charge time, and the calendar month around it as the billing period."""
    start = F.date_trunc("month", F.col(at).cast("timestamp"))
    return df.withColumns({
        at: F.col(at).cast("timestamp"),
        "billing_period_start": start,
        "billing_period_end": (start + F.expr("INTERVAL 1 MONTH")).cast("timestamp"),
    })


# Longest text accepted per column.
LENGTH_LIMITS = {
    "billing_account_id": 256,
    "billing_account_name": 512,
    "resource_id": 1024,
    "resource_name": 512,
    "resource_type": 256,
    "service_name": 256,
    "service_category": 128,
    "region_id": 128,
    "availability_zone": 128,
    "usage_unit": 64,
    "charge_description": 1024,
    "commitment_discount_id": 512,
    "commitment_discount_name": 512,
    "sub_account_id": 256,
    "sub_account_name": 512,
}


def rules(columns: list[str]) -> list[tuple[str, Column]]:
    """(name, broken) per rule; ``broken`` is never NULL."""
    def never_null(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    tests = [
        ("billing_period_order", ~never_null(F.col("billing_period_start") < F.col("billing_period_end"))),
        ("charge_period_order", ~never_null(F.col("charge_period_start") < F.col("charge_period_end"))),
        ("provider", ~never_null(F.lower("provider_name").isin(schema.PROVIDERS))),
        ("charge_category", ~never_null(F.col("charge_category").isin(schema.CHARGE_CATEGORIES))),
        ("account_missing", ~present("billing_account_id")),
        ("service_missing", ~present("service_name")),
        ("cost_missing", F.col("effective_cost").isNull() | F.col("list_cost").isNull() | F.col("billed_cost").isNull()),
        ("negative_list_cost", never_null(F.col("list_cost") < 0)),
        ("negative_usage", never_null(F.col("usage_quantity") < 0)),
        ("negative_effective_cost",
         never_null(F.col("effective_cost") < 0) & ~never_null(F.col("charge_category").isin("Credit", "Adjustment"))),
        ("currency", F.length(F.coalesce("billing_currency", F.lit(""))) != 3),
    ]
    return tests + [
        (f"{name}_length", never_null(F.length(name) > limit))
        for name, limit in LENGTH_LIMITS.items() if name in columns
    ]


def violation_text(columns: list[str]) -> Column:
    """The names of the rules a row breaks, comma separated; empty for a valid row."""
    return F.concat_ws(",", *[F.when(broken, F.lit(name)) for name, broken in rules(columns)])


def violations(columns: list[str]) -> Column:
    """The same as an array."""
    text = violation_text(columns)
    return F.when(text != "", F.split(text, ",")).otherwise(F.array().cast("array<string>"))


def is_valid(columns: list[str]) -> Column:
    """One boolean over all rules: stays in generated code and stops at the first broken rule."""
    return ~reduce(lambda x, y: x | y, [broken for _, broken in rules(columns)])


def accepted(valid: DataFrame) -> DataFrame:
    """Valid rows in their stored form: FOCUS columns, provider in lower and currency in upper case."""
    return schema.conform(valid.withColumns({
        "provider_name": F.lower("provider_name"),
        "billing_currency": F.upper("billing_currency"),
    }))


def mark(df: DataFrame) -> DataFrame:
    """All rows with ``violations``, the rules they break (none: an empty array); valid rows have provider and currency in their stored
    form. One pass over the input serves an aggregate over both kinds, or a writer that parts them."""
    marked = df.withColumn("violations", violations(df.columns))
    valid = F.size("violations") == 0
    return marked.withColumns({
        "provider_name": F.when(valid, F.lower("provider_name")).otherwise(F.col("provider_name")),
        "billing_currency": F.when(valid, F.upper("billing_currency")).otherwise(F.col("billing_currency")),
    })


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the rest with the rules they break.

    Each of the two reads the input once. Where both are wanted, ``mark`` reads it once for both.
    """
    valid = is_valid(df.columns)
    return accepted(df.filter(valid)), df.filter(~valid).withColumn("violations", violations(df.columns))


def normalise_tags(df: DataFrame, column: str = "tags") -> DataFrame:
    """Tags as a map with lower-case keys; NULL becomes the empty map.

    JSON text is parsed first; text that is no JSON object counts as no tags.
    """
    tags = F.col(column)
    if df.schema[column].dataType.simpleString() == "string":
        tags = F.from_json(tags, schema.TAGS)
    empty = F.create_map().cast(schema.TAGS)
    return df.withColumn(column, F.transform_keys(F.coalesce(tags, empty), lambda k, v: F.lower(k)))


def _first_tag(*keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.col("tags")[k], F.lit("")) for k in keys])


def tag_accessors(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "team": _first_tag("team", "Team"),
        "environment": _first_tag("environment", "Environment", "env"),
    })


def discounts(df: DataFrame) -> DataFrame:
    diff = F.col("list_cost") - F.col("effective_cost")
    return df.withColumns({
        "discount_amount": diff.cast(schema.MONEY),
        "discount_percentage": F.when(
            F.col("list_cost") != 0,
            F.round(F.try_divide(diff.cast("double"), F.col("list_cost").cast("double")) * 100, 2),
        ).otherwise(F.lit(0.0)),
    })


def source_tests(df: DataFrame) -> DataFrame:
    """Failure counts of the source's column tests, all from one pass."""
    tests = {
        "not_null_provider_name": F.col("provider_name").isNull(),
        "accepted_values_provider_name": ~F.col("provider_name").isin(schema.PROVIDERS),
        "not_null_billing_account_id": F.col("billing_account_id").isNull(),
        "not_null_effective_cost": F.col("effective_cost").isNull(),
        "not_null_charge_period_start": F.col("charge_period_start").isNull(),
        "not_null_service_name": F.col("service_name").isNull(),
    }
    counted = df.agg(F.count(F.lit(1)).alias("row_count"),
                     *[F.count_if(failed).alias(name) for name, failed in tests.items()])
    pairs = ", ".join(f"'{name}', {name}" for name in tests)
    return counted.selectExpr("row_count", f"stack({len(tests)}, {pairs}) AS (test, failures)")


def dedup_latest(df: DataFrame, key: list[str] | None = None, newest: str = "cs_ingested_at") -> DataFrame:
    """The newest row per charge.

    ``row_number() = 1`` is pruned before the shuffle: every map task keeps one
    row per key, so a charge repeated in a third of the input stays cheap.
    A hash leads the key: rows are sorted by one number, and the many texts are compared where it is equal only.
    """
    key = key or schema.CHARGE_KEY
    rest = [F.col(c) for c in ("effective_cost", "list_cost", "billed_cost") if c in df.columns]
    order = [F.col(newest).desc_nulls_last(), *[c.desc_nulls_last() for c in rest]]
    ranked = Window.partitionBy(F.xxhash64(*key), *key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def retain(df: DataFrame, as_of: date | str, months: int = 18, at: str = "charge_period_start") -> DataFrame:
    """Rows younger than the retention time (18 months raw, 36 narrow, 12 anomalies)."""
    cutoff = F.add_months(F.lit(as_date(as_of)), -months).cast("timestamp")
    kept = F.col(at) >= cutoff
    if at == "charge_period_start":
        for test in month_range(df, _months_before(as_of, months), None):
            kept = kept & test
    return df.filter(kept)


def _months_before(day: date | str, months: int) -> date:
    """The first day of the month that lies so many months before."""
    d = as_date(day)
    n = d.year * 12 + d.month - 1 - months
    return date(n // 12, n % 12 + 1, 1)


def month_range(b: DataFrame, start: date | str | None, end: date | str | None, slack: int = 0) -> list[Column]:
    """Tests on the month a stored table is partitioned by, so that other months are not read; none if it has no month.

    With a billing period's dates a ``slack`` of one month is needed: a charge may lie outside of its invoice's month.
    """
    if "charge_month" not in b.columns:
        return []
    tests = []
    if start is not None:
        d = _months_before(start, slack)
        tests.append(F.col("charge_month") >= d.year * 100 + d.month)
    if end is not None:
        d = _months_before(end, -slack)
        tests.append(F.col("charge_month") <= d.year * 100 + d.month)
    return tests


def filter_billing(
    b: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    providers: str | list[str] | None = None,
    accounts: list[str] | None = None,
    services: str | list[str] | None = None,
    regions: str | list[str] | None = None,
    tags: dict[str, str] | None = None,
    at: str = "charge_period_start",
) -> DataFrame:
    """The shared predicate: date range (end inclusive), IN lists, tag values.

    When the stored table is partitioned by month, the month range is added so
    that partitions are pruned; Spark cannot derive it from the charge time.
    """
    from datetime import timedelta

    def listed(v):
        return [v] if isinstance(v, str) else list(v)

    tests: list[Column] = []
    if start is not None:
        tests.append(F.col(at) >= F.lit(as_date(start)).cast("timestamp"))
    if end is not None:
        tests.append(F.col(at) < F.lit(as_date(end) + timedelta(days=1)).cast("timestamp"))
    tests += month_range(b, start, end, 0 if at == "charge_period_start" else 1)
    if providers:
        tests.append(F.col("provider_name").isin([p.lower() for p in listed(providers)]))
    if accounts:
        tests.append(F.col("billing_account_id").isin(listed(accounts)))
    if services:
        tests.append(F.col("service_name").isin(listed(services)))
    if regions:
        tests.append(F.col("region_id").isin(listed(regions)))
    for key, value in (tags or {}).items():
        tests.append(tag(key) == value)
    return b.filter(reduce(lambda x, y: x & y, tests)) if tests else b
