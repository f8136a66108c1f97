"""Audit events and approvals: queries, envelopes and per-day documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.operators.numbering import in_chunks
from spendlake.functions.columns import as_date
from spendlake.operators.spend import top_per

AUDIT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("actor_id", T.StringType()),
    T.StructField("actor_type", T.StringType()),
    T.StructField("tenant_slug", T.StringType()),
    T.StructField("resource_id", T.StringType()),
    T.StructField("resource_type", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("ip_address", T.StringType()),
])


def audit_events(events: DataFrame) -> DataFrame:
    """Audit rows from the product's event table (id, time, user, type, value, JSON props)."""
    return events.select(
        F.format_string("evt-%010d", "event_id").alias("event_id"),
        "event_type",
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor_id"),
        F.lit("user").alias("actor_type"),
        F.lit("main").alias("tenant_slug"),
        F.concat(F.lit("res-"), (F.col("user_id") % 40).cast("string")).alias("resource_id"),
        F.lit("account").alias("resource_type"),
        F.when(F.col("user_id") % 2 == 0, "aws").otherwise("gcp").alias("provider"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"),
        F.from_json("props", "map<string,string>").alias("details"),
        F.col("ts").alias("timestamp"),
        F.lit("").alias("ip_address"),
    )


def audit_query(events: DataFrame, event_type: str | None = None, actor_id: str | None = None,
                outcome: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of events, newest first. ``audit_total`` gives the number behind it."""
    return (
        _matching(events, event_type, actor_id, outcome)
        .orderBy(F.desc("timestamp"), "event_id").offset(offset).limit(limit)
    )


def audit_total(events: DataFrame, event_type: str | None = None, actor_id: str | None = None,
                outcome: str | None = None) -> DataFrame:
    return _matching(events, event_type, actor_id, outcome).agg(F.count(F.lit(1)).alias("total"))


def _matching(events: DataFrame, event_type, actor_id, outcome) -> DataFrame:
    for name, value in (("event_type", event_type), ("actor_id", actor_id), ("outcome", outcome)):
        if value:
            events = events.filter(F.col(name) == value)
    return events


def audit_history(events: DataFrame, resource_id: str | None = None, limit: int = 100) -> DataFrame:
    """The latest events of one resource, or of all resources together."""
    rows = events.filter(F.col("resource_id") == resource_id) if resource_id else events
    return rows.orderBy(F.desc("timestamp"), "event_id").limit(limit)


def latest_per_resource(events: DataFrame, n: int) -> DataFrame:
    return top_per(events, ["resource_id"], [F.desc("timestamp"), F.asc("event_id")], n)


def event_json(source: str = "finops") -> Column:
    """The event as one JSON object, as every log export writes it."""
    return F.to_json(F.struct(
        "event_id", "event_type", "actor_id", "actor_type", "tenant_slug", "resource_id",
        "resource_type", "provider", "outcome", "severity", "details",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "ip_address", F.lit(source).alias("source"),
    ))


# Rows per request of the two log back ends.
LOG_BATCH = {"splunk": 500, "datadog": 1000}


def batch_ids(df: DataFrame, key: str, size: int) -> DataFrame:
    """Number rows into batches of ``size`` along their unique key, the same way on every run; only the last is smaller."""
    return in_chunks(df, [key], size, "batch_id")


def audit_log_payloads(events: DataFrame, dest: str, index: str = "finops_audit",
                       source: str = "finops", env: str = "production") -> DataFrame:
    """Envelope rows for a log back end, with the request each row belongs to."""
    if dest == "splunk":
        payload = F.to_json(F.struct(
            F.unix_seconds("timestamp").alias("time"),
            F.lit(source).alias("host"),
            F.lit(source).alias("source"),
            F.lit(f"{source}:audit").alias("sourcetype"),
            F.lit(index).alias("index"),
            event_json(source).alias("event"),
        ))
    elif dest == "datadog":
        payload = F.to_json(F.struct(
            F.lit(source).alias("ddsource"),
            F.concat(F.lit(f"env:{env},provider:"), "provider", F.lit(",event_type:"), "event_type").alias("ddtags"),
            F.lit(source).alias("hostname"),
            event_json(source).alias("message"),
            F.lit(source).alias("service"),
            F.col("severity").alias("status"),
        ))
    else:
        raise ValueError(f"unknown destination {dest!r}")
    return batch_ids(events, "event_id", LOG_BATCH[dest]).select("event_id", "batch_id", payload.alias("payload"))


def cloudtrail_record(source: str = "finops.local") -> Column:
    """One audit event in the CloudTrail record layout (version 1.09)."""
    return F.struct(
        F.lit("1.09").alias("eventVersion"),
        F.lit(source).alias("eventSource"),
        F.col("event_type").alias("eventName"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("eventTime"),
        F.col("event_id").alias("eventID"),
        F.when(F.col("provider") == "aws", "us-east-1").otherwise("global").alias("awsRegion"),
        F.coalesce(F.nullif("ip_address", F.lit("")), F.lit(source)).alias("sourceIPAddress"),
        F.lit("finops-export").alias("userAgent"),
        F.struct(F.col("actor_type").alias("type"), F.col("actor_id").alias("principalId")).alias("userIdentity"),
        F.when(F.coalesce("resource_id", F.lit("")) != "",
               F.array(F.struct(F.col("resource_id").alias("ARN"), F.col("resource_type").alias("resourceType"))))
        .otherwise(F.array().cast("array<struct<ARN:string,resourceType:string>>")).alias("resources"),
        F.when(F.col("outcome") != "success", "AuditError").alias("errorCode"),
        F.col("details").alias("requestParameters"),
        F.struct("outcome").alias("responseElements"),
        F.struct(F.col("tenant_slug").alias("tenantSlug"), "provider", "severity").alias("additionalEventData"),
    )


def _by_event_id(left: Column, right: Column) -> Column:
    return F.when(left["eventID"] < right["eventID"], -1).when(left["eventID"] > right["eventID"], 1).otherwise(0)


def audit_cloudtrail(events: DataFrame, chunk: int = 1000) -> DataFrame:
    """Documents of ``chunk`` records each, by day; only a day's last is smaller. A day may hold any number of events."""
    rows = events.select(F.to_date("timestamp").alias("day"), "event_id", cloudtrail_record().alias("record"))
    return (
        in_chunks(rows, ["event_id"], chunk, "part", ["day"])
        .groupBy("day", "part")
        .agg(F.array_sort(F.collect_list("record"), _by_event_id).alias("Records"))
        .select(
            F.date_format("day", "yyyy").alias("year"), F.date_format("day", "MM").alias("month"),
            F.date_format("day", "dd").alias("day"), "part", "Records")
    )


# ── Approvals ─────────────────────────────────────────────────────────────

# Days until a pending approval expires and a rollback is lost.
APPROVAL_DAYS = 7
ROLLBACK_DAYS = 7

# States an action never leaves.
TERMINAL = ["completed", "failed", "rolled_back", "rejected"]


def pending_approvals(actions: DataFrame, as_of, environment: str | None = None) -> DataFrame:
    """Pending actions, newest first, with the ones past their time marked."""
    rows = actions.filter(F.col("status") == "pending")
    if environment:
        rows = rows.filter(F.col("environment") == environment)
    expires = F.coalesce(F.col("expires_at"), F.col("created_at") + F.expr(f"INTERVAL {APPROVAL_DAYS} DAYS"))
    return (
        rows.withColumn("expires_at", expires)
        .withColumn("expired", F.col("expires_at") < F.lit(as_date(as_of)).cast("timestamp"))
        .orderBy(F.desc("created_at"), "action_id")
    )


def action_outcomes(actions: DataFrame, as_of) -> DataFrame:
    """Terminal state, need of a human, and whether a rollback is still possible."""
    until = F.col("executed_at") + F.expr(f"INTERVAL {ROLLBACK_DAYS} DAYS")
    now = F.lit(as_date(as_of)).cast("timestamp")
    return actions.withColumns({
        "is_terminal": F.col("status").isin(TERMINAL),
        "requires_human_approval": F.coalesce(F.col("environment") == "production", F.lit(False)),
        "rollback_available": F.coalesce(
            (F.col("status") == "completed") & (now <= until), F.lit(False)),
    })
