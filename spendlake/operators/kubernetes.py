"""Cluster cost allocation from the ``k8s.*`` tags."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.columns import sum_dollars, tag
from spendlake.operators.spend import recent_periods
from spendlake.operators.staging import filter_billing

# Share of a cluster cost booked to each resource.
COST_SHARES = {"cpuCost": 0.6, "ramCost": 0.3, "pvCost": 0.1}


def window_days(window: str) -> int:
    """``7d`` is 7, hours count as whole days but at least one, anything else is a week."""
    text = window.strip().lower()
    match = re.fullmatch(r"(\d+)([dh])", text)
    if not match:
        return 7
    number = int(match.group(1))
    return number if match.group(2) == "d" else max(1, number // 24)


def _scope(b: DataFrame, as_of, days: int, cluster: str | None, namespace: str | None = None) -> DataFrame:
    wanted = {}
    if cluster:
        wanted["k8s.cluster"] = cluster
    if namespace:
        wanted["k8s.namespace"] = namespace
    return filter_billing(recent_periods(b, as_of, days), tags=wanted)


def _first(rows: DataFrame, limit: int | None, *order) -> DataFrame:
    """The first rows in order, or all of them, unsorted."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def namespaces(b: DataFrame, as_of, cluster: str | None = None, days: int = 7, limit: int | None = None) -> DataFrame:
    rows = (
        _scope(b, as_of, days, cluster)
        .withColumns({"namespace": tag("k8s.namespace"), "cluster": tag("k8s.cluster")})
        .filter((F.col("service_name") == "Kubernetes") | (F.col("namespace") != ""))
        .filter(F.col("namespace") != "")
        .groupBy("namespace", "cluster")
        .agg(
            sum_dollars("effective_cost").alias("total_cost"),
            F.count_distinct("resource_id").alias("resource_count"),
            F.min("billing_period_start").cast("date").alias("window_start"),
            F.max("billing_period_start").cast("date").alias("window_end"),
        )
        .withColumn("daily_cost", F.round(F.col("total_cost") / days, 6))
        .withColumn("monthly_cost", F.round(F.col("total_cost") / days * 30, 4))
    )
    return _first(rows, limit, F.desc("total_cost"), "namespace", "cluster")


def workloads(b: DataFrame, as_of, namespace: str | None = None, cluster: str | None = None,
              days: int = 7, limit: int | None = None) -> DataFrame:
    rows = (
        _scope(b, as_of, days, cluster, namespace)
        .withColumns({
            "workload": tag("k8s.workload"), "namespace": tag("k8s.namespace"),
            "cluster": tag("k8s.cluster"), "workload_type": tag("k8s.workload_type"),
        })
        .filter(F.col("workload") != "")
        .groupBy("workload", "namespace", "cluster", "workload_type")
        .agg(
            sum_dollars("effective_cost").alias("total_cost"),
            F.sum("usage_quantity").alias("cpu_hours"),
            F.count_distinct("resource_id").alias("pod_count"),
        )
    )
    return _first(rows, limit, F.desc("total_cost"), "workload", "namespace", "cluster", "workload_type")


def nodes(b: DataFrame, as_of, cluster: str | None = None, days: int = 7, limit: int | None = None) -> DataFrame:
    rows = (
        _scope(b, as_of, days, cluster)
        .withColumns({"node": tag("k8s.node"), "cluster": tag("k8s.cluster")})
        .filter(F.col("node") != "")
        .groupBy("node", "cluster", F.col("resource_type").alias("instance_type"))
        .agg(
            sum_dollars("effective_cost").alias("node_cost"),
            sum_dollars("list_cost").alias("on_demand_cost"),
            F.count_distinct("resource_id").alias("pod_count"),
        )
    )
    return _first(rows, limit, F.desc("node_cost"), "node", "cluster", "instance_type")


def allocation(b: DataFrame, as_of, window: str = "7d", aggregate: str = "namespace",
               cluster: str | None = None) -> DataFrame:
    """Cost per namespace or workload, split over cpu, memory and volumes."""
    days = window_days(window)
    if aggregate == "namespace":
        rows = namespaces(b, as_of, cluster, days).select(
            F.col("namespace").alias("name"), "cluster", "namespace",
            F.lit(0.0).alias("cpuCoreHours"), F.col("total_cost").alias("totalCost"))
    elif aggregate in ("controller", "workload"):
        rows = workloads(b, as_of, cluster=cluster, days=days).select(
            F.col("workload").alias("name"), "cluster", "namespace",
            F.col("cpu_hours").alias("cpuCoreHours"), F.col("total_cost").alias("totalCost"))
    else:
        raise ValueError(f"cannot allocate by {aggregate!r}")
    shares = {name: F.round(F.col("totalCost") * share, 4) for name, share in COST_SHARES.items()}
    return rows.withColumns(shares)


def allocation_summary(b: DataFrame, as_of, window: str = "30d", cluster: str | None = None,
                       top: int = 5) -> DataFrame:
    """One row: total, number of namespaces and the dearest ones as text."""
    rows = namespaces(b, as_of, cluster, window_days(window))
    order = [F.desc("total_cost"), F.asc("namespace"), F.asc("cluster")]
    totals = rows.agg(
        F.round(F.coalesce(F.sum("total_cost"), F.lit(0.0)), 2).alias("total_cost"), F.count(F.lit(1)).alias("namespace_count"),
        F.lit(None).cast("string").alias("top_namespaces"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("total_cost")).alias("k"), "namespace", "cluster")))
    dearest = rows.orderBy(*order).limit(top).agg(
        F.lit(None).cast("double").alias("total_cost"), F.lit(None).cast("long").alias("namespace_count"),
        F.concat_ws(",", F.transform(best, lambda s: F.concat(s["namespace"], F.lit("@"), s["cluster"]))).alias("top_namespaces"))
    return totals.unionByName(dearest).agg(*[F.max(c).alias(c) for c in totals.columns]).withColumns(
        {"window": F.lit(window), "cluster": F.lit(cluster or "all")})
