"""Billing rows derived from the star-schema tables the checks run on."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake import schema, session
from spendlake.operators.staging import stage_billing

# One text for both engines. The table names are filled in: plain names for
# the SQL check, DataFrame references for Spark.
BILLING_SQL = """SELECT
  CASE l.l_suppkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' ELSE 'gcp' END AS provider_name,
  concat('acct-', CAST(c.c_nationkey AS VARCHAR(20))) AS billing_account_id,
  concat('Account ', CAST(c.c_nationkey AS VARCHAR(20))) AS billing_account_name,
  CASE WHEN l.l_linenumber % 7 = 0 THEN '  ' ELSE concat('sub-', CAST(l.l_suppkey AS VARCHAR(20))) END AS sub_account_id,
  CAST(date_trunc('month', l.l_shipdate) AS TIMESTAMP) AS billing_period_start,
  CAST(date_trunc('month', l.l_shipdate) + INTERVAL '1' MONTH AS TIMESTAMP) AS billing_period_end,
  l.l_shipdate AS charge_period_start,
  l.l_shipdate + INTERVAL '1' DAY AS charge_period_end,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber % 5 = 0 THEN 'Credit'
       WHEN l.l_orderkey % 11 = 0 THEN 'Tax' ELSE 'Usage' END AS charge_category,
  concat(p.p_name, '/', CAST(l.l_orderkey AS VARCHAR(20)), '/', CAST(l.l_linenumber AS VARCHAR(20))) AS charge_description,
  CASE WHEN l.l_partkey % 13 = 0 THEN '' ELSE concat('res-', CAST(l.l_partkey AS VARCHAR(20))) END AS resource_id,
  p.p_name AS resource_name,
  p.p_brand AS resource_type,
  CASE WHEN l.l_linenumber % 6 = 0 THEN concat(' ', r.r_name, ' ') ELSE r.r_name END AS region_id,
  CASE p.p_type WHEN 'ECONOMY' THEN 'Virtual Machine' WHEN 'SMALL' THEN 'Relational Database'
       WHEN 'MEDIUM' THEN 'Object Storage' WHEN 'PROMO' THEN 'Kubernetes'
       WHEN 'STANDARD' THEN 'Serverless Function' ELSE 'CDN' END AS service_name,
  CASE p.p_type WHEN 'SMALL' THEN 'Database' WHEN 'MEDIUM' THEN 'Storage' WHEN 'LARGE' THEN 'Networking'
       ELSE 'Compute' END AS service_category,
  CAST(CAST(CAST(round(l.l_extendedprice * (1 - l.l_discount) * 100) AS BIGINT)
       * CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber % 5 = 0 THEN -1 ELSE 1 END AS DECIMAL(18,6))
       * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,6)) AS billed_cost,
  CAST(CAST(CAST(round(l.l_extendedprice * (1 - l.l_discount) * 100) AS BIGINT)
       * CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber % 5 = 0 THEN -1 ELSE 1 END AS DECIMAL(18,6))
       * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,6)) AS effective_cost,
  CAST(CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS DECIMAL(18,6))
       * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,6)) AS list_cost,
  'USD' AS billing_currency,
  CASE WHEN l.l_partkey % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE l.l_quantity END AS usage_quantity,
  CASE WHEN l.l_linestatus = 'F' AND l.l_discount >= 0.05 THEN concat('cd-', CAST(l.l_suppkey AS VARCHAR(20))) ELSE '' END AS commitment_discount_id,
  CASE WHEN l.l_linestatus = 'F' AND l.l_discount >= 0.05 THEN 'Reserved' ELSE 'None' END AS commitment_discount_type,
  CASE WHEN l.l_partkey % 4 = 0 THEN '' ELSE concat('team-', CAST(l.l_partkey % 8 AS VARCHAR(20))) END AS tag_team,
  CASE l.l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'production' WHEN 2 THEN 'staging' WHEN 3 THEN 'dev' ELSE 'qa' END AS tag_env,
  CASE WHEN l.l_partkey % 3 = 0 THEN '' ELSE concat('proj-', CAST(l.l_partkey % 12 AS VARCHAR(20))) END AS tag_project,
  CASE WHEN l.l_partkey % 6 = 0 THEN '' ELSE concat('owner-', CAST(l.l_partkey % 9 AS VARCHAR(20))) END AS tag_owner,
  CASE WHEN p.p_type = 'PROMO' THEN concat('ns-', CAST(l.l_partkey % 10 AS VARCHAR(20))) ELSE '' END AS k8s_namespace,
  CASE WHEN p.p_type = 'PROMO' THEN concat('cluster-', CAST(l.l_suppkey % 2 AS VARCHAR(20))) ELSE '' END AS k8s_cluster,
  CASE WHEN p.p_type = 'PROMO' THEN concat('wl-', CAST(l.l_partkey % 30 AS VARCHAR(20))) ELSE '' END AS k8s_workload,
  CASE WHEN p.p_type = 'PROMO' THEN concat('node-', CAST(l.l_suppkey % 7 AS VARCHAR(20))) ELSE '' END AS k8s_node,
  l.l_shipdate + INTERVAL '2' DAY AS cs_ingested_at
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {nation} n ON s.s_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
JOIN {part} p ON l.l_partkey = p.p_partkey
"""

BILLING_TABLES = ["lineitem", "orders", "customer", "supplier", "nation", "region", "part"]

# Tag key -> view column. ``env`` repeats ``environment``.
TAG_COLUMNS = {
    "team": "tag_team",
    "environment": "tag_env",
    "env": "tag_env",
    "project": "tag_project",
    "owner": "tag_owner",
    "k8s.namespace": "k8s_namespace",
    "k8s.cluster": "k8s_cluster",
    "k8s.workload": "k8s_workload",
    "k8s.node": "k8s_node",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tags_from_columns() -> "F.Column":
    keys = F.array(*[F.lit(k) for k in TAG_COLUMNS])
    values = F.array(*[F.col(c) for c in TAG_COLUMNS.values()])
    return F.map_filter(F.map_from_arrays(keys, values), lambda k, v: v != "")


def billing_view(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The raw billing table over the given tables; ``lineitem`` may be a stream."""
    text = BILLING_SQL.format(**{name: "{" + name + "}" for name in BILLING_TABLES})
    rows = spark.sql(text, **{name: tables[name] for name in BILLING_TABLES})
    return schema.conform(rows.withColumn("tags", tags_from_columns()))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when the files are too few to be read by all of them.

    A small Parquet file with one row group is one task. Tables of many files
    are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """The driver tables at one scale, and the billing tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = session.configure(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def billing(self) -> DataFrame:
        tables = {n: self.table(n) for n in BILLING_TABLES}
        tables["lineitem"] = spread(tables["lineitem"], "l_orderkey")
        return billing_view(self.spark, tables)

    @cached_property
    def staged(self) -> DataFrame:
        return stage_billing(self.billing)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def billing_stream(self, max_files: int | None = None) -> DataFrame:
        """Billing rows as a stream: new line items joined to the static dimensions."""
        tables = {n: self.table(n) for n in BILLING_TABLES}
        reader = self.spark.readStream.schema(tables["lineitem"].schema)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        tables["lineitem"] = reader.parquet(f"{self.sf_dir}/lineitem.parquet")
        return billing_view(self.spark, tables)
