"""Registered queries: a Spark plan next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from spendlake.sources.driver_tables import BILLING_SQL, BILLING_TABLES, Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BILLING_CTE = "billing AS (\n" + BILLING_SQL.format(**{n: n for n in BILLING_TABLES}) + ")"

# The staged table in the check's SQL; ``tag_env`` also stands for ``environment``.
_STAGED_CTE = """b AS (
SELECT provider_name, billing_account_id, billing_account_name,
  nullif(trim(sub_account_id), '') AS sub_account_id,
  billing_period_start, billing_period_end, charge_period_start, charge_period_end,
  CAST(charge_period_start AS DATE) AS charge_date,
  CAST(year(charge_period_start) * 100 + month(charge_period_start) AS INTEGER) AS charge_month,
  charge_category, charge_description,
  nullif(trim(resource_id), '') AS resource_id,
  nullif(trim(resource_name), '') AS resource_name,
  nullif(trim(resource_type), '') AS resource_type,
  nullif(lower(trim(region_id)), '') AS region_id,
  service_name, service_category, billed_cost,
  greatest(effective_cost, 0) AS effective_cost, list_cost, billing_currency, usage_quantity,
  nullif(commitment_discount_id, '') AS commitment_discount_id, commitment_discount_type,
  nullif(tag_team, '') AS tag_team, nullif(tag_env, '') AS tag_env,
  nullif(tag_project, '') AS tag_project, nullif(tag_owner, '') AS tag_owner,
  nullif(k8s_namespace, '') AS k8s_namespace, nullif(k8s_cluster, '') AS k8s_cluster,
  nullif(k8s_workload, '') AS k8s_workload, nullif(k8s_node, '') AS k8s_node,
  greatest(list_cost - greatest(effective_cost, 0), 0) AS savings_amount,
  CASE WHEN list_cost > 0 THEN CAST(greatest(list_cost - greatest(effective_cost, 0), 0) AS DOUBLE)
       / CAST(list_cost AS DOUBLE) * 100 ELSE 0 END AS savings_pct,
  cs_ingested_at
FROM billing
WHERE (billed_cost <> 0 OR effective_cost <> 0) AND charge_category <> 'Tax')"""


def with_billing(sql: str) -> str:
    """Prefix a check with the views it names: ``billing`` raw, ``b`` staged."""
    head = sql.lstrip()
    word = next((w for w in ("WITH RECURSIVE ", "WITH ") if head.upper().startswith(w)), None)
    more = head[len(word):] if word else None
    ctes = f"{word or 'WITH '}{_BILLING_CTE},\n{_STAGED_CTE}"
    return f"{ctes},\n{more}" if more is not None else f"{ctes}\n{head}"


def query(name: str, oracle: str | None = None, billing: bool = True):
    """Register a query; ``oracle`` is its check, over the billing views unless told otherwise."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_billing(oracle) if billing else oracle
        return fn

    return add


@lru_cache(maxsize=8)
def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Plans over one folder, so that file listings and footers are read once. Holds no rows."""
    return Tables(spark, sf_dir)


def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_tables(spark, sf_dir))

    run.__name__ = name
    return run
