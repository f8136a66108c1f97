"""Time the headline queries over the stored billing table. Prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores,
``BENCH_RUNS`` how often each query runs (default 2; the best time counts, so
that compiling the plan's code for the first time does not).
Deriving and writing the billing table by month is a timed step of its own; the
queries then read it as they would in production, and write to the no-op sink,
so every output row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from functools import cached_property

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from spendlake.operators.staging import stage_billing  # noqa: E402
from spendlake.plans import catalog  # noqa: E402
from spendlake.plans.catalog_sources import message_folder  # noqa: E402
from spendlake.session import local_session, run_dir  # noqa: E402
from spendlake.sources import billing_table  # noqa: E402
from spendlake.sources.driver_tables import Tables  # noqa: E402

HEADLINE = [
    "q1_cost_overview", "q2_cost_by_service_daily", "q2_cost_by_service_monthly", "q3_cost_by_team", "q4_top_services",
    "q5_overview_by_service", "q6_daily_trend", "q8_cost_by_tag", "q9_provider_spend", "q12_cost_by_region",
    "q13_high_cost_resources", "q14_k8s_namespaces", "q16_k8s_nodes", "q19_panel_timeseries", "q20_panel_table",
    "q21_spike_annotations", "q23_dashboard_widgets",
    "a1_daily_cost", "a2_team_cost", "a3_daily_costs_ext", "a4_monthly_services", "a5_mart_daily_service", "a7_slice_summary",
    "t5_validate", "t9_source_tests", "t10_dedup_latest", "t11_retain", "t12_filter_billing",
    "s9_export_focus", "s11_metric_points", "s15_audit_log_payloads_splunk",
    "d1_idle_resources", "d2_idle_vms", "d6_commitment_coverage", "d7_tag_coverage", "d8_tag_violations",
    "d14_budget_alerts", "d15_scoped_budgets", "d16_monitor_thresholds",
    "m1_cost_series_service", "m2_forecast_service", "m3_interval_anomalies_service", "m4_feature_outliers",
    "m5_consensus_anomalies", "m7_backtest", "m8_rolling_origin_eval",
    "r2_dedup_insights", "r3_recommend", "r5_prioritise", "r7_conflicts", "r9_policy_gate", "r10_policy_rules",
    "x3_daily_cost_stream",
]


class StoredTables(Tables):
    """The same tables with the billing rows read from the stored table."""

    def __init__(self, spark, sf_dir: str, path: str) -> None:
        super().__init__(spark, sf_dir)
        self.path = path

    @cached_property
    def billing(self) -> DataFrame:
        return billing_table.read_billing(self.spark, self.path)

    @cached_property
    def staged(self) -> DataFrame:
        return stage_billing(self.billing)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = sys.argv[1:]
    spark = local_session(cpus, "spendlake-bench")
    path = run_dir(spark, "bench-billing")
    timings: dict[str, float] = {}

    took = []
    for _ in range(runs):
        began = time.perf_counter()
        billing_table.write_billing(Tables(spark, sf_dir).billing, path)
        took.append(time.perf_counter() - began)
    timings["s1_write_billing"] = min(took)

    tables = StoredTables(spark, sf_dir, path)
    message_folder(tables)  # what the streams read; not timed
    for name in HEADLINE:
        if only and not any(part in name for part in only):
            continue
        took = []
        for _ in range(1 if name.startswith("x") else runs):
            began = time.perf_counter()
            catalog.QUERIES[name](tables).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        timings[name] = min(took)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "runs": runs,
        "queries": {k: round(v, 3) for k, v in timings.items()}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
