"""Known small cases of single operators."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlake import plugins, schema
from spendlake.operators import audit, budgets, detectors, kubernetes, recommend, rollups, series, spend, staging
from spendlake.plans import analysis
from spendlake.sinks import exports, metrics
from spendlake.sources import billing_table, messages, payloads

DAY = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)


def charge(**over):
    row = {
        "provider_name": "aws", "billing_account_id": "123", "billing_account_name": "Main", "sub_account_id": "s1",
        "billing_period_start": dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc),
        "billing_period_end": dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc),
        "charge_period_start": DAY, "charge_period_end": DAY + dt.timedelta(days=1),
        "charge_category": "Usage", "charge_description": "box", "service_name": "Virtual Machine",
        "service_category": "Compute", "resource_id": "i-1", "resource_name": "web", "resource_type": "m5",
        "region_id": "us-east-1", "billed_cost": Decimal("80"), "effective_cost": Decimal("80"), "list_cost": Decimal("100"),
        "billing_currency": "USD", "usage_quantity": 720.0, "commitment_discount_id": "", "commitment_discount_type": "None",
        "tags": {"team": "platform", "env": "production"}, "cs_ingested_at": DAY,
    }
    row.update(over)
    return row


@pytest.fixture
def billing(spark):
    def make(*rows):
        full = [[charge(**r).get(f.name) for f in schema.BILLING_SCHEMA.fields] for r in rows]
        return spark.createDataFrame(full, schema.BILLING_SCHEMA)
    return make


def only(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


# ── Staging ───────────────────────────────────────────────────────────────

def test_stage_trims_and_drops(billing):
    rows = staging.stage_billing(billing(
        {"resource_id": "  ", "region_id": " EU-West ", "effective_cost": Decimal("-5"), "charge_category": "Credit"},
        {"charge_category": "Tax"}, {"billed_cost": Decimal(0), "effective_cost": Decimal(0)}))
    row = only(rows)
    assert (row.resource_id, row.region_id, row.effective_cost) == (None, "eu-west", Decimal("0"))
    assert row.savings_amount == Decimal("100") and row.charge_month == 202401


@pytest.mark.parametrize("change, broken", [
    ({}, []),
    ({"charge_category": "Credit", "effective_cost": Decimal("-1")}, []),
    ({"effective_cost": Decimal("-1")}, ["negative_effective_cost"]),
    ({"billing_period_end": dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)}, ["billing_period_order"]),
    ({"provider_name": "oracle"}, ["provider"]),
    ({"provider_name": "AWS"}, []),
    ({"billing_currency": "US"}, ["currency"]),
    ({"usage_quantity": -1.0}, ["negative_usage"]),
    ({"resource_id": "x" * 1025}, ["resource_id_length"]),
    ({"service_name": ""}, ["service_missing"]),
])
def test_validation(billing, change, broken):
    good, bad = staging.validate(billing(change))
    assert (good.count(), bad.count()) == ((0, 1) if broken else (1, 0))
    if broken:
        assert bad.first()["violations"] == broken


def test_dedup_keeps_the_newest(billing):
    later = {"cs_ingested_at": DAY + dt.timedelta(days=1), "effective_cost": Decimal("70")}
    rows = staging.dedup_latest(billing({}, later, {"region_id": "eu"}))
    assert sorted(r.effective_cost for r in rows.collect()) == [Decimal("70"), Decimal("80")]


def test_dedup_of_a_hot_charge(spark, billing):
    """A third of the rows are copies of one charge, spread over all tasks."""
    one = billing({}).drop("cs_ingested_at", "effective_cost", "charge_description")
    rows = spark.range(0, 3000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("charge_description"),
        F.col("id").cast("decimal(18,6)").alias("effective_cost"),
        F.timestamp_seconds(F.col("id")).alias("cs_ingested_at")).crossJoin(one).select(*schema.BILLING_SCHEMA.names)
    kept = staging.dedup_latest(rows)
    assert kept.count() == 2001
    assert only(kept.filter("charge_description = 'hot'")).effective_cost == Decimal("2997")


def test_dedup_prunes_before_the_exchange(billing):
    plan = staging.dedup_latest(billing({}))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_normalise_tags_parses_text(spark):
    df = spark.createDataFrame([('{"Team":"a","ENV":"p"}',), (None,), ("no json",)], "tags string")
    assert [r.tags for r in staging.normalise_tags(df).collect()] == [{"team": "a", "env": "p"}, {}, {}]


def test_tag_accessors_fall_back(billing):
    row = only(staging.tag_accessors(billing({"tags": {"Team": "x", "team": "", "env": "dev"}})))
    assert (row.team, row.environment) == ("x", "dev")


@pytest.mark.parametrize("lst, eff, pct", [("100", "80", 20.0), ("0", "5", 0.0), ("3", "2", 33.33)])
def test_discounts(billing, lst, eff, pct):
    row = only(staging.discounts(billing({"list_cost": Decimal(lst), "effective_cost": Decimal(eff)})))
    assert row.discount_percentage == pct


@pytest.mark.parametrize("provider, hint, category, kind", [
    ("aws", "USE1-ReservedUsage", "Commitment-Based", "Reserved"),
    ("aws", "SavingsPlanUsage", "Commitment-Based", "Savings Plan"),
    ("aws", "SpotUsage:m5", "Dynamic", "None"),
    ("aws", "CapacityReservation", "On-Demand", "None"),
    ("azure", "Reservation", "Commitment-Based", "Reserved"),
    ("gcp", "CUD", "Commitment-Based", "Committed Use"),
    ("gcp", "SUD", "On-Demand", "None"),
])
def test_pricing(spark, provider, hint, category, kind):
    row = only(staging.infer_pricing(spark.createDataFrame([(provider, hint)], "provider_name string, usage_type string")))
    assert (row.pricing_category, row.commitment_discount_type) == (category, kind)


def test_unknown_service_is_kept(spark):
    df = spark.createDataFrame([("aws", "AWS Lambda"), ("aws", "Brand New")], "provider_name string, service_name string")
    got = {r.service_name: r.service_category for r in staging.map_service(df).collect()}
    assert got == {"Serverless Function": "Compute", "Brand New": "Other"}


# ── Spend ─────────────────────────────────────────────────────────────────

def test_end_date_is_inclusive(billing):
    b = staging.stage_billing(billing({}, {"charge_period_start": DAY + dt.timedelta(hours=23)},
                                      {"charge_period_start": DAY + dt.timedelta(days=1)}))
    assert only(spend.cost_overview(b, "2024-01-10", "2024-01-10")).total_effective_cost == 160.0


def test_absent_provider_gets_zeros(billing):
    rows = {r.provider_name: r for r in spend.provider_spend(staging.stage_billing(billing({})), "2024-01-31").collect()}
    assert rows["aws"].total_cost == 80.0 and rows["gcp"].record_count == 0 and rows["azure"].total_cost == 0.0


def test_untagged_environment(billing):
    row = only(spend.cost_by_team(staging.stage_billing(billing({"tags": {"team": "a"}}, {"tags": {}})), "2024-01-01", "2024-01-31"))
    assert (row.team_tag, row.env_tag) == ("a", "untagged")


def test_panel_rejects_other_dimensions(billing):
    assert only(spend.panel_table(staging.stage_billing(billing({})), "2024-01-01", "2024-01-31", "1; drop")).dimension == "Virtual Machine"


@pytest.mark.parametrize("text, days", [("7d", 7), ("30d", 30), ("24h", 1), ("48h", 2), ("2h", 1), ("x", 7)])
def test_window_text(text, days):
    assert kubernetes.window_days(text) == days


def test_namespace_projection(billing):
    b = staging.stage_billing(billing({"effective_cost": Decimal("450"), "tags": {"k8s.namespace": "frontend", "k8s.cluster": "prod"}}))
    row = only(kubernetes.namespaces(b, "2024-01-08", days=7))
    assert (row.namespace, row.daily_cost, row.monthly_cost) == ("frontend", round(450 / 7, 6), round(450 / 7 * 30, 4))


def test_slice_summary_tells_null_from_total(billing):
    rows = rollups.slice_summary(staging.stage_billing(billing({}, {"region_id": ""})), ["region_id", "provider_name"]).collect()
    got = {(r.dimension_key, r.dimension_value): r.record_count for r in rows}
    assert got == {("region_id", "us-east-1"): 1, ("region_id", ""): 1, ("provider_name", "aws"): 2}


def test_merge_rollup_refuses_distinct(billing):
    with pytest.raises(ValueError):
        rollups.merge_rollup([billing({})], ["provider_name"], {"resource_id": "count_distinct"})


# ── Detectors ─────────────────────────────────────────────────────────────

def test_idle_vm(billing):
    rows = [{"usage_quantity": 1.5, "effective_cost": Decimal("75")}] * 2
    row = only(detectors.idle_vms(staging.stage_billing(billing(*rows)), "2024-01-15"))
    assert row.severity == "high" and row.current_monthly_cost == 150.0 and row.projected_monthly_savings == 120.0
    assert row.title == "Potentially idle EC2: i-1" and row.projected_annual_savings == 1440.0


def test_stored_rows_are_sorted_by_columns(billing):
    plan = billing_table.laid_out(billing({}))._jdf.queryExecution().optimizedPlan().toString()
    (sort,) = [line for line in plan.splitlines() if "Sort [" in line]
    assert "_place" in sort and "xxhash64" not in sort


def test_dear_resources_lose_no_violation(billing):
    """A resource under several tags, with a credit, is kept for its whole cost; a cheap one moves no names."""
    rows = [{"resource_id": "two", "tags": {"team": t}, "effective_cost": Decimal(c)} for t, c in (("a", "60"), ("b", "55"), ("b", "-20"))]
    b = billing(*rows, {"resource_id": "dear", "tags": {}, "effective_cost": Decimal("100.00006")}, {"resource_id": "cheap", "effective_cost": Decimal("9")})
    kept = detectors.dear_resources(b, "2024-01-15", 30, 100)
    assert kept.columns == b.columns and {r.resource_id for r in kept.collect()} == {"two", "dear"} and kept.count() == 4
    plain, fewer = (detectors.tag_violations(rows, "2024-01-15", min_cost=100).select("resource_id", "monthly_cost").collect() for rows in (b, kept))
    assert plain == fewer == [("dear", 100.0001)]


def test_every_insight_reads_the_billing_once(spark, billing, tmp_path):
    billing({}, {"resource_id": "j", "tags": {}}).write.parquet(f"{tmp_path}/billing")
    found = analysis.every_insight(staging.stage_billing(spark.read.parquet(f"{tmp_path}/billing")), "2024-01-15")
    assert found.count() > 0
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]


def test_tag_violation_of_untagged_and_compliant(billing):
    full = {"team": "a", "environment": "prod", "project": "p", "owner": "o"}
    b = staging.stage_billing(billing({"tags": {}, "effective_cost": Decimal("200")}, {"resource_id": "ok", "tags": full},
                                      {"resource_id": "bad", "tags": {**full, "environment": "qa"}}))
    rows = {r.resource_id: r for r in detectors.tag_violations(b, "2024-01-15").collect()}
    assert set(rows) == {"i-1", "bad"}
    assert rows["i-1"].missing_tags == ["team", "environment", "project", "owner"] and rows["i-1"].severity == "medium"
    assert rows["bad"].bad_environment == "qa" and rows["bad"].severity == "low"


@pytest.mark.parametrize("n, level", [(0, "none"), (1, "low"), (2, "low"), (3, "medium"), (5, "medium"), (6, "high")])
def test_severity(spark, n, level):
    assert spark.range(1).select(detectors.violation_severity(F.lit(n)).alias("s")).first()["s"] == level


@pytest.mark.parametrize("limit, level", [(80, "breach"), (85, "critical"), (100, "warning"), (200, None)])
def test_budget_levels(spark, billing, limit, level):
    plans = spark.createDataFrame([("Virtual Machine", float(limit))], "budget_name string, monthly_limit double")
    rows = budgets.budget_alerts(staging.stage_billing(billing({})), plans, "2024-01-20").collect()
    assert [r.alert_level for r in rows] == ([level] if level else [])


# ── Series ────────────────────────────────────────────────────────────────

def straight(spark, n):
    return spark.createDataFrame(
        [("k", dt.date(2024, 1, 1) + dt.timedelta(days=i), 100.0 + 2 * i) for i in range(n)], "key string, ds date, y double")


def test_forecast_continues_a_line(spark):
    rows = series.forecast(straight(spark, 30), 7).orderBy("ds").collect()
    assert len(rows) == 7
    assert [round(r.predicted, 6) for r in rows] == [160.0 + 2 * i for i in range(7)]
    assert all(r.lower <= r.predicted + 1e-6 and r.upper >= r.predicted - 1e-6 for r in rows)


def test_short_series_are_dropped(spark):
    assert series.long_enough(straight(spark, 13), 14).count() == 0
    assert series.lag_features(straight(spark, 60)).count() == 46


def test_spike_is_an_anomaly(spark):
    rows = straight(spark, 60).withColumn("y", F.when(F.col("ds") == "2024-02-10", 5000.0).otherwise(F.col("y")))
    found = series.interval_anomalies(rows).collect()
    assert [str(r.ds) for r in found] == ["2024-02-10"] and found[0].severity == "critical"


def test_series_insights(spark):
    rows = straight(spark, 60).withColumn("y", F.when(F.col("ds") == "2024-02-10", 5000.0).otherwise(F.col("y")))
    row = only(series.anomaly_insights(series.interval_anomalies(rows)))
    assert (row.title, row.severity, row.action_type) == ("Cost anomaly detected: K", "critical", "investigate")
    totals = series.forecast_totals(series.forecast(straight(spark, 30), 30))
    plan = spark.createDataFrame([("k", 1000.0)], "key string, budget double")
    breach = only(series.breach_insights(series.forecast_breaches(totals, plan), 30))
    assert (breach.title, breach.severity, breach.provider) == ("Budget breach forecast: k", "critical", "multi")


@pytest.mark.parametrize("expected, actual, score, pct, significant", [
    (100.0, 250.0, 0.9, 150.0, True), (100.0, 150.0, 0.3, 50.0, False), (0.0, 10.0, 0.9, 100.0, True), (100.0, 110.0, 0.9, 10.0, False)])
def test_anomaly_metrics(spark, expected, actual, score, pct, significant):
    row = only(series.anomaly_metrics(spark.createDataFrame([(expected, actual, score)], "expected_cost double, actual_cost double, anomaly_score double")))
    assert (row.percentage_increase, row.is_significant) == (pct, significant)


def test_rolling_origin_matches_a_plain_refit(spark):
    """Block sums against fits that see every day of every cut-off."""
    import numpy as np

    rng = np.random.default_rng(7)
    first = dt.date(2023, 1, 1)
    ys = [100 + 0.5 * i + 20 * (i % 7 == 3) + float(rng.normal(0, 5)) for i in range(400)]
    df = spark.createDataFrame([("k", first + dt.timedelta(days=i), y) for i, y in enumerate(ys)], "key string, ds date, y double")
    errors, inside, cuts = [], [], 0
    for i in range(100):
        cut = 399 - 30 * (i + 1)
        if cut < 90:
            break
        cuts += 1
        x, y = np.arange(cut + 1), np.array(ys[:cut + 1])
        slope, intercept = np.polyfit(x, y, 1)
        dow = np.array([(first + dt.timedelta(days=int(d))).weekday() for d in x])
        rest = y - intercept - slope * x
        effect = {d: rest[dow == d].mean() for d in range(7)}
        sigma = np.std(rest - np.array([effect[d] for d in dow]), ddof=1)
        for d in range(cut + 1, cut + 31):
            error = abs(ys[d] - (intercept + slope * d + effect[(first + dt.timedelta(days=d)).weekday()]))
            errors.append(error)
            inside.append(error <= 1.96 * sigma)
    row = only(series.rolling_origin_eval(df))
    assert (row.cutoffs, row.points) == (cuts, len(errors))
    assert row.mae == pytest.approx(np.mean(errors), abs=0.006)
    assert row.rmse == pytest.approx(np.sqrt(np.mean(np.square(errors))), abs=0.006)
    assert row.coverage == pytest.approx(np.mean(inside), abs=1e-4)


# ── Recommendations ───────────────────────────────────────────────────────

def insight(spark, *rows):
    base = {"agent": "a", "provider": "aws", "category": "idle_resource", "severity": "high", "status": "open", "title": "t",
            "description": "d", "resource_ids": ["r"], "projected_monthly_savings": 10.0, "projected_annual_savings": 120.0,
            "confidence_score": 0.8, "action_type": "stop", "risk_level": "low"}
    full = [{**base, **r} for r in rows]
    df = spark.createDataFrame([[r.get(f.name) for f in schema.INSIGHT_SCHEMA.fields] for r in full], schema.INSIGHT_SCHEMA)
    return df.withColumn("insight_id", detectors.insight_id())


def test_recommend_groups_and_ranks(spark):
    rows = insight(spark, *[{"title": f"t{i}", "projected_monthly_savings": float(i), "resource_ids": [f"r{i}"]} for i in range(5)],
                   {"category": "right_size", "risk_level": "high", "provider": "gcp", "projected_monthly_savings": 20.0})
    recs = {r.category: r for r in recommend.prioritise(recommend.recommend(rows)).collect()}
    idle = recs["idle_resource"]
    assert idle.title == "Idle Resource: 5 findings" and idle.description == "- t4\n- t3\n- t2\n- ... and 2 more"
    assert (idle.total_projected_monthly_savings, idle.implementation_effort, idle.requires_approval) == (10.0, "low", False)
    assert recs["right_size"].requires_approval and recs["right_size"].priority_score == 8.0
    assert len(idle.actions) == 4


def test_dedup_keeps_the_best(spark):
    rows = insight(spark, {"projected_monthly_savings": 1.0}, {"projected_monthly_savings": 9.0, "title": "u"}, {"resource_ids": ["other"]})
    assert sorted(r.projected_monthly_savings for r in recommend.dedup_insights(rows).collect()) == [9.0, 10.0]


@pytest.mark.parametrize("change, reason", [
    ({"action_type": "investigate"}, None),
    ({"action_type": "delete"}, "Delete actions permanently blocked"),
    ({"action_type": "stop"}, "Stop actions require approval"),
    ({"action_type": "stop", "status": "resolved"}, None),
    ({"action_type": "right-size", "risk_level": "high"}, "High-risk right-sizing requires approval"),
    ({"action_type": "right-size"}, None)])
def test_policy_gate(spark, change, reason):
    row = only(recommend.policy_gate(insight(spark, change)))
    assert (row.reason, row.allowed) == (reason, reason is None)


def test_roi(spark):
    recs = spark.createDataFrame([("a", 200.0), ("b", 0.0)], "recommendation_id string, total_projected_monthly_savings double")
    rows = {r.recommendation_id: r for r in recommend.roi(recs).collect()}
    assert (rows["a"].payback_months, rows["a"].roi_percent) == (2.0, 500.0)
    assert rows["b"].payback_months is None and rows["b"].roi_percent == -100.0


def test_conflicts_count_every_pair(spark):
    """Pairs of provider sets stand for all pairs of recommendations, as brute force finds them."""
    recs = [(f"id{i}", c, p) for i, (c, p) in enumerate(
        [("right_size", ["aws"])] * 4 + [("right_size", ["gcp"])] * 3 + [("right_size", ["aws", "gcp"])] * 2
        + [("idle_resource", ["aws"])] * 5 + [("general", ["aws"]), ("general", ["gcp"])])]
    df = spark.createDataFrame(recs, "recommendation_id string, category string, providers array<string>")
    want = sum(1 for i, a in enumerate(recs) for b in recs[i + 1:]
               if a[1] == b[1] and a[1] in recommend.CONFLICTING and a[2] != b[2])
    assert sum(r.pairs for r in recommend.conflicts(df).collect()) == want
    assert recommend.conflict_members(df).count() == 9


# ── Payloads and messages ─────────────────────────────────────────────────

def test_aws_payload(spark, tmp_path):
    doc = ('{"ResultsByTime":[{"TimePeriod":{"Start":"2024-01-15","End":"2024-01-16"},"Groups":['
           '{"Keys":["Amazon Elastic Compute Cloud","111","us-east-1","BoxUsage"],"Metrics":{"BlendedCost":{"Amount":"1000.00","Unit":"USD"},'
           '"UnblendedCost":{"Amount":"950.00","Unit":"USD"},"UsageQuantity":{"Amount":"720","Unit":"Hrs"}}},'
           '{"Keys":["AWS Lambda"],"Metrics":{"BlendedCost":{"Amount":"0","Unit":"USD"},"UnblendedCost":{"Amount":"0","Unit":"USD"}}}]}]}')
    (tmp_path / "a.json").write_text(doc)
    row = only(payloads.aws_to_focus(payloads.read_payloads(spark, str(tmp_path), payloads.AWS_SCHEMA), "payer"))
    assert (row.billed_cost, row.effective_cost, row.list_cost) == (Decimal("1000"), Decimal("950"), Decimal("950"))
    assert (row.sub_account_id, row.service_category, row.pricing_category) == ("111", "Compute", "On-Demand")
    assert str(row.billing_period_end)[:10] == "2024-02-01"


def test_azure_payload_with_numbers(spark, tmp_path):
    doc = ('{"columns":[{"name":"Cost"},{"name":"CostUSD"},{"name":"UsageDate"},{"name":"ServiceName"},{"name":"ReservationId"}],'
           '"rows":[[12.5,14,20240115,"Virtual Machines","r-1"],[0,0,20240115,"Storage",""]]}')
    (tmp_path / "a.json").write_text(doc)
    row = only(payloads.azure_to_focus(payloads.read_payloads(spark, str(tmp_path), payloads.AZURE_SCHEMA), "sub"))
    assert (row.effective_cost, row.list_cost, row.commitment_discount_type) == (Decimal("12.5"), Decimal("14"), "Reserved")
    assert (str(row.charge_period_start)[:10], str(row.charge_period_end)[:10]) == ("2024-01-15", "2024-01-16")


def test_messages_round_trip(spark, billing):
    rows = billing({}, {"resource_id": None, "tags": {}})
    sent = messages.to_messages(rows)
    good, bad = messages.decode_billing(sent.select("value").unionByName(
        spark.createDataFrame([("{broken",), ("[1]",)], "value string")))
    assert bad.count() == 2
    got = good.select("effective_cost", "charge_period_start", "tags").collect()
    assert len(got) == 2 and got[0].effective_cost == Decimal("80") and got[0].tags == {"team": "platform", "env": "production"}


def test_one_partition_per_provider_without_spread(billing):
    rows = messages.to_messages(billing({}, {"provider_name": "azure"}, {"provider_name": "gcp"}), spread=1)
    assert sorted(r.partition for r in rows.collect()) == [0, 4, 8]


# ── Table, exports, audit, plug-ins ───────────────────────────────────────

def test_table_prunes_months_and_pushes_filters(spark, billing, tmp_path):
    path = str(tmp_path / "t")
    feb = dt.datetime(2024, 2, 3, tzinfo=dt.timezone.utc)
    billing_table.write_billing(billing({}, {"charge_period_start": feb, "effective_cost": Decimal("5")}), path)
    billing_table.write_billing(billing({"charge_period_start": feb, "effective_cost": Decimal("7")}), path)
    rows = billing_table.read_billing(spark, path, "2024-02-01", "2024-02-28")
    assert [r.effective_cost for r in rows.collect()] == [Decimal("7")]
    assert spark.read.parquet(path).count() == 2
    plan = rows.select("effective_cost")._jdf.queryExecution().executedPlan().toString()
    assert "charge_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "charge_period_start" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "resource_id" not in plan.split("ReadSchema:")[1]


def test_export_has_33_columns(billing):
    rows = exports.export_rows(staging.stage_billing(billing({})), "2024-01-01", "2024-01-31")
    assert len(rows.columns) == 33 and rows.columns[0] == "BillingAccountId" and rows.columns[-1] == "Tags"
    assert only(exports.typed_cells(rows)).EffectiveCost == 80.0


def test_batches_are_bounded_and_whole(spark):
    rows = audit.batch_ids(spark.range(5000).repartition(6).select(F.col("id").cast("string").alias("k")), "k", 7)
    sizes = [r["count"] for r in rows.groupBy("batch_id").count().orderBy("batch_id").collect()]
    assert sizes == [7] * 714 + [2]
    edges = rows.groupBy("batch_id").agg(F.min("k").alias("low"), F.max("k").alias("high")).orderBy("batch_id").collect()
    assert all(a["high"] < b["low"] for a, b in zip(edges, edges[1:]))


def test_numbers_in_groups_hold_nulls_and_hot_groups(spark):
    from spendlake.operators.numbering import numbered

    df = spark.range(2000).repartition(7).selectExpr("case when id % 10 < 8 then 'hot' when id % 10 = 8 then null else 'b' end as g", "id % 50 as v", "id")
    rows = numbered(df, ["v", "id"], "n", ["g"]).collect()
    for g in ("hot", None, "b"):
        own = sorted((r["n"], r["v"], r["id"]) for r in rows if r["g"] == g)
        assert [n for n, _, _ in own] == list(range(len(own))) and [o[1:] for o in own] == sorted(o[1:] for o in own)
    assert len(rows) == 2000 and numbered(df.filter("false"), ["v"], "n").count() == 0


def test_metric_points(spark):
    daily = spark.createDataFrame([("aws", "VM", None, "1", 5.0)], "provider_name string, service_name string, region_id string, billing_account_id string, total_cost double")
    rows = {r.metric: r for r in metrics.metric_points(daily).collect()}
    assert set(rows) == {f"finops.cost.{m}" for m in ("daily", "by_service", "by_provider", "by_region")}
    assert rows["finops.cost.by_region"].tags == ["region:unknown", "source:finops"]


def test_audit_jsonl_appends(spark, small, tmp_path):
    from spendlake.sources.driver_tables import Tables

    events = audit.audit_events(Tables(spark, small).events)
    path = str(tmp_path / "audit")
    exports.write_audit_jsonl(events, path)
    exports.write_audit_jsonl(events, path, compress=True)
    assert spark.read.text(path).count() == 2 * events.count()


def test_plugin_contract(spark):
    with pytest.raises(ValueError):
        plugins.check_insights(spark.createDataFrame([("aws",)], "provider string"), "x")
    fixed = plugins.check_insights(spark.createDataFrame([("aws", "t")], "provider string, title string"), "x")
    assert fixed.schema == schema.INSIGHT_SCHEMA


def test_coverage_of_findings_without_a_figure_counts_as_none(spark):
    rows = insight(spark, dict(category="tag_compliance", coverage_pct=60.0), dict(category="tag_compliance", coverage_pct=None, insight_id="other"))
    assert "30% coverage" in recommend.synthesise(rows).first()["title"]


def test_date_ranges_prune_months(spark, billing, tmp_path):
    """Every question with a range reads its months only."""
    path = str(tmp_path / "table")
    billing_table.write_billing(billing({}), path)
    b = staging.stage_billing(billing_table.read_billing(spark, path))
    daily = [
        staging.retain(b, "2024-01-31", 1), exports.export_rows(b, "2024-01-01", "2024-01-31"),
        spend.overview_by_service(b, "2024-01-01", "2024-01-31"), spend.spike_annotations(b, "2024-01-01", "2024-01-31"),
        spend.daily_cost_points(b, "2024-01-01"),
        spend.recent(b, "2024-01-31", 30),
    ]
    for df in daily:
        plan = df._jdf.queryExecution().toString()
        filters = [x.split("PartitionFilters: [")[1].split("]")[0] for x in plan.splitlines() if "PartitionFilters: [" in x]
        assert filters and all("charge_month" in f for f in filters), filters


def test_dashboard_and_monitor_take_a_range_of_the_daily_rollup(spark):
    from datetime import date, timedelta

    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(60)]
    daily = spark.createDataFrame([("aws", "VM", d, Decimal(i + 1)) for i, d in enumerate(days)],
                                  "provider_name string, service_name string, day date, total_effective_cost decimal(18,6)")
    rows = spend.dashboard_widgets(daily, start="2024-02-10", end="2024-02-12").collect()
    rolling = {r["day"]: r["value"] for r in rows if r["widget"] == "monthly_cost"}
    assert rolling == {days[i]: float(sum(range(i - 28, i + 2))) for i in (40, 41, 42)}
    assert [r["value"] for r in rows if r["widget"] == "top_services"] == [41.0 + 42.0 + 43.0]
    plan = spark.createDataFrame([("x", "aws", None, 1290.0)], "name string, provider string, service string, monthly_threshold double")
    hit = budgets.monitor_thresholds(daily, plan, "2024-02-10", "2024-02-13").collect()
    assert sorted((r["day"], r["level"]) for r in hit) == [(days[40], "warning"), (days[41], "warning"), (days[42], "warning"), (days[43], "critical")]


def test_levels_of_any_width():
    assert series.z_value(0.95) == 1.96 and abs(series.z_value(0.5) - 0.6745) < 1e-4
    with pytest.raises(ValueError):
        series.z_value(1.0)


# ── Parsed rows and detectors ─────────────────────────────────────────────

def test_detectors_find_parsed_rows(spark, tmp_path):
    cost = {"Amount": "900", "Unit": "USD"}
    group = {"Keys": ["Amazon Elastic Compute Cloud - Compute", "acct", "us-east-1", "BoxUsage"],
             "Metrics": {"BlendedCost": cost, "UnblendedCost": cost, "UsageQuantity": {"Amount": "1", "Unit": "Hrs"}}}
    document = {"ResultsByTime": [{"TimePeriod": {"Start": "2024-01-10", "End": "2024-01-11"}, "Groups": [group]}]}
    (tmp_path / "a.json").write_text(json.dumps(document))
    parsed = payloads.aws_to_focus(payloads.read_payloads(spark, str(tmp_path), payloads.AWS_SCHEMA), "payer")
    row = only(payloads.normalised(parsed))
    assert (row.service_name, row.service_category, row.region_name) == ("Virtual Machine", "Compute", "US East (N. Virginia)")
    b = staging.stage_billing(payloads.normalised(parsed))
    assert only(detectors.idle_vms(b, "2024-01-31")).region == "us-east-1"
    assert only(detectors.aws_commitment_gap(b, "2024-01-31")).service_name == "Virtual Machine"


# ── Boosted trees ─────────────────────────────────────────────────────────

def test_trees_know_the_series_and_forecast_ahead(spark):
    """Two series that differ in level only where their lags do not show it, and days after the last."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = [(k, d, base + 10.0 * (d.weekday() >= 5) + (i * 37 % 11)) for k, base in (("a", 100.0), ("b", 300.0)) for i, d in enumerate(days)]
    made = series.gbt_forecast(spark.createDataFrame(rows, "key string, ds date, y double"), trees=5, horizon=3).collect()
    ahead = {(r.key, r.ds): r.predicted for r in made if r.y is None}
    assert set(ahead) == {(k, days[-1] + dt.timedelta(days=i)) for k in "ab" for i in (1, 2, 3)}
    assert len(made) == 2 * (120 - 14) + 6
    assert all(abs(p - (100 if k == "a" else 300)) < 40 for (k, _), p in ahead.items())
    y = {(k, d): v for k, d, v in rows}
    fitted = [r for r in made if r.y is not None]
    naive = sum(abs(r.y - y[r.key, r.ds - dt.timedelta(days=7)]) for r in fitted)
    assert sum(abs(r.y - r.predicted) for r in fitted) < naive



def test_boosted_trees_read_their_input_once(spark, tmp_path):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i % 7) for i in range(40)]
    spark.createDataFrame(rows, "key string, ds date, y double").write.parquet(f"{tmp_path}/series")
    made = series.gbt_forecast(spark.read.parquet(f"{tmp_path}/series"), trees=2, horizon=2)
    assert made.count() == 40 - 14 + 2
    assert not [f for f in made.inputFiles() if str(tmp_path) in f]

def test_the_registered_trees_are_of_full_size(monkeypatch):
    import inspect

    from spendlake.plans import catalog, registry  # noqa: F401

    given, own = {}, inspect.signature(series.gbt_forecast)
    monkeypatch.setattr(series, "gbt_forecast", lambda *a, **more: given.update(own.bind(*a, **more).arguments))
    monkeypatch.setattr("spendlake.plans.catalog_series.provider_series", lambda t: None)
    registry.QUERIES["m6_gbt_forecast"](None)
    assert given.get("trees", own.parameters["trees"].default) == 500


# ── Data skipping of the stored table ─────────────────────────────────────

def _rows_scanned(df):
    """Rows that the scan hands on after row groups and pages were left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_single_resources_teams_accounts_and_days_leave_row_groups_out(spark, small, tmp_path):
    from pyspark.sql import functions as F

    from spendlake.sources import billing_table
    from spendlake.sources.driver_tables import Tables

    # All charges in one month, 20 resources apart by provider, so that one file has many row groups.
    rows = Tables(spark, small).billing
    rows = rows.withColumn("charge_period_start", F.expr("timestamp'2024-05-01' + make_interval(0, 0, 0, pmod(hash(charge_description, resource_id), 30), pmod(hash(resource_id), 24))"))
    path = str(tmp_path / "billing")
    billing_table.write_billing(rows.coalesce(1), path, row_group_bytes=48 << 10)
    whole = billing_table.read_billing(spark, path)
    n = whole.count()
    assert set(whole.columns) == {*rows.columns, "charge_month"} and n == rows.count()
    busy = rows.filter("resource_id <> ''").groupBy("resource_id").count().orderBy("count", "resource_id").first()
    account = rows.groupBy("billing_account_id").count().orderBy("count", "billing_account_id").first()[0]
    questions = {
        "resource": (dict(resources=[busy["resource_id"]]), F.col("resource_id") == busy["resource_id"]),
        "account": (dict(accounts=[account]), F.col("billing_account_id") == account),
        "days": (dict(start="2024-05-03", end="2024-05-04"), F.to_date("charge_period_start").between("2024-05-03", "2024-05-04")),
        "no such team": (dict(tags={"team": "nobody"}), F.lit(False)),
    }
    for name, (how, test) in questions.items():
        got = billing_table.read_billing(spark, path, **how)
        assert got.count() == rows.filter(test).count(), name
        assert _rows_scanned(billing_table.read_billing(spark, path, **how).select("effective_cost", "resource_id")) < 0.7 * n, name
    team = rows.filter("tags['team'] <> ''").select("tags").first()["tags"]["team"]
    assert billing_table.read_billing(spark, path, tags={"team": team}).count() == rows.filter(F.col("tags")["team"] == team).count()


# ── Seasons and bends ─────────────────────────────────────────────────────

def test_seasons_beat_the_line_on_a_yearly_series_and_the_sums_equal_least_squares(spark):
    import math
    from datetime import date, timedelta

    import numpy as np

    from spendlake.operators import seasonal, series

    first = date(2020, 1, 1)

    def true(i):
        return 1000 + 300 * math.sin(2 * math.pi * i / 365.25) + 40 * ((first + timedelta(days=i)).weekday() == 5) + 2 * max(0, i - 800)

    days = [first + timedelta(days=i) for i in range(1400)]
    rng = np.random.default_rng(5)
    rows = [("a", d, true(i) + float(rng.normal(0, 5))) for i, d in enumerate(days)] + [("short", d, 7.0) for d in days[:20]]
    known = spark.createDataFrame([r for r in rows if r[1] < days[1300]], "key string, ds date, y double")
    error = {}
    for name, ahead in (("seasons", seasonal.forecast(known, 90)), ("line", series.forecast(known, 90))):
        got = {r.ds: r.predicted for r in ahead.where("key = 'a'").collect()}
        assert len(got) == 90
        error[name] = sum(abs(got[d] - true((d - first).days)) for d in got) / 90
    assert error["seasons"] < 60 and error["seasons"] < error["line"] / 3
    models = {r.key: r for r in seasonal.fit(known).collect()}
    assert abs(models["short"].sigma) < 1e-6
    # The same weights by least squares over all days at once, the ridge as further rows.
    n = 1300
    t = np.arange(n) / (n - 1)
    x = np.asarray([(d - date(1970, 1, 1)).days for d in days[:n]])
    wave = lambda p, k: [np.sin(2 * np.pi * k * x / p), np.cos(2 * np.pi * k * x / p)]
    phi = np.stack([np.ones(n), t, *[np.maximum(t - (i + 1) / 6, 0) for i in range(5)],
                    *[w for k in (1, 2, 3) for w in wave(7.0, k)], *[w for k in (1, 2, 3) for w in wave(365.25, k)]], 1)
    ridge = np.diag([0.0, 0.0] + [1.0] * (phi.shape[1] - 2))
    want = np.linalg.lstsq(np.r_[phi, ridge], np.r_[[r[2] for r in rows[:n]], np.zeros(len(ridge))], rcond=None)[0]
    assert np.allclose(models["a"].weights, want, rtol=1e-6, atol=1e-6)


# ── Isolation ─────────────────────────────────────────────────────────────

def test_mean_depth_of_random_cuts():
    """Against the recursion over every place of the first cut."""
    import numpy as np

    from spendlake.operators import isolation

    exact = {1: 0.0, 2: 1.0}
    for n in range(3, 300):  # depth(n) = 1 + mean over the cut of the two sides, weighted by their points
        exact[n] = 1 + sum(k * exact[k] + (n - k) * exact[n - k] for k in range(1, n)) / (n - 1) / n
    for n in (10, 50, 299):
        assert abs(float(isolation.mean_depth(n)) - exact[n]) < 0.2
    same = np.zeros((40, 3))
    assert np.allclose(isolation.scores(same, np.random.default_rng(1)), 0.5)


def test_isolation_finds_planted_days_alike_in_any_partitions(spark):
    from datetime import date, timedelta

    import numpy as np

    from spendlake.operators import isolation

    rng = np.random.default_rng(3)
    planted = {50, 120, 333}
    rows = [(k, date(2023, 1, 1) + timedelta(days=i), float(rng.normal(100, 5)) + (400 if i in planted else 0)) for k in ("a", "b") for i in range(400)]
    rows += [("flat", date(2023, 1, 1) + timedelta(days=i), 5.0) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, ds date, y double")
    one = {(r.key, r.ds): (r.isolation_score, r.isolated) for r in isolation.outliers(df.coalesce(1)).collect()}
    many = {(r.key, r.ds): (r.isolation_score, r.isolated) for r in isolation.outliers(df.repartition(7)).collect()}
    assert one == many and len(one) == len(rows)
    for k in ("a", "b"):
        own = sorted(((s, d) for (key, d), (s, _) in one.items() if key == k), reverse=True)
        top = {(d - date(2023, 1, 1)).days for _, d in own[:10]}
        assert planted <= top
        assert sum(f for (key, _), (_, f) in one.items() if key == k) == 20
    assert not any(f for (key, _), (_, f) in one.items() if key == "flat")


# ── Plug-ins: commit, abort and pushed filters ────────────────────────────

class _BreaksOn(plugins.JsonLines):
    def encode(self, batch) -> bytes:
        if any(row["id"] == 777 for row in batch.to_pylist()):
            raise ValueError("no room")
        return super().encode(batch)


def test_a_failed_export_leaves_nothing_and_the_manifest_counts(spark, tmp_path):
    import os

    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="no room"):
        plugins.export_files(spark.range(1000).repartition(4), path, _BreaksOn())
    assert plugins.exported_files(path) == [] and not any(files for _, _, files in os.walk(path))
    manifest = plugins.export_files(spark.range(500).repartition(4), path, _BreaksOn())
    assert manifest["records"] == 500 and manifest["bytes"] == sum(os.path.getsize(f) for f in plugins.exported_files(path))
    with pytest.raises(Exception, match="no room"):
        plugins.export_files(spark.range(1000), path, _BreaksOn())
    assert spark.read.json(plugins.exported_files(path)).count() == 500


class _Days(plugins.Connector):
    day_column = "day"

    def __init__(self, options) -> None:
        self.log = options["log"]

    def fetch(self, start, end, account):
        import pyarrow as pa

        with open(f"{self.log}/{start}_{end}", "w"):
            pass
        n = (end - start).days
        yield pa.record_batch([pa.array([start.toordinal() + i - 719163 for i in range(n)], pa.int32()).cast(pa.date32())], names=["day"])


def test_filters_on_the_day_narrow_what_a_connector_fetches(spark, tmp_path):
    import os

    plugins.register_sources(spark, plugins.connector_source("days_of_a_test", _Days, "day date"))
    rows = spark.read.format("days_of_a_test").options(log=str(tmp_path), start="2024-01-01", end="2025-01-01").load()
    assert rows.filter("day >= date'2024-03-05' and day < date'2024-04-02'").count() == 28
    assert sorted(os.listdir(tmp_path)) == ["2024-03-05_2024-04-01", "2024-04-01_2024-04-03"]


def test_text_files_of_exports_and_payloads_are_packed(spark, small):
    from spendlake.plans import catalog_sources
    from spendlake.session import run_dir
    from spendlake.sources.driver_tables import Tables

    t = Tables(spark, small)
    for fmt in ("csv", "jsonl"):
        path = run_dir(spark, "export")
        exports.export_focus(t.staged, fmt, path, "1990-01-01", "2010-01-01")
        read = (lambda p: spark.read.option("header", True).csv(p)) if fmt == "csv" else spark.read.json
        assert all(f.endswith(".gz") for f in read(path).inputFiles()) and read(path).count() == t.staged.count()
    assert all(f.endswith(".json.gz") for f in catalog_sources.gcp_rows(t).inputFiles())


def test_messages_are_decoded_once_for_both_kinds(spark, small):
    from spendlake.plans.catalog import QUERIES
    from spendlake.sources.driver_tables import Tables

    plan = QUERIES["s6_decode_billing"](Tables(spark, small))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_exported_files_are_sorted_by_day(spark, small, tmp_path):
    from spendlake.sinks import exports
    from spendlake.sources.driver_tables import Tables

    b = Tables(spark, small).staged
    exports.export_focus(b, "csv", str(tmp_path / "csv"), "1990-01-01", "2010-12-31")
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert rows.count() == exports.export_rows(b, "1990-01-01", "2010-12-31").count()
    day = F.col("ChargePeriodStart")
    at = rows.select(F.input_file_name().alias("f"), day.alias("day")).withColumn("n", F.monotonically_increasing_id())
    from pyspark.sql import Window

    before = F.lag("day").over(Window.partitionBy("f").orderBy("n"))
    assert at.withColumn("before", before).filter("before > day").count() == 0
