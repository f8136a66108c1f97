"""Registered series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlake.operators import isolation, seasonal, series
from spendlake.plans.catalog_spend import DAYS, END
from spendlake.plans.registry import query
from spendlake.sources.driver_tables import Tables


def series_cte(key: str) -> str:
    return f"""sr AS (SELECT * FROM (SELECT coalesce({key}, '') AS key, charge_date AS ds,
  CAST(sum(effective_cost) AS DOUBLE) AS y FROM b GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY key) >= 14)"""


EVENTS_CTE = """sr AS (SELECT * FROM (SELECT event_type AS key, CAST(ts AS DATE) AS ds,
  CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS y FROM events GROUP BY ALL)
  QUALIFY count(*) OVER (PARTITION BY key) >= 14)"""

FIT_CTE = """f0 AS (SELECT *, CAST(datediff('day', DATE '1970-01-01', ds) AS DOUBLE) AS x, isodow(ds) - 1 AS dow FROM sr),
fl AS (SELECT key, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, max(ds) AS last FROM f0 GROUP BY key),
fr AS (SELECT f0.*, slope, intercept, last, y - intercept - slope * x AS r FROM f0 JOIN fl USING (key)),
fe AS (SELECT key, dow, avg(r) AS effect FROM fr GROUP BY ALL),
fs AS (SELECT key, coalesce(stddev_samp(r - effect), 0) AS sigma FROM fr JOIN fe USING (key, dow) GROUP BY key),
fit AS (SELECT fr.*, effect, sigma, intercept + slope * x + effect AS yhat FROM fr JOIN fe USING (key, dow) JOIN fs USING (key))"""

AHEAD_CTE = """ah AS (SELECT key, slope, intercept, sigma, CAST(unnest(generate_series(last + 1, last + {h}, INTERVAL 1 DAY)) AS DATE) AS ds
  FROM fl JOIN fs USING (key)),
fc AS (SELECT ah.key, ah.ds, intercept + slope * datediff('day', DATE '1970-01-01', ah.ds) + coalesce(effect, 0) AS predicted, sigma
  FROM ah LEFT JOIN fe ON fe.key = ah.key AND fe.dow = isodow(ah.ds) - 1)"""


# To hundredths. What lies half-way goes up, whatever the order of a sum.
NUDGE = 1e-5


def CENTS(expr: str) -> str:
    return f"round(({expr}) + {NUDGE}, 2)"


def cents(column):
    return F.round(F.col(column) + NUDGE, 2)


def service_series(t: Tables):
    return series.cost_series(t.staged, "service", END, DAYS)


def provider_series(t: Tables):
    return series.cost_series(t.staged, "total", END, DAYS)


def event_series(t: Tables):
    return series.value_series(t.events, "event_type", "ts", "value")


for _g, _c in (("service", "service_name"), ("team", "tag_team"), ("environment", "tag_env"), ("total", "provider_name")):
    query(f"m1_cost_series_{_g}", f"WITH {series_cte(_c)} SELECT key, ds, round(y, 4) AS y FROM sr")(
        lambda t, g=_g: series.cost_series(t.staged, g, END, DAYS).select("key", "ds", F.round("y", 4).alias("y")))

for _name, _cte, _src, _billing in (("service", series_cte("service_name"), service_series, True),
                                    ("events", EVENTS_CTE, event_series, False)):
    query(f"m2_forecast_{_name}", f"""
WITH {_cte}, {FIT_CTE}, {AHEAD_CTE.format(h=90)}
SELECT key, ds, {CENTS('predicted')} AS predicted, {CENTS('predicted - 1.96 * sigma')} AS lower,
  {CENTS('predicted + 1.96 * sigma')} AS upper FROM fc""", billing=_billing)(
        lambda t, s=_src: series.forecast(s(t), 90).select("key", "ds", *[cents(c).alias(c) for c in ("predicted", "lower", "upper")]))

# The terms of a day, the sums of the normal equations and their solution by elimination, as SQL.
_PI2 = "2 * pi()"
_TERMS = (["1.0", "t"] + [f"greatest(t - {i + 1}.0 / 6.0, 0)" for i in range(5)]
          + [f"{f}(x * ({_PI2} * {k} / 7.0))" for k in (1, 2, 3) for f in ("sin", "cos")]
          + [f"CASE WHEN span >= 730 THEN {f}(x * ({_PI2} * {k} / 365.25)) ELSE 0 END" for k in (1, 2, 3) for f in ("sin", "cos")])
_N = len(_TERMS)
_MATRIX = ", ".join(
    "[" + ", ".join([f"sum(p[{min(i, j)}] * p[{max(i, j)}])" + (" + 1.0" if i == j > 2 else "") for j in range(1, _N + 1)] + [f"sum(p[{i}] * y)"]) + "]"
    for i in range(1, _N + 1))
SEASONAL_CTE = f"""ex AS (SELECT key, min(ds) AS first, max(ds) AS last, datediff('day', min(ds), max(ds)) AS span FROM sr GROUP BY key),
days AS (SELECT key, ds, y FROM sr UNION ALL
  SELECT key, CAST(unnest(generate_series(last + 1, last + 90, INTERVAL 1 DAY)) AS DATE), NULL FROM ex),
dt AS (SELECT key, ds, y, span, CAST(datediff('day', DATE '1970-01-01', ds) AS DOUBLE) AS x,
  datediff('day', first, ds)::DOUBLE / greatest(span, 1) AS t FROM days JOIN ex USING (key)),
ph AS MATERIALIZED (SELECT key, ds, y, [{", ".join(f"({t})::DOUBLE" for t in _TERMS)}] AS p FROM dt),
el(key, k, m) AS (SELECT key, 1, [{_MATRIX}] FROM ph WHERE y IS NOT NULL GROUP BY key UNION ALL
  SELECT key, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
    ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM el WHERE k <= {_N}),
wt AS (SELECT key, list_transform(m, lambda r: r[{_N + 1}]) AS w FROM el WHERE k = {_N + 1}),
ev AS MATERIALIZED (SELECT key, ds, y, list_dot_product(w, p) AS yhat FROM ph JOIN wt USING (key)),
sg AS (SELECT key, coalesce(stddev_samp(y - yhat), 0) AS sigma FROM ev WHERE y IS NOT NULL GROUP BY key)"""

for _name, _cte, _src, _billing in (("service", series_cte("service_name"), service_series, True),
                                    ("events", EVENTS_CTE, event_series, False)):
    query(f"m2_seasonal_forecast_{_name}", f"""
WITH RECURSIVE {_cte}, {SEASONAL_CTE}
SELECT key, ds, {CENTS('yhat')} AS predicted, {CENTS('yhat - 1.96 * sigma')} AS lower, {CENTS('yhat + 1.96 * sigma')} AS upper
FROM ev JOIN sg USING (key) WHERE y IS NULL""", billing=_billing)(
        lambda t, s=_src: seasonal.forecast(s(t), 90).select("key", "ds", *[cents(c).alias(c) for c in ("predicted", "lower", "upper")]))


@query("m3_seasonal_anomalies", f"""
WITH RECURSIVE {series_cte('provider_name')}, {SEASONAL_CTE}
SELECT key, ds, {CENTS('y')} AS actual_cost, {CENTS('yhat')} AS expected_cost,
  {CENTS('CASE WHEN yhat > 0 THEN abs(y - yhat) / yhat * 100 ELSE 0 END')} AS deviation_percent
FROM ev JOIN sg USING (key) WHERE abs(y - yhat) > 1.96 * sigma""")
def _(t: Tables):
    return seasonal.anomalies(provider_series(t)).select(
        "key", "ds", *[cents(c).alias(c) for c in ("actual_cost", "expected_cost", "deviation_percent")])


    query(f"m3_interval_anomalies_{_name}", f"""
WITH {_cte}, {FIT_CTE}, a AS (SELECT *, 1.6449 * sigma AS half,
  CASE WHEN yhat > 0 THEN abs(y - yhat) / yhat * 100 ELSE 0 END AS deviation FROM fit)
SELECT key, ds, round(y, 2) AS actual_cost, round(yhat, 2) AS expected_cost, round(half, 2) AS uncertainty,
  round(deviation, 2) AS deviation_percent, CASE WHEN deviation > 50 THEN 'critical' ELSE 'high' END AS severity,
  round(abs(y - yhat) / (2 * half), 6) AS anomaly_score
FROM a WHERE y > yhat + half OR y < yhat - half""", billing=_billing)(
        lambda t, s=_src: series.interval_anomalies(s(t), 0.90).select(
            "key", "ds", *[F.round(c, 2).alias(c) for c in ("actual_cost", "expected_cost", "uncertainty", "deviation_percent")],
            "severity", F.round("anomaly_score", 6).alias("anomaly_score")))


FEATURE_CTE = """ft AS (SELECT key, ds, y, coalesce(y - lag(y) OVER o, 0) AS y_diff,
  avg(y) OVER (o ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS y_roll_mean,
  coalesce(stddev_samp(y) OVER (o ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS y_roll_std
  FROM sr WINDOW o AS (PARTITION BY key ORDER BY ds)),
md AS (SELECT key, median(y) AS m1, median(y_diff) AS m2, median(y_roll_mean) AS m3, median(y_roll_std) AS m4 FROM ft GROUP BY key),
dv AS (SELECT key, ds, y, abs(y - m1) AS d1, abs(y_diff - m2) AS d2, abs(y_roll_mean - m3) AS d3, abs(y_roll_std - m4) AS d4
  FROM ft JOIN md USING (key)),
ms AS (SELECT key, median(d1) AS s1, median(d2) AS s2, median(d3) AS s3, median(d4) AS s4 FROM dv GROUP BY key),
ds_ AS (SELECT key, ds, y, CASE WHEN s1 > 0 THEN d1 / s1 ELSE 0 END + CASE WHEN s2 > 0 THEN d2 / s2 ELSE 0 END
  + CASE WHEN s3 > 0 THEN d3 / s3 ELSE 0 END + CASE WHEN s4 > 0 THEN d4 / s4 ELSE 0 END AS distance FROM dv JOIN ms USING (key)),
fo AS (SELECT *, percent_rank() OVER (PARTITION BY key ORDER BY round(distance, 9)) AS outlier_score FROM ds_)"""


@query("m4_outlier_features", f"""
WITH {EVENTS_CTE}, {FEATURE_CTE} SELECT key, ds, round(y, 4) AS y, round(y_diff, 4) AS y_diff,
  round(y_roll_mean, 4) AS y_roll_mean, round(y_roll_std, 4) AS y_roll_std FROM ft""", billing=False)
def _(t: Tables):
    return series.outlier_features(event_series(t)).select(
        "key", "ds", *[F.round(c, 4).alias(c) for c in series.FEATURES])


@query("m4_feature_outliers", f"""
WITH {series_cte('service_name')}, {FEATURE_CTE} SELECT key, ds, round(distance, 6) AS distance,
  round(outlier_score, 9) AS outlier_score, outlier_score > 0.95 AS outlier FROM fo""")
def _(t: Tables):
    return series.feature_outliers(service_series(t)).select(
        "key", "ds", F.round("distance", 6).alias("distance"), F.round("outlier_score", 9).alias("outlier_score"), "outlier")


@query("m5_consensus_anomalies", f"""
WITH {series_cte('service_name')}, {FIT_CTE}, {FEATURE_CTE}
SELECT key, ds, y > yhat + 1.96 * sigma OR y < yhat - 1.96 * sigma AS anomaly_interval, outlier_score > 0.95 AS anomaly_outlier,
  anomaly_interval AND anomaly_outlier AS anomaly,
  round((abs(fit.y - yhat) / (2 * 1.96 * sigma) + outlier_score) / 2, 6) AS anomaly_score
FROM fit JOIN (SELECT key, ds, outlier_score FROM fo) USING (key, ds)""")
def _(t: Tables):
    return series.consensus_anomalies(service_series(t)).drop("y").withColumn(
        "anomaly_score", F.round("anomaly_score", 6))


# Random trees are beyond SQL: tests hold the depths against a plain walk, and plant outliers.
@query("m4_isolation_outliers")
def _(t: Tables):
    return isolation.outliers(service_series(t)).select("key", "ds", F.round("isolation_score", 9).alias("isolation_score"), "isolated")


@query("m5_isolation_consensus")
def _(t: Tables):
    return isolation.consensus(service_series(t)).drop("y").withColumn("anomaly_score", F.round("anomaly_score", 9))


@query("m6_lag_features", f"""
WITH {EVENTS_CTE}, l AS (SELECT key, ds, y, isodow(ds) - 1 AS dayofweek, month(ds) AS month, day(ds) AS day, quarter(ds) AS quarter,
  year(ds) AS year, (isodow(ds) >= 6)::INT AS is_weekend, lag(y, 1) OVER o AS lag_1, lag(y, 7) OVER o AS lag_7, lag(y, 14) OVER o AS lag_14,
  avg(y) OVER (o ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
  stddev_samp(y) OVER (o ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_std_7
  FROM sr WINDOW o AS (PARTITION BY key ORDER BY ds))
SELECT key, ds, round(y, 4) AS y, dayofweek, month, day, quarter, year, is_weekend, round(lag_1, 4) AS lag_1, round(lag_7, 4) AS lag_7,
  round(lag_14, 4) AS lag_14, round(rolling_mean_7, 4) AS rolling_mean_7, round(rolling_std_7, 4) AS rolling_std_7
FROM l WHERE lag_14 IS NOT NULL""", billing=False)
def _(t: Tables):
    rounded = ["y", "lag_1", "lag_7", "lag_14", "rolling_mean_7", "rolling_std_7"]
    return series.lag_features(event_series(t)).withColumns({c: F.round(c, 4) for c in rounded})


@query("m6_gbt_forecast")
def _(t: Tables):
    return series.gbt_forecast(provider_series(t))


@query("m7_backtest", f"""
WITH {series_cte('service_name')}, n AS (SELECT *, CAST(datediff('day', DATE '1970-01-01', ds) AS DOUBLE) AS x, isodow(ds) - 1 AS dow,
  row_number() OVER (PARTITION BY key ORDER BY ds) <= floor(count(*) OVER (PARTITION BY key) * CAST(0.8 AS DOUBLE)) AS train FROM sr
  QUALIFY count(*) OVER (PARTITION BY key) >= 30),
l AS (SELECT key, regr_slope(y, x) AS a, regr_intercept(y, x) AS c FROM n WHERE train GROUP BY key),
e AS (SELECT key, dow, avg(y - c - a * x) AS effect FROM n JOIN l USING (key) WHERE train GROUP BY ALL),
p AS (SELECT n.key, train, y, c + a * x + coalesce(effect, 0) AS yhat FROM n JOIN l USING (key) LEFT JOIN e USING (key, dow))
SELECT key, count(*) FILTER (train) AS train_points, count(*) FILTER (NOT train) AS test_points, CAST(0.8 AS DOUBLE) AS train_ratio,
  round(avg(CASE WHEN NOT train AND y <> 0 THEN abs(y - yhat) / abs(y) END) * 100, 2) AS mape_percent,
  round(sqrt(avg(CASE WHEN NOT train THEN (y - yhat) * (y - yhat) END)), 2) AS rmse FROM p GROUP BY key""")
def _(t: Tables):
    return series.backtest(service_series(t))


@query("m8_rolling_origin_eval", f"""
WITH {series_cte('provider_name')}, k AS (SELECT key, min(ds) AS first, max(ds) AS last FROM sr GROUP BY key),
c AS (SELECT * FROM (SELECT key, last, first, unnest(generate_series(0, CAST(floor((datediff('day', first, last) - 90) / 30) AS BIGINT) - 1)) AS i FROM k)
  ),
cu AS (SELECT key, i, last - CAST(30 * (i + 1) AS INTEGER) AS cut FROM c),
tr AS (SELECT cu.key, i, sr.y, CAST(datediff('day', cut, ds) AS DOUBLE) AS x, isodow(ds) - 1 AS dow FROM cu JOIN sr ON sr.key = cu.key AND ds <= cut),
l AS (SELECT key, i, regr_slope(y, x) AS a, regr_intercept(y, x) AS c FROM tr GROUP BY ALL),
r AS (SELECT tr.*, a, c, y - c - a * x AS r FROM tr JOIN l USING (key, i)),
e AS (SELECT key, i, dow, avg(r) AS effect FROM r GROUP BY ALL),
s AS (SELECT key, i, stddev_samp(r - effect) AS sigma FROM r JOIN e USING (key, i, dow) GROUP BY ALL),
te AS (SELECT cu.key, i, sr.y, CAST(datediff('day', cut, ds) AS DOUBLE) AS x, isodow(ds) - 1 AS dow FROM cu JOIN sr
  ON sr.key = cu.key AND ds > cut AND ds <= cut + 30),
p AS (SELECT te.key, te.i, y, c + a * x + coalesce(effect, 0) AS yhat, sigma FROM te JOIN l USING (key, i)
  JOIN s USING (key, i) LEFT JOIN e USING (key, i, dow))
SELECT key, count(DISTINCT i) AS cutoffs, count(*) AS points, round(avg(abs(y - yhat)), 2) AS mae,
  round(sqrt(avg((y - yhat) * (y - yhat))), 2) AS rmse, round(avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) * 100, 2) AS mape,
  round(avg(CASE WHEN abs(y - yhat) <= 1.96 * sigma THEN 1.0 ELSE 0.0 END), 4) AS coverage FROM p GROUP BY key""")
def _(t: Tables):
    return series.rolling_origin_eval(provider_series(t))


@query("m9_anomaly_metrics", f"""
WITH {series_cte('service_name')}, {FIT_CTE}, a AS (SELECT key, ds, y, yhat, abs(y - yhat) / (2 * 1.6449 * sigma) AS score FROM fit
  WHERE y > yhat + 1.6449 * sigma OR y < yhat - 1.6449 * sigma),
m AS (SELECT *, CASE WHEN yhat = 0 THEN 100 ELSE round((y - yhat) / yhat * 100, 2) END AS pct FROM a)
SELECT key, ds, round(y - yhat, 2) AS cost_delta, pct AS percentage_increase, pct > 20 AND score > 0.5 AS is_significant FROM m""")
def _(t: Tables):
    return series.anomaly_metrics(series.interval_anomalies(service_series(t), 0.90)).select(
        "key", "ds", F.round("cost_delta", 2).alias("cost_delta"), "percentage_increase", "is_significant")


TOTALS_CTE = """ft_ AS (SELECT key, count(*) AS horizon_days, round(sum(predicted), 2) AS projected_total_cost,
  round(sum(predicted - 1.96 * sigma), 2) AS lower, round(sum(predicted + 1.96 * sigma), 2) AS upper FROM fc GROUP BY key)"""
SERVICE_TOTALS = f"{series_cte('service_name')}, {FIT_CTE}, {AHEAD_CTE.format(h=30)}, {TOTALS_CTE}"


def service_totals(t: Tables):
    return series.forecast_totals(series.forecast(service_series(t), 30))


@query("m2_forecast_totals", f"WITH {SERVICE_TOTALS} SELECT * FROM ft_")
def _(t: Tables):
    return service_totals(t)


@query("m10_forecast_metrics", f"""
WITH {SERVICE_TOTALS} SELECT key, lower <= projected_total_cost AND upper >= projected_total_cost AS bounds_ok,
  upper > length(key) * CAST(700000 AS DOUBLE) AS budget_breach_risk, round(upper - lower, 2) AS confidence_range FROM ft_""")
def _(t: Tables):
    rows = service_totals(t).select(
        "key", F.col("projected_total_cost").alias("predicted_cost"), F.col("lower").alias("lower_bound"),
        F.col("upper").alias("upper_bound"), (F.length("key") * F.lit(700000.0)).alias("budget_limit"))
    return series.forecast_metrics(rows).select(
        "key", "bounds_ok", "budget_breach_risk", F.round("confidence_range", 2).alias("confidence_range"))


@query("m11_forecast_breaches", f"""
WITH {SERVICE_TOTALS}, bd AS (SELECT service_name AS key, round(CAST(sum(effective_cost) AS DOUBLE) / 83 * length(service_name) / 15, 2) AS budget
  FROM b GROUP BY service_name),
o AS (SELECT *, (projected_total_cost - budget) / budget * 100 AS pct FROM ft_ JOIN bd USING (key) WHERE projected_total_cost > budget)
SELECT key, projected_total_cost, budget, round(pct, 1) AS overrun_pct, CASE WHEN pct > 50 THEN 'critical' ELSE 'high' END AS severity FROM o""")
def _(t: Tables):
    plans = t.staged.groupBy(F.col("service_name").alias("key")).agg(F.sum("effective_cost").cast("double").alias("c")).select(
        "key", F.round(F.col("c") / 83 * F.length("key") / 15, 2).alias("budget"))
    return series.forecast_breaches(service_totals(t), plans)


@query("m12_forecast_summary", f"""
WITH {series_cte('provider_name')}, {FIT_CTE}, {AHEAD_CTE.format(h=90)}, {TOTALS_CTE}
SELECT round(sum(projected_total_cost), 2) AS total_projected_cost, count(*) AS series_count FROM ft_""")
def _(t: Tables):
    return series.forecast_summary(series.forecast_totals(series.forecast(provider_series(t), 90)))
