"""Daily cost series: forecast, anomalies, back-tests.

The model of a series is a straight line plus one effect per weekday, with a
normal band from the spread of what remains. All of it is aggregates and
windows over daily rows, partitioned by series, so thousands of series are
fitted in one pass and none is held by the driver.
"""

from __future__ import annotations

from datetime import date
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.functions.columns import amount, day_of, days_before
from spendlake.operators.detectors import as_insights
from spendlake.operators.staging import filter_billing
from spendlake.session import run_dir, shared_dir

# The shortest series that is fitted or back-tested.
MIN_DAYS = 14
MIN_BACKTEST_DAYS = 30

# Width of the normal band in standard deviations, by confidence.
Z_VALUES = {0.80: 1.2816, 0.90: 1.6449, 0.95: 1.9600, 0.99: 2.5758}


def z_value(level: float) -> float:
    """Half the width of a normal band of this level, in standard deviations."""
    if not 0 < level < 1:
        raise ValueError(f"a level lies between 0 and 1, not at {level}")
    return Z_VALUES.get(level) or NormalDist().inv_cdf((1 + level) / 2)


# Deviation (percent) from which an anomaly or overrun is critical.
CRITICAL_PCT = 50

# Titles of insights.
ANOMALY_TITLE = "Cost anomaly detected: %s"
BREACH_TITLE = "Budget breach forecast: %s"

SERIES_KEYS = {
    "service": "service_name",
    "team": "tag_team",
    "environment": "tag_env",
    "total": "provider_name",
}


def _of_key() -> Window:
    return Window.partitionBy("key")


def cost_series(b: DataFrame, granularity: str, as_of: date | str, days: int = 180,
                min_days: int = MIN_DAYS) -> DataFrame:
    """(key, ds, y): daily cost per service, team, environment or provider; short series dropped.

    Days without charges stay absent.
    """
    key = F.coalesce(F.col(SERIES_KEYS[granularity]), F.lit(""))
    daily = (
        filter_billing(b, start=days_before(as_of, days))
        .groupBy(key.alias("key"), day_of("charge_period_start").alias("ds"))
        .agg(F.sum("effective_cost").cast("double").alias("y"))
    )
    return long_enough(daily, min_days)


def value_series(events: DataFrame, key: str, at: str, value: str, min_days: int = MIN_DAYS) -> DataFrame:
    """The same shape from any table with a key, a time and a value."""
    daily = events.groupBy(F.col(key).alias("key"), day_of(at).alias("ds")).agg(
        F.sum(F.col(value).cast("decimal(18,6)")).cast("double").alias("y"))
    return long_enough(daily, min_days)


def long_enough(series: DataFrame, min_days: int) -> DataFrame:
    return (
        series.withColumn("_n", F.count(F.lit(1)).over(_of_key()))
        .filter(F.col("_n") >= min_days).drop("_n")
    )


def _x(ds: Column | str = "ds") -> Column:
    return F.datediff(ds, F.lit("1970-01-01").cast("date")).cast("double")


def fit(series: DataFrame, used: Column | None = None) -> DataFrame:
    """Add slope, intercept, weekday effect, fitted value and spread to every point.

    ``used`` marks the points the fit may look at; the others are only
    predicted. All windows are by series or by series and weekday, so the
    series is exchanged once.
    """
    y = F.col("y") if used is None else F.when(used, F.col("y"))
    by_day = Window.partitionBy("key", "dow")
    return (
        series.withColumns({"x": _x(), "dow": F.weekday("ds"), "_y": y})
        .withColumns({
            "slope": F.regr_slope("_y", "x").over(_of_key()),
            "intercept": F.regr_intercept("_y", "x").over(_of_key()),
        })
        .withColumn("_r", F.col("_y") - F.col("intercept") - F.col("slope") * F.col("x"))
        .withColumn("effect", F.coalesce(F.avg("_r").over(by_day), F.lit(0.0)))
        .withColumn("sigma", F.stddev_samp(F.col("_r") - F.col("effect")).over(_of_key()))
        .withColumn("yhat", F.col("intercept") + F.col("slope") * F.col("x") + F.col("effect"))
        .drop("_y", "_r")
    )


def forecast(series: DataFrame, horizon: int = 90, confidence: float = 0.95) -> DataFrame:
    """Daily prediction with its band for the ``horizon`` days after each series ends."""
    z = z_value(confidence)
    effects = [F.coalesce(F.max(F.when(F.col("dow") == d, F.col("effect"))), F.lit(0.0)) for d in range(7)]
    models = fit(series).groupBy("key").agg(
        F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
        F.coalesce(F.max("sigma"), F.lit(0.0)).alias("sigma"),
        F.max("ds").alias("last"), F.array(*effects).alias("effects"))
    ahead = models.withColumn("ds", F.explode(F.sequence(
        F.date_add("last", 1), F.date_add("last", horizon), F.expr("INTERVAL 1 DAY"))))
    predicted = (F.col("intercept") + F.col("slope") * _x()
                 + F.get("effects", F.weekday("ds")))
    return ahead.select(
        "key", "ds", predicted.alias("predicted"),
        (predicted - z * F.col("sigma")).alias("lower"), (predicted + z * F.col("sigma")).alias("upper"))


def forecast_totals(predictions: DataFrame) -> DataFrame:
    """Projected total per series over the horizon, with the summed band."""
    return predictions.groupBy("key").agg(
        F.count(F.lit(1)).alias("horizon_days"),
        F.round(F.sum("predicted"), 2).alias("projected_total_cost"),
        F.round(F.sum("lower"), 2).alias("lower"),
        F.round(F.sum("upper"), 2).alias("upper"))


def forecast_summary(totals: DataFrame) -> DataFrame:
    return totals.agg(
        F.round(F.coalesce(F.sum("projected_total_cost"), F.lit(0.0)), 2).alias("total_projected_cost"),
        F.count(F.lit(1)).alias("series_count"))


def forecast_metrics(forecasts: DataFrame) -> DataFrame:
    """Band checks on rows of (predicted_cost, lower_bound, upper_bound, budget_limit)."""
    return forecasts.withColumns({
        "bounds_ok": (F.col("lower_bound") <= F.col("predicted_cost")) & (F.col("upper_bound") >= F.col("predicted_cost")),
        "budget_breach_risk": F.coalesce(F.col("upper_bound") > F.col("budget_limit"), F.lit(False)),
        "confidence_range": F.col("upper_bound") - F.col("lower_bound"),
    })


def forecast_breaches(totals: DataFrame, budgets: DataFrame) -> DataFrame:
    """Series whose projected total passes its budget (key, budget)."""
    over = (F.col("projected_total_cost") - F.col("budget")) / F.col("budget") * 100
    return (
        totals.join(budgets.filter(F.col("budget") > 0), "key")
        .filter(F.col("projected_total_cost") > F.col("budget"))
        .select("key", "projected_total_cost", "budget", F.round(over, 1).alias("overrun_pct"),
                F.when(over > CRITICAL_PCT, "critical").otherwise("high").alias("severity"))
    )


def with_band(series: DataFrame, sensitivity: float = 0.95) -> DataFrame:
    """Every point with its expected value, band, flag and score."""
    z = z_value(sensitivity)
    half = z * F.coalesce(F.col("sigma"), F.lit(0.0))
    return (
        fit(series)
        .withColumns({"lower": F.col("yhat") - half, "upper": F.col("yhat") + half})
        .withColumns({
            "outside": (F.col("y") < F.col("lower")) | (F.col("y") > F.col("upper")),
            "interval_score": F.try_divide(F.abs(F.col("y") - F.col("yhat")), F.col("upper") - F.col("lower")),
        })
        .drop("x", "dow", "slope", "intercept", "effect", "sigma")
    )


def interval_anomalies(series: DataFrame, sensitivity: float = 0.95) -> DataFrame:
    """Points outside the band, with their deviation from the expected value."""
    deviation = F.when(
        F.col("yhat") > 0, F.try_divide(F.abs(F.col("y") - F.col("yhat")), F.col("yhat")) * 100).otherwise(F.lit(0.0))
    return (
        with_band(series, sensitivity).filter("outside")
        .select(
            "key", "ds", F.col("y").alias("actual_cost"), F.col("yhat").alias("expected_cost"),
            ((F.col("upper") - F.col("lower")) / 2).alias("uncertainty"),
            deviation.alias("deviation_percent"), F.lit(sensitivity).alias("confidence"),
            F.when(deviation > CRITICAL_PCT, "critical").otherwise("high").alias("severity"),
            F.col("interval_score").alias("anomaly_score"))
    )


def outlier_features(series: DataFrame) -> DataFrame:
    """y, its change, and its mean and spread over seven rows."""
    ordered = _of_key().orderBy("ds")
    last7 = ordered.rowsBetween(-6, 0)
    return series.withColumns({
        "y_diff": F.coalesce(F.col("y") - F.lag("y").over(ordered), F.lit(0.0)),
        "y_roll_mean": F.avg("y").over(last7),
        "y_roll_std": F.coalesce(F.stddev_samp("y").over(last7), F.lit(0.0)),
    })


FEATURES = ["y", "y_diff", "y_roll_mean", "y_roll_std"]


def feature_outliers(series: DataFrame, contamination: float = 0.05) -> DataFrame:
    """The most extreme share of each series, by robust distance over the features.

    Distance is the sum over features of |value - median| / MAD; a feature
    without spread adds nothing.
    """
    of_key = _of_key()
    rows = outlier_features(series)
    rows = rows.withColumns({f"_m_{f}": F.median(f).over(of_key) for f in FEATURES})
    rows = rows.withColumns({f"_d_{f}": F.abs(F.col(f) - F.col(f"_m_{f}")) for f in FEATURES})
    rows = rows.withColumns({f"_s_{f}": F.median(f"_d_{f}").over(of_key) for f in FEATURES})
    distance = None
    for f in FEATURES:
        part = F.when(F.col(f"_s_{f}") > 0, F.col(f"_d_{f}") / F.col(f"_s_{f}")).otherwise(F.lit(0.0))
        distance = part if distance is None else distance + part
    scratch = [f"_{kind}_{f}" for kind in ("m", "d", "s") for f in FEATURES]
    return (
        rows.withColumn("distance", distance).drop(*scratch)
        .withColumn("outlier_score", F.percent_rank().over(of_key.orderBy(F.round("distance", 9))))
        .withColumn("outlier", F.col("outlier_score") > 1 - contamination)
    )


def consensus_anomalies(series: DataFrame, sensitivity: float = 0.95, contamination: float = 0.05) -> DataFrame:
    """Points both methods flag; the score is the mean of theirs.

    Both run on the same partitioning by series, so there is no join.
    """
    both = feature_outliers(with_band(series, sensitivity), contamination)
    return both.select(
        "key", "ds", "y", F.col("outside").alias("anomaly_interval"), F.col("outlier").alias("anomaly_outlier"),
        (F.col("outside") & F.col("outlier")).alias("anomaly"),
        ((F.col("interval_score") + F.col("outlier_score")) / 2).alias("anomaly_score"))


def anomaly_metrics(anomalies: DataFrame) -> DataFrame:
    """Delta, increase and significance from (expected_cost, actual_cost, anomaly_score)."""
    delta = F.col("actual_cost") - F.col("expected_cost")
    increase = F.when(F.col("expected_cost") == 0, F.lit(100.0)).otherwise(
        F.round(F.try_divide(delta.cast("double"), F.col("expected_cost").cast("double")) * 100, 2))
    return anomalies.withColumns({
        "cost_delta": delta,
        "percentage_increase": increase,
        "is_significant": (increase > 20) & (F.col("anomaly_score") > 0.5),
    })


def anomaly_insights(anomalies: DataFrame, provider: Column | str = "multi") -> DataFrame:
    """One insight per anomaly. ``provider`` says whose costs the series are: ``F.col("key")`` if there is one series per provider."""
    return as_insights(
        anomalies,
        agent="anomaly_agent", provider=provider, category="general", severity=F.col("severity"),
        title=F.format_string(ANOMALY_TITLE, F.upper("key")),
        description=F.format_string("%s: $%s where about $%s was to be expected, %s%% off.", F.date_format("ds", "yyyy-MM-dd"),
                                    amount("actual_cost"), amount("expected_cost"), amount("deviation_percent", 1)),
        resource_ids=F.array(F.date_format("ds", "yyyy-MM-dd")),
        current_monthly_cost=F.col("actual_cost"), projected_monthly_savings=0.0,
        confidence_score=F.col("confidence"), recommendation=F.concat(F.lit("Compare the charges of "), F.date_format("ds", "yyyy-MM-dd"), F.lit(" with those of the week before.")),
        action_type="investigate", risk_level="high",
    )


def breach_insights(breaches: DataFrame, horizon: int) -> DataFrame:
    return as_insights(
        breaches,
        agent="forecasting_agent", provider="multi", category="general", severity=F.col("severity"),
        title=F.format_string(BREACH_TITLE, "key"),
        description=F.format_string(f"The coming {horizon} days come to $%s, %s%% above the budget of $%s.", amount("projected_total_cost"),
                                    amount("overrun_pct", 1), amount("budget")),
        service_name=F.col("key"), current_monthly_cost=F.col("projected_total_cost"),
        projected_monthly_savings=0.0, confidence_score=0.85,
        recommendation=F.format_string("Save $%s in that time, or raise the budget.", amount(F.col("projected_total_cost") - F.col("budget"))),
        action_type="investigate", risk_level="medium",
    )


# ── Lag features and boosted trees ────────────────────────────────────────

LAG_FEATURES = ["dayofweek", "month", "day", "quarter", "year", "is_weekend",
                "lag_1", "lag_7", "lag_14", "rolling_mean_7", "rolling_std_7"]


def _calendar() -> dict[str, Column]:
    return {
        "dayofweek": F.weekday("ds"), "month": F.month("ds"), "day": F.dayofmonth("ds"),
        "quarter": F.quarter("ds"), "year": F.year("ds"),
        "is_weekend": (F.weekday("ds") >= 5).cast("int"),
    }


def lag_features(series: DataFrame) -> DataFrame:
    """Calendar parts, lags by row and statistics of the seven rows before; incomplete rows dropped."""
    ordered = _of_key().orderBy("ds")
    before7 = ordered.rowsBetween(-7, -1)
    return series.withColumns({
        **_calendar(),
        "lag_1": F.lag("y", 1).over(ordered),
        "lag_7": F.lag("y", 7).over(ordered),
        "lag_14": F.lag("y", 14).over(ordered),
        "rolling_mean_7": F.avg("y").over(before7),
        "rolling_std_7": F.stddev_samp("y").over(before7),
    }).dropna(subset=["lag_1", "lag_7", "lag_14", "rolling_mean_7", "rolling_std_7"])


def _written(df: DataFrame, name: str) -> DataFrame:
    """The rows in the shared folder, computed once."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gbt_forecast(series: DataFrame, trees: int = 500, depth: int = 5, rate: float = 0.05,
                 seed: int = 42, horizon: int = 30) -> DataFrame:
    """Boosted trees over the series and its lag features, one model for all, trained by MLlib.

    One prediction for each row with complete lags, and for ``horizon`` days after each series, where ``y`` is null. A day
    ahead is predicted from the last values and the predictions before it. The series and its features are written once: the trainer reads
    its rows again in each pass, and a pass over what they come from would move that input each time.
    """
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    spark = series.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:  # the trainer cuts its lineage there
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    series = _written(series, "gbt-series")
    index = StringIndexer(inputCol="key", outputCol="series", stringOrderType="alphabetAsc", handleInvalid="keep").fit(series)
    vector = VectorAssembler(inputCols=["series", *LAG_FEATURES], outputCol="features")
    rows = vector.transform(index.transform(_written(lag_features(series), "gbt-features")))
    model = GBTRegressor(
        featuresCol="features", labelCol="y", predictionCol="predicted", maxIter=trees, maxDepth=depth,
        stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, maxBins=max(32, len(index.labels) + 1),
    ).fit(rows)

    newest = series.withColumn("_i", F.row_number().over(_of_key().orderBy(F.desc("ds")))).filter("_i <= 14")
    state = newest.groupBy("key").agg(
        F.max("ds").alias("ds"), F.transform(F.array_sort(F.collect_list(F.struct("ds", "y"))), lambda r: r["y"]).alias("past"),
    ).filter(F.size("past") == 14).withColumn("made", F.array().cast("array<double>"))
    week = F.slice("past", 8, 7)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    for _ in range(horizon):
        day = state.withColumn("ds", F.date_add("ds", 1)).withColumns({
            **_calendar(), **{f"lag_{k}": F.col("past")[14 - k] for k in (1, 7, 14)}, "rolling_mean_7": total(week) / 7,
        }).withColumn("rolling_std_7", F.sqrt(total(F.transform(week, lambda v: F.pow(v - F.col("rolling_mean_7"), 2))) / 6))
        told = F.array("predicted")
        made = model.transform(vector.transform(index.transform(day))).select(
            "key", "ds", F.concat(F.slice("past", 2, 13), told).alias("past"), F.concat("made", told).alias("made"))
        state = _written(made, "gbt-day")  # a row per series, so that no plan holds more than one day
    ahead = state.select("key", F.col("ds").alias("_last"), F.posexplode("made").alias("_i", "predicted")).select(
        "key", F.date_add("_last", F.col("_i") + 1 - horizon).alias("ds"), F.lit(None).cast("double").alias("y"), "predicted")
    return model.transform(rows).select("key", "ds", "y", "predicted").unionByName(ahead)


# ── Evaluation ────────────────────────────────────────────────────────────

def _errors() -> dict[str, Column]:
    error = F.abs(F.col("y") - F.col("yhat"))
    return {
        "mae": F.avg(error),
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.avg(F.when(F.col("y") != 0, F.try_divide(error, F.abs("y")))) * 100,
    }


def backtest(series: DataFrame, ratio: float = 0.8, min_points: int = MIN_BACKTEST_DAYS) -> DataFrame:
    """Fit the first part of each series, score the rest: MAPE in percent and RMSE."""
    split = (
        long_enough(series, min_points)
        .withColumns({
            "_i": F.row_number().over(_of_key().orderBy("ds")),
            "_n": F.count(F.lit(1)).over(_of_key()),
        })
        .withColumn("train", F.col("_i") <= F.floor(F.col("_n") * ratio))
    )
    # Errors look at the tested points alone: the others have no value there.
    tested = {c: F.when(~F.col("train"), F.col(c)) for c in ("y", "yhat")}
    metrics = {name: F.round(m, 2) for name, m in _errors().items()}
    return fit(split, F.col("train")).withColumns(tested).groupBy("key").agg(
        F.count_if("train").alias("train_points"), F.count_if(~F.col("train")).alias("test_points"),
        F.max(F.lit(ratio)).alias("train_ratio"), metrics["mape"].alias("mape_percent"), metrics["rmse"].alias("rmse"),
    ).filter("test_points > 0")


def rolling_origin_eval(series: DataFrame, initial: int = 90, period: int = 30,
                        confidence: float = 0.95) -> DataFrame:
    """MAE, RMSE, MAPE and coverage over cut-offs ``period`` days apart, each judged on the next period.

    The last cut-off lies one period before the end; earlier ones keep at
    least ``initial`` days for training. A fit needs only sums per weekday, and
    sums of 30-day blocks add up, so no day is repeated per cut-off: block sums
    are spread over the cut-offs after them and added.
    """
    z = z_value(confidence)
    of_key = _of_key()
    age = F.datediff("_last", "ds")
    points = (
        series.withColumns({"_last": F.max("ds").over(of_key), "_first": F.min("ds").over(of_key)})
        .withColumns({
            "x": -age.cast("double"), "dow": F.weekday("ds"),
            "block": F.floor(age / period).cast("int"),
            "cutoffs": F.floor((F.datediff("_last", "_first") - initial) / period).cast("int"),
        })
        .filter(F.col("cutoffs") >= 1)
    )
    x, y = F.col("x"), F.col("y")
    blocks = points.groupBy("key", "cutoffs", "dow", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    # Cut-off i trains on blocks older than i and is tested on block i.
    sums = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    per_day = (
        blocks.filter(F.col("block") >= 1)
        .withColumn("cutoff", F.explode(F.sequence(F.lit(0), F.least(F.col("block"), F.col("cutoffs")) - 1)))
        .groupBy("key", "cutoff", "dow").agg(*[F.sum(c).alias(c) for c in sums])
    )
    of_fit = Window.partitionBy("key", "cutoff")
    total = {c: F.sum(c).over(of_fit) for c in sums}
    lines = (
        per_day.withColumns({f"t_{c}": w for c, w in total.items()})
        .withColumn("slope", F.try_divide(
            F.col("t_n") * F.col("t_sxy") - F.col("t_sx") * F.col("t_sy"),
            F.col("t_n") * F.col("t_sxx") - F.col("t_sx") * F.col("t_sx")))
        .withColumn("intercept", (F.col("t_sy") - F.col("slope") * F.col("t_sx")) / F.col("t_n"))
        .withColumn("effect", (F.col("sy") - F.col("intercept") * F.col("n") - F.col("slope") * F.col("sx")) / F.col("n"))
        .withColumn("sse", F.col("t_syy") - F.col("intercept") * F.col("t_sy") - F.col("slope") * F.col("t_sxy")
                    - F.sum(F.col("n") * F.col("effect") * F.col("effect")).over(of_fit))
        .withColumn("sigma", F.sqrt(F.greatest(F.col("sse"), F.lit(0.0)) / (F.col("t_n") - 1)))
    )
    fits = lines.groupBy("key", "cutoff").agg(
        F.max("slope").alias("slope"), F.max("intercept").alias("intercept"), F.max("sigma").alias("sigma"),
        F.array(*[F.coalesce(F.max(F.when(F.col("dow") == d, F.col("effect"))), F.lit(0.0)) for d in range(7)]).alias("effects"))
    scored = (
        points.filter(F.col("block") < F.col("cutoffs"))
        .join(fits.withColumnRenamed("cutoff", "block"), ["key", "block"])
        .select("key", F.col("block").alias("cutoff"), "y", "sigma",
                (F.col("intercept") + F.col("slope") * F.col("x") + F.get("effects", F.col("dow"))).alias("yhat"))
    )
    metrics = _errors()
    inside = F.abs(F.col("y") - F.col("yhat")) <= z * F.col("sigma")
    return scored.groupBy("key").agg(
        F.count_distinct("cutoff").alias("cutoffs"),
        F.count(F.lit(1)).alias("points"),
        F.round(metrics["mae"], 2).alias("mae"), F.round(metrics["rmse"], 2).alias("rmse"),
        F.round(metrics["mape"], 2).alias("mape"),
        F.round(F.avg(inside.cast("double")), 4).alias("coverage"))
