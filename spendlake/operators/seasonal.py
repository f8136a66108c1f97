"""Daily series with yearly and weekly seasons and a trend that may bend.

The model is a ridge regression. Its normal equations are sums over the days of a series, so they are one aggregate: partial sums are made
where the days are, and no series is ever in one task. Only the small system of each series is solved in one place.

Terms of a day: one, time from 0 to 1, five bends of the trend, three waves of the week and three of the year (if the series spans
two years at least). Bends and waves are held small by the ridge, so terms that a short series cannot tell apart share the effect.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.operators.series import z_value

BENDS, WEEK_WAVES, YEAR_WAVES = 5, 3, 3
#: Days of a year, and days that a series must span before it has yearly waves.
YEAR, TWO_YEARS = 365.25, 730
#: What a squared weight of a bend or wave costs.
RIDGE = 1.0
TERMS = 2 + BENDS + 2 * WEEK_WAVES + 2 * YEAR_WAVES
_PAIRS = list(combinations_with_replacement(range(TERMS), 2))


def _terms(ds: Column, first: Column, span: Column) -> list[Column]:
    """The terms of a day, for a series that begins at ``first`` and lasts ``span`` days."""
    x = F.datediff(ds, F.lit("1970-01-01").cast("date")).cast("double")
    t = F.datediff(ds, first) / F.greatest(span, F.lit(1))
    bends = [F.greatest(t - (i + 1) / (BENDS + 1), F.lit(0.0)) for i in range(BENDS)]
    waves = lambda days, k: [f(x * (2 * np.pi * k / days)) for f in (F.sin, F.cos)]
    week = [w for k in range(1, WEEK_WAVES + 1) for w in waves(7.0, k)]
    year = [F.when(span >= TWO_YEARS, w).otherwise(F.lit(0.0)) for k in range(1, YEAR_WAVES + 1) for w in waves(YEAR, k)]
    return [F.lit(1.0), t, *bends, *week, *year]


def _solved(sums: pd.Series) -> pd.Series:
    """The weights of each series from its sums: the upper half of the matrix, then the right-hand side."""
    if not len(sums):
        return sums
    flat = np.stack([np.asarray(s, float) for s in sums])
    matrix = np.zeros((len(flat), TERMS, TERMS))
    i, j = np.array(_PAIRS).T
    matrix[:, i, j] = matrix[:, j, i] = flat[:, : len(_PAIRS)]
    matrix += np.diag([0.0, 0.0] + [RIDGE] * (TERMS - 2))
    return pd.Series(list(np.linalg.solve(matrix, flat[:, len(_PAIRS) :, None])[:, :, 0]))


def fit(series: DataFrame) -> DataFrame:
    """One row per series of (key, ds, y): ``first``, ``last``, ``span``, ``weights`` and ``sigma``, the spread of what is left."""
    extent = series.groupBy("key").agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    dated = series.join(extent, "key").withColumn("span", F.datediff("last", "first"))
    terms = dated.withColumn("_t", F.array(*_terms(F.col("ds"), F.col("first"), F.col("span"))))
    part = lambda i: F.col("_t")[i]
    sums = [F.sum(part(i) * part(j)) for i, j in _PAIRS] + [F.sum(part(i) * F.col("y")) for i in range(TERMS)]
    solve = F.pandas_udf(_solved, "array<double>")
    weights = terms.groupBy("key", "first", "last", "span").agg(F.array(*sums).alias("_sums")).select(
        "key", "first", "last", "span", solve("_sums").alias("weights"))
    left = with_expected(series, weights).groupBy("key").agg(F.coalesce(F.stddev_samp(F.col("y") - F.col("yhat")), F.lit(0.0)).alias("sigma"))
    return weights.join(left, "key")


def with_expected(days: DataFrame, models: DataFrame) -> DataFrame:
    """``days`` (key, ds, ...) with the columns of their model and ``yhat``."""
    joined = days.join(models, "key")
    terms = _terms(F.col("ds"), F.col("first"), F.col("span"))
    value = sum((t * F.col("weights")[i] for i, t in enumerate(terms)), F.lit(0.0))
    return joined.withColumn("yhat", value)


def forecast(series: DataFrame, horizon: int = 90, confidence: float = 0.95) -> DataFrame:
    """Daily prediction with its band for the ``horizon`` days after each series ends."""
    models = fit(series)
    ahead = models.select("key", F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon), F.expr("INTERVAL 1 DAY"))).alias("ds"))
    half = z_value(confidence) * F.col("sigma")
    return with_expected(ahead, models).select(
        "key", "ds", F.col("yhat").alias("predicted"), (F.col("yhat") - half).alias("lower"), (F.col("yhat") + half).alias("upper"))


def anomalies(series: DataFrame, sensitivity: float = 0.95) -> DataFrame:
    """Days outside the band of the model, with what was expected."""
    half = z_value(sensitivity) * F.col("sigma")
    return with_expected(series, fit(series)).filter(F.abs(F.col("y") - F.col("yhat")) > half).select(
        "key", "ds", F.col("y").alias("actual_cost"), F.col("yhat").alias("expected_cost"),
        F.when(F.col("yhat") > 0, F.abs(F.col("y") - F.col("yhat")) / F.col("yhat") * 100).otherwise(F.lit(0.0)).alias("deviation_percent"))
