"""Outliers of a series by isolation: a point that random cuts soon leave alone is unusual.

Each tree cuts a bounded sample of the series' days, feature by feature, at random places until a day is alone or the tree is as
deep as a balanced one would be; every day of the series then falls through the tree. A series is a row per day, so what one task
holds is bounded by the calendar; series are dealt over the tasks. The random numbers hang on the seed and the series'
name alone: the same series gets the same answer whatever the partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.operators.series import FEATURES, outlier_features, with_band

#: Trees, and days of a tree's sample at most.
TREES, SAMPLE = 100, 256


def mean_depth(n: np.ndarray | float) -> np.ndarray:
    """The mean depth of a leaf when n points are cut until each is alone: 2 H(n - 1) - 2 (n - 1) / n."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _fall(points: np.ndarray, rows: np.ndarray, sample: np.ndarray, depth: int, rng: np.random.Generator, out: np.ndarray) -> None:
    """Add to ``out`` how deep each of ``rows`` falls in a tree that is cut from ``sample`` on the way."""
    own = points[sample]
    low, high = own.min(0), own.max(0)
    wide = np.flatnonzero(high > low)
    if depth == 0 or not len(wide) or not len(rows):
        out[rows] += mean_depth(len(sample))
        return
    feature = wide[rng.integers(len(wide))]
    cut = rng.uniform(low[feature], high[feature])
    out[rows] += 1
    at, of = points[rows, feature] < cut, own[:, feature] < cut
    if of.all() or not of.any():  # the cut is on a border
        of = own[:, feature] == low[feature]
        at = points[rows, feature] <= low[feature]
    _fall(points, rows[at], sample[of], depth - 1, rng, out)
    _fall(points, rows[~at], sample[~of], depth - 1, rng, out)


def scores(points: np.ndarray, rng: np.random.Generator, trees: int = TREES, sample: int = SAMPLE) -> np.ndarray:
    """One score per point, from 0 to 1; 0.5 is usual."""
    n = len(points)
    size = min(sample, n)
    depth = int(np.ceil(np.log2(max(size, 2))))
    total = np.zeros(n)
    for _ in range(trees):
        _fall(points, np.arange(n), rng.choice(n, size, replace=False), depth, rng, total)
    usual = float(mean_depth(size))
    return np.full(n, 0.5) if usual == 0 else 2.0 ** (-total / trees / usual)


def outliers(series: DataFrame, contamination: float = 0.05, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """The rows of ``series`` (key, ds, y, ...) with ``isolation_score`` and ``isolated``: the most unusual share of each series."""
    rows = outlier_features(series)
    fields = [*rows.schema.fields, T.StructField("isolation_score", T.DoubleType()), T.StructField("isolated", T.BooleanType())]

    def judge(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("ds", ignore_index=True)
        rng = np.random.default_rng([seed, zlib.crc32(str(days["key"].iloc[0]).encode())])
        score = scores(np.nan_to_num(days[FEATURES].to_numpy(float)), rng, trees, sample)
        return days.assign(isolation_score=score, isolated=score > np.quantile(score, 1 - contamination))

    return rows.groupBy("key").applyInPandas(judge, T.StructType(fields))


def consensus(series: DataFrame, sensitivity: float = 0.95, contamination: float = 0.05, trees: int = TREES, seed: int = 42) -> DataFrame:
    """Days that lie outside the band and are isolated too; the score is the mean of both."""
    both = outliers(with_band(series, sensitivity), contamination, trees, seed=seed)
    return both.select(
        "key", "ds", "y", F.col("outside").alias("anomaly_interval"), F.col("isolated").alias("anomaly_outlier"),
        (F.col("outside") & F.col("isolated")).alias("anomaly"),
        ((F.col("interval_score") + F.col("isolation_score")) / 2).alias("anomaly_score"))
