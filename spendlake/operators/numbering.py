"""Numbers along an order for tables of any size: two passes, no window over a table, a day or another group.

Rows are dealt into ranges of the order and stored with their place in the range. Counts per range and group are few; their running
sums tell how many rows of a group come before a range, and each row adds its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.session import run_dir


def numbered(df: DataFrame, order: Sequence[str], name: str, group: Sequence[str] = ()) -> DataFrame:
    """``df``, stored once, with ``name`` (long, from 0): a row's number along ``order`` in its ``group`` (in all, if none is named).

    Groups and order may hold nulls, which come first. Rows that are equal in ``order`` get consecutive numbers.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    group_key: Column = F.struct(*group) if group else F.struct(F.lit(0))
    place = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    path = run_dir(df.sparkSession, "numbered")
    place.withColumn("_range", F.shiftright("_at", 33).cast("int")).write.parquet(path)
    ranges = df.sparkSession.read.parquet(path).withColumn("_group", group_key)
    counts = ranges.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("_group", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranges.join(starts, ["_group", "_range"]).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def in_chunks(df: DataFrame, order: Sequence[str], size: int, name: str, group: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: the number of its chunk of ``size`` rows, all but the last of a group full."""
    return numbered(df, order, "_number", group).withColumn(name, F.expr(f"_number div {int(size)}")).drop("_number")
