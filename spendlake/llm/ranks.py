"""Global gapless numbers along an order, without a window over the table or a group.

Rows are dealt into ranges of the order and written with their place in the range. Counts per range (and group) are few; their
running sums tell how many rows come before a range, and each row adds its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import stored


def numbered(df: DataFrame, order: Sequence[Column], name: str, group: str | None = None, total: str | None = None) -> DataFrame:
    """``df``, written once, with ``name`` (long, from 0): a row's number along ``order``, or in its ``group`` if one is named; and
    with ``total``, if that is named: how many rows there are, or in the group.

    Rows that are equal in ``order`` get consecutive numbers in any order. A group may span any number of ranges. The columns
    ``_range``, ``_nth``, ``_part``, ``_of``, ``_rows``, ``_least``, ``_before`` and ``_total`` must be free. A null group is a group.
    """
    by = ([F.col(group).asc_nulls_first()] if group else []) + list(order)
    place = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_nth", F.monotonically_increasing_id())
    ranges = stored(place.withColumn("_range", F.shiftright("_nth", 33).cast("int")), "ranked-ranges")
    if group is None:
        parts = ranges.groupBy("_range").agg(F.count("*").alias("_rows"), F.min("_nth").alias("_least"))
        every = Window.partitionBy(F.lit(0))
        before = every.orderBy("_range")  # one row for each range
        same = F.col("_range") == F.col("_part")
    else:
        parts = ranges.groupBy("_range", group).agg(F.count("*").alias("_rows"), F.min("_nth").alias("_least"))
        parts = parts.withColumnRenamed(group, "_of")
        every = Window.partitionBy("_of")
        before = every.orderBy("_range")  # at most one row for each range
        same = (F.col("_range") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_of"))
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumnRenamed("_range", "_part")
    starts = starts.withColumn("_total", F.sum("_rows").over(every))
    joined = ranges.join(stored(starts, "ranked-starts"), same)
    more = [F.col("_total").alias(total)] if total else []
    return joined.select(*df.columns, (F.col("_before") + F.col("_nth") - F.col("_least")).alias(name), *more)
