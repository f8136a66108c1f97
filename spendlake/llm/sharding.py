"""Contiguous shards of equal byte size from global prefix sums.

Rows are dealt into ranges of the id; each range has a byte total and a row count; the running sums of these few totals
give every range its global start, and the sums inside a range give every row its own. A row belongs to the shard in which
its middle byte falls when the whole is cut at equal targets, so the size of a shard misses its target by at most half of
the longest row at either end. Only ids, sizes and checksums are moved, unless columns are to be carried.

Defined results:
* a null text has no bytes, so its row has the overhead alone; its checksum is that of the empty text;
* rows are in order of their ids, nulls first; rows with equal ids are in the order of the input;
* equal texts are not held together: the law is about bytes; an empty table gives an empty table;
* a row longer than a target makes its shard longer and may leave the next one empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import fresh, quoted, stored

#: Bytes that a row costs besides its text.
OVERHEAD = 16


def assign(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``shard`` and ``slot``, the place inside the shard.

    The columns named in ``carry`` come along as one struct column ``carried``.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(
        quoted(id_col).alias("_id"), F.monotonically_increasing_id().alias("_at"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("_size"), F.crc32(F.encode(text, "UTF-8")).alias("_crc"),
        *([F.struct(*[quoted(c) for c in carry]).alias("carried")] if carry else []),
    )
    # The place in the input is part of the range key, so that one id on many rows does not fill one range.
    ranges = stored(rows.repartitionByRange("_id", "_at").withColumn("_range", F.spark_partition_id()), "shard-ranges")

    totals = ranges.groupBy("_range").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = totals.select(
        "_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    inside = Window.partitionBy("_range").orderBy(F.col("_id").asc_nulls_first(), "_at")
    placed = (
        ranges.withColumn("_from", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        .withColumn("_nth", F.row_number().over(inside) - 1)
        .join(starts, "_range")
    )
    middle = "2 * (cast(_bytes_before as decimal(38, 0)) + _from) + _size"
    placed = placed.withColumn("shard", F.expr(f"cast(({middle}) * {int(shards)} div (2 * _total) as int)")).withColumn(
        "_row", F.col("_rows_before") + F.col("_nth")
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), *(["carried"] if carry else []),
    )


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` below ``path``, one folder for each shard, in order inside it."""
    placed = assign(docs, shards, id_col, text_col, carry=docs.columns)
    shard, slot = fresh(docs.columns, "shard"), fresh(docs.columns, "slot")
    rows = placed.select(F.col("shard").alias(shard), F.col("slot").alias(slot), "carried.*")
    rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
