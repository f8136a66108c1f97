"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

One pass counts (length, prefix hash) pairs; counts are combined in the map tasks, so a text that a third of the rows
repeat is one row per task. Pairs that occur twice or more are *contested*. They are kept as a bitmap of fixed size, which
the second pass over the texts looks up: only a contested text is hashed in full. A bit set by another pair costs a hash,
never a wrong answer. No text is moved to make a decision; :func:`deduplicate` moves contested texts alone.

Defined results:
* a null text counts as an empty one; empty texts are equal to each other;
* of equal texts the row with the smallest id stays, null ids after all others; rows with equal ids and texts are told
  apart by their place in the input, so exactly one row of a group stays;
* an empty table gives an empty table; extra columns are kept by :func:`deduplicate`, whatever their names.

The input must give its rows in the same order when it is read again, as a stored table does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlake.llm.common import SPACE, flag_keys, fresh, key_bitmap, quoted, stored

#: Characters of the prefix that is hashed in the second refinement.
PREFIX = 256


def one_space(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def _keyed(text: Column) -> list[Column]:
    normal = one_space(text)
    return [F.length(normal).alias("_len"), F.xxhash64(F.substring(normal, 1, PREFIX)).alias("_prefix")]


def contested_bitmap(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (row, bits) of the bitmap of (length, prefix hash) pairs that two or more texts share."""
    pairs = docs.select(*_keyed(quoted(text_col))).groupBy("_len", "_prefix").agg(F.count("*").alias("_n"))
    by_length = pairs.groupBy("_len").agg(F.sum("_n").alias("_all")).where("_all > 1")
    by_prefix = pairs.where("_n > 1").join(by_length, "_len", "left_semi")
    return key_bitmap(by_prefix, F.xxhash64("_len", "_prefix"))


def flag_contested(docs: DataFrame, text_col: str, flag: str) -> DataFrame:
    """``docs`` with a boolean: may another text have the same length and prefix? Never false when one has."""
    length, prefix = fresh(docs.columns, "_len"), fresh(docs.columns, "_prefix")
    keys = _keyed(quoted(text_col))
    keyed = docs.withColumns({length: keys[0], prefix: keys[1]})
    return flag_keys(keyed, F.xxhash64(length, prefix), contested_bitmap(docs, text_col), flag).drop(length, prefix)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    The digest is null where the refinement needed none, unless ``digest_all`` asks for all of them.
    """
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    flagged = flag_contested(rows, "_text", "_contested")
    full = F.sha2(one_space(F.col("_text")), 256)
    digest = full if digest_all else F.when(F.col("_contested"), full)
    hashed = stored(
        flagged.select("_id", F.monotonically_increasing_id().alias("_at"), "_contested", digest.alias("text_sha256")), "exact-hashed"
    )
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_at").alias("at"))
    contested = hashed.where("_contested")
    groups = contested.groupBy("text_sha256").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    judged = contested.join(groups, "text_sha256").select(
        F.col("_id").alias(id_col), F.col("_first.id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_first.at") == F.col("_at")).alias("kept"), "text_sha256",
    )
    alone = hashed.where("not _contested").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    return judged.unionByName(alone)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but the first of equal texts. Texts that no other can equal stay where they are."""
    flag, at, full = (fresh(docs.columns, c) for c in ("_contested", "_at", "_full"))
    flagged = flag_contested(docs, text_col, flag)
    columns = [quoted(c) for c in docs.columns]
    alone = flagged.where(~F.col(flag)).select(*columns)
    contested = stored(
        flagged.where(flag).withColumn(at, F.monotonically_increasing_id())
        .withColumn(full, F.sha2(one_space(quoted(text_col)), 256)).drop(flag),
        "exact-contested",
    )
    ident = quoted(id_col)
    first = contested.groupBy(full).agg(F.min(F.struct(ident.isNull(), ident, F.col(at).alias("at"))).alias("_first"))
    winners = first.select(F.col("_first.at").alias(at))
    return alone.unionByName(contested.join(winners, at, "left_semi").select(*columns))
