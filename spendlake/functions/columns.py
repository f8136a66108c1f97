"""Column expressions used across operators. All of them stay in the JVM."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dollars(col: Column | str, places: int = 4) -> Column:
    """An exact decimal sum as a rounded double, for output only."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), places)


def sum_dollars(col: Column | str, places: int = 4) -> Column:
    return dollars(F.coalesce(F.sum(col), F.lit(0)), places)


def share_pct(part: Column, whole: Column, places: int = 2) -> Column:
    """``part / whole * 100``, and 0 where the whole is not positive."""
    part, whole = part.cast("double"), whole.cast("double")
    return F.when(whole > 0, F.round(F.try_divide(part, whole) * 100, places)).otherwise(F.lit(0.0))


def tag(key: str) -> Column:
    """A tag value, with the empty string for an absent key."""
    return F.coalesce(F.col("tags")[key], F.lit(""))


def present(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit("")) != ""


def absent(col: Column | str) -> Column:
    return ~present(col)


def blank_to_null(col: Column | str) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def month_number(col: Column | str) -> Column:
    """yyyymm as an integer."""
    return F.year(col) * 100 + F.month(col)


# Bucket name -> truncation unit.
GRANULARITY = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}


def bucket(granularity: str, col: Column | str) -> Column:
    unit = GRANULARITY[granularity]
    truncated = F.date_trunc(unit, F.col(col) if isinstance(col, str) else col)
    return truncated if granularity == "hourly" else truncated.cast("date")


def day_of(col: Column | str) -> Column:
    return F.to_date(col)


def as_date(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def days_before(as_of: date | str, days: int) -> date:
    return as_date(as_of) - timedelta(days=days)


def amount(col: Column | str, places: int = 2) -> Column:
    """``1,234.50`` as text."""
    return F.format_string(f"%,.{places}f", col)


def distinct_count(col: Column | str) -> Column:
    return F.count_distinct(col)


#: Bits of a set of keys: 2048 rows of 4 kB, so never more than 8 MB to broadcast, whatever it is made from.
SET_BITS = 1 << 26
_ROW_BITS = 1 << 15


def maybe_in(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key (a 64-bit hash) is among those of ``wanted`` (one column), and some more: keys may share a bit. Moves no
    row of ``df``."""
    bit = F.pmod(F.col(wanted.columns[0]), F.lit(SET_BITS))
    rows = wanted.select(bit.alias("_bit")).groupBy((F.col("_bit") / _ROW_BITS).cast("int").alias("_row")).agg(
        F.bitmap_construct_agg(F.col("_bit") % _ROW_BITS).alias("_bits"))
    keyed = df.withColumn("_bit", F.pmod(key, F.lit(SET_BITS))).withColumn("_row", (F.col("_bit") / _ROW_BITS).cast("int"))
    byte = F.ascii(F.decode(F.substring("_bits", (F.col("_bit") % _ROW_BITS / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    hit = byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) != 0
    return keyed.join(F.broadcast(rows), "_row").filter(hit).select(*df.columns)


def local_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table as a local relation, so that its size is known to the planner."""
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"{v!r}D"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(literal(x) for x in v) + ")"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
