"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import spendlake
from spendlake.session import run_dir

#: The white space of every word rule here, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"
_BLANKS = "\t\n\x0b\x0c\r"

#: Bytes of one Arrow batch handed to a Python worker. Bounds the memory of a task whatever the length of its texts.
BATCH_BYTES = 4 << 20


_SENT: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that long texts do not pile up in a worker.

    A local session's workers also get this package, wherever the program was started; on a cluster it is installed.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.master.split("[")[0] == "local" and context.applicationId not in _SENT:
        _SENT.add(context.applicationId)
        root = Path(spendlake.__file__).parents[1]
        context.addPyFile(shutil.make_archive(tempfile.mkdtemp(prefix="spendlake-") + "/package", "zip", root, "spendlake"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends at files every executor can reach."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def has_files(df: DataFrame) -> bool:
    """Do the rows of ``df`` still know their Parquet file and place in it?"""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return "_metadata" not in (c.lower() for c in df.columns)


def placed(df: DataFrame, at: str, scanned: bool = False) -> DataFrame:
    """``df`` with a column ``at`` (file, row) that names each row alike in every job, however the jobs split the files.

    ``scanned`` says that ``df`` is a table as read from Parquet files, each once: columns picked and rows filtered, but nothing joined or
    exploded. A row is then named by a hash of its file's path and its number in the file, so nothing is moved or written. Anything
    else is numbered while it is written into the shared folder, once, and read back.
    """
    if not scanned:
        named = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
        return stored(df.withColumn(at, named), "placed")
    return df.withColumn(at, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some ``most`` bytes of text; a text is never cut."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    at = (np.cumsum(sizes) - sizes) // most
    cuts = [*np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)]).tolist(), len(at)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that no column of ``taken`` has, in any letter case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at its end the worker, which lives on for other stages, gives free memory back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for columns of any name: ``run`` finds them by their place."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body's lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bits of a key bitmap: 2048 rows of 4 kB, so never more than 8 MB to broadcast, whatever it is made from.
BITMAP_BITS = 1 << 26
_ROW_BITS = 1 << 15


def key_bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """The set of keys (64-bit hashes) as rows (_row, _bits) of a bitmap of fixed size. Other keys may share a bit."""
    at = F.pmod(key, F.lit(BITMAP_BITS))
    return keys.select(at.alias("_at")).groupBy((F.col("_at") / _ROW_BITS).cast("int").alias("_row")).agg(
        F.bitmap_construct_agg(F.col("_at") % _ROW_BITS).alias("_bits")
    )


def flag_keys(df: DataFrame, key: Column, bitmap: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean: may the row's key be in the bitmap? Never false when it is. Moves no row of ``df``."""
    row, bits, at = (fresh(df.columns, c) for c in ("_row", "_bits", "_at"))
    keyed = df.withColumn(at, F.pmod(key, F.lit(BITMAP_BITS))).withColumn(row, (F.col(at) / _ROW_BITS).cast("int"))
    joined = keyed.join(F.broadcast(bitmap.toDF(row, bits)), row, "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(at) % _ROW_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = (byte / F.pow(F.lit(2), F.col(at) % 8)).cast("int") % 2
    return joined.select(*[quoted(c) for c in df.columns], (F.coalesce(bit, F.lit(0)) == 1).alias(flag))


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def split_words(text: str | None) -> list[str]:
    """The same words in Python."""
    if not text:
        return []
    for c in _BLANKS:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]
