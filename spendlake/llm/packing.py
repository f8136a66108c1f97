"""Best-fit packing with large-item matching.

Texts become token ids in the tasks; a text longer than the capacity is cut into full pieces and a rest. The global plan
needs only how many pieces have each length: at most as many numbers as the capacity, whatever the corpus. From this
histogram the plan is made by length class and not by piece:

* a piece above one third of the capacity meets at most one other such piece in a sequence: going down from the longest,
  each class is matched with the longest class that fits beside it;
* shorter classes, longest first, go where they fit best: into the smallest gap that holds them, as often as they fit.

The plan is a list of intervals, "pieces number a to b of length n go to sequences from s on, k to each, at offset o", a
few thousand at most. Each piece finds its interval by its number among the pieces of its length. These numbers are global:
a count per task and length, summed over the tasks, so that no length class is ever in one place.

Defined results:
* null or empty text: no ids of its own, the end id alone;
* repeated rows are packed each; equal lengths are placed in the order of the input; an empty table packs to nothing;
* a rest that is cut off is placed like any other piece, not beside the full ones.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm import wordbpe
from spendlake.llm.common import frugal, parts, quoted, small_batches, stored

#: Bytes of text whose pre-tokens are held at once.
ENCODED_BYTES = 1 << 20

#: One interval of the plan: pieces ``first <= number < last`` of a length; sequence = ``sequence + (number - first) // times``.
Interval = tuple[int, int, int, int, int, int]  # length, first, last, sequence, times, offset


def plan(counts: dict[int, int], capacity: int) -> list[Interval]:
    """The intervals for a histogram of lengths. Work and result follow the number of lengths, not of pieces."""
    left = {n: c for n, c in counts.items() if c > 0 and 0 < n <= capacity}
    taken: dict[int, int] = defaultdict(int)
    intervals: list[Interval] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> [(first sequence, how many)]
    open_gaps: list[int] = []  # sorted
    sequences = 0

    def leave(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, many))

    def place(length: int, sequence: int, many: int, times: int, offset: int) -> None:
        """``many`` sequences get ``times`` pieces each."""
        first = taken[length]
        taken[length] += many * times
        left[length] -= many * times
        intervals.append((length, first, first + many * times, sequence, times, offset))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - n) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        m = large[at] if at >= 0 else None
        if m is None:
            many = left[n]
            place(n, sequences, many, 1, 0)
        elif m == n and left[n] > 1:
            many = left[n] // 2
            place(n, sequences, many, 2, 0)
            leave(capacity - 2 * n, sequences, many)
            sequences += many
            continue
        elif m == n:
            many = 1
            place(n, sequences, many, 1, 0)
            m = None
        else:
            many = min(left[n], left[m])
            place(n, sequences, many, 1, 0)
            place(m, sequences, many, 1, n)
        leave(capacity - n - (m or 0), sequences, many)
        sequences += many

    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(open_gaps, n)
            if at == len(open_gaps):  # no gap: new sequences, as full of this length as they get
                times = min(capacity // n, left[n])
                many = left[n] // times
                place(n, sequences, many, times, 0)
                leave(capacity - n * times, sequences, many)
                sequences += many
                continue
            gap = open_gaps[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(at)
            times = min(gap // n, left[n])
            used = min(many, left[n] // times)
            place(n, first, used, times, capacity - gap)
            leave(gap - n * times, first, used)
            leave(gap, first + used, many - used)
    return intervals


def find_places(intervals: list[Interval], lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces given by their length and their number among the pieces of that length."""
    table = np.array(sorted(intervals), np.int64).reshape(-1, 6)
    keys, wanted = (table[:, 0] << 48) + table[:, 1], (lengths << 48) + numbers
    row = table[np.searchsorted(keys, wanted, "right") - 1]
    nth = numbers - row[:, 1]
    return row[:, 3] + nth // row[:, 4], row[:, 5] + nth % row[:, 4] * lengths


def pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``), with ``_task`` and ``_nth``:
    the task that cut it and its number among that task's pieces of its length."""
    small_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    fields = [T.StructField("_id", rows.schema["_id"].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "_task", "_nth")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, task = wordbpe.pool(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in (part for whole in batches for part in parts(whole, "_text", ENCODED_BYTES)):
            ids, per_text = pool.encode(batch.column("_text").to_pylist())
            flat = np.insert(ids, np.cumsum(per_text), end_id).astype("<u4")
            size = per_text + 1
            many = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            ends = np.cumsum(length)
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length)  # pieces of the batch that are shorter
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            nth = seen[length] + place - first
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [
                batch.column("_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int64()), pa.array(nth),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat.view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(frugal(cut), T.StructType(fields))


def place_pieces(cut: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces; ``_task`` and ``_nth`` go."""
    tasks = cut.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # At most one row for each length up to the capacity.
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    intervals = plan(counts, capacity)
    numbered = cut.join(starts, ["length", "_task"]).withColumn("_number", F.col("_before") + F.col("_nth"))

    kept = numbered.drop("_before", "_task", "_nth")
    names = [c for c in kept.columns if c != "_number"]
    fields = [*(kept.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_places(intervals, np.asarray(batch.column("length")), np.asarray(batch.column("_number")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, found)], names=[*names, "sequence_id", "offset"])

    return kept.mapInArrow(frugal(places), T.StructType(fields))


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Every piece of every text with its place: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset`` and, if asked for, ``ids``."""
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    placed = place_pieces(cut, capacity)
    order = [F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*order, *(["ids"] if with_ids else []))


def default_tokenizer() -> str:
    """The place of the public word-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
