"""Token counts without token ids: the pieces of each distinct pre-token are counted once, then joined to frequencies.

1. Each task turns its texts into *postings*: for a pre-token and a block of rows, the rows that hold it and how often.
   A word that every text has is one posting list per block, not one row per text. The lists of a block are dealt by a hash
   of the pre-token, all lists with one destination in one row.
2. A pre-token has one destination, where its pieces are counted, once, with the tokenizer's library, and joined to all its
   postings; a row of postings becomes one sum for each text it speaks of.
3. The sums of a block, packed like the postings, meet again and are added up for each text.

Defined results:
* null or empty text, or one whose characters the tokenizer drops: 0 tokens (and 0 bytes for the first two);
* repeated rows are counted each, also with the same or a null id; an empty table gives an empty table;
* special strings inside a text are one token each, as the library reads them by default;
* texts of any length: postings are handed on whenever a bounded number has gathered.

Rows are named by file and row number, so the two scans may split the files differently. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.llm import wordbpe
from spendlake.llm.common import placed, quoted, small_batches

#: Postings a task gathers before it hands them on, and rows of a block.
GATHERED, BLOCK_ROWS = 2_000_000, 1 << 16
#: Distinct pre-tokens whose count a task remembers; beyond it the memory starts anew, which costs time only.
REMEMBERED = 500_000


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Counts(dict):
    def __init__(self, path: str) -> None:
        super().__init__()
        self.ids = wordbpe.tokenizer(path).ids

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self.ids(token))
        return n


def postings(docs: DataFrame, tokenizer_path: str, destinations: int) -> DataFrame:
    """Rows (to, file, base, tokens, sizes, rows, counts) for ``docs`` (_file, _row, _text).

    ``tokens`` are the pre-tokens, one in a line; the next ``sizes[i]`` entries are of token i: row ``base + rows[j]`` of the file has it
    ``counts[j]`` times. The numbers are packed.
    """
    small_batches(docs.sparkSession)

    def flush(codes: _Codes, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], file: int, base: int) -> pa.RecordBatch:
        tokens = np.asarray(list(codes), object)
        to = np.fromiter((zlib.crc32(t.encode()) % destinations for t in codes), np.int64, len(codes))
        code, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, code, to[code]))
        code, at, n = code[order], at[order], n[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        sizes, own = np.diff(np.r_[starts, len(code)]), code[starts]
        cuts = np.r_[np.flatnonzero(np.r_[True, to[own][1:] != to[own][:-1]]), len(own)]
        ends = np.r_[starts, len(code)]
        out: list[tuple] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = slice(ends[a], ends[b])
            out.append((
                int(to[own[a]]), file, base, "\n".join(tokens[own[a:b]]), sizes[a:b].astype("<u4").tobytes(),
                at[part].astype("<u2").tobytes(), n[part].astype("<u4").tobytes(),
            ))
        types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        names = ["to", "file", "base", "tokens", "sizes", "rows", "counts"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = wordbpe.tokenizer(tokenizer_path).split
        codes, found, many, last, base = _Codes(), [], 0, 0, -1
        for batch in batches:
            for file, at, text in zip(*(batch.column(c).to_pylist() for c in ("_file", "_row", "_text")), strict=True):
                words = split(text) if text else []
                if not words:
                    continue
                if found and (many > GATHERED or file != last or not 0 <= at - base < BLOCK_ROWS):
                    yield flush(codes, found, last, base)
                    codes, found, many = _Codes(), [], 0
                if not found:
                    last, base = file, at
                code, n = np.unique(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), return_counts=True)
                found.append((code, np.full(len(code), at - base), n))
                many += len(code)
        if found:
            yield flush(codes, found, last, base)

    schema = "to int, file long, base long, tokens string, sizes binary, rows binary, counts binary"
    return docs.select("_file", "_row", "_text").mapInArrow(gather, schema)


def sums_of_postings(dealt: DataFrame, tokenizer_path: str) -> DataFrame:
    """(file, base, rows, sums), packed: for each row of postings, the tokens that it adds to the texts it speaks of."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Counts(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("tokens", "sizes", "rows", "counts")]
            for tokens, sizes, rows, counts in zip(*columns, strict=True):
                if len(pieces) > REMEMBERED:
                    pieces.clear()
                own = tokens.split("\n")
                each = np.fromiter(map(pieces.__getitem__, own), np.int64, len(own))
                n = np.repeat(each, np.frombuffer(sizes, "<u4")) * np.frombuffer(counts, "<u4")
                sums = np.bincount(np.frombuffer(rows, "<u2"), n)
                at = np.flatnonzero(sums)
                out.append((at.astype("<u2").tobytes(), sums[at].astype("<u4").tobytes()))
            packed = [pa.array(list(c), pa.binary()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("base"), *packed], names=["file", "base", "rows", "sums"])

    return dealt.mapInArrow(join, "file long, base long, rows binary, sums binary")


def added_up(sums: DataFrame) -> DataFrame:
    """(_file, _row, n): the tokens of each text. The sums of a block meet in one task, which holds one number for each text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, total = None, np.zeros(BLOCK_ROWS, np.int64)

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            file, row = np.full(len(at), base[0]), base[1] + at
            return pa.RecordBatch.from_arrays([pa.array(file), pa.array(row), pa.array(total[at])], names=["_file", "_row", "n"])

        for batch in batches:
            for file, first, rows, n in zip(*(batch.column(c).to_pylist() for c in ("file", "base", "rows", "sums")), strict=True):
                own = (file, first)
                if own != base:
                    if base is not None:
                        yield done()
                    base, total = own, np.zeros(BLOCK_ROWS, np.int64)
                total[np.frombuffer(rows, "<u2")] += np.frombuffer(n, "<u4")
        if base is not None:
            yield done()

    return sums.repartition("file", "base").sortWithinPartitions("file", "base").mapInArrow(add, "_file long, _row long, n long")


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", scanned: bool = False
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes`` and ``n_tokens``.

    ``scanned``: ``docs`` is a table as read from Parquet files (:func:`common.placed`).
    """
    named = placed(docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")), "_at", scanned)
    rows = named.select(F.col("_at.file").alias("_file"), F.col("_at.row").alias("_row"), "_id", "_text")
    destinations = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings(rows, tokenizer_path, destinations).repartitionById(destinations, F.col("to"))
    sums = added_up(sums_of_postings(dealt, tokenizer_path)).withColumnRenamed("n", "_n")
    own = rows.select("_file", "_row", "_id", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"))
    return own.join(sums, ["_file", "_row"], "left").select(
        F.col("_id").alias(id_col), "n_bytes", F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n_tokens")
    )
