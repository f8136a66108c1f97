"""Benchmark decontamination: words of training texts that repeat n words of a test item are found and removed.

1. *Items.* Test texts are normalised and cut into pieces of bounded size that overlap by a window. Their bytes are
   counted; a set is made from so many pieces as fit a bound, so a benchmark of any size becomes one or more sets.
2. *Set.* A set holds the hashes of the windows of its pieces, the windows themselves as numbers of words, and the items of each. It is
   broadcast: its size is bounded by ``SET_BYTES``.
3. *Scan.* A task turns its texts into numbers of words (a word that no item has is unknown, and so is every window over it), hashes
   all windows at once, looks them up, and verifies each hit on the words.
4. *Removal.* Hit windows are merged to spans; the spans, or the documents that have any, are taken out. With more than one set each is
   scanned for in turn, and the spans of a row are merged.

Defined results:
* null or empty text, or one without a word: no words, no hits; such an item has no window;
* an item shorter than a window is one window as a whole; items with equal ids are one item, a null id is named by an empty string;
* repeated rows are judged each, also with the same or a null id; an empty table gives an empty table, an empty benchmark no hits;
* texts of any length are scanned in slices, windows across their borders included; extra columns are left out by :func:`find`, and
  kept by :func:`decontaminate`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.alnum import normalised, slices, together
from spendlake.llm.common import flag_keys, fresh, key_bitmap, map_batches, quoted, small_batches, stored
from spendlake.llm.minhash import mixed

#: Bytes of item text in one set, on average; a set takes about five times as much in a worker.
SET_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A word as it stands in a text, before its letters are lowered.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_SPANS = T.ArrayType(T.ArrayType(T.LongType()))


class _Numbers(dict):
    """word -> its number; a word that is not in here is 0 and stays out."""

    def __missing__(self, word: bytes) -> int:
        return 0


class WindowSet:
    """The windows of some pieces of items (id, normalised words)."""

    def __init__(self, pieces: list[tuple[str, bytes]], size: int) -> None:
        self.size = size
        self.items = sorted({i for i, _ in pieces})
        number = {item: n for n, item in enumerate(self.items)}
        words = [p.split() for _, p in pieces]
        self.numbers = _Numbers((w, n + 1) for n, w in enumerate(sorted(set(chain.from_iterable(words)))))
        sizes = np.asarray([len(w) for w in words], np.int64)
        self.words = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        ends = np.repeat(np.cumsum(sizes), sizes)
        owner = np.repeat(np.asarray([number[i] for i, _ in pieces], np.int64), sizes)
        own_size = np.repeat(np.minimum(sizes, size), sizes)
        begins = np.flatnonzero(np.arange(len(self.words)) + own_size <= ends)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.seed = 0
        while not self._filled(begins, own_size, owner):  # two windows with one hash: once in ten thousand lives of a worker
            self.seed += 1

    def hashes(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For 1, 2, ... words the hash of so many from each place on; the last places are of no use."""
        padded = np.r_[words, np.zeros(self.size, np.int64)].astype(np.uint64)
        acc = np.full(len(words), self.seed, np.uint64)
        for m in range(1, self.size + 1):
            acc = mixed(acc * _ODD + padded[m - 1 : len(words) + m - 1])
            yield m, acc

    def _filled(self, begins: np.ndarray, own_size: np.ndarray, owner: np.ndarray) -> bool:
        for m, named in self.hashes(self.words):
            at = begins[own_size[begins] == m]
            if not len(at):
                continue
            order = np.lexsort((owner[at], named[at]))
            at = at[order]
            h = named[at]
            new = np.r_[True, h[1:] != h[:-1]]
            first = at[new]
            if any((self.words[at + j] != self.words[first[np.cumsum(new) - 1] + j]).any() for j in range(m)):
                return False
            once = np.r_[True, new[1:] | (owner[at][1:] != owner[at][:-1])]
            starts = np.r_[np.flatnonzero(new[once]), once.sum()]
            self.by_size[m] = (h[new], first, starts, owner[at][once])
        return True

    def find(self, words: np.ndarray, doc: np.ndarray, old: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """Hits in the words of several texts that end behind the first ``old``: their first words, their size, and the numbers
        of the texts and items, each pair once."""
        unknown = np.r_[0, np.cumsum(words == 0)]
        for m, named in self.hashes(words):
            if m not in self.by_size or len(words) < m:
                continue
            known, first, starts, owner = self.by_size[m]
            at = np.arange(max(0, old - m + 1), len(words) - m + 1)
            at = at[(unknown[at + m] == unknown[at]) & (doc[at] == doc[at + m - 1])]
            place = np.minimum(np.searchsorted(known, named[at]), len(known) - 1)
            hit = known[place] == named[at]
            at, place = at[hit], place[hit]
            for j in range(m):
                same = words[at + j] == self.words[first[place] + j]
                at, place = at[same], place[same]
            if not len(at):
                continue
            pair = np.unique(np.stack([doc[at], place]), axis=1)
            many = starts[pair[1] + 1] - starts[pair[1]]
            took = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[pair[1]], many)
            yield at, m, np.repeat(pair[0], many), owner[took]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals that overlap or touch, as one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def scan(texts: list[str | None], windows: WindowSet) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, list[str]]]:
    """The number of words of each text; and of the texts that are hit the spans (rows of first word and end) and the items."""
    total = np.zeros(len(texts), np.int64)
    words, doc, place = (np.zeros(0, np.int64) for _ in range(3))
    spans: list[tuple[np.ndarray, np.ndarray, int]] = []
    owned: list[np.ndarray] = []
    for rows, pieces in together(texts):
        split = [p.split() for p in pieces]
        many = np.fromiter(map(len, split), np.int64, len(split))
        new = np.fromiter(map(windows.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(many.sum()))
        before = np.cumsum(many) - many
        row = np.asarray(rows)
        base = np.zeros(len(row), np.int64)  # words of its text before a piece
        for i, (r, n) in enumerate(zip(rows, many.tolist(), strict=True)):
            base[i] = total[r]
            total[r] += n
        old = min(windows.size - 1, len(words))
        words = np.r_[words[len(words) - old :], new]
        doc = np.r_[doc[len(doc) - old :], np.repeat(row, many)]
        place = np.r_[place[len(place) - old :], np.arange(len(new)) + np.repeat(base - before, many)]
        for at, m, in_doc, item in windows.find(words, doc, old):
            spans.append((doc[at], place[at], m))
            owned.append(np.stack([in_doc, item]))
    if not spans:
        return total, {}, {}
    ends_before = np.r_[0, np.cumsum(total + 1)]  # one place between two texts, so that spans of two never touch
    start = np.concatenate([ends_before[d] + p for d, p, _ in spans])
    a, b = merged(start, start + np.concatenate([np.full(len(p), m) for _, p, m in spans]))
    d = np.searchsorted(ends_before, a, "right") - 1
    cuts = np.r_[np.flatnonzero(np.r_[True, d[1:] != d[:-1]]), len(d)]
    by_doc = {int(d[i]): np.stack([a[i:j], b[i:j]], 1) - ends_before[d[i]] for i, j in zip(cuts[:-1], cuts[1:], strict=True)}
    pairs = np.unique(np.concatenate(owned, axis=1), axis=1)
    items: dict[int, list[str]] = {r: [] for r in by_doc}
    for r, i in pairs.T.tolist():
        items[r].append(windows.items[i])
    return total, by_doc, items


def item_pieces(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words): the normalised words of every item, a long one in pieces that overlap by all but one word of a window."""
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("item"), quoted(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items: list[str] = []
            words: list[bytes] = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                carried: list[bytes] = []
                whole = True
                for piece in slices(normalised(text)):
                    carried += piece.split()
                    if len(carried) >= size:
                        items.append(item)
                        words.append(b" ".join(carried))
                        carried, whole = carried[len(carried) - size + 1 :], False
                if carried and whole:
                    items.append(item)
                    words.append(b" ".join(carried))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(words, pa.binary())], names=["item", "words"])

    return rows.mapInArrow(run, "item string, words binary")


def window_sets(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> Iterator[WindowSet]:
    """The windows of all items, in sets of a bounded size. Pieces are dealt by a hash of their words and item."""
    pieces = stored(item_pieces(benchmark, size, id_col, text_col), "benchmark-pieces")
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    many = -(-total // SET_BYTES)
    for n in range(many):
        own = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(many)) == n)
        yield WindowSet([(r["item"], bytes(r["words"])) for r in own.collect()], size)


def _scanned(rows: DataFrame, windows: WindowSet | None, only_hit: bool) -> DataFrame:
    """(all columns of ``rows`` but ``_text``, n_words, spans, items); only the rows that are hit, if so asked."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(windows or WindowSet([], 1))
    carried = [c for c in rows.columns if c != "_text"]
    fields = [rows.schema[c] for c in carried] + [
        T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, spans, items = scan(batch.column("_text").to_pylist(), sent.value)
            at = np.asarray(sorted(spans), np.int64) if only_hit else np.arange(batch.num_rows)
            new = [
                pa.array(total[at]), pa.array([spans[i].tolist() if i in spans else [] for i in at.tolist()], pa.list_(pa.list_(pa.int64()))),
                pa.array([items.get(i, []) for i in at.tolist()], pa.list_(pa.string())),
            ]
            old = [batch.column(c).take(pa.array(at)) for c in carried]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def _united(hits: DataFrame) -> DataFrame:
    """``hits`` with the spans and items that several sets found united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.asarray(s, np.int64).reshape(-1, 2) for s in batch.column("spans").to_pylist()]
            spans = [np.stack(merged(s[:, 0], s[:, 1]), 1).tolist() for s in arrays]
            items = [sorted(set(i)) for i in batch.column("items").to_pylist()]
            new = {"spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "items": pa.array(items, pa.list_(pa.string()))}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return hits.mapInArrow(run, hits.schema)


def _hits(rows: DataFrame, benchmark: DataFrame, size: int, item_col: str, item_text_col: str, name: str | None) -> DataFrame:
    """(all columns of ``rows`` but ``_text``, n_words, spans, items) of every row, or of the rows that are hit if ``name`` is the
    column that names a row."""
    sets = window_sets(benchmark, size, item_col, item_text_col)
    first, second = next(sets, None), next(sets, None)
    if second is None and name is None:
        return _scanned(rows, first, only_hit=False)
    at = name or fresh(rows.columns, "_at")
    if name is None:
        rows = stored(rows.withColumn(at, F.monotonically_increasing_id()), "decontaminate-rows")
    hits = None
    for windows in chain((w for w in (first, second) if w is not None), sets):
        own = stored(_scanned(rows.select(at, "_text"), windows, only_hit=True), "decontaminate-hits")
        hits = own if hits is None else hits.unionByName(own)
    if hits is None:
        hits = _scanned(rows.select(at, "_text"), None, only_hit=True)
    gathered = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]  # one row for each set at most
    hits = _united(hits.groupBy(at).agg(F.first("n_words").alias("n_words"), *gathered))
    if name is not None:
        return hits
    counted = _scanned(rows, None, only_hit=False).drop("spans", "items")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(hits.schema[c].dataType)).alias(c)
    return counted.join(hits.drop("n_words"), at, "left").select(*[c for c in counted.columns if c != at], empty("spans"), empty("items"))


def find(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``spans`` (first word and end of every hit passage, from 0) and ``items``
    (ids of the items with a window in the text, as strings, sorted)."""
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    return _hits(rows, benchmark, size, item_col, item_text_col, None).withColumnRenamed("_id", id_col)


def without_spans(text: str, spans: list[list[int]]) -> str:
    """A text without the words of the spans and what stands between them; a space joins what is left."""
    words = _WORD.finditer(text)
    out: list[str] = []
    at = n = 0
    for begin, end in spans:
        first = next(m for i, m in enumerate(words, n) if i == begin)
        stop = first.end()
        for _ in range(end - begin - 1):
            stop = next(words).end()
        out.append(text[at : first.start()].rstrip())
        at, n = stop, end
    out.append(text[at:].lstrip() if spans else text[at:])
    return " ".join(p for p in out if p)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "spans", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without what repeats the benchmark: the words alone (``spans``) or every text that has any (``documents``)."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove must be 'spans' or 'documents'")
    at, flag, spans = (fresh(docs.columns, c) for c in ("_at", "_hit", "_spans"))
    rows = stored(docs.withColumn(at, F.monotonically_increasing_id()), "decontaminate-rows")
    texts = rows.select(F.col(at).alias("_name"), quoted(text_col).alias("_text"))
    hits = stored(_hits(texts, benchmark, size, item_col, item_text_col, "_name"), "decontaminate-found")
    hits = hits.select(F.col("_name").alias(at), F.col("spans").alias(spans))
    flagged = flag_keys(rows, F.xxhash64(at), key_bitmap(hits, F.xxhash64(at)), flag)
    columns = [quoted(c) for c in docs.columns]
    clean, maybe = flagged.where(~F.col(flag)).select(*columns), flagged.where(flag)
    if remove == "documents":
        return clean.unionByName(maybe.join(hits, at, "left_anti").select(*columns))
    where, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
            texts = pa.array([without_spans(t, s) if s else t for t, s in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == where else batch.column(i) for i in range(len(names))], names=names)

    cut = map_batches(maybe.join(hits, at, "left").select(*columns, spans), run, docs.schema)
    return clean.unionByName(cut)
