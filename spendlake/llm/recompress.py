"""Substring deduplication by recompression.

Texts are rewritten in rounds: one names the runs of equal words, the others name pairs of neighbours. A name is a hash of what it stands
for, so equal runs and pairs have equal names in every text and task without a table of names. Whether two neighbours are
paired depends on them alone (a coin of the left one and a coin of the right one), so equal passages are rewritten alike but
for their ends. For each symbol the words are tracked on which its being there depends; if a window holds all of these, the
symbol is one of the window's own.

1. Texts that are equal as a whole have one name; all but the first of them are repeats from end to end and need no more.
2. Each window of the others picks the largest symbol it owns as its *anchor*, or its own name if it owns none. Equal windows
   pick equal anchors. An anchor is one row per text, whatever the number of its windows.
3. Anchors that two or more texts share reveal where repeats can be. Kept as a bitmap of fixed size, they are looked up by
   a second pass, which writes the names of the windows around them, and of no others.
4. These windows are verified: the first text of each is found, and the windows of later texts cover the words to remove.

Defined results:
* null or empty text: no words; a text shorter than a window has no window and is kept whole;
* very long texts are worked on in slices; what a task holds besides a text is bounded (the kept words of a text that loses some are
  held at once);
* windows are judged on the input: a removed window still counts as the first place of its words;
* only a smaller id makes a repeat: rows with the same id do not remove each other's words, nor does a window repeated
  inside one text; null ids come after all others and are equal to each other;
* an empty table gives an empty table; extra columns are left out.

Rows are named by file and row number (:func:`common.placed`), so the jobs may split the table differently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.alnum import SLICE, slices
from spendlake.llm.common import BITMAP_BITS, flag_keys, key_bitmap, placed, quoted, small_batches, stored
from spendlake.llm.minhash import mixed

WINDOW = 13
#: Rounds of pairs: three give symbols of up to eight words.
PAIR_ROUNDS = 3
#: Words that an anchor has at least; a shorter symbol is in too many texts to reveal anything.
LEAST_SPAN = 3
#: An anchor is looked up by two of its bit fields, so that few anchors are found that are not shared.
PROBES = (0, 28)
#: Words that are rewritten in one array.
TOGETHER = 400_000

#: Bytes of a word that is hashed by sums along its slice; a longer one is hashed alone.
SHORT_WORD = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)


#: White space, as it separates words, as spaces.
_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))
#: What stands for each byte in a word's hash.
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def raw_slices(text: str | None) -> Iterator[bytes]:
    """A text with its white space as spaces, a bounded number of bytes at a time; no word is cut."""
    yield from slices((text or "").encode().translate(_BLANKS))


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time."""
    for piece in raw_slices(text):
        yield piece.split()


def word_hashes(raw: bytes) -> np.ndarray:
    """The 64-bit hash of each word of a slice, from sums of scaled bytes; a word has the same hash wherever it stands."""
    raw = raw.rstrip(b" ")
    if len(raw) > 2 * SLICE:  # a slice is as long as this for its last word alone
        cut = raw.rfind(b" ") + 1
        return np.append(word_hashes(raw[:cut]), np.uint64(xxhash.xxh3_64_intdigest(raw[cut:])))
    data = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = data == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    a, b = edge[::2], edge[1::2]
    scale, back = _scales(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * scale[:-1], out=sums[1:])
    size = b - a
    out = mixed((sums[b] - sums[a]) * back[a] + size.astype(np.uint64))
    for i in np.flatnonzero(size > SHORT_WORD):
        out[i] = xxhash.xxh3_64_intdigest(raw[a[i] : b[i]])
    return out


def whole_name(text: str | None) -> tuple[int, bytes]:
    """How many words a text has, and the name of all of them."""
    n, name = 0, xxhash.xxh3_128()
    for words in word_slices(text):
        n += len(words)
        if words:
            name.update(b" ".join(words) + b" ")
    return n, name.digest()


def window_names(words: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The name of the window that begins at each word; the last ones are of no use."""
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    acc = np.full(len(words), size, np.uint64)
    for j in range(size):
        acc = mixed(acc * _ODD + padded[j : len(words) + j])
    return acc


def _runs(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of one word. A run is known only with the different words on both its sides, which are part of its name."""
    a = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])])
    run = np.diff(np.r_[a, len(words)])
    same = doc[a][1:] == doc[a][:-1]
    inner = np.r_[False, same] & np.r_[same, False] & (run > 1)
    a, run = a[inner], run[inner]
    return run, a - 1, run + 2


def _symbols(words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The symbols of the round of runs and of each round of pairs: spans, and the first word and the number of words that the symbol depends on (0: on the
    text's ends)."""
    n = len(words)
    sym, a, b = words, np.arange(n), np.arange(1, n + 1)
    low, high, known = a, b, np.ones(n, bool)
    yield _runs(words, doc)
    for level in range(PAIR_ROUNDS):
        right_side = (mixed(sym + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)).astype(bool)
        next_same = np.r_[doc[1:] == doc[:-1], False]
        after = np.r_[right_side[1:], False]
        pair = ~right_side & after & next_same
        second = np.r_[False, pair[:-1]]
        # What each symbol's place depends on: a left one on its right neighbour, a right one on its left neighbour.
        other = np.where(right_side, np.arange(len(sym)) - 1, np.arange(len(sym)) + 1)
        there = np.where(right_side, np.r_[False, next_same[:-1]], next_same)
        other = np.where(there, other, np.arange(len(sym)))
        known_new = known & known[other] & there
        low_new, high_new = np.minimum(low, low[other]), np.maximum(high, high[other])
        name = sym.copy()
        at = np.flatnonzero(pair)
        name[at] = mixed(mixed(sym[at] * _ODD + np.uint64(level + 7)) + sym[at + 1])
        end = b.copy()
        end[at] = b[at + 1]
        keep = ~second
        sym, a, b, doc, known, low, high = (x[keep] for x in (name, a, end, doc, known_new, low_new, high_new))
        yield b - a, low, np.where(known, high - low, 0)


def _passages(words: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that names the words from ``low`` on, ``many`` of them each, from sums of scaled words."""
    scale, back = _scales(len(words) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(words * scale[:-1], dtype=np.uint64)]
    return lambda low, many: mixed((sums[low + many] - sums[low]) * back[low] + many.astype(np.uint64))


def _powers(base: int, many: int) -> np.ndarray:
    out = np.full(many, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_SCALES: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def _scales(many: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a scale and of its inverse, remembered by the worker up to the bytes of two slices."""
    if len(_SCALES[0]) < many:
        _SCALES[:] = [_powers(base, many) for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64))]
    return _SCALES[0][:many], _SCALES[1][:many]


def anchors(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The anchor of the window that begins at each word, for words of several texts behind each other.

    An anchor is the window's largest own symbol: its number of words in the upper byte, and below the name of all words that
    it depends on, which are more than its own and so in fewer texts. Windows that leave their text have anchors of no use.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    passage = _passages(words)
    own = np.zeros((WINDOW + 1, n), np.uint64)  # own[w, i]: the largest symbol that depends on just the w words from i on
    for span, low, needs in _symbols(words, doc):
        ok = (needs > 0) & (needs <= WINDOW) & (span >= LEAST_SPAN)
        span, low, needs = span[ok], low[ok], needs[ok]
        np.maximum.at(own.reshape(-1), needs * n + low, (span.astype(np.uint64) << np.uint64(56)) | (passage(low, needs) >> np.uint64(8)))
    best = own[1]
    for w in range(2, WINDOW + 1):
        best = np.maximum(np.maximum(best, np.r_[best[1:], np.uint64(0)]), own[w])
    bare = best == 0
    return np.where(bare, (np.uint64(WINDOW) << np.uint64(56)) | (window_names(words) >> np.uint64(8)), best)


_Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _blocks(texts: list[str | None]) -> Iterator[_Block]:
    """Texts with a window, some together: per part the number of its text and the place of its first word in it; per word its hash,
    its part, and whether a window begins there. A long text is several parts that overlap by all but one word of a window: what
    a window owns depends on its own words alone, so it is the same in every cut."""
    rows: list[int] = []
    bases: list[int] = []
    parts: list[np.ndarray] = []
    size = 0

    def block() -> _Block:
        sizes = np.asarray([len(p) for p in parts])
        ends = np.repeat(np.cumsum(sizes), sizes)
        words = np.concatenate(parts)
        part = np.repeat(np.arange(len(parts)), sizes)
        return np.asarray(rows), np.asarray(bases), words, part, np.arange(len(words)) + WINDOW <= ends

    for i, text in enumerate(texts):
        base, carried = 0, np.zeros(0, np.uint64)
        for piece in raw_slices(text):
            words = np.concatenate([carried, word_hashes(piece)])
            if len(words) >= WINDOW:
                rows.append(i)
                bases.append(base)
                parts.append(words)
                size += len(words)
            cut = max(0, len(words) - WINDOW + 1)
            base, carried = base + cut, words[cut:]
            if size > TOGETHER:
                yield block()
                rows, bases, parts, size = [], [], [], 0
    if parts:
        yield block()


def _root_names(docs: DataFrame) -> DataFrame:
    """(_at, _id, n_words, root): root is the name of the whole text, null if it has no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [whole_name(t) for t in batch.column("_text").to_pylist()]
            roots = pa.array([name if n >= WINDOW else None for n, name in names], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_at"), batch.column("_id"), pa.array([n for n, _ in names], pa.int64()), roots],
                names=["_at", "_id", "n_words", "root"],
            )

    more = [T.StructField("n_words", T.LongType()), T.StructField("root", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([docs.schema["_at"], docs.schema["_id"], *more]))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(anchor, _at), once for each text and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at")
            for rows, _, words, part, begins in _blocks(batch.column("_text").to_pylist()):
                found, doc = anchors(words, part)[begins], rows[part[begins]]
                new = np.r_[True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]
                found, doc = found[new], doc[new]
                order = np.lexsort((found, doc))
                found, doc = found[order], doc[order]
                new = np.r_[True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[new].view(np.int64)), at.take(pa.array(doc[new]))], names=["anchor", "_at"]
                )

    return docs.select("_at", "_text").mapInArrow(run, T.StructType([T.StructField("anchor", T.LongType()), docs.schema["_at"]]))


def _bitmap_bytes(bitmap: DataFrame) -> bytes:
    """A key bitmap as one string of bytes, 8 MB at most."""
    out = bytearray(BITMAP_BITS // 8)
    size = len(out) // (BITMAP_BITS >> 15)
    for row in bitmap.toLocalIterator():
        out[row["_row"] * size : (row["_row"] + 1) * size] = row["_bits"]
    return bytes(out)


def _window_rows(docs: DataFrame, shared: bytes) -> DataFrame:
    """(window, _at, _id, pos) of the windows whose anchor may be in more than one text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = batch.column("_at")
            for rows, bases, words, part, begins in _blocks(batch.column("_text").to_pylist()):
                key, hit = anchors(words, part).view(np.int64), begins
                for probe in PROBES:
                    at_bit = key >> probe & BITMAP_BITS - 1
                    hit = hit & (bits[at_bit >> 3] >> (at_bit & 7).astype(np.uint8) & 1).astype(bool)
                hit = np.flatnonzero(hit)
                if not len(hit):
                    continue
                own = part[hit]
                row = rows[own]
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(window_names(words)[hit].view(np.int64)), at.take(pa.array(row)), batch.column("_id").take(pa.array(row)),
                        pa.array((hit - first[own] + bases[own]).astype(np.int32)),
                    ],
                    names=["window", "_at", "_id", "pos"],
                )

    fields = [T.StructField("window", T.LongType()), docs.schema["_at"], docs.schema["_id"], T.StructField("pos", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType(fields))


def find_repeats(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``texts`` (_at, _id, _text): rows (_at, _id, n_words, whole) of all texts, ``whole`` if a text repeats a smaller one from end to end; and rows
    (_at, starts) of the other texts that have windows to remove."""
    small_batches(texts.sparkSession)
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    named = stored(_root_names(texts), "repeat-roots")
    firsts = named.where("root is not null").groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    known = stored(
        named.where("root is not null").join(firsts, "root", "left").select("_at", "_id", "n_words", (F.coalesce(F.col("first") < order, F.lit(False))).alias("whole"))
        .unionByName(named.where("root is null").select("_at", "_id", "n_words", F.lit(False).alias("whole"))),
        "repeat-texts",
    )
    # Texts that repeat another as a whole take no part in the rest.
    gone = known.where("whole").select("_at")
    flagged = flag_keys(texts, F.xxhash64("_at"), key_bitmap(gone, F.xxhash64("_at")), "_maybe")
    still = flagged.where("not _maybe").drop("_maybe").unionByName(flagged.where("_maybe").drop("_maybe").join(gone, "_at", "left_anti"))

    met = _anchor_rows(still).groupBy("anchor").agg(F.min("_at").alias("low"), F.max("_at").alias("high")).where("low != high")
    bits = met.select(F.explode(F.array(*[F.shiftright("anchor", p) for p in PROBES])).alias("bit"))
    windows = stored(_window_rows(still, _bitmap_bytes(key_bitmap(bits, F.col("bit")))), "repeat-windows")
    first = windows.groupBy("window").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last").select("window", "first")
    later = windows.join(first, "window").where(F.col("first") < order)
    return known, later.groupBy("_at").agg(F.collect_list("pos").alias("starts"))


def covered(n_words: int, starts: list[int] | np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Which words lie in a window that begins at one of ``starts``."""
    step = np.zeros(n_words + size + 1, np.int64)
    at = np.unique(np.asarray(starts, np.int64))
    step[at] += 1
    step[at + size] -= 1
    return np.cumsum(step)[:n_words] > 0


def _joined(words: Iterable[bytes]) -> tuple[str, int]:
    own = list(words)
    return b" ".join(own).decode(), len(own)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanned: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``n_removed`` and ``kept_text``, the kept words joined by spaces.

    ``scanned``: ``docs`` is a table as read from Parquet files (:func:`common.placed`).
    """
    picked = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    rows = placed(picked, "_at", scanned)
    known, later = find_repeats(rows)
    later = stored(later, "repeat-starts")
    touched = later.select("_at").unionByName(known.where("whole").select("_at"))
    flagged = flag_keys(rows, F.xxhash64("_at"), key_bitmap(touched, F.xxhash64("_at")), "_touched")
    more = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType())]
    result = T.StructType([rows.schema["_id"], *(T.StructField(c, t) for c, t in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("_text", "starts", "whole")]
            for text, starts, whole in zip(*columns, strict=True):
                if not starts:
                    words = (w for piece in word_slices(text) for w in piece)
                    kept, n = ("", sum(1 for _ in words)) if whole else _joined(words)
                    out.append((n, n if whole else 0, kept))
                    continue
                n = sum(map(len, word_slices(text)))
                gone = covered(n, starts)
                kept, left = _joined(compress((w for piece in word_slices(text) for w in piece), ~gone))
                out.append((n, n - left, kept))
            n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
            arrays = [batch.column("_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "n_words", "n_removed", "kept_text"])

    calm = flagged.where("not _touched").select("_id", "_text", F.lit(None).cast("array<int>").alias("starts"), F.lit(False).alias("whole"))
    whole = known.where("whole").select("_at", "whole")
    hit = flagged.where("_touched").join(later, "_at", "left").join(whole, "_at", "left").select(
        "_id", "_text", "starts", F.coalesce("whole", F.lit(False)).alias("whole")
    )
    done = calm.unionByName(hit).mapInArrow(run, result)
    return done.withColumnRenamed("_id", id_col)
