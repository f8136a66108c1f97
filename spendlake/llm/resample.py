"""Importance resampling towards a target: documents are drawn in proportion to how much more likely their word n-grams are in
the target than in the corpus.

1. *Dictionary.* The distinct words of the texts in hand, each between two delimiters, are put into an Aho-Corasick
   automaton; the payload of a word is its CRC and its length. A dictionary lives as long as one batch, so its size is bounded by
   the batch and not by the vocabulary of the corpus.
2. *Scan.* The automaton runs over the texts and emits the payload of every word in order. A CRC of joined strings follows from
   the CRCs and lengths of the parts, so neighbouring payloads are composed to the CRC, and the bucket, of each n-gram;
   no n-gram is ever built as a string.
3. *Counts.* A task adds up its buckets and hands on one row for each; their sums give each bucket's gain.
4. *Scores.* A second scan adds up the gains of each text; Gumbel noise from a hash of the id makes the highest scores a
   weighted draw without replacement. Ranks are global numbers along the score (:mod:`ranks`).

Defined results:
* null or empty text, or one without a word: no features, weight 0, never drawn unless ``min_words`` is 0;
* a null id is hashed like an empty one, and comes before other ids among equal scores; repeated rows are scored and ranked each;
* an empty table gives an empty table; an empty target leaves gains that favour rare buckets;
* texts of any length are scanned in slices, n-grams across their borders included; extra columns are left out by
  :func:`score`, and kept by :func:`draw`, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.alnum import together
from spendlake.llm.common import fresh, quoted, small_batches, stored
from spendlake.llm.ranks import numbered

#: Buckets come to the driver and go to every task, so they are bounded.
MOST_BUCKETS = 1 << 20
_POLYNOMIAL = 0xEDB88320
_SPACE_CRC = np.uint32(zlib.crc32(b" "))


@lru_cache(maxsize=1)
def _one_byte() -> np.ndarray:
    """Entry c of four tables of 256: what one more zero byte makes of a CRC register whose byte i is c, all others zero."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), c >> np.uint32(1))
    low = np.arange(256, dtype=np.uint32)
    return np.stack([c, low, low << np.uint32(8), low << np.uint32(16)])


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@lru_cache(maxsize=64)
def _power(k: int) -> np.ndarray:
    """The tables for 2**k bytes."""
    if k == 0:
        return _one_byte()
    half = _power(k - 1)
    return np.stack([_applied(half, half[i]) for i in range(4)])


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The part of the CRC of A + B that comes from A: ``crc(A + B) == shifted(crc(A), len(B)) ^ crc(B)``."""
    out = crc.astype(np.uint32)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero(n_bytes >> k & 1)
        out[at] = _applied(_power(k), out[at])
    return out


def _payloads(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and length of every word of the pieces in order, and how many words each piece has."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in set().union(*(p.split() for p in pieces)):
        found.add_word(f" {word.decode('latin-1')} ", len(word) << 32 | zlib.crc32(word))
    if not len(found):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint32), none, np.zeros(len(pieces), np.int64)
    found.make_automaton()
    each = [np.fromiter(map(itemgetter(1), found.iter(f" {p.decode('latin-1')} ")), np.int64) for p in pieces]
    all_of = np.concatenate(each)
    return (all_of & 0xFFFFFFFF).astype(np.uint32), all_of >> 32, np.asarray([len(e) for e in each])


def features(texts: list[str | None], longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the texts' features: of each word the number of its text, and for each feature the number of its text and
    its bucket. A feature is counted with the part that holds its last word."""
    crc, length, doc = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows, pieces in together(texts):
        new_crc, new_length, many = _payloads(pieces)
        old = min(longest - 1, len(crc))  # words of the part before, for the n-grams across the border
        new_doc = np.repeat(np.asarray(rows), many)
        crc, length, doc = (np.concatenate([a[len(a) - old :], b]) for a, b in ((crc, new_crc), (length, new_length), (doc, new_doc)))
        after = shifted(np.full(len(crc), _SPACE_CRC), length) ^ crc  # of a space and the word
        gram, of, at = crc, [new_doc], [crc[old:] % np.uint32(buckets)]
        for n in range(2, longest + 1):
            if len(crc) < n:
                break
            gram = shifted(gram[:-1], length[n - 1 :] + 1) ^ after[n - 1 :]
            last = np.arange(n - 1, len(crc))
            own = (doc[last] == doc[last - n + 1]) & (last >= old)
            of.append(doc[last[own]])
            at.append(gram[own] % np.uint32(buckets))
        yield new_doc, np.concatenate(of), np.concatenate(at)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over the texts of ``texts`` (_text)."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, at in features(batch.column("_text").to_pylist(), longest, buckets):
                total += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): how much a feature of the bucket speaks for the target, in thousandths of a natural log."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    all_s, all_t = (F.lit(float(d.agg(F.sum("n")).first()[0] or 0)) for d in (corpus, target))
    ratio = (F.col("t") + 1) * (all_s + buckets) / ((F.col("s") + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _noise(ident: F.Column, seed: int) -> F.Column:
    """Gumbel noise from the id, in thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def score(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    percent: int = 5, min_words: int = 20, longest: int = 3, buckets: int = 10_000, seed: int = 42,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn)."""
    texts = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    ranked = _ranked(texts, target, target_col, percent, min_words, longest, buckets, seed)
    return ranked.select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")


def _ranked(
    texts: DataFrame, target: DataFrame, target_col: str, percent: int, min_words: int, longest: int, buckets: int, seed: int
) -> DataFrame:
    """(all columns of ``texts`` but the text, n_features, weight, score, rank)."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    corpus = stored(bucket_counts(texts.select("_text"), longest, buckets), "resample-corpus")
    wanted = stored(bucket_counts(target.select(quoted(target_col).alias("_text")), longest, buckets), "resample-target")
    gain = np.zeros(buckets, np.int64)
    for r in gains(corpus, wanted, buckets).collect():
        gain[r["bucket"]] = r["gain"]
    carried = [c for c in texts.columns if c != "_text"]
    fields = [texts.schema[c] for c in carried] + [T.StructField(c, T.LongType()) for c in ("_words", "n_features", "weight")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, many, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for doc, of, at in features(batch.column("_text").to_pylist(), longest, buckets):
                words += np.bincount(doc, minlength=batch.num_rows)
                many += np.bincount(of, minlength=batch.num_rows)
                # Sums of whole numbers, exact in doubles below 2**53.
                weight += np.bincount(of, gain[at], batch.num_rows).astype(np.int64)
            new = [pa.array(x) for x in (words, many, weight)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *new], names=[f.name for f in fields])

    scored = texts.mapInArrow(run, T.StructType(fields)).withColumn("score", F.col("weight") + _noise(F.col("_id"), seed))
    scored = stored(scored, "resample-scored")
    fit = scored.where(F.col("_words") >= min_words)
    drawn = percent * fit.count() // 100
    # The row's number in its file deals out rows that are equal in all else.
    order = [F.col("score").desc(), F.col("_id").asc_nulls_first(), F.col("weight"), F.col("n_features"), F.col("_salt")]
    ranked = numbered(fit.withColumn("_salt", F.col("_metadata.row_index")), order, "_number").drop("_salt")
    ranked = ranked.withColumn("rank", F.when(F.col("_number") < drawn, F.col("_number") + 1)).drop("_number")
    return ranked.unionByName(scored.where(F.col("_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The drawn rows of ``docs``, all columns, with their ``rank``. The table is written once, so that both scans name rows alike."""
    at, rank = fresh(docs.columns, "_row"), fresh(docs.columns, "rank")
    rows = stored(docs.withColumn(at, F.monotonically_increasing_id()), "resample-rows")
    texts = rows.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"), F.col(at).alias("_at"))
    known = {"target_col": "text", "percent": 5, "min_words": 20, "longest": 3, "buckets": 10_000, "seed": 42} | how
    ranked = _ranked(texts, target, **known).where("rank is not null").select(F.col("_at").alias(at), F.col("rank").alias(rank))
    return rows.join(stored(ranked, "resample-drawn"), at).select(*[quoted(c) for c in docs.columns], rank)
