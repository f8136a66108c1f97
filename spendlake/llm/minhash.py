"""Near-duplicates by one-permutation MinHash.

1. *Signatures.* Each text's set of shingles is hashed once; the hash deals a shingle to one of the bins, and each bin keeps
   its least value. Empty bins take the value of a bin that a hash of bin and attempt picks until one is filled (optimal
   densification). Texts with the same set are one class with one representative.
2. *Buckets.* Bands of bin values are bucket keys.
3. *Stars.* A bucket picks one of its members at random as centre, and gives a candidate edge from it to each other one: edges follow the
   members, not their square. In the first round the lots are the members' own, so that the buckets of a large group agree on few centres.
   Sizes, then bitmaps of the sets, rule out most edges that are no links; the rest is confirmed on the full sets.
4. *Further rounds.* A bucket of at most ``SMALL`` members then gives all its pairs of different components, once. A larger one whose members are
   in several components draws ``CENTRES`` members more a round, each bucket by lots of its own, and gives an edge from each to the members of other
   components. Buckets of odd and even bands take turns, and no bucket is dealt anew: a round's rows are the members, not their square. Rounds go
   on until one adds no link after every bucket has had its turn.
5. *Components* of the confirmed links.

With 32 bands of 5 bins a pair at the threshold of 0.8 shares no band with a chance of 3 in a million, a pair at 0.9 with
less than 1 in 10**12. A pair that only large buckets hold is found when one of the two is drawn in one of them; tests measure the recall.

Defined results:
* null or empty text, or white space only: an empty set, linked with nothing, a component of its own;
* fewer words than a shingle has: the whole sequence is one shingle;
* repeated rows are linked; the smallest id of a component stays, null ids after all others, equal ids by their place;
* an empty table gives an empty table; extra columns are kept by :func:`deduplicate`.

* very long texts: a set is made in one array, some 40 bytes a word; the tables hold no texts;
* the id's column gives way, by underscores, where it is called like one of the result.

Rows are named by file and row number (:func:`common.placed`), so the jobs may split the table differently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.llm.common import flag_keys, fresh, frugal, key_bitmap, placed, quoted, small_batches, stored
from spendlake.llm.components import components

BANDS, ROWS = 32, 5
#: Members of a bucket that are compared in pairs, and centres that a larger bucket draws in each further round.
SMALL, CENTRES = 20, 4
#: Words a worker remembers the hash of during a task; beyond it the memory starts anew.
REMEMBERED = 300_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix in which every bit of the input counts."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """The 64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = WordHashes()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text. ``bytes.split`` splits at the white space of the word rule, and
    ``bytes.lower`` lowers A-Z alone."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _HASHES.of(words)
    k = min(size, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return np.unique(acc)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of bin minima per non-empty set, empty bins filled by optimal densification."""
    sizes = np.asarray([len(s) for s in sets])
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    # The sets are sorted, so a row's bins follow each other.
    key = doc * bins + (((flat >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    filled = np.full(len(sets) * bins, _EMPTY)
    filled[key[starts]] = np.minimum.reduceat(mixed(flat ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(16), starts)
    filled = filled.reshape(len(sets), bins)
    out = filled.copy()
    row, column = np.nonzero(filled == _EMPTY)
    attempt = 0
    while len(row):
        attempt += 1
        donor = mixed(column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)
        value = filled[row, donor.astype(np.int64)]
        got = value != _EMPTY
        out[row[got], column[got]] = value[got]
        row, column = row[~got], column[~got]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return acc


def bitmap(shingles: np.ndarray) -> bytes:
    """The set as a bitmap of four to eight bits for each shingle; a bitmap of half the size is its halves, united."""
    bits = max(256, 1 << int(np.ceil(np.log2(4 * len(shingles)))))
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    out = np.zeros(bits, np.uint8)
    out[at] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap, or rows of them, at a smaller size."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def may_link(n: np.ndarray, m: np.ndarray, only_a: np.ndarray, only_b: np.ndarray, percent: int) -> np.ndarray:
    """Can sets of sizes n and m reach the threshold if at least so many bits are in one of them alone?"""
    shared = np.minimum(n - only_a, m - only_b)
    return 100 * shared >= percent * (n + m - shared)


def _sign(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(_place, _id, n, set_key, bands, bitmap) of each row of ``docs`` (_place, _id, _text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column("_text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if full:
                found = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows).view(np.int64)
                for i, k in zip(full, found, strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_place"), batch.column("_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                ],
                names=["_place", "_id", "n", "set_key", "bands", "bitmap"],
            )
        _HASHES.clear()  # the worker lives on in other stages

    more = [("n", T.LongType()), ("set_key", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("bitmap", T.BinaryType())]
    return docs.mapInArrow(frugal(run), T.StructType([docs.schema["_place"], docs.schema["_id"], *(T.StructField(c, t) for c, t in more)]))


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(_at, shingles) of the rows of ``docs`` (_place, _text) that ``wanted`` (_at, _place) names. A bitmap keeps other texts in place."""
    keys = key_bitmap(wanted, F.xxhash64("_place"))
    near = flag_keys(docs.select("_place", "_text"), F.xxhash64("_place"), keys, "_wanted").where("_wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_place"), pa.array(sets, pa.binary())], names=["_place", "shingles"])
        _HASHES.clear()

    sets = near.select("_place", "_text").mapInArrow(frugal(run), T.StructType([docs.schema["_place"], T.StructField("shingles", T.BinaryType())]))
    return sets.join(wanted, "_place").select("_at", "shingles")


def _with_both(edges: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """``edges`` (u, v) with the columns of ``values`` (_at, ...) of both ends, named ..._u and ..._v."""
    for end in ("v", "u"):
        named = values.select(F.col("_at").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        edges = edges.join(named, end)
    return edges


def _kept_edges(rows: DataFrame, test: Callable[[dict], bool]) -> DataFrame:
    """The edges (u, v) of rows for which the test holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array([test(r) for r in batch.to_pylist()], pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("u"), kept.column("v")], names=["u", "v"])

    return rows.mapInArrow(frugal(run), "u long, v long")


def _bitmaps_allow(percent: int) -> Callable[[dict], bool]:
    def test(r: dict) -> bool:
        a, b = (np.frombuffer(r[c], np.uint64) for c in ("bitmap_u", "bitmap_v"))
        size = min(len(a), len(b))
        a, b = folded(a, size), folded(b, size)
        only_a, only_b = (int(np.bitwise_count(x).sum()) for x in (a & ~b, b & ~a))
        return bool(may_link(r["n_u"], r["n_v"], only_a, only_b, percent))

    return test


def _sets_agree(percent: int) -> Callable[[dict], bool]:
    def test(r: dict) -> bool:
        a, b = (np.frombuffer(r[c], np.uint64) for c in ("shingles_u", "shingles_v"))
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= percent * (len(a) + len(b) - shared)

    return test


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Can different sets of sizes n and m reach the threshold? Sets of one size share all but one member at most."""
    shared = F.least(n, m) - (n == m).cast("long")
    return 100 * shared >= percent * (n + m - shared)


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _first_stars(buckets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate edges (u, v) of the first round, and the members (key, i, _at, n, k, tried) of the buckets of ``buckets`` (key, i, _at, n) that have
    several; k is how many, tried the centre that all of them have met."""
    lot = F.struct(F.xxhash64("_at").alias("h"), "_at", "n")
    centres = buckets.groupBy("key").agg(F.min(lot).alias("c"), F.count("*").alias("k")).where("k > 1")
    met = buckets.join(centres, "key").select("key", "i", "_at", "n", "k", F.col("c._at").alias("tried"), F.col("c.n").alias("n_c"))
    met = stored(met, "minhash-buckets")
    edges = met.where((F.col("tried") != F.col("_at")) & _fits(F.col("n"), F.col("n_c"), percent))
    return edges.select(*_pair(F.col("tried"), F.col("_at"))).distinct(), met.drop("n_c")


def _labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with the label of their component."""
    return met.join(labels.withColumnRenamed("v", "_at"), "_at", "left").withColumn("label", F.coalesce("label", "_at"))


def _all_pairs(small: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of different components in buckets of at most ``SMALL`` members, but for those with the centre they have met."""
    of = small.groupBy("key").agg(F.collect_list(F.struct("_at", "n", "label", "tried")).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    a = F.col("a")
    partners = F.filter("members", lambda b: (
        (b["_at"] > a["_at"]) & (b["label"] != a["label"]) & _fits(a["n"], b["n"], percent) & (a["tried"] != a["_at"]) & (a["tried"] != b["_at"])
    ))
    pairs = of.where("low != high").select(F.explode("members").alias("a"), "members").select(a["_at"].alias("u"), F.explode(partners).alias("b"))
    return pairs.select("u", F.col("b._at").alias("v")).distinct()


def _more_stars(large: DataFrame, salt: int, percent: int) -> DataFrame:
    """Edges (u, v) from ``CENTRES`` members that each bucket of several components draws, to its members of other components."""
    lots = [F.struct(F.xxhash64("key", "_at", F.lit(salt * CENTRES + t)).alias("h"), "_at", "n", "label") for t in range(CENTRES)]
    drawn = large.groupBy("key").agg(F.array(*[F.min(lot) for lot in lots]).alias("centres"), F.min("label").alias("low"), F.max("label").alias("high"))
    met = large.join(drawn.where("low != high").select("key", "centres"), "key")
    others = F.filter("centres", lambda c: (c["label"] != F.col("label")) & _fits(F.col("n"), c["n"], percent))
    return met.select("_at", F.explode(F.transform(others, lambda c: c["_at"])).alias("c")).select(*_pair(F.col("c"), F.col("_at"))).distinct()


def _named_by(members: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``members`` that columns of ``rows`` may name by ``_at``. A bitmap keeps the others in place."""
    ends = [rows.select(F.col(c).alias("_at")) for c in columns]
    named = reduce(DataFrame.unionByName, ends)
    flagged = flag_keys(members, F.xxhash64("_at"), key_bitmap(named, F.xxhash64("_at")), "_wanted")
    return flagged.where("_wanted").drop("_wanted")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS, scanned: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``_place`` (its name), its id, ``n_shingles``, ``component_id`` and ``kept``.

    ``scanned``: ``docs`` is a table as read from Parquet files (:func:`common.placed`).
    """
    place = fresh(docs.columns, "_place")
    found = _components_of(placed(docs, place, scanned), place, id_col, text_col, shingle, percent, bands, rows)
    return found.withColumnRenamed("_id", fresh([c for c in found.columns if c != "_id"], id_col))


def _components_of(
    docs: DataFrame, place: str, id_col: str, text_col: str, shingle: int, percent: int, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """:func:`near_components` of rows whose names are in the column ``place``, with ``_id`` for the id."""
    texts = docs.select(F.col(place).alias("_place"), quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    # A name of one number for the tables of members and edges, given while they are written.
    signed = stored(_sign(texts, shingle, bands, rows).withColumn("_at", F.monotonically_increasing_id()), "minhash-signed")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_at").alias("at"))
    classes = signed.where("n > 0").groupBy("set_key").agg(F.min(order).alias("first"))
    first = classes.select(F.col("first.at").alias("_at"))
    members = stored(signed.join(first, "_at", "left_semi").select("_at", "_place", "_id", "n", "bands", "bitmap"), "minhash-classes")
    sizes = members.select("_at", "n", "bitmap")

    def confirmed(edges: DataFrame) -> DataFrame:
        edges = stored(edges, "minhash-edges")
        close = stored(_kept_edges(_with_both(edges, _named_by(sizes, edges, ["u", "v"]), ["n", "bitmap"]), _bitmaps_allow(percent)), "minhash-close")
        # The bitmap may name a few others too; the join with the edges drops their sets.
        places = _named_by(members.select("_at", "_place"), close, ["u", "v"])
        return stored(_kept_edges(_with_both(close, _full_sets(texts, places, shingle), ["shingles"]), _sets_agree(percent)), "minhash-links")

    edges, met = _first_stars(members.select("_at", "n", F.posexplode("bands").alias("i", "key")), percent)
    links = confirmed(edges)
    labels = members.sparkSession.createDataFrame([], "v long, label long")
    salt, largest = 0, met.agg(F.max("k")).first()[0] or 0
    while True:
        new = not links.isEmpty()
        if new:
            # A component stands for its links so far.
            labels = stored(components(labels.select(F.col("v").alias("u"), F.col("label").alias("v")).unionByName(links)), "minhash-labels")
        if largest <= (2, SMALL)[min(salt, 1)] or (salt > 1 and not new):
            break
        salt += 1
        # The bands take turns, so that two rounds see each large bucket once.
        large = stored(_labelled(met.where(f"k > {SMALL} and i % 2 = {salt % 2}"), labels), "minhash-large")
        edges = _more_stars(large, salt, percent)
        if salt == 1:
            edges = edges.unionByName(_all_pairs(_labelled(met.where(f"k > 2 and k <= {SMALL}"), labels), percent)).distinct()
        links = confirmed(edges)

    labelled = members.select("_at", "_id").join(labels.withColumnRenamed("v", "_at"), "_at", "left").select(
        "_at", "_id", F.coalesce("label", "_at").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min(order).alias("least"))
    component = labelled.join(least, "label").select(F.col("_at").alias("class"), "least")
    known = signed.select("_at", "_place", "_id", "n", "set_key")
    own = known.where("n > 0").join(classes.select("set_key", F.col("first.at").alias("class")), "set_key").join(component, "class").select(
        "_place", "_id", F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), (F.col("least.at") == F.col("_at")).alias("kept")
    )
    alone = known.where("n = 0").select(
        "_place", "_id", F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return own.unionByName(alone)


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, scanned: bool = False
) -> DataFrame:
    """``docs`` with one row of each component. Texts that cannot be dropped stay where they are. ``scanned`` as in :func:`near_components`."""
    place, flag = fresh(docs.columns, "_place"), fresh(docs.columns, "_maybe")
    named = placed(docs, place, scanned)
    found = _components_of(named, place, id_col, text_col, shingle, percent)
    dropped = stored(found.where("not kept").select(F.col("_place").alias(place)), "minhash-dropped")
    flagged = flag_keys(named, F.xxhash64(place), key_bitmap(dropped, F.xxhash64(place)), flag)
    columns = [quoted(c) for c in docs.columns]
    return flagged.where(~F.col(flag)).select(*columns).unionByName(flagged.where(flag).join(dropped, place, "left_anti").select(*columns))
