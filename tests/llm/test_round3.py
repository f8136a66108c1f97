"""Merkle manifest, importance resampling and decontamination: by brute force, and on the awkward cases their docstrings define."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlake.llm import alnum, decontaminate, merkle, ranks, resample

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, _id string, _at long, rank int, idx int, `odd``name` int, tree string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    def make(*rows):
        path = str(tmp_path_factory.mktemp("docs") / "t.parquet")
        full = [(i, t, s, "x", None, "y", 1, 2, 3, 4, "z") for i, t, s in rows]
        spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# Words and numbers


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB9 ,é 漢\n", max_size=80), st.integers(1, 9))
def test_slices_hold_the_words(text, size):
    raw = alnum.normalised(text)
    assert [w.decode() for p in alnum.slices(raw, size) for w in p.split()] == words_of(text)


def test_numbers_along_an_order_and_in_groups(spark):
    rows = [(g, v) for g in ("a", None, "b") for v in [7] * 300 + list(range(200))]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = ranks.numbered(df, [F.col("v")], "n", "g").collect()
    for g in ("a", None, "b"):
        own = sorted((r["n"], r["v"]) for r in got if r["g"] == g)
        assert [n for n, _ in own] == list(range(500)) and [v for _, v in own] == sorted(v for _, v in own)
    plain = sorted((r["n"], r["v"]) for r in ranks.numbered(df, [F.col("v").desc()], "n").collect())
    assert [n for n, _ in plain] == list(range(1500)) and [v for _, v in plain] == sorted((v for _, v in rows), reverse=True)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes, arity):
    """The root and each node's proof, by the words of the definition."""
    proofs, level, where = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for leaf, at in enumerate(where):
            run = at // arity * arity
            proofs[leaf] += [level[i] for i in range(run, min(run + arity, len(level))) if i != at]
        level = [sha(*level[i : i + arity]) for i in range(0, len(level), arity)]
        where = [w // arity for w in where]
    return level[0], proofs


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_manifest_by_brute_force(spark, table, arity):
    rows = [(i * 3 % 41, f"t{i}\n", "hot") for i in range(40)] + [(1, None, None), (2, "", None), (3, "lone", "é"), (None, "n", "hot"), (5, "r", "hot"), (5, "r", "hot")]
    docs = table(*rows)
    got = merkle.manifest(docs, ["doc_id", "text", "source", "n_chars"], arity=arity)
    checked = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof(F.col("path"))).collect()
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for i, t, s in rows:
        groups[s].append((i is not None, i or 0, sha(value(i), value(t), value(s), "-")))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([n for _, _, n in sorted(groups[s])], arity) for s in names}
    root, upper = brute_tree([trees[s][0] for s in names], arity)
    want = Counter(
        (node, trees[s][0], root, sha(*proof, *upper[names.index(s)])) for s in names for (_, _, node), proof in zip(sorted(groups[s]), trees[s][1], strict=True)
    )
    assert Counter((r["leaf"], r["subroot"], r["root"], r["proof"]) for r in checked) == want
    assert all(r["folded"] == r["root"] for r in checked)


def test_manifest_of_one_row_and_of_none(table):
    one = merkle.manifest(table((1, "x" * 3_000_000, None)), ["doc_id", "text"]).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and not one[0]["path"]
    assert merkle.manifest(table(), ["doc_id", "text"]).count() == 0


# Importance resampling


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=8), st.binary(max_size=90_000))
def test_checksums_compose(heads, tail):
    crc = np.asarray([zlib.crc32(h) for h in heads], np.uint32)
    got = resample.shifted(crc, np.full(len(heads), len(tail))) ^ np.uint32(zlib.crc32(tail))
    assert got.tolist() == [zlib.crc32(h + tail) for h in heads]


def brute_buckets(text, longest, buckets):
    ws = words_of(text)
    return Counter(zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 ,é漢", max_size=60)), max_size=5), st.integers(1, 5), st.integers(1, 20))
def test_features_across_slices(texts, longest, together):
    size, alnum.TOGETHER = alnum.TOGETHER, together
    alnum.slices.__defaults__ = (together,)
    try:
        got = defaultdict(Counter)
        for _, of, at in resample.features(texts, longest, 97):
            for o, a in zip(of.tolist(), at.tolist(), strict=True):
                got[o][a] += 1
    finally:
        alnum.TOGETHER, alnum.slices.__defaults__ = size, (alnum.SLICE,)
    assert all(got[i] == brute_buckets(t, longest, 97) for i, t in enumerate(texts))


PROSE = " ".join(f"w{i % 7} and the{i % 3}" for i in range(15))


def test_scores_of_odd_rows(spark, table):
    long = " ".join(f"v{i}" for i in range(300_000))
    docs = table(*[(i, f"{PROSE} n{i}", "s") for i in range(30)], (None, PROSE, "s"), (7, PROSE, "s"), (7, PROSE, "s"), (50, None, "s"), (51, " ,", "s"), (52, long, "s"))
    target = table((1, PROSE, "t"), (2, None, "t"))
    got = resample.score(docs, target, percent=20).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[50]["n_features"], by_id[50]["weight"], by_id[50]["rank"]) == (0, 0, None) and by_id[51]["n_features"] == 0
    assert by_id[52]["n_features"] == 3 * 300_000 - 3
    drawn = sorted((r["rank"], -r["score"]) for r in got if r["rank"] is not None)
    assert [r for r, _ in drawn] == list(range(1, 34 * 20 // 100 + 1)) and [s for _, s in drawn] == sorted(s for _, s in drawn)
    rows = resample.draw(docs, target, percent=20)
    assert rows.columns == [*docs.columns, "rank_"] and sorted(r["rank_"] for r in rows.collect()) == [r for r, _ in drawn]
    assert resample.score(table(), target).count() == 0 and resample.score(docs, table(), percent=0).where("rank is not null").count() == 0
    with pytest.raises(ValueError):
        resample.score(docs, target, buckets=0)


# Decontamination


def brute_hits(text, items, size):
    ws = words_of(text)
    hit, found = set(), set()
    for item, t in items:
        own = words_of(t)
        m = min(size, len(own))
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
        for i in range(len(ws) - m + 1):
            if tuple(ws[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add("" if item is None else str(item))
    return len(ws), sorted(hit), sorted(found)


SHORT = st.lists(st.sampled_from(["a", "b", "C", "é"]), max_size=14).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(SHORT, max_size=6), st.lists(SHORT, max_size=4), st.integers(1, 5), st.integers(1, 20))
def test_scan_by_brute_force(texts, items, size, together):
    named = [(n % 3, t) for n, t in enumerate(items)]
    windows = decontaminate.WindowSet([(str(n), alnum.normalised(t)) for n, t in named if words_of(t)], size)
    old, alnum.TOGETHER = alnum.TOGETHER, together
    alnum.slices.__defaults__ = (together,)
    try:
        total, spans, found = decontaminate.scan(texts, windows)
    finally:
        alnum.TOGETHER, alnum.slices.__defaults__ = old, (alnum.SLICE,)
    for i, t in enumerate(texts):
        hit = [w for a, b in spans[i].tolist() for w in range(a, b)] if i in spans else []
        assert (int(total[i]), hit, found.get(i, [])) == brute_hits(t, named, size)


@pytest.mark.parametrize("bound", [8 << 20, 60])
def test_find_and_remove(spark, table, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "SET_BYTES", bound)  # the lower bound makes several sets
    items = [(1, PROSE, "b"), (2, "Short item", "b"), (3, None, "b"), (None, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11", "b"), (2, "w1 and the1 w2 and the2 w3 and the0 w4", "b")]
    long = " ".join(f"v{i}" for i in range(250_000))
    rows = [(1, f"Start: {PROSE}, end.", "s"), (2, None, "s"), (3, "", "s"), (4, "a short, ITEM here", "s"), (4, "a short, ITEM here", "s"), (None, "nothing of it", "s"), (5, f"{long} X1 x2 x3-x4 x5 x6 x7 x8 x9 x10 tail", "s")]
    docs, bench = table(*rows), table(*items)
    bench = bench.withColumnRenamed("doc_id", "item_id")
    got = decontaminate.find(docs, bench).collect()
    want = [(i, *brute_hits(t, [(i, t) for i, t, _ in items], 10)) for i, t, _ in rows]
    flat = lambda spans: [w for a, b in spans for w in range(a, b)]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["n_words"], flat(r["spans"]), r["items"]) for r in got), key=key) == sorted(want, key=key)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.schema == docs.schema
    texts = Counter((r["doc_id"], r["text"] if r["doc_id"] != 5 else r["text"][-10:]) for r in left.collect())
    assert texts == Counter([(1, "Start: , end."), (2, None), (3, ""), (4, "a here"), (4, "a here"), (None, "nothing of it"), (5, "49999 tail")])
    whole = decontaminate.decontaminate(docs, bench, remove="documents")
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter([2, 3, None])
    assert decontaminate.find(table(), bench).count() == 0
    assert not any(r["items"] for r in decontaminate.find(docs, table().withColumnRenamed("doc_id", "item_id")).collect())


# Long texts in the search for repeats


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=120).map(" ".join), min_size=1, max_size=3), st.integers(1, 60))
def test_anchors_do_not_depend_on_the_slices(texts, size):
    from spendlake.llm import recompress

    def found():
        return {
            (int(rows[p]), int(i - first[p] + bases[p])): int(a)
            for rows, bases, words, part, begins in recompress._blocks(texts)
            for first in [np.r_[0, np.flatnonzero(np.diff(part)) + 1]]
            for i, (a, p) in enumerate(zip(recompress.anchors(words, part), part.tolist(), strict=True)) if begins[i]
        }

    want = found()
    before = recompress.TOGETHER
    recompress.TOGETHER, alnum.slices.__defaults__ = size, (size,)
    try:
        got = found()
    finally:
        recompress.TOGETHER, alnum.slices.__defaults__ = before, (alnum.SLICE,)
    assert got == want


# Near-duplicates: links that the first centres miss


def test_recall_of_links_in_hard_groups(spark, table):
    """Chains, clouds around a text, and pairs behind shared boilerplate, against the links of all pairs."""
    import random

    from spendlake.llm import minhash

    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]

    def edited(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = fresh(1)[0]
        return out

    texts = []
    for _ in range(6):  # chains: each text a little further from the first
        words = fresh(150)
        for _ in range(40):
            texts.append(words)
            words = edited(words, 5)
    for _ in range(4):  # clouds: pairs between 0.65 and 0.9
        base = fresh(150)
        texts += [edited(base, rng.randrange(3, 14)) for _ in range(100)]
    boiler = fresh(120)
    for _ in range(120):  # all share most of their words and are no links; every second one has a near copy
        own = boiler + fresh(36)
        texts += [own, edited(own, 5)] if rng.random() < 0.5 else [own]
    rng.shuffle(texts)
    sets = [frozenset(zip(t, t[1:])) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(a := sets[i] & sets[j]) >= 80 * (len(sets[i]) + len(sets[j]) - len(a))]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in links:
        label[max(root(i), root(j))] = min(root(i), root(j))
    docs = table(*[(i, " ".join(t), "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_components(docs, shingle=2, percent=80, scanned=True).collect()}
    assert not any(got[i] != got[j] and root(i) == root(j) for i, j in links), sum(got[i] != got[j] for i, j in links) / len(links)
    assert all(got[i] == root(i) for i in got)


def test_candidates_of_a_large_group_of_near_copies(spark, table, monkeypatch):
    """A member of a large group meets a few centres, not one in each of its buckets, and the group is not dealt around once it is linked."""
    import random

    from spendlake.llm import minhash

    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(500):
        words = list(base)
        for j in rng.sample(range(200), 3):
            words[j] = f"v{i}x{j}"
        texts.append(" ".join(words))
    compared, joined = [], minhash._with_both

    def counted(edges, values, columns):
        compared.append(edges.count())
        return joined(edges, values, columns)

    monkeypatch.setattr(minhash, "_with_both", counted)
    got = minhash.near_components(table(*[(i, t, "s") for i, t in enumerate(texts)]), shingle=2, percent=80, scanned=True).collect()
    assert {r["component_id"] for r in got} == {0}
    assert compared[0] <= 12 * len(texts), compared


def test_further_rounds_take_no_more_rows_than_the_first(spark, table, monkeypatch):
    """The buckets of a large group whose members are in several components are not multiplied."""
    import random

    from spendlake.llm import minhash

    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):
        words = list(base)
        for j in rng.sample(range(150), rng.randrange(4, 16)):
            words[j] = f"v{i}x{j}"
        texts.append(" ".join(words))
    rows, stored = [], minhash.stored

    def counted(df, name):
        out = stored(df, name)
        if "key" in out.columns:
            rows.append((name, out.count()))
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    assert minhash.near_components(table(*[(i, t, "s") for i, t in enumerate(texts)]), shingle=2, percent=80, scanned=True).count() == 300
    assert len(rows) > 2 and all(n <= rows[0][1] for _, n in rows), rows


# Pre-tokens: the ranges of the fast pattern


def test_fast_pattern_has_the_classes_of_the_general_one():
    from spendlake.llm import packing, wordbpe

    common = [c for c in map(chr, range(0xD800)) if not wordbpe._UNCOMMON.search(c)]
    general = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    texts = [a.join(["x'", "ll", "7", "_", " "]) + a for a in common] + ["".join(common), "don't we'll 'd'sx 'rest o'ts"]
    own = wordbpe.tokenizer(packing.default_tokenizer())
    for text in texts:
        assert wordbpe._WORDS.findall(text.lower()) == general.findall(text.lower()), text
        assert [i for t in own.split(text) for i in own.ids(t)] == own.library.encode(text, add_special_tokens=False).ids, text


# Words of the repeats


def test_words_are_hashed_alike_wherever_they_stand():
    from spendlake.llm import recompress

    def thue_morse(swap, n=2048):
        return bytes(b"ab"[(bin(i).count("1") + swap) % 2] for i in range(n))

    words = [b"a", b"b", b"ab", b"ba", "é漢".encode(), b"x" * 64, b"x" * 65, thue_morse(0), thue_morse(1), b"\x00", b"\x00\x00", b"a", b"w" * (3 << 20)]
    got = recompress.word_hashes(b"  " + b" ".join(words))
    assert [recompress.word_hashes(w).tolist() for w in words] == [[h] for h in got.tolist()]
    assert len(set(got.tolist())) == len(set(words))
    assert not len(recompress.word_hashes(b"")) and not len(recompress.word_hashes(b"   "))
    many = [f"w{i}".encode() for i in range(200_000)]
    assert len(np.unique(recompress.word_hashes(b" ".join(many)))) == len(many)
    assert recompress.whole_name(" a\tb ") == recompress.whole_name("a b") != recompress.whole_name("ab")
