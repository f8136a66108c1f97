"""Each operator on the awkward cases its docstring defines: nulls, empty and very long texts, ties, repeated rows, empty
tables, and extra columns whose names clash with its own."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlake.llm import chat, common, components, exact, minhash, packing, pii, piece_codec, quality, recompress, sharding, token_counts, wordbpe

PROSE = "the cat and the dog of this house went to a wood in the morning and it was on the hill that they had been for long"
SCHEMA = "doc_id long, text string, _id string, _at long, _text string, n long, shard int, quality int, _contested boolean, carried int"


def rows_of(*pairs):
    return [(i, t, "x", None, None, 7, 3, 1, None, 5) for i, t in pairs]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    def make(*pairs):
        path = str(tmp_path_factory.mktemp("docs") / "t.parquet")
        spark.createDataFrame(rows_of(*pairs), SCHEMA).coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="module")
def odd(table):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return table((1, PROSE), (2, None), (3, ""), (4, " \t\n"), (5, PROSE.replace(" ", "\n ")), (None, PROSE), (6, PROSE), (6, PROSE), (7, long), (None, None))


@pytest.fixture(scope="module")
def empty(table):
    return table()


# Quality rules


def test_quality_of_odd_texts(odd, empty):
    judged, m, b = quality.judge(odd)
    assert m == "quality_" and set(odd.columns) < set(judged.columns)
    got = {r["doc_id"]: (r[m]["n_words"], len(r[b]) == 0) for r in judged.where("doc_id is not null").collect()}
    assert got[1] == (27, True) and got[2][0] == got[3][0] == got[4][0] == 0 and not any(got[i][1] for i in (2, 3, 4))
    assert got[7][0] == 30_000
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, None, 6, 6])  # in 5 each line is a word
    assert quality.keep_good(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeated_words_by_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", quality.measures(df.t)["n_repeat_words"].alias("n")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert got[i] == len(covered)


# Exact deduplication


def test_exact_decisions(odd, empty):
    got = exact.decisions(odd).collect()
    assert len(got) == 10 and sum(r["kept"] for r in got) == 4
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 6)}
    assert by[1]["kept"] and by[1]["group_size"] == 5 and by[5]["keep_id"] == 1
    assert by[2]["kept"] and by[3]["keep_id"] == 2 and by[3]["group_size"] == 3 and by[4]["keep_id"] == 4
    assert exact.decisions(empty).count() == 0


def test_exact_rows(odd, empty, table):
    kept = exact.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 7]
    assert exact.deduplicate(empty).count() == 0
    twice = exact.deduplicate(table((9, "same"), (9, "same"), (None, "same"))).collect()
    assert [r["doc_id"] for r in twice] == [9]


# Shards


def test_shards_of_odd_rows(odd, empty, spark, tmp_path):
    got = sharding.assign(odd, 3).collect()
    assert len(got) == 10 and sum(r["size"] for r in got if r["doc_id"] == 2) == 16
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign(empty, 3).count() == 0
    sharding.write_shards(odd, 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 10 and set(odd.columns) <= set(back.columns)


# Near duplicates


def test_near_components_of_odd_texts(odd, empty):
    got = minhash.near_components(odd).collect()
    by = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got)
    assert by[(1, 1, True)] == by[(5, 1, False)] == by[(None, 1, False)] == 1 and by[(6, 1, False)] == 2
    assert all(by[(i, i, True)] == 1 for i in (2, 3, 4, 7)) and by[(None, None, True)] == 1
    assert minhash.near_components(empty).count() == 0
    assert minhash.deduplicate(empty).count() == 0


def test_near_groups_that_only_a_member_holds_together(table):
    """Variants of one text, each like it but not like each other: the smallest is not the middle."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]

    def variant(k):
        out = words.copy()
        for j in rng.sample(range(200), k):
            out[j] = f"v{rng.random()}"
        return " ".join(out)

    docs = [(i, variant(6)) for i in range(1, 9)] + [(50, " ".join(words))] + [(60 + i, variant(70)) for i in range(5)]
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(199)} for i, t in docs}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 90 * (len(sets[a]) + len(sets[b]) - shared):
                    label[a] = label[b] = min(label[a], label[b])
    frame = table(*docs)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_components(frame, shingle=2, percent=90).collect()}
    assert got == label and len(set(label.values())) < len(label)
    kept = minhash.deduplicate(frame, shingle=2, percent=90)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == set(label.values())


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = np.unique(base[:800]), np.unique(np.r_[base[:700], base[800:]])
    signed = minhash.signatures([a, b, a[:3]], 4096)
    assert abs((signed[0] == signed[1]).mean() - 700 / 900) < 0.05
    assert not (signed == minhash._EMPTY).any()


def test_bitmap_bound_never_rules_out_a_link():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        other = np.unique(np.r_[base[: int(len(base) * 0.9)], rng.integers(0, 2**63, n // 8).astype(np.uint64)])
        shared = len(np.intersect1d(base, other))
        if 100 * shared >= 80 * (len(base) + len(other) - shared):
            row = {"bitmap_u": minhash.bitmap(base), "bitmap_v": minhash.bitmap(other), "n_u": len(base), "n_v": len(other)}
            assert minhash._bitmaps_allow(80)(row)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, i) for i in range(201, 230)]
    label = {v: v for e in links for v in e}
    for _ in range(40):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["v"]: r["label"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got.get(v, v) == label[v] for v in label)


# Row names


@pytest.fixture
def regrouped(spark, tmp_path):
    """A file of many row groups, and a switch from one task for all of them to one task for each."""
    rng = random.Random(11)
    texts = [" ".join(f"r{rng.randrange(10**6)}" for _ in range(60)) for _ in range(400)]
    docs = [(i, texts[i % 400]) if i % 3 else (i, f"{texts[i % 400]} s{i}") for i in range(600)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 16384).option(
        "parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 10).parquet(path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)

    def split(fine):
        spark.conf.set(key, "16k" if fine else "128m")

    split(False)
    yield docs, spark.read.parquet(path), split
    spark.conf.set(key, before)


def test_near_duplicates_when_jobs_split_the_file_differently(regrouped):
    docs, frame, split = regrouped
    kept = minhash.deduplicate(frame, scanned=True)
    split(True)
    assert frame.rdd.getNumPartitions() > 1
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(400))


def test_repeats_when_jobs_split_the_file_differently(regrouped):
    docs, frame, split = regrouped
    rest = recompress.remove_repeats(frame, scanned=True).select("doc_id", "n_words", "n_removed", "kept_text")
    split(True)
    assert Counter(tuple(r) for r in rest.collect()) == Counter(brute_repeats(docs, 13))


def test_token_counts_when_jobs_split_the_file_differently(regrouped):
    from tokenizers import Tokenizer

    docs, frame, split = regrouped
    library = Tokenizer.from_file(packing.default_tokenizer())
    counted = token_counts.count_tokens(frame, packing.default_tokenizer(), scanned=True)
    split(True)
    want = Counter((i, len(library.encode(t, add_special_tokens=False).ids)) for i, t in docs)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counted.collect()) == want


def test_rows_that_are_no_scan_are_numbered_once(spark, regrouped):
    docs, frame, split = regrouped
    for rows in (frame.unionByName(frame), frame.repartition(3), frame.where("doc_id % 2 = 0").select("text", "doc_id"), spark.read.parquet(*frame.inputFiles() * 2)):
        split(False)
        named = common.placed(rows, "_at")
        before = Counter((r["_at"], r["doc_id"]) for r in named.collect())
        split(True)
        assert before == Counter((r["_at"], r["doc_id"]) for r in named.collect())
        assert len({at for at, _ in before}) == rows.count()


# Personal data


def test_personal_data_of_odd_texts(table, empty):
    docs = table(
        (1, "mail a.b@c.org or 10.0.0.1"), (2, None), (3, ""), (None, "call +1 (212) 555-0199 now"), (4, "4111 1111 1111 1111"),
        (5, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'), (5, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'), (6, "4111 1111 1111 1112 pages"),
        (7, "1" * 100_000 + "a" * 100_000 + "@"),
    )
    spans = sorted((r["doc_id"] or 0, [s["kind"] for s in r["spans"]]) for r in pii.detect(docs).collect())
    assert spans == [(0, ["phone"]), (1, ["email", "ip"]), (2, []), (3, []), (4, ["card"]), (5, ["secret"]), (5, ["secret"]), (6, []), (7, [])]
    masked = pii.redact(docs)
    assert masked.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert got[1] == "mail [EMAIL] or [IP]" and got[2] is None and got[3] == "" and got[5] == 'token = "[SECRET]"'
    assert pii.detect(empty).count() == 0 and pii.redact(empty).count() == 0


def test_reliabilities_and_held_out_accuracy():
    """Labelers of known reliability: the estimates come near, and the classifier is right on patterns it was not fitted to."""
    rng = np.random.default_rng(4)
    truth = rng.random(6000) < 0.4
    right = np.asarray([0.95, 0.85, 0.8, 0.75, 0.7])
    agree = rng.random((6000, 5)) < right
    voted = np.where(agree == truth[:, None], 2, 1)
    codes = np.asarray([pii.pattern_of(2, v.tolist(), 0) for v in voted])
    kinds, counts = np.unique(codes[:4000], return_counts=True)
    model = pii.train(kinds, counts)
    assert abs(model.reliabilities["card"]["pattern"] - 0.95) < 0.05
    assert ((model.probability(codes[4000:]) >= 0.5) == truth[4000:]).mean() > 0.93


# Packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=150), st.integers(40, 60))
def test_plan_places_every_piece_once(lengths, capacity):
    table = packing.plan(dict(Counter(lengths)), capacity)
    seen: Counter = Counter()
    numbers = []
    for n in lengths:
        numbers.append(seen[n])
        seen[n] += 1
    if not lengths:
        assert table == []
        return
    sequences, offsets = packing.find_places(table, np.asarray(lengths, np.int64), np.asarray(numbers, np.int64))
    bins: dict[int, list[tuple[int, int]]] = {}
    for s, o, n in zip(sequences.tolist(), offsets.tolist(), lengths, strict=True):
        bins.setdefault(s, []).append((o, n))
    for own in bins.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= capacity
        assert sum(3 * n > capacity for _, n in own) <= 2
    # No worse than first-fit decreasing's bound.
    assert len(bins) <= 11 / 9 * -(-sum(lengths) // capacity) + max(4, sum(2 * n > capacity for n in lengths))


def test_packing_odd_rows(odd, empty):
    placed = packing.pack(odd, packing.default_tokenizer(), capacity=64, with_ids=True).collect()
    assert Counter(r["doc_id"] for r in placed if r["doc_id"] in (2, 3, 4)) == {2: 1, 3: 1, 4: 1}
    assert all(len(r["ids"]) == r["length"] for r in placed) and all(r["length"] == 1 for r in placed if r["doc_id"] in (2, 3, 4))
    assert packing.pack(empty, packing.default_tokenizer()).count() == 0


# Token counts


def test_token_counts_of_odd_rows(odd, empty, table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(odd, packing.default_tokenizer()).collect()) == want
    assert token_counts.count_tokens(empty, packing.default_tokenizer()).count() == 0
    special = "a<|endoftext|>b é ½ 日本 İx"
    (row,) = token_counts.count_tokens(table((1, special)), packing.default_tokenizer()).collect()
    assert row["n_tokens"] == len(library.encode(special, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_pre_tokens_give_the_library_ids(text):
    t = wordbpe.tokenizer(packing.default_tokenizer())
    assert [i for w in t.split(text) for i in t.ids(w)] == t.library.encode(text, add_special_tokens=False).ids


# Piece codec


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=40), max_size=5))
def test_codec_equals_the_library(texts):
    import sentencepiece

    path = piece_codec.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, per_text = piece_codec.encode_texts(path, texts)
    assert np.split(ids, np.cumsum(per_text))[: len(texts)] is not None
    assert [x.tolist() for x in np.split(ids, np.cumsum(per_text))[: len(texts)]] == [sp.encode(t) for t in texts]
    assert piece_codec.decode_ids(path, ids, per_text) == [sp.decode(sp.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 300)), max_size=8), max_size=4))
def test_decoding_any_ids(lists):
    import sentencepiece

    path = piece_codec.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    flat = np.asarray([i for x in lists for i in x], np.int64)
    assert piece_codec.decode_ids(path, flat, np.asarray(list(map(len, lists)), np.int64)) == [sp.decode(x) for x in lists]


def test_codec_of_odd_rows(odd, empty, table):
    path = piece_codec.default_model()
    encoded = piece_codec.encode(odd, path)
    assert set(encoded.columns) == set(odd.columns) - {"text"} | {"ids"}
    back = piece_codec.decode(encoded, path)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert piece_codec.decode(piece_codec.encode(empty, path), path).count() == 0
    with pytest.raises(ValueError):
        piece_codec.encode(encoded.withColumnRenamed("_text", "text"), path)


# Substrings


def brute_repeats(docs, size):
    order = lambda i: (i is None, i or 0)
    first: dict = {}
    for i, t in docs:
        w = (t or "").split()
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, t in docs:
        w = (t or "").split()
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < order(i) for j in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_repeats_by_brute_force(table, odd, empty):
    rng = random.Random(8)
    passages = [" ".join(f"p{rng.randrange(40)}" for _ in range(rng.randint(10, 70))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [" ".join(f"q{rng.randrange(4 if i % 5 == 0 else 400)}" for _ in range(rng.randint(0, 40))) for _ in range(3)]
        docs.append((None if i % 13 == 0 else i % 50, " ".join([parts[0], rng.choice(passages), parts[1], rng.choice(passages), parts[2]])))
    docs += docs[:8] + [(90, "a " * 60), (91, "b " + "a " * 40), (92, None), (93, "one two"), (94, "")]
    got = Counter(tuple(r) for r in recompress.remove_repeats(table(*docs)).select("doc_id", "n_words", "n_removed", "kept_text").collect())
    assert got == Counter(brute_repeats(docs, 13))
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = Counter(tuple(r) for r in recompress.remove_repeats(odd).select("doc_id", "n_words", "n_removed", "kept_text").collect())
    assert got == Counter(brute_repeats(plain, 13))
    assert recompress.remove_repeats(empty).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    words = np.asarray([rng.randrange(12) for _ in range(6000)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.repeat(np.arange(60), 100)
    found = recompress.anchors(words, doc)
    seen: dict = {}
    for i in range(len(words) - 12):
        if doc[i] == doc[i + 12]:
            assert seen.setdefault(words[i : i + 13].tobytes(), found[i]) == found[i]
    assert len(set(seen.values())) < len(seen)


# Chat


def conversation(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1) for c, t, r, x in rows], "conv_id long, turn long, role string, text string, piece int")


def test_chat_spans_and_reading_back(spark):
    odd = "<|im_end|>\\n \\ <|im_start|>assistant\nok\\"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, None, None), (2, 0, None, None), (None, None, "assistant", ""), (3, 0, "a\nb", "x")]
    made = chat.format_turns(conversation(spark, rows))
    for r in made.collect():
        assert not r["rewrites"] and r["end"] - r["start"] == len(r["piece"])
        if r["role"] == "assistant":
            inside = r["piece"][r["loss_start"] - r["start"] : r["loss_end"] - r["start"]]
            assert chat.unescape(inside) == (odd if r["conv_id"] == 1 else "")
    back = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(made).collect()}
    assert back == {1: (2, len(odd)), 2: (2, 0), None: (1, 0), 3: (1, 0)}
    assert chat.read_back(chat.format_turns(conversation(spark, []))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30), st.text(alphabet="<|\\im_startend>\n", max_size=30))
def test_escapes_are_reversible(a, b):
    for text in (a, b):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_templates_that_rewrite_history_are_found(spark):
    def shortened_history(turns):
        """Drops what earlier turns say before a bar."""
        return "".join(f"[{r}]{t if i == len(turns) - 1 else t.rpartition('|')[2]};" for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "think|say"), (1, 2, "user", "next")]
    marks = {r["turn"]: r["rewrites"] for r in chat.format_turns(conversation(spark, rows), shortened_history).collect()}
    assert marks == {0: False, 1: False, 2: True}


def test_templates_that_look_far_back_are_followed_or_found(spark):
    def told_by_the_first(turns):
        """Writes roles as the system turn at the start says."""
        loud = bool(turns) and turns[0] == ("system", "loud")
        return "".join(f"[{r.upper() * 2 if loud else r}]{t};" for r, t in turns)

    def forgets(turns):
        """Drops all but the last five turns once there are more than six."""
        return "".join(f"[{r}]{t};" for r, t in (turns if len(turns) <= 6 else turns[-5:]))

    turns = [("system", "loud")] + [("assistant" if i % 2 else "user", f"t{i}") for i in range(1, 10)]
    rows = conversation(spark, [(1, i, r, t) for i, (r, t) in enumerate(turns)])
    made = sorted(chat.format_turns(rows, told_by_the_first).collect(), key=lambda r: r["turn"])
    whole = "".join(r["piece"] for r in made)
    assert whole == told_by_the_first(turns) and not any(r["rewrites"] for r in made)
    assert all(whole[r["loss_start"] : r["loss_end"]] == (turns[r["turn"]][1] if r["role"] == "assistant" else "") for r in made)
    marks = {r["turn"]: r["rewrites"] for r in chat.format_turns(rows, forgets).collect()}
    assert marks == {i: i >= 6 for i in range(10)}


def test_long_conversations_are_streamed(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(3000)]
    made = chat.format_turns(conversation(spark, rows)).collect()
    assert "".join(r["piece"] for r in sorted(made, key=lambda r: r["turn"])) == chat.marked([(r, t) for _, _, r, t in rows])
