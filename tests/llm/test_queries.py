"""The registered queries over the smallest tables, beside their SQL or a brute-force version."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlake.llm import packing, pii, piece_codec
from spendlake.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "conversations", "benchmark")


@pytest.fixture(scope="module")
def texts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, small).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = want.columns[0]
    got = got[list(want.columns)].sort_values(key).reset_index(drop=True)
    want = want.sort_values(key).reset_index(drop=True)
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist(), c


def test_shards(spark, small, texts):
    rows = QUERIES["op2_shards"](spark, small).toPandas().sort_values(["shard", "slot"])
    assert rows.doc_id.tolist() == sorted(texts)
    for r in rows.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert all(g.slot.tolist() == list(range(len(g))) for _, g in rows.groupby("shard"))
    target, longest = rows["size"].sum() / 40, rows["size"].max()
    assert all(abs(s - target) <= longest for s in rows.groupby("shard")["size"].sum())


def brute_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(digits):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    def holds(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if holds(k, m[0])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.@+-() ab%", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [(pii.KINDS[c.kind], c.start, c.end) for c in pii.candidates(text) if c.base] == brute_spans(text)


def test_personal_data(spark, small, texts):
    for r in QUERIES["op4_pii"](spark, small).collect():
        base = brute_spans(texts[r["doc_id"]])
        counts = Counter(k for k, _, _ in base)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [counts[k] for k in ("email", "ip", "card", "phone")]
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r["spans"].split(",")) | {""}


@pytest.fixture(scope="module")
def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return {i: e.ids for i, e in zip(texts, t.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}


def test_packing(spark, small, library_ids):
    rows = QUERIES["op6_packing"](spark, small).toPandas()
    assert set(rows.doc_id) == set(library_ids)
    for doc, pieces in rows.groupby("doc_id"):
        ids = [*library_ids[doc], 1]
        pieces = pieces.sort_values("piece")
        assert pieces.piece.tolist() == list(range(len(pieces))) and pieces.start.tolist() == list(range(0, len(ids), 4096))
        for p in pieces.itertuples():
            own = ids[p.start : p.start + 4096]
            assert (p.length, p.ids_crc32) == (len(own), zlib.crc32(np.asarray(own, "<u4").tobytes()))
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 4096
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 4096) + 1


def test_token_counts(spark, small, texts, library_ids):
    rows = QUERIES["op7_token_counts"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library_ids[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


def test_piece_codec(spark, small, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    rows = QUERIES["op9_piece_codec"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
