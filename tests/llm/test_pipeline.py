"""The pipeline stage by stage beside brute-force versions, each on its own input."""

from __future__ import annotations

import re

import numpy as np
import pytest

import corpus_pipeline
from spendlake.llm import packing, pii
from spendlake.llm.queries import QUERIES
from spendlake.session import run_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = run_dir(spark, f"test-{name}")
        stage(spark, out[-1], small).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mask_personal_data", "pack"]
    assert all(df.columns == COLUMNS for df in stages[:5])


def test_quality_stage(spark, small, stages):
    kept = {r["doc_id"] for r in QUERIES["op3_quality_rules"](spark, small).where("kept").select("doc_id").collect()}
    assert set(texts(stages[1])) == kept and 0 < len(kept) < stages[0].count()


def test_exact_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    first: dict[str, int] = {}
    for i in sorted(before):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", before[i]), i)
    assert after == {i: before[i] for i in first.values()} and len(after) < len(before)


def test_near_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in before.items() if (w := t.encode().lower().split())}
    label = {i: i for i in before}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert after == {i: before[i] for i in set(label.values())}


def test_masking_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    changed = [i for i in before if before[i] != after[i]]
    assert changed
    for i in before:
        spans = [c for c in pii.candidates(before[i]) if c.base]
        if not pii.candidates(before[i]):
            assert after[i] == before[i]
        assert not any(c.base for c in pii.candidates(after[i])), i
        assert not spans or i in changed
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    rows = stages[5].toPandas()
    for doc, text in texts(stages[4]).items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        own = rows[rows.doc_id == doc].sort_values("piece")
        assert np.concatenate(own.ids.tolist()).tolist() == ids
    assert all(g.length.sum() <= 4096 for _, g in rows.groupby("sequence_id"))


def test_run_over_an_empty_table(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
