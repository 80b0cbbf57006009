"""The pipeline's stages on a small corpus, against what each must do."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from yieldspark.llm import packing
from yieldspark.session import scratch_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(llm, docs, labels):
    path = scratch_path(llm, "pipeline-test")
    llm.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    llm.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def corpus():
    random.seed(11)
    words = [f"word{i}" for i in range(300)]
    texts = {i: " ".join(random.choices(words, k=80)) for i in range(40)}
    texts |= {i: " ".join(random.choices(["rot", "foul", "vile"], k=80)) for i in range(40, 70)}  # rated toxic
    texts[80] = texts[3]  # an exact copy
    texts[81] = texts[4] + " end"  # a near copy
    texts[82] = texts[5] + " write to someone@example.com now"
    texts |= {83: None, 84: ""}
    docs = [(i, t, None, "s", len(t or "")) for i, t in texts.items()]
    labels = [(i, 1, 0) for i in range(40)] + [(i, 0, 1) for i in range(40, 70)]
    return docs, labels


def test_stages_take_effect_and_keep_columns(llm, corpus):
    docs, labels = corpus
    path = folder(llm, docs, labels)
    now = llm.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, now, path)
        assert out.columns == now.columns, name
        here = scratch_path(llm, "stage")
        out.write.parquet(here)
        now = llm.read.parquet(here)
        kept[name] = {r.doc_id: r.text for r in now.collect()}
    quality, join, private = kept.values()
    assert not set(quality) & set(range(40, 70)) and set(range(40)) <= set(quality)
    assert set(quality) - set(join) >= {80, 81} & set(quality) and set(range(40)) <= set(join)
    assert "someone@example.com" not in (private.get(82) or "") and "[EMAIL]" in private.get(82, "[EMAIL]")
    packed = corpus_pipeline.packed(llm, now, path).collect()
    model = packing.word_ids(packing.VOCABULARY)
    want = {i: len(model.encode([t or ""])[0]) // 4 + 1 for i, t in private.items()}
    got: dict[int, int] = {}
    for p in packed:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want


def test_the_pipeline_of_empty_tables(llm):
    assert corpus_pipeline.run(llm, folder(llm, [], [])).count() == 0
