"""Stages of the pipeline against plain Python on the smallest tables."""

import random

import pytest

import corpus_pipeline
from stepweave.llm.shared import folder
from tests.llm import tables as t

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = [set(texts)]
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        path = folder(spark, "stage")
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "token_files":
            assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
    assert kept[1] == {i for i, text in texts.items() if any(c.isalpha() for c in text)}
    sets = {i: t.shingle_set(texts[i], 5) for i in kept[1]}
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    at = t.smallest_reachable(ids, links)
    assert kept[2] == {i for i in ids if at[i] == i}
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    leaks = {i for i in kept[2] if any(item in texts[i] for item in items)}
    assert leaks and kept[3] == kept[2] - leaks
    words = lambda ids: sum(len(t.lowered_words(texts[i])) for i in ids)
    assert 0.8 * words(kept[3]) <= words(kept[4]) <= 0.9 * words(kept[3])
    assert kept[5] == kept[4]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (7, "some words here", None, None, 3)]])
def test_stages_pass_empty_and_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, t.DOCS).selectExpr("*", "'x' as lang_pred", "1 as kept")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() <= len(rows)


def test_the_mix_keeps_rows_without_an_id(spark):
    rng = random.Random(4)
    rows = [(i, t.sentence(rng, "en", 20), "en", "src1", 1) for i in range(40)]
    lost = [(None, t.sentence(rng, "en", 30), "en", "src1", 2), (None, t.sentence(rng, "de", 500), "de", "src2", 3)]
    docs = spark.createDataFrame(rows + lost, t.DOCS)
    found = [tuple(r) for r in corpus_pipeline.target_mix(spark, docs, SF_DIR).collect()]
    assert sorted((r for r in found if r[0] is None), key=lambda r: r[4]) == lost
    kept = [r for r in found if r[0] is not None]
    assert kept and len(kept) == len(set(kept)) and set(kept) <= set(rows)


def test_documents_stay_where_no_language_was_learned(spark):
    kept = [(1, "some words", None, "s", 1), (None, "é", None, None, None), (2, "ONE 2", None, "s", 5)]
    odd = [(3, None, None, "s", 1), (4, "", None, "s", 1), (5, "12 !!", None, "s", 1)]
    docs = spark.createDataFrame(kept + odd, t.DOCS)
    found = corpus_pipeline.language(spark, docs, SF_DIR)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, kept)) and found.columns == docs.columns
    assert corpus_pipeline.language(spark, docs.limit(0), SF_DIR).collect() == []
