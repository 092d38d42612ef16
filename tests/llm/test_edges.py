"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""

import pytest
from brute import CLASHES, odd_documents, odd_rows
from pyspark.sql import functions as F

import corpus_pipeline
from lexiframe.llm import (bpe, licences, line_dedup, near_dup, packing, pii, quality_model, quality_rules,
                           search, toxicity)


@pytest.fixture(scope="module", params=[False, True], ids=["odd", "empty"])
def docs(request, spark):
    return odd_documents(spark, request.param).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (6, 1, 0), (None, 0, 1), (99, 0, None)], "doc_id long, quality int, toxic int")


def kept_columns(docs, out):
    assert out.columns[:len(docs.columns)] == docs.columns
    assert len({c.lower() for c in out.columns}) == len(out.columns)


def test_pii(docs):
    out = pii.find(docs)
    kept_columns(docs, out)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["text"] is None:
            assert r[out.columns[-2]] == []
        if r["doc_id"] == 9:
            assert [s["kind"] for s in r[out.columns[-2]]] == ["email", "phone"]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert r["doc_id"] != 9 or ("[EMAIL]" in r["text"] and r["n_chars"] == len(r["text"]))


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs, counts=True)
    kept_columns(docs, out)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] == 11:
            assert r["text"] == "x" and (r[out.columns[-2]], r[out.columns[-1]]) == (3, 1)
        if r["doc_id"] == 0:
            assert r["text"] is None


def test_packing(docs, vocabulary):
    rows = packing.pack(docs, vocabulary).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_tokens"] == 1) == len(
        [r for r in rows if r["doc_tokens"] == 1])
    assert len([r for r in rows if r["start"] == 0]) == docs.count()
    held = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == held.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 1024 for n in held.values())


def test_bpe(docs, vocabulary):
    out = bpe.encode(docs, vocabulary)
    kept_columns(docs, out)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns[-2:] == ["ids_", "decoded_"]
    assert all(r["decoded_"] == (r["text"] or "") for r in rows)


def test_quality_model(docs):
    out = quality_model.score(docs)
    kept_columns(docs, out)
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["quality_"] <= 1 for r in rows)


def test_near_duplicates(docs):
    groups = near_dup.near_groups(docs).collect()
    assert len(groups) == docs.count()
    by_id = {r["doc_id"]: r["class_id"] for r in groups if r["doc_id"] not in (4, None)}
    if groups:
        # texts without words are one class with the null row first
        assert by_id[0] is None and by_id[1] is None and by_id[2] is None and by_id[10] is None
        assert by_id[6] == 6 and by_id[3] == 3 and by_id[11] == 11
        assert by_id[5] is None  # the same text stands in the row without an id
        assert {r["class_id"] for r in groups if r["doc_id"] == 4} == {4, None}
    out = near_dup.drop_near(docs)
    assert out.columns == docs.columns
    assert out.count() == len({(r["class_a"], r["class_b"]) for r in groups})


def test_licences(docs):
    rows = licences.scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["licenses"] == ("CC-BY-NC-4.0" if r["doc_id"] == 9 else "") and r["license"] is None
        assert r["n_matches"] == (r["doc_id"] == 9)


def test_toxicity(docs, labels):
    chain = toxicity.fit(docs, labels)
    out = toxicity.score(docs, chain)
    kept_columns(docs, out)
    rows = out.collect()
    assert len(rows) == docs.count()
    assert not any(r[out.columns[-1]] for r in rows if not (r["text"] or "").strip())
    assert toxicity.clean(docs, chain).columns == docs.columns
    assert not toxicity.fit(docs, labels.limit(0)).threshold <= 1


def test_search(docs):
    rows = search.search(docs).collect()
    assert {r["query_id"] for r in rows} <= {0}
    for r in search.search(docs, every=2).collect():
        assert r["query_id"] % 2 == 0 and r["score"] > 0


def test_quality_rules(docs):
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] in (0, 1, 2, 10):
            assert (r["n_words"], r["base_failed"], r["kept"], r["word_distance"]) == (0, True, False, None)
        if r["doc_id"] == 11:
            assert r["n_dup_lines"] == 2


def test_every_stage(docs, spark, small):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == docs.columns, name
        out = out.collect()
        assert bool(out) == bool(docs.count()), name


def test_clashes_are_there(docs):
    assert set(CLASHES) <= set(docs.columns) and len(odd_rows()) == 18
    assert docs.select(F.count("*")).first()[0] in (0, 18)
