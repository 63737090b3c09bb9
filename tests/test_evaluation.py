import json
import math

import pytest
from pyspark.sql import functions as F

from quillgrain.config import read_settings
from quillgrain.operators import datasets, evaluation, metrics, parsing
from quillgrain.sources import store


def parts(spark):
    corpus = spark.createDataFrame([(f"d{i}",) for i in range(5)], "doc_id string")
    vectors = {"c0": ("d0", "p0", [1.0, 0.0]), "c1": ("d1", "p1", [0.9, 0.1]), "c2": ("d1", "p2", [0.0, 1.0]), "c3": ("d2", "p3", [0.7, 0.7]), "c4": ("d3", "p4", [-1.0, 0.0])}
    chunks = spark.createDataFrame([(c, *v) for c, v in vectors.items()], "chunk_id string, doc_id string, family string, embedding array<double>")
    gone = spark.createDataFrame([("d4",)], "doc_id string")
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "qid string")
    asked = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0]), ("q3", [1.0, 1.0])], "qid string, qvec array<double>")
    qrels = spark.createDataFrame([("q1", "d1", 2), ("q1", "d0", 1), ("q2", "d4", 1), ("q2", "d1", 1), ("q2", "d1", 1), ("q3", "d0", 0), ("other", "d0", 1)], "qid string, doc_id string, rel int")
    return corpus, chunks, gone, queries, asked, qrels


def test_figures_by_hand(spark):
    corpus, chunks, gone, queries, asked, qrels = parts(spark)
    r = evaluation.evaluate(corpus, chunks, gone, queries, asked, qrels.distinct()).first()
    # q1: d0, d1 come first and second; q2: d1 first, d4 can't be found.
    ndcg1 = (1 / math.log2(2) + 3 / math.log2(3)) / (3 / math.log2(2) + 1 / math.log2(3))
    ndcg2 = 1 / (1 + 1 / math.log2(3))
    assert (r.queries, r.recall_1, r.recall_10, r.mrr_10) == (2, 0.5, 0.75, 1.0) and abs(r.ndcg_10 - (ndcg1 + ndcg2) / 2) < 1e-5
    assert (r.relevant_pairs, r.retrievable_pairs, r.coverage) == (4, 3, 0.75)
    none = metrics.qrels_coverage(qrels.limit(0), corpus, queries).first()
    assert (none.judged_queries, none.relevant_pairs, none.coverage) == (0, 0, 0.0)


def test_a_scope_that_is_not_whole(spark):
    corpus, chunks, gone, queries, asked, qrels = parts(spark)
    bad = [
        ("document_embedded_or_excluded", (corpus, chunks, gone.limit(0), queries, asked)),
        ("chunk_of_a_document", (corpus.filter("doc_id <> 'd3'"), chunks, gone, queries, asked)),
        ("excluded_without_chunks", (corpus, chunks, gone.union(corpus.filter("doc_id = 'd0'")), queries, asked)),
        ("query_has_a_vector", (corpus, chunks, gone, queries, asked.filter("qid <> 'q3'"))),
        ("vector_of_a_query", (corpus, chunks, gone, queries.filter("qid <> 'q3'"), asked)),
    ]
    for rule, scope in bad:
        assert {r.rule for r in evaluation.scope_violations(*scope).collect() if r.violations} == {rule}
        with pytest.raises(ValueError, match=rule):
            evaluation.evaluate(*scope, qrels)
    with pytest.raises(ValueError, match="no query"):
        evaluation.evaluate(corpus, chunks, gone, queries, asked, qrels.filter("rel = 0"))


def test_rows_and_documents_that_cannot_be_searched(spark):
    rows = spark.createDataFrame([("a", True, [1.0, 0.0]), ("b", True, None), ("c", True, [0.0, 0.0]), ("d", False, [1.0, 1.0]), ("e", False, None), ("f", True, [1.0])], "chunk_id string, retrieval_eligible boolean, embedding array<double>")
    with pytest.raises(ValueError, match="^b: no vector; c: invalid vector; d: vector of a row that isn't searched$"):
        store.require_index_rows(rows, 2)
    assert store.require_index_rows(rows.filter("chunk_id IN ('a', 'e')"), 2).count() == 2
    docs = spark.createDataFrame([("1", "txt", "hi"), ("2", "exe", "x"), ("3", "txt", "picture only")], "doc_id string, file_type string, content string")
    chunks = spark.createDataFrame([("1", "child", True), ("3", "child", False), ("3", "parent", True)], "doc_id string, chunk_role string, retrieval_eligible boolean")
    assert {r.doc_id: r.reason for r in parsing.exclusions(parsing.parse_documents(docs), docs, chunks).collect()} == {"2": "unsupported file type: exe", "3": "no eligible child"}


def test_too_few_queries(spark):
    queries = spark.createDataFrame([(1,), (2,)], "qid int")
    qrels = spark.createDataFrame([(1, "a", 1), (2, "a", 0)], "qid int, doc_id string, rel int")
    with pytest.raises(ValueError, match="only 1 of 2"):
        datasets.subsample(spark.createDataFrame([("a",)], "doc_id string"), queries, qrels, 2, 1, 1)


def test_settings_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"search": {"k": 5, "mode": "hybrid"}, "debug": False}))
    (tmp_path / "b.toml").write_text("debug = true\n[search]\nk = 7\n")
    (tmp_path / "c.json").write_text('{"search": {"unknown": 1}}')
    (tmp_path / "d.json").write_text("{")
    at = lambda name: str(tmp_path / name)
    assert read_settings(spark, at("a.json"), at("b.toml")) == {"search": {"k": 7, "mode": "hybrid"}, "debug": True}
    with pytest.raises(ValueError, match="search.unknown"):
        read_settings(spark, at("a.json"), at("c.json"))
    with pytest.raises(ValueError, match="d.json"):
        read_settings(spark, at("d.json"))
    assert F is not None and read_settings(spark) == {}
