"""Golden cases of retrieval: fusion, families, thresholds, step-back, search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillgrain.operators import retrieval as r
from quillgrain.operators import search


def channel(spark, rows):
    return spark.createDataFrame([(1, d, float(s), i) for i, (d, s) in enumerate(rows, 1)], "qid int, doc_id string, score double, rank int")


def test_rrf_golden(spark):
    v, k = channel(spark, [("a", 0.9), ("b", 0.8), ("c", 0.7)]), channel(spark, [("b", 1), ("d", 0.5), ("a", 0.2)])
    rows = r.rrf_fuse(v, k, 10).orderBy("rank").collect()
    assert [x.doc_id for x in rows] == ["b", "a", "d", "c"]
    assert rows[0].fused_score == pytest.approx((1 / 62 + 1 / 61) / (2 / 61), abs=1e-6) and rows[0].channel_hits == "keyword,vector"
    assert rows[2].vector_score == 0 and rows[2].channel_hits == "keyword"
    scaled = r.rrf_fuse(v.withColumn("score", F.col("score") / 10), k, 10).orderBy("rank").collect()
    assert [x.fused_score for x in scaled] == [x.fused_score for x in rows]


def test_one_empty_channel(spark):
    assert [x.fused_score for x in r.rrf_fuse(channel(spark, [("c1", 0.4)]), channel(spark, [("x", 1)]).limit(0), 5).collect()] == [0.5]


def children(spark):
    rows = [(1, "a", "p1", 0.2, 0.2, 1), (1, "b", "p1", 0.95, 0.9, 2), (1, "c", "p2", 0.6, 0.6, 3)]
    return spark.createDataFrame(rows, "qid int, chunk_id string, family string, score double, keyword_score double, rank int")


def test_family_mean_and_max(spark):
    assert [(x.family, x.score) for x in r.expand_families(children(spark), None, "mean").orderBy("rank").collect()] == [("p2", 0.6), ("p1", 0.575)]
    best = r.expand_families(children(spark), None, "max").orderBy("rank").collect()
    assert [(x.family, x.score, x.primary_child) for x in best] == [("p1", 0.95, "b"), ("p2", 0.6, "c")]


def test_missing_and_empty_parents(spark):
    parents = spark.createDataFrame([("p1", "text"), ("p2", "")], "family string, content string")
    assert {x.family: x.parent_found for x in r.expand_families(children(spark), parents, "max").collect()} == {"p1": True, "p2": False}


def test_family_key(spark):
    df = spark.createDataFrame([("p", "c"), ("", "c"), (None, "c")], "p string, c string")
    assert [x[0] for x in df.select(r.family_key(F.col("p"), F.col("c"))).collect()] == ["p", "c", "c"]


def test_document_ranking(spark):
    rows = [(1, "pa", "A", 0.9), (1, "pa", "A", 0.1), (1, "pb", "B", 0.7)]
    df = spark.createDataFrame(rows, "qid int, family string, doc_id string, score double")
    assert [x.doc_id for x in r.rank_documents(df).orderBy("rank").collect()] == ["B", "A"]


def test_dedupe_makes_ranks_contiguous(spark):
    df = spark.createDataFrame([(1, "d1", "x", 1), (1, "d1", "y", 2), (1, "d2", "z", 3)], "qid int, doc_id string, chunk_id string, rank int")
    assert [(x.doc_id, x.rank) for x in r.dedupe_by_document(df).orderBy("rank").collect()] == [("d1", 1), ("d2", 2)]


def test_step_back_prefers_first_on_ties(spark):
    a, b = channel(spark, [("x", 0.5), ("y", 0.4)]), channel(spark, [("y", 0.9), ("x", 0.5)])
    assert [(m.doc_id, m.score, m.source) for m in r.merge_step_back(a, b, 5).orderBy("rank").collect()] == [("y", 0.9, 1), ("x", 0.5, 0)]


def test_chunk_order(spark):
    df = spark.createDataFrame([(3, "a_ck_9"), (None, "a_ck_12"), (None, "plain")], "o int, c string")
    assert [x[0] for x in df.select(r.chunk_order(F.col("o"), F.col("c"))).collect()] == [3, 12, 1_000_000]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["z"])], "n int, s string, t array<string>")
    pick = lambda *a, **k: [x.n for x in df.filter(r.compile_filters(*a, **k)).collect()]
    assert pick({"s": "a"}) == [1] and pick({"s": ["a", "b"]}) == [1, 2] and pick(None) == [1, 2]
    assert pick({"t": "z"}, arrays=["t"]) == [2] and pick({"n": 1}, {"n": 2}) == [2]


def test_pair_text(spark):
    df = spark.createDataFrame([("name", ["a", "b"], "body"), ("", [], "body")], "n string, p array<string>, c string")
    assert [x[0] for x in df.select(r.pair_text(F.col("n"), F.col("p"), F.col("c"))).collect()] == ["name\na > b\nbody", "body"]


def test_vector_search_ways_agree(spark):
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    corpus = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    asked = data[:5]
    plan = r.vector_topk(corpus, spark.createDataFrame(asked, "qid long, qvec array<float>"), 7)
    blocks = r.vector_topk_blocks(corpus, asked, 7)
    pick = lambda df: sorted((x.qid, x["rank"], x.vec_id) for x in df.collect())
    assert pick(plan) == pick(blocks) and len(pick(plan)) == 35


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "other")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common rare"), (2, "absent")], "qid int, text string")
    rows = r.keyword_topk(docs, asked, 5, {"text": 1.0}).orderBy("rank").collect()
    assert [(x.qid, x.doc_id) for x in rows] == [(1, 1), (1, 2)] and rows[0].score == 1.0


def test_zero_null_and_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("s", [1.0]), ("i", [float("inf"), 1.0]), ("h", [None, 1.0]), (None, [1.0, 0.0]), ("b", [-1.0, 0.0])]
    corpus = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "qid int, qvec array<double>")
    got = [(x.qid, x.vec_id, x.score, x["rank"]) for x in r.vector_topk(corpus, asked, 5).orderBy("qid", "rank").collect()]
    assert got == [(1, "a", 1.0, 1), (1, "z", 0.5, 2), (1, "b", 0.0, 3), (2, "a", 0.5, 1), (2, "b", 0.5, 2), (2, "z", 0.5, 3)]
    assert r.vector_topk(corpus, asked.limit(0), 5).count() == 0 and r.vector_topk(corpus.limit(0), asked, 5).count() == 0


def plain_bm25(docs, terms):
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in terms}
    return {i: sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in terms if t in d) for i, d in docs.items()}


@pytest.mark.parametrize("cells", [4_000_000, 60])
def test_bm25_of_the_best_field(spark, monkeypatch, cells):
    """All fields in one pass, questions and rows in blocks or not, equal the definition; a list is one text."""
    monkeypatch.setattr(search, "MOST_CELLS", cells)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"c{i:03d}", rng.choice(words), [rng.choice(words), rng.choice(words)], " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(80)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_name string, section_path array<string>, content string")
    asked = [(i, " ".join(rng.choices(words, k=4))) for i in range(6)] + [(9, ""), (10, None)]
    got = {(x.qid, x.chunk_id): x.raw for x in r.keyword_topk(chunks, spark.createDataFrame(asked, "qid int, text string"), 100, r.KEYWORD_FIELDS, "chunk_id").collect()}
    want = {}
    for q, text in asked:
        terms = set((text or "").split())
        for boost, docs in ((2, {i: [n] for i, n, _, _ in rows}), (2, {i: p for i, _, p, _ in rows}), (1, {i: c.split() for i, _, _, c in rows})):
            for i, raw in plain_bm25(docs, terms).items():
                if raw > 0:
                    want[q, i] = max(want.get((q, i), 0), boost * raw)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_fusion_ties_go_by_place(spark):
    """Equal scores: chunk order, then document, then chunk, ids as texts."""
    v = spark.createDataFrame([(1, "x_ck_2", 1.0, 1), (1, "b", 0.5, 2)], "qid int, chunk_id string, score double, rank int")
    k = spark.createDataFrame([(1, "y", 1.0, 1), (1, "a", 0.5, 2)], "qid int, chunk_id string, score double, rank int")
    places = spark.createDataFrame([("x_ck_2", None, "d"), ("y", 1, "d"), ("a", 7, "d10"), ("b", 7, "d9")], "chunk_id string, chunk_order int, doc_id string")
    assert [x.chunk_id for x in r.rrf_fuse(v, k, 9, "chunk_id", places).orderBy("rank").collect()] == ["y", "x_ck_2", "a", "b"]


def test_rule_rerank_reads_all_fields(spark):
    corpus = spark.createDataFrame([("a", "alpha", ["beta"], ["gamma"], "none", 5), ("b", "x", [], [], "alpha", 3), ("c", "x", [], [], "alpha", 2)], "chunk_id string, doc_name string, section_path array<string>, question_kwd array<string>, content string, chunk_order int")
    pool = spark.createDataFrame([(1, i, 0.5, 0.2, 0.0, n) for n, i in enumerate("abc", 1)], "qid int, chunk_id string, fused_score double, keyword_score double, vector_score double, rank int")
    rows = r.rule_rerank(pool, spark.createDataFrame([(1, "alpha beta gamma delta")], "qid int, text string"), corpus, "chunk_id").orderBy("rank").collect()
    assert [(x.chunk_id, x.rerank_score) for x in rows] == [("a", 0.575), ("c", 0.525), ("b", 0.525)]
