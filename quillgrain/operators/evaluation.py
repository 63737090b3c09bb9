"""Evaluation of document search over chunk vectors, from a checked scope to one row of figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics, retrieval


def scope_violations(corpus: DataFrame, chunks: DataFrame, exclusions: DataFrame, queries: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """(rule, violations): an evaluation is of the whole corpus and of the very queries asked, or it isn't one.

    corpus: doc_id; chunks: doc_id, chunk_id, embedding; exclusions: doc_id of
    documents that couldn't be parsed; queries: qid; query_vectors: qid, qvec.
    """
    of = lambda df, key: df.select(key).distinct()
    embedded = chunks.filter(F.col("embedding").isNotNull())
    rules = [
        ("document_embedded_or_excluded", of(corpus, "doc_id").join(of(embedded, "doc_id").union(of(exclusions, "doc_id")), "doc_id", "left_anti")),
        ("chunk_of_a_document", of(chunks, "doc_id").join(of(corpus, "doc_id"), "doc_id", "left_anti")),
        ("excluded_without_chunks", of(exclusions, "doc_id").join(of(chunks, "doc_id"), "doc_id", "left_semi")),
        ("query_has_a_vector", of(queries, "qid").join(of(query_vectors.filter(F.col("qvec").isNotNull()), "qid"), "qid", "left_anti")),
        ("vector_of_a_query", of(query_vectors, "qid").join(of(queries, "qid"), "qid", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, (bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, bad in rules))


def check_scope(corpus: DataFrame, chunks: DataFrame, exclusions: DataFrame, queries: DataFrame, query_vectors: DataFrame) -> None:
    broken = {r.rule: r.violations for r in scope_violations(corpus, chunks, exclusions, queries, query_vectors).collect() if r.violations}
    if broken:
        raise ValueError(f"the evaluation's scope isn't whole: {broken}")


def evaluate(corpus: DataFrame, chunks: DataFrame, exclusions: DataFrame, queries: DataFrame, query_vectors: DataFrame, qrels: DataFrame, candidate_k: int = 50, how: str = "max", top_n: int = 3) -> DataFrame:
    """One row: queries, recall at the cutoffs, MRR@10, graded nDCG@10, and how many relevant pairs can be found at all.

    chunks: chunk_id, doc_id, family, embedding. Only judged queries count; none
    at all raises. The scope is checked first.
    """
    check_scope(corpus, chunks, exclusions, queries, query_vectors)
    relevant = qrels.filter("rel > 0")
    judged = queries.select("qid").distinct().join(relevant.select("qid").distinct(), "qid", "left_semi")
    if judged.isEmpty():
        raise ValueError("no query has a judgement")
    found = retrieval.vector_topk(chunks.filter(F.col("embedding").isNotNull()), query_vectors.join(judged, "qid", "left_semi"), candidate_k, "chunk_id")
    run = retrieval.rank_documents(found.join(chunks.select("chunk_id", "doc_id", "family"), "chunk_id"), how, top_n)
    per = metrics.score_queries(judged, relevant, run)
    graded = metrics.graded_ndcg(relevant.join(judged, "qid", "left_semi").select("qid", "doc_id", "rel"), run)
    wanted = [*(f"recall_{k}" for k in metrics.CUTOFFS), "mrr_10"]
    figures = per.join(graded, "qid").agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in wanted), F.round(F.avg("ndcg"), 6).alias("ndcg_10"))
    indexed = chunks.filter(F.col("embedding").isNotNull()).select("doc_id")
    return figures.crossJoin(F.broadcast(metrics.qrels_coverage(qrels, indexed, judged).drop("judged_queries")))
