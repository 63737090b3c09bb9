"""Ranking, evidence, citation and latency metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)


def _ideal(n: Column, depth: int) -> Column:
    gains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(depth)).cast("int"))), lambda r: 1 / F.log2(r + F.lit(1.0)))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)


def score_queries(queries: DataFrame, qrels: DataFrame, run: DataFrame, cutoffs: Sequence[int] = CUTOFFS, depth: int = 10) -> DataFrame:
    """Per query of ``queries``: hit and recall at the cutoffs, reciprocal rank and binary nDCG.

    qrels: qid, doc_id. run: qid, doc_id, rank. Queries without a run score 0.
    """
    relevant = qrels.select("qid", "doc_id").distinct()
    n_rel = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    hits = run.join(relevant, ["qid", "doc_id"], "left_semi").select("qid", "rank")
    aggs = [F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in cutoffs]
    found = hits.groupBy("qid").agg(*aggs, F.min(F.when(F.col("rank") <= depth, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= depth, 1 / F.log2(F.col("rank") + 1))).alias("dcg"))
    joined = queries.join(n_rel, "qid", "left").join(found, "qid", "left")
    n = F.coalesce("n_rel", F.lit(0))
    at = lambda k: F.coalesce(f"found_{k}", F.lit(0))
    return joined.select(
        *queries.columns,
        *(F.when(at(k) > 0, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in cutoffs),
        *(F.round(F.when(n > 0, at(k) / n).otherwise(0.0), 6).alias(f"recall_{k}") for k in cutoffs),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias(f"mrr_{depth}"),
        F.round(F.when(n > 0, F.coalesce("dcg", F.lit(0.0)) / _ideal(n, depth)).otherwise(0.0), 6).alias(f"ndcg_{depth}"),
    )


def macro_average(per_query: DataFrame, task: str, metrics: Sequence[str]) -> DataFrame:
    """Means overall (group ``overall``) and of each task, from one grouping-sets aggregation."""
    means = [F.round(F.avg(m), 6).alias(m) for m in metrics]
    grouped = per_query.rollup(task).agg(F.grouping(task).alias("whole"), F.count("*").alias("queries"), *means)
    return grouped.select(F.when(F.col("whole") == 1, F.lit("overall")).otherwise(F.col(task).cast("string")).alias("task_group"), "queries", *metrics)


def qrels_coverage(qrels: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: queries judged, relevant pairs of asked queries, those whose document can be found, and their share.

    qrels: qid, doc_id, rel; corpus has the doc_id of what is indexed. A pair counts once.
    """
    pairs = qrels.filter("rel > 0").select("qid", "doc_id").distinct().join(queries.select("qid").distinct(), "qid", "left_semi")
    found = pairs.join(corpus.select("doc_id", F.lit(True).alias("found")).distinct(), "doc_id", "left")
    counts = found.agg(F.count_distinct("qid").alias("judged_queries"), F.count("*").alias("relevant_pairs"), F.count("found").alias("retrievable_pairs"))
    return counts.withColumn("coverage", F.round(F.when(F.col("relevant_pairs") > 0, F.col("retrievable_pairs") / F.col("relevant_pairs")).otherwise(0.0), 6))


def graded_ndcg(qrels: DataFrame, run: DataFrame, depth: int = 10) -> DataFrame:
    """qid, ndcg with gain 2^rel - 1; the ideal order comes from all judgements."""
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    ideal = qrels.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id"))).filter(F.col("r") <= depth).groupBy("qid").agg(F.sum(gain / F.log2(F.col("r") + 1)).alias("idcg"))
    got = run.filter(F.col("rank") <= depth).join(qrels, ["qid", "doc_id"]).groupBy("qid").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"))
    return ideal.join(got, "qid", "left").select("qid", F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"))


def set_metrics(evidence: Column, relevant: Column, citations: Column) -> dict[str, Column]:
    """Evidence recall and precision of sets; validity and precision of citations as a bag. Empty gives 0."""
    share = lambda a, b: F.round(F.when(F.size(b) > 0, F.size(a) / F.size(b)).otherwise(0.0), 6)
    common = F.array_intersect(evidence, relevant)
    return {
        "evidence_recall": share(common, F.array_distinct(relevant)),
        "evidence_precision": share(common, F.array_distinct(evidence)),
        "citation_validity": share(F.filter(citations, lambda c: F.array_contains(evidence, c)), citations),
        "citation_precision": share(F.filter(citations, lambda c: F.array_contains(relevant, c)), citations),
    }


def latency_rollup(rows: DataFrame, field: str, value: str) -> DataFrame:
    """field, available, p50, p95 and total; exact percentiles, missing values are left out."""
    p = lambda q: F.round(F.percentile(value, F.lit(q)), 6)
    return rows.groupBy(field).agg(F.count(value).alias("available"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.sum(value), 4).alias("total"))


def render_report(groups: dict[str, dict[str, float | None]], metrics: Sequence[str]) -> str:
    """A Markdown table in the given order, four decimals, ``unavailable`` for what is missing."""
    say = lambda x: "unavailable" if x is None else f"{x:.4f}"
    head = ["| group | " + " | ".join(metrics) + " |", "|" + "---|" * (len(metrics) + 1)]
    return "\n".join(head + [f"| {g} | " + " | ".join(say(row.get(m)) for m in metrics) + " |" for g, row in groups.items()]) + "\n"
