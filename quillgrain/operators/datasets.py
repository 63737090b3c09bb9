"""Building, validating and subsampling evaluation sets; sweeps over configurations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import builder_tokens, normalize_lines, stable_id
from . import search
from .retrieval import top_by

#: Prefixes of stable ids (fixed values).
QUERY_PREFIX, DOCUMENT_PREFIX = "crud_q_", "crud_"


def first_by_content(rows: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """One row of each content id: the first by the given order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def exact_dedup(rows: DataFrame, text: Column, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(content_id, id, columns): of rows that say the same the one of the least id; copies are aggregated where they lie first."""
    named = rows.select(id_col, *columns, F.sha2(text, 256).alias("content_id"))
    return named.groupBy("content_id").agg(F.min(id_col).alias(id_col), *(F.min_by(c, id_col).alias(c) for c in columns))


def counts_by(rows: DataFrame, key: str, column: str, values: Sequence[str]) -> DataFrame:
    """Rows of each key by the given values of a column, zeros kept, and in total."""
    return rows.groupBy(key).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("total"))


def sample_order(key: Column, seed: int) -> Column:
    """A seeded shuffle as an order: any engine with MD5 draws the same sample."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def quota(rows: DataFrame, per_task: int, task_order: Sequence[str], seed: int) -> DataFrame:
    """(task, event_id, ...): each event goes to its first task, each task keeps its quota in sample order."""
    priority = F.coalesce(F.array_position(F.array(*map(F.lit, task_order)), F.col("task")), F.lit(len(task_order) + 1))
    own = rows.withColumn("__e", F.row_number().over(Window.partitionBy("event_id").orderBy(priority, "position"))).filter("__e = 1").drop("__e")
    return own.withColumn("__t", F.row_number().over(Window.partitionBy("task").orderBy(sample_order(F.col("event_id"), seed), "event_id"))).filter(F.col("__t") <= per_task).drop("__t")


def hard_negatives(corpus: DataFrame, queries: DataFrame, positives: DataFrame, n: int) -> DataFrame:
    """qid, doc_id, score, rank: documents that share most tokens with a query and aren't its positives.

    Every task keeps its best rows a query, as many more as a query has positives.
    """
    own = positives.select("qid", "doc_id").distinct()
    most = own.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    asked = queries.select("qid", builder_tokens(F.col("text")).alias("terms"))
    kind = queries.schema["qid"].dataType
    tokens = corpus.select("doc_id", builder_tokens(F.col("text")).alias("own"))
    parts = [search.overlap_best(tokens, terms, kind, n + most, "doc_id") for terms in search.term_blocks(asked)]
    if not parts:
        return corpus.select(F.lit(None).cast(kind).alias("qid"), "doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return top_by(reduce(DataFrame.unionByName, parts).join(own, ["qid", "doc_id"], "left_anti"), n, F.desc("score"), F.asc("doc_id"))


def demo_cases(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, n: int) -> DataFrame:
    """qid, doc_id, kind, place: each query's positives, then the ``n`` documents that share most with it otherwise."""
    positive = qrels.filter("rel > 0").select("qid", "doc_id").distinct().join(corpus.select("doc_id"), "doc_id", "left_semi")
    first = positive.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))).select("qid", "doc_id", F.lit("positive").alias("kind"), "place")
    other = hard_negatives(corpus, queries, positive, n).select("qid", "doc_id", F.lit("distractor").alias("kind"), F.col("rank").alias("place"))
    return first.unionByName(other)


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows): rows that only one of two tables has; both 0 for equal ones, repeats counted."""
    only = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias("rows")).select(F.lit(name).alias("side"), "rows")
    return only(a, b, "left").unionByName(only(b, a, "right"))


def subsample(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, n_queries: int, n_docs: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries with positives, all their positives in the pool, the rest filled at random; qrels restricted.

    Fewer queries with positives than asked for raise.
    """
    positive = qrels.filter("rel > 0")
    chosen = queries.join(positive.select("qid").distinct(), "qid", "left_semi").orderBy(sample_order(F.col("qid"), seed), "qid").limit(n_queries)
    held = chosen.count()
    if held < n_queries:
        raise ValueError(f"only {held} of {n_queries} queries have a positive")
    own = qrels.join(chosen.select("qid"), "qid", "left_semi")
    forced = own.filter("rel > 0").select("doc_id").distinct()
    pool = corpus.join(forced.withColumn("forced", F.lit(0)), "doc_id", "left").orderBy(F.coalesce("forced", F.lit(1)), sample_order(F.col("doc_id"), seed), "doc_id").limit(n_docs).drop("forced")
    return pool, chosen, own.join(pool.select("doc_id"), "doc_id", "left_semi")


def violations(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(rule, violations) of a dataset; all 0 if it is sound."""
    doubled = lambda df, *keys: df.groupBy(*keys).count().filter("count > 1")
    rules = [
        ("corpus_id_unique", doubled(corpus, "doc_id")),
        ("corpus_text_present", corpus.filter(F.coalesce(F.trim("text"), F.lit("")) == "")),
        ("corpus_text_unique", doubled(corpus.select(F.sha2(F.trim("text"), 256).alias("h")), "h")),
        ("query_id_unique", doubled(queries, "qid")),
        ("query_text_present", queries.filter(F.coalesce(F.trim("text"), F.lit("")) == "")),
        ("qrel_unique", doubled(qrels, "qid", "doc_id")),
        ("qrel_query_exists", qrels.join(queries.select("qid").distinct(), "qid", "left_anti")),
        ("qrel_document_exists", qrels.join(corpus.select("doc_id").distinct(), "doc_id", "left_anti")),
        ("query_has_positive", queries.join(qrels.filter("rel > 0").select("qid").distinct(), "qid", "left_anti")),
        ("relevance_known", qrels.filter(~F.col("rel").isin(0, 1))),
    ]
    return _counted(rules)


def _counted(rules: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(rule, violations): how many rows break each rule, in one plan."""
    return reduce(DataFrame.unionByName, (bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, bad in rules))


def manifest_counts(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(name, n): what a dataset's manifest counts. Names with a slash are task and split."""
    of = lambda df, *by: df.groupBy(F.concat_ws("/", *by).alias("name")).agg(F.count("*").alias("n"))
    total = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [total(corpus, "corpus"), total(queries, "queries"), total(qrels, "qrels"), of(queries, "split"), of(queries, "task"), of(queries, "task", "split"), of(corpus, "source")]
    return reduce(DataFrame.unionByName, parts)


def dataset_violations(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, references: DataFrame, task_docs: dict[str, int], expected: DataFrame) -> DataFrame:
    """(rule, violations) of a built dataset; all 0 if it is sound.

    corpus: doc_id, text, source. queries: query_id, task, event_id, question,
    answer, split. qrels: query_id, doc_id, relevance. references: query_id,
    answer, expected_doc_ids. ``expected`` (name, n) are the counts that the
    manifest and its parameters ask for, named as in ``manifest_counts``.
    Rows are joined by their ids; nothing is gathered but one list a query.
    """
    doubled = lambda df, *keys: df.groupBy(*keys).count().filter("count > 1")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    absent = lambda df, other, key: df.join(other.select(key).distinct(), key, "left_anti")
    clean = lambda c: normalize_lines(F.coalesce(F.col(c), F.lit("")))
    most = F.try_element_at(F.create_map(*(F.lit(x) for pair in task_docs.items() for x in pair)), F.col("task"))
    relevant = qrels.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("relevant"))
    judged = queries.join(relevant, "query_id", "left")
    told = references.join(judged.select("query_id", F.col("answer").alias("right"), "relevant"), "query_id")
    counts = manifest_counts(corpus, queries, qrels).withColumnRenamed("n", "found").join(expected, "name", "right")
    return _counted(
        [
            ("corpus_fields", corpus.filter(F.col("doc_id").isNull() | blank("text") | F.col("source").isNull())),
            ("corpus_id_stable", corpus.filter(F.col("doc_id") != stable_id(DOCUMENT_PREFIX, clean("text")))),
            ("corpus_id_unique", doubled(corpus, "doc_id")),
            ("corpus_text_unique", doubled(corpus.select(F.sha2(clean("text"), 256).alias("h")), "h")),
            ("corpus_source_known", corpus.filter(~F.col("source").isin("positive", "hard_negative", "random_negative"))),
            ("query_fields", queries.filter(F.col("query_id").isNull() | F.col("event_id").isNull() | blank("question") | blank("answer"))),
            ("query_task_known", queries.filter(~F.coalesce(F.col("task").isin(list(task_docs)), F.lit(False)))),
            ("query_split_known", queries.filter(~F.coalesce(F.col("split").isin("dev", "test"), F.lit(False)))),
            ("query_id_stable", queries.filter(F.col("query_id") != stable_id(QUERY_PREFIX, F.col("task"), F.col("event_id").cast("string"), F.col("question")))),
            ("query_id_unique", doubled(queries, "query_id")),
            ("query_event_unique", doubled(queries, "event_id")),
            ("qrel_query_known", absent(qrels, queries, "query_id")),
            ("qrel_document_known", absent(qrels, corpus, "doc_id")),
            ("qrel_relevance", qrels.filter(~F.col("relevance").eqNullSafe(F.lit(1)))),
            ("qrel_unique", doubled(qrels, "query_id", "doc_id")),
            ("qrel_document_positive", qrels.join(corpus.filter("source <> 'positive'").select("doc_id"), "doc_id", "left_semi")),
            ("query_has_qrels", judged.filter("relevant IS NULL")),
            ("query_qrels_of_task", judged.filter(F.size("relevant") > most)),
            ("reference_query_known", absent(references, queries, "query_id")),
            ("reference_unique", doubled(references, "query_id")),
            ("reference_of_each_query", absent(queries, references, "query_id")),
            ("reference_answer", told.filter(~clean("answer").eqNullSafe(clean("right")))),
            ("reference_documents", told.filter(~F.sort_array(F.array_distinct("expected_doc_ids")).eqNullSafe(F.col("relevant")))),
            ("manifest_counts", counts.filter(F.coalesce("found", F.lit(0)) != F.col("n"))),
        ]
    )


def run_errors(runs: DataFrame, queries: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """(query_id, retrieved, citations, evidence_doc_ids, latency_ms, status) to query_id, error: one row for each fault.

    With ``queries`` (query_id), unknown, repeated and missing ones are faults
    too, with ``corpus`` (doc_id), documents it doesn't have. Columns that a run
    lacks aren't judged.
    """
    has = lambda name: name in runs.columns
    distinct = lambda a: F.size(a) == F.size(F.array_distinct(a))
    number = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    ids = F.transform("retrieved", lambda x: x["doc_id"])
    sound = [
        (F.forall(F.transform("retrieved", lambda x, i: x["rank"] == i + 1), lambda ok: ok), "ranks are not contiguous"),
        (distinct(ids), "a document is there twice"),
        (F.forall("retrieved", lambda x: x["score"].isNull() | number(x["score"])), "a score is not a number"),
    ]
    sound += [(F.forall(F.map_values(m), lambda x: (x >= 0) & number(x)), f"{m} has no number of at least 0") for m in ("latency_ms", "usage") if has(m)]
    if has("evidence_doc_ids"):
        sound.append((distinct(F.col("evidence_doc_ids")), "evidence is there twice"))
    if has("status"):
        sound.append((F.col("status").isin("ok", "no_evidence", "error"), "unknown status"))
    named = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(said)) for ok, said in sound)))
    found = [runs.select("query_id", F.explode(named).alias("error"))]
    if queries is not None:
        asked = queries.select("query_id").distinct()
        found += [
            runs.join(asked, "query_id", "left_anti").select("query_id", F.lit("unknown query").alias("error")),
            runs.groupBy("query_id").count().filter("count > 1").select("query_id", F.lit("a query is there twice").alias("error")),
            asked.join(runs, "query_id", "left_anti").select("query_id", F.lit("the run lacks the query").alias("error")),
        ]
    if corpus is not None:
        cited = [c for c in ("evidence_doc_ids", "citations") if has(c)]
        named = F.concat(ids, *(F.transform(c, lambda x: x if isinstance(runs.schema[c].dataType.elementType, T.StringType) else x["doc_id"]) for c in cited))  # noqa: B023
        told = runs.select("query_id", F.explode(F.array_distinct(named)).alias("doc_id"))
        found.append(told.join(corpus.select("doc_id").distinct(), "doc_id", "left_anti").select("query_id", F.lit("unknown document").alias("error")).distinct())
    return reduce(DataFrame.unionByName, found)


def sweep_axes(axes: dict[str, Sequence[dict[str, Any]]], evaluate: Callable[[dict[str, Any]], dict[str, Any]], metrics: Sequence[str]) -> dict[str, Any]:
    """One factor at a time: each axis's settings are evaluated alone, and its best one by the metrics in turn is picked."""
    tried = {axis: [{"overrides": o, **evaluate(o)} for o in settings] for axis, settings in axes.items()}
    return {"tried": tried, "picks": {axis: choose(rows, metrics)["overrides"] for axis, rows in tried.items()}}


def compose(base: dict[str, Any], picks: dict[str, dict[str, Any]], rerank: bool) -> dict[str, Any]:
    """The base with all picks, in order of axis; without a gain from reranking nothing of it stays, else its pool is clamped."""
    locked = reduce(lambda a, b: a | b, (picks[axis] for axis in sorted(picks)), dict(base))
    if not rerank:
        locked = {k: v for k, v in locked.items() if not k.startswith("rerank")}
    elif locked.get("rerank_top_n") is not None:
        locked["rerank_top_n"] = clamp_pool(locked["rerank_top_n"], locked.get("top_k", 5), locked.get("candidate_top_k", 30))
    return locked


def sweep_candidate_k(candidates: DataFrame, cuts: Sequence[int], score_run: Any) -> DataFrame:
    """Metrics of one candidate list cut at several depths; the search itself is done once, at the largest."""
    out = None
    for k in cuts:
        one = score_run(candidates.filter(F.col("rank") <= k)).withColumn("candidate_k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def choose(rows: Sequence[dict[str, Any]], metrics: Sequence[str]) -> dict[str, Any]:
    """The greatest by the metrics in turn; the first of equals."""
    return max(rows, key=lambda r: tuple(r[m] for m in metrics))


def keep_rerank(without: dict[str, float], with_it: dict[str, float], gain: float = 0.01) -> bool:
    return with_it["recall_10"] - without["recall_10"] >= gain and with_it["mrr_10"] >= without["mrr_10"]


def clamp_pool(pool: int, top_k: int, candidate_top_k: int) -> int:
    return min(max(pool, top_k), candidate_top_k)


__all__ = ["choose", "clamp_pool", "first_by_content", "hard_negatives", "keep_rerank", "overlap_score", "quota", "run_errors", "sample_order", "subsample", "sweep_candidate_k", "violations"]
