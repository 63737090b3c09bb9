"""Run rows of an evaluation: recording, variants, dataset building, choice of a configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import builder_tokens, normalize_lines, overlap_score, stable_id
from ..sources.store import fingerprint
from .datasets import DOCUMENT_PREFIX, QUERY_PREFIX, choose, keep_rerank, quota, sample_order
from .search import kept


def run_rows(queries: DataFrame, results: DataFrame, channel: str) -> DataFrame:
    """(qid, question) and (qid, doc_id, score, rank) to query_id, retrieved, evidence_doc_ids, status.

    The best chunk of a document counts, ranks are made contiguous, scores have six digits.
    """
    best = results.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc_id")))
    item = F.struct(F.col("place").alias("rank"), F.col("doc_id"), F.round("score", 6).alias("score"), F.lit(channel).alias("channel"))
    lists = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("retrieved"))
    joined = queries.join(lists, "qid", "left")
    empty = F.array().cast(lists.schema["retrieved"].dataType)
    return joined.select(
        F.col("qid").alias("query_id"), "question", F.coalesce("retrieved", empty).alias("retrieved"), F.coalesce(F.transform("retrieved", lambda x: x["doc_id"]), F.array().cast("array<string>")).alias("evidence_doc_ids"), F.when(F.col("retrieved").isNull(), "no_evidence").otherwise("ok").alias("status")
    )


def numeric_usage(usage_json, names: Sequence[str] = ("prompt_tokens", "completion_tokens", "total_tokens")):
    """The usage figures that are numbers; ``unavailable`` and the like are left out, not 0."""
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.get_json_object(usage_json, f"$.{n}").try_cast("double").alias("value")) for n in names))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def variants(configs: dict[str, Any], run: Callable[[Any], DataFrame]) -> DataFrame:
    """One run of each variant, in one plan, with its name."""
    parts = [run(c).withColumn("variant", F.lit(n)) for n, c in configs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_meta(config: dict[str, Any], stage: str, variant: str, dataset_digest: str, commit: str | None) -> dict[str, Any]:
    return {"stage": stage, "variant": variant, "dataset_manifest_sha256": dataset_digest, "git_commit": commit or "unavailable", "config": config, "config_fingerprint": fingerprint(config)}


def build_dataset(rows: DataFrame, distractors: DataFrame, task_docs: dict[str, int], per_task: int, dev_per_task: int, corpus_size: int, n_hard: int, seed: int = 42) -> dict[str, DataFrame]:
    """corpus, queries and qrels from task rows (task, position, ID, event, questions, answers, news1..3) and distractor texts.

    Each event serves one task; positives come from the rows' texts, then come
    the distractors that share most with all questions, then random ones.
    """
    clean = lambda c: normalize_lines(F.coalesce(F.col(c), F.lit("")))
    news = [c for c in ("news1", "news2", "news3") if c in rows.columns]
    wanted = F.create_map(*(F.lit(x) for pair in task_docs.items() for x in pair))
    texts = F.slice(F.array(*(clean(c) for c in news)), F.lit(1), F.try_element_at(wanted, F.col("task")))
    # Spark may run this filter on all texts before rows are joined, so it asks for one visible character and normalizes none.
    raw = F.slice(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in news)), F.lit(1), F.try_element_at(wanted, F.col("task")))
    usable = rows.filter(F.forall(raw, lambda t: t.rlike(r"(?U)\S"))).select("task", "position", F.trim(F.col("ID").cast("string")).alias("event_id"), clean("event").alias("event"), clean("questions").alias("question"), clean("answers").alias("answer"), texts.alias("texts"))
    usable = usable.filter((F.col("event_id") != "") & (F.col("question") != "") & (F.col("answer") != ""))
    # Bounded by the quotas; kept, so that the rows are read once, and the count tells Spark that the asked terms are few.
    chosen = kept(quota(usable, per_task, list(task_docs), seed))
    place = F.row_number().over(Window.partitionBy("task").orderBy(sample_order(F.col("event_id"), seed), "event_id"))
    queries = chosen.withColumn("split", F.when(place <= dev_per_task, "dev").otherwise("test")).withColumn("query_id", stable_id(QUERY_PREFIX, F.col("task"), F.col("event_id"), F.col("question")))
    qrels = queries.select("query_id", F.explode("texts").alias("text")).select("query_id", stable_id(DOCUMENT_PREFIX, F.col("text")).alias("doc_id"), F.lit(1).alias("relevance"), "text").distinct()
    positives = qrels.groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("source", F.lit("positive"))
    asked = queries.select(F.explode(builder_tokens(F.col("question"))).alias("term")).distinct().withColumn("asked", F.lit(True))
    need = max(0, corpus_size - positives.count())
    # Each text is read once, where it lies; only ids and scores are shuffled, kept and ranked.
    terms = distractors.select(stable_id(DOCUMENT_PREFIX, F.col("text")).alias("doc_id"), builder_tokens(F.col("text")).alias("own")).select("doc_id", F.size("own").alias("n"), F.explode_outer("own").alias("term"))
    # Copies of a text have one id and add to both counts alike, so the quotient is that of one copy.
    both = F.expr("count(asked) * greatest(1, n) div count(*)")
    scored = kept(terms.join(asked, "term", "left").groupBy("doc_id", "n").agg(both.alias("both")).select("doc_id", F.round(F.col("both") / F.sqrt(F.greatest(F.lit(1), F.col("n"))), 6).alias("score")))
    pool = scored.join(positives.select("doc_id"), "doc_id", "left_anti")
    hard = pool.orderBy(F.desc("score"), "doc_id").limit(min(n_hard, need)).select("doc_id", F.lit("hard_negative").alias("source"))
    rest = pool.select("doc_id").join(hard.select("doc_id"), "doc_id", "left_anti").orderBy(sample_order(F.col("doc_id"), seed + 1), "doc_id").limit(max(0, need - n_hard)).select("doc_id", F.lit("random_negative").alias("source"))
    others = hard.unionByName(rest)
    # The texts of the chosen ones are fetched last, by an outer join that falls away where only ids are asked for.
    texts = distractors.select(stable_id(DOCUMENT_PREFIX, F.col("text")).alias("doc_id"), "text").join(others.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    others = others.join(texts, "doc_id", "left").select("doc_id", "text", "source")
    corpus = positives.unionByName(others)
    references = queries.join(qrels.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("expected_doc_ids")), "query_id").select("query_id", "answer", "expected_doc_ids")
    return {"corpus": corpus, "queries": queries.drop("texts", "position"), "qrels": qrels.drop("text"), "references": references}


def lock(rows: Sequence[dict[str, Any]], metrics: Sequence[str], baseline: dict[str, Any], reranked: dict[str, Any]) -> dict[str, Any]:
    """The chosen variant of a dev sweep, whether reranking stays on, and everything that was measured."""
    return {"split": "dev", "chosen": choose(rows, metrics), "rerank": keep_rerank(baseline, reranked), "baseline": baseline, "reranked": reranked, "variants": list(rows)}


def lock_text(locked: dict[str, Any]) -> str:
    return json.dumps(locked, sort_keys=True, ensure_ascii=False, indent=2) + "\n"
