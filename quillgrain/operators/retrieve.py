"""End-to-end batch retrieval over a chunk table.

The plan is built from the configuration: a channel that isn't asked for is
never planned. Results and a trace come back as two DataFrames over the same
questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EvidenceConfig, RetrievalConfig
from ..functions.providers import Answerer, Embedder, Predictor, cross_scores, embed
from ..functions.text import query_terms
from ..functions.tokens import Counter, approximate_tokens
from . import retrieval as r

SCORES = ("score", "vector_score", "keyword_score", "fused_score", "rerank_score")


def searchable(chunks: DataFrame, config: RetrievalConfig, vector_profile: dict | None = None) -> DataFrame:
    """Eligible children that match the filters; neither the guards nor the vector profile can be overridden."""
    guards = F.coalesce(F.col("chunk_role"), F.lit("child")).isin("child") & F.coalesce(F.col("retrieval_eligible"), F.lit(True))
    return chunks.filter(guards & r.compile_filters(config.filters, vector_profile))


def question_ok(text, max_bytes: int = 3072):
    """Questions that may be asked: not blank, and of bounded bytes."""
    return (F.trim(text) != "") & (F.octet_length(text) <= max_bytes)


def channels(questions: DataFrame, corpus: DataFrame, config: RetrievalConfig) -> dict[str, DataFrame]:
    """The asked channels: qid, chunk_id, score, rank."""
    found = {}
    if config.mode in ("vector", "hybrid"):
        found["vector"] = r.vector_topk(corpus.filter(F.col("embedding").isNotNull()), questions, config.candidate_top_k, "chunk_id")
    if config.mode in ("keyword", "hybrid"):
        found["keyword"] = r.keyword_topk(corpus, questions, config.candidate_top_k, r.KEYWORD_FIELDS, "chunk_id").drop("raw")
    return found


def candidates(found: dict[str, DataFrame], config: RetrievalConfig, corpus: DataFrame | None = None) -> DataFrame:
    """One list a question: qid, chunk_id, vector_score, keyword_score, channel_hits, fused_score, rank."""
    if len(found) == 2:
        return r.rrf_fuse(found["vector"], found["keyword"], config.candidate_top_k, "chunk_id", corpus)
    ((name, only),) = found.items()
    own = lambda c: F.col("score") if c == name else F.lit(0.0)
    return only.select("qid", "chunk_id", own("vector").alias("vector_score"), own("keyword").alias("keyword_score"), F.lit(name).alias("channel_hits"), F.col("score").alias("fused_score"), "rank")


def cross_encoder_rerank(pool: DataFrame, questions: DataFrame, corpus: DataFrame, predictor: Callable[[], Predictor]) -> DataFrame:
    """Pool rows with the provider's score of (question, name + path + content), best first, and the error of a pair without one."""
    said = r.pair_text(F.col("doc_name"), F.coalesce("section_path", F.array().cast("array<string>")), F.col("content"))
    pairs = pool.drop("rank").join(corpus.select("chunk_id", said.alias("passage"), "chunk_order"), "chunk_id").join(questions.select("qid", "text"), "qid")
    said = pairs.withColumn("said", cross_scores(F.col("text"), F.col("passage"), predictor))
    scored = said.withColumn("rerank_score", F.round("said.score", 6)).withColumn("error", F.col("said.error")).drop("said")
    order = [F.desc("rerank_score"), F.desc("fused_score"), F.desc("keyword_score"), F.asc("chunk_order"), F.desc("vector_score"), F.asc("chunk_id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).drop("text", "passage", "chunk_order")


def embed_questions(questions: DataFrame, embedder: Callable[[], Embedder], dim: int) -> DataFrame:
    """(qid, text, ...) with qvec from the provider."""
    return questions.withColumn("qvec", embed(F.col("text"), embedder, dim))


def retrieve(
    questions: DataFrame, chunks: DataFrame, config: RetrievalConfig = RetrievalConfig(), predictor: Callable[[], Predictor] | None = None, embedder: Callable[[], Embedder] | None = None, dim: int | None = None, vector_profile: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """Families for each question, and one trace row a question.

    questions: qid, text, qvec (or none, and an ``embedder`` of ``dim``). chunks:
    chunk_id, doc_id, parent_id, chunk_role, retrieval_eligible, chunk_order,
    doc_name, section_path, content, embedding. The rerank pool is the head of
    the fused list; what lies behind it is not returned. A question for which
    the reranking provider fails keeps its fused list, and its trace says why.
    The provider's scores are written to the checkpoint folder, so it is asked
    once. Questions that mayn't be asked get no results. ``vector_profile`` holds whatever the
    caller's filters say.
    """
    asked = questions.filter(question_ok(F.col("text")))
    if embedder is not None and "qvec" not in questions.columns and config.mode != "keyword":
        asked = embed_questions(asked, embedder, dim)
    corpus = searchable(chunks, config, vector_profile)
    fused = candidates(channels(asked, corpus, config), config, corpus)
    pool = fused.filter(F.col("rank") <= config.pool) if config.rerank else fused
    failed = None
    if config.rerank and config.reranker == "rule":
        pool = r.rule_rerank(pool, asked, corpus, "chunk_id")
    elif config.rerank and config.rerank_level == "child":
        ranked = cross_encoder_rerank(pool, asked, corpus, predictor).checkpoint()
        failed = failures(ranked)
        pool = per_question(ranked.drop("error"), fused, failed)
    score = F.coalesce("rerank_score", "fused_score") if "rerank_score" in pool.columns else F.col("fused_score")
    own = corpus.select("chunk_id", "doc_id", r.family_key(F.col("parent_id"), F.col("chunk_id")).alias("family"))
    scored = pool.withColumn("score", score).join(own, "chunk_id")
    parents = chunks.filter("chunk_role = 'parent'").select(F.col("chunk_id").cast("string").alias("family"), "content", "doc_name", "section_path", "chunk_order")
    kept = scored.filter(F.col("score") >= config.threshold)
    results = r.expand_families(kept, parents.select("family", "content"), config.aggregation).filter(F.col("rank") <= config.top_k)
    if config.rerank and config.rerank_level == "parent":
        # Children only gather the parents; the encoder reads whole parents and its score meets the threshold.
        families = r.expand_families(scored, None, "mean").withColumnRenamed("family", "chunk_id").select("qid", "chunk_id", F.col("score").alias("fused_score"), "keyword_score", "vector_score", "rank")
        ranked = cross_encoder_rerank(families, asked, parents.withColumnRenamed("family", "chunk_id"), predictor).checkpoint()
        failed = failures(ranked)
        best = ranked.filter(F.col("rerank_score") >= config.threshold).select("qid", F.col("chunk_id").alias("family"), F.col("rerank_score").alias("score"), "keyword_score", "vector_score", "fused_score", "rerank_score")
        kept = per_question(best, kept, failed)
        results = per_question(r.top_by(best, config.top_k, F.desc("score"), F.asc("family")), results, failed)
    reasons = failed if failed is not None else questions.select("qid", F.lit(None).cast("string").alias("fallback_reason")).limit(0)
    trace = questions.select("qid").join(_counts(scored, kept, results), "qid", "left").join(reasons, "qid", "left").select(
        "qid",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_candidates", "n_eligible", "n_returned")),
        F.coalesce("avg_score", F.lit(0.0)).alias("avg_score"),
        F.when(F.coalesce("n_returned", F.lit(0)) > 0, "ok").otherwise("no_evidence").alias("status"),
        F.lit(config.rerank_level if config.rerank else None).cast("string").alias("rerank_level"),
        F.lit(config.aggregation).alias("aggregation"),
        "fallback_reason",
    )
    return results, trace


def evidence_of(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked families with what evidence is built from: content, matched children with their places, primary child.

    chunks also have parent_char_start and parent_char_end. A family without a
    parent stands for its primary child.
    """
    place = lambda c: F.col(c).cast("int")
    child = F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), place("parent_char_start").alias("start"), place("parent_char_end").alias("end"), F.col("content").alias("snippet"))
    kids = chunks.filter("chunk_role = 'child'").select("doc_id", "doc_name", "section_path", "content", F.col("chunk_id").alias("primary_child"), child.alias("child"))
    heads = chunks.filter("chunk_role = 'parent'").select(F.col("chunk_id").cast("string").alias("family"), F.nullif("content", F.lit("")).alias("whole"), F.coalesce("preserve_structure", F.lit(False)).alias("kept") if "preserve_structure" in chunks.columns else F.lit(False).alias("kept"))
    joined = results.join(kids, "primary_child").join(heads, "family", "left")
    return joined.select(
        "qid", "rank", "score", F.when(F.col("whole").isNull(), F.col("child.chunk_id")).otherwise(F.col("family")).alias("chunk_id"), "doc_id", "doc_name", "section_path",
        F.coalesce("whole", "content").alias("content"), F.array("child").alias("children"), F.col("child.chunk_id").alias("primary_child"), F.coalesce("kept", F.lit(False)).alias("preserve_structure"),
    )


def ask(questions: DataFrame, chunks: DataFrame, answerer: Callable[[], Answerer], config: RetrievalConfig = RetrievalConfig(), evidence_config: EvidenceConfig = EvidenceConfig(), fixed_tokens: int = 100, count: Counter = approximate_tokens, **providers) -> DataFrame:
    """Questions to cited answers: qid, status, answer, citations.

    Retrieval, evidence windows, the prompt budget and the provider, one after
    the other; questions without evidence aren't sent.
    """
    from . import evidence, rewriting

    results, _ = retrieve(questions, chunks, config, **providers)
    ranked = evidence_of(results, chunks)
    windows = evidence.evidence_windows(ranked, evidence_config, count)
    chosen = evidence.fit_prompts(windows, evidence_config, fixed_tokens, count).select("qid", F.posexplode("shown").alias("place", "w"))
    names = ranked.select(F.col("qid").cast("string").alias("qid"), "rank", F.col("doc_name").alias("name"), F.array_join("section_path", " > ").alias("path"))
    told = chosen.select("qid", "place", F.col("w.rank").alias("rank"), F.col("w.content").alias("content")).join(names, ["qid", "rank"]).select("qid", "place", "name", "path", "content")
    return rewriting.answer(questions.select(F.col("qid").cast("string").alias("qid"), "text"), told, answerer)


def _counts(scored: DataFrame, kept: DataFrame, results: DataFrame) -> DataFrame:
    one = scored.groupBy("qid").agg(F.count("*").alias("n_candidates"))
    two = kept.groupBy("qid").agg(F.count("*").alias("n_eligible"))
    three = results.groupBy("qid").agg(F.count("*").alias("n_returned"), F.round(F.avg("score"), 4).alias("avg_score"))
    return one.join(two, "qid", "left").join(three, "qid", "left")


def failures(ranked: DataFrame) -> DataFrame:
    """(qid, fallback_reason) of the questions for which a pair has no score."""
    return ranked.filter(F.col("error").isNotNull()).groupBy("qid").agg(F.min("error").alias("fallback_reason"))


def per_question(reranked: DataFrame, fused: DataFrame, failed: DataFrame) -> DataFrame:
    """The reranked rows of each question, the fused ones where the provider failed."""
    return reranked.join(failed.select("qid"), "qid", "left_anti").unionByName(fused.join(failed.select("qid"), "qid", "left_semi"), allowMissingColumns=True)


def check_scores(rows: DataFrame) -> DataFrame:
    """``rows`` if all scores are null or in [0, 1]; another one fails its task."""
    own = [c for c in SCORES if c in rows.columns]
    bad = F.lit(False)
    for c in own:
        bad = bad | (F.col(c).isNotNull() & ~F.col(c).between(0.0, 1.0))
    return rows.filter(F.when(~bad, F.lit(True)).otherwise(F.raise_error(F.lit("scores must be between 0 and 1"))))


def chunk_traces(results: DataFrame, vector: DataFrame, keyword: DataFrame, fused: DataFrame, corpus: DataFrame) -> DataFrame:
    """Results with their ranks in each channel and after fusion, scores to four digits, and a snippet."""
    at = lambda df, name: df.select("qid", F.col("chunk_id").alias("primary_child"), F.col("rank").alias(name))
    joined = results
    for df, name in ((vector, "rank_in_vector"), (keyword, "rank_in_keyword"), (fused, "rank_after_fusion")):
        joined = joined.join(at(df, name), ["qid", "primary_child"], "left")
    said = F.substring(F.translate("content", "\n", " "), 1, 120)
    joined = joined.join(corpus.select(F.col("chunk_id").alias("primary_child"), said.alias("snippet")), "primary_child", "left")
    return joined.withColumn("score", F.round("score", 4)).withColumn("keyword_score", F.round("keyword_score", 4))
