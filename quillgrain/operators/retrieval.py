"""Batch retrieval: channels, fusion, reranking and family expansion.

All operators take many queries at once (``qid``) and answer each of them. What
is sent to every task is the query side, which is the asked set; the corpus is
never collected, crossed with itself or broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import query_terms, tokenize
from ..functions.vectors import doubles, unit_score
from . import search

#: Parameters of BM25 and of rank fusion, and the place of a chunk without one (fixed values).
K1, B = 1.2, 0.75
RRF_K = 60
DEFAULT_ORDER = 1_000_000


def compile_filters(filters: dict[str, Any] | None, mandatory: dict[str, Any] | None = None, arrays: Sequence[str] = ()) -> Column:
    """Equality for scalars, membership for lists, all ANDed; mandatory ones win over the caller's.

    Array columns match if any element does.
    """

    def one(name: str, value: Any) -> Column:
        many = isinstance(value, (list, tuple, set, frozenset))
        if name in arrays:
            return F.arrays_overlap(F.col(name), F.array(*map(F.lit, value if many else [value])))
        return F.col(name).isin(list(value)) if many else F.col(name) == F.lit(value)

    return reduce(lambda a, b: a & b, (one(k, v) for k, v in ((filters or {}) | (mandatory or {})).items()), F.lit(True))


def chunk_order(order: Column, chunk_id: Column) -> Column:
    """A given order, else the number that ends the id after ``_ck_``, else a large one."""
    return F.coalesce(order, F.nullif(F.regexp_extract(chunk_id, r"_ck_([0-9]+)$", 1), F.lit("")).try_cast("int"), F.lit(DEFAULT_ORDER))


def top_by(df: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each query; ranks are limited within tasks before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col(rank) <= k)


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """qid, id, score and rank of exact cosine search, score (1 + cos) / 2.

    Queries come in ``qid`` and ``qvec``; one block of them is on the driver at a
    time. Filters apply before the search. Vectors that are null, of another
    length or not finite are left out; one of zeros scores 0.5.
    """
    base = corpus if where is None else corpus.filter(where)
    kind = queries.schema["qid"].dataType
    parts = [search.nearest(base, [(r.qid, r.qvec) for r in block], kind, k, id_col, vector) for block in search.in_blocks(queries.select("qid", "qvec"))]
    return top_by(reduce(DataFrame.unionByName, parts), k, F.desc("score"), F.asc(id_col))


def vector_topk_blocks(corpus: DataFrame, queries: list[tuple[Any, list[float]]], k: int, id_col: str = "vec_id", vector: str = "embedding", qid_type: T.DataType = T.LongType()) -> DataFrame:
    """``vector_topk`` for queries that the caller holds."""
    blocks = [queries[at : at + search.QUERY_BLOCK] for at in range(0, len(queries), search.QUERY_BLOCK)] or [[]]
    return top_by(reduce(DataFrame.unionByName, (search.nearest(corpus, b, qid_type, k, id_col, vector) for b in blocks)), k, F.desc("score"), F.asc(id_col))


def field_texts(corpus: DataFrame, fields: Sequence[str]) -> list[Column]:
    """The text of each field; a list of texts is read as one text."""
    return [(F.array_join(F.col(f), " ") if isinstance(corpus.schema[f].dataType, T.ArrayType) else F.col(f)).alias(f) for f in fields]


def field_tokens(corpus: DataFrame, fields: Sequence[str]) -> list[Column]:
    """Tokens of each field."""
    return [tokenize(said).alias(f) for f, said in zip(fields, field_texts(corpus, fields))]


def keyword_topk(corpus: DataFrame, queries: DataFrame, k: int, fields: dict[str, float], id_col: str = "doc_id") -> DataFrame:
    """qid, id, raw, score and rank: BM25 of the best boosted field, over the query's greatest.

    ``queries`` has qid and text. The corpus is read once, to count the asked
    terms; nothing but each task's best rows is shuffled.
    """
    asked = queries.select("qid", query_terms(F.col("text")).alias("terms"))
    kind = queries.schema["qid"].dataType
    texts = corpus.select(id_col, *field_texts(corpus, list(fields)))
    parts = [search.keyword_best(texts, terms, kind, k, id_col, fields, K1, B) for terms in search.term_blocks(asked)]
    none = [corpus.sparkSession.createDataFrame([], T.StructType([T.StructField("qid", kind), corpus.schema[id_col], T.StructField("score", T.DoubleType())]))]
    top = top_by(reduce(DataFrame.unionByName, parts or none).withColumnRenamed("score", "raw"), k, F.desc("raw"), F.asc(id_col))
    greatest = F.max("raw").over(Window.partitionBy("qid"))
    return top.withColumn("score", F.round(F.when(greatest > 0, F.col("raw") / greatest).otherwise(F.lit(0.0)), 6))


def rrf_fuse(vector: DataFrame, keyword: DataFrame, k: int, id_col: str = "doc_id", places: DataFrame | None = None) -> DataFrame:
    """Equal-weight reciprocal rank fusion, rescaled so that first in both gives 1.

    Both inputs have qid, id, score and rank. Equal scores go by chunk order,
    then document id, both from ``places`` (id, chunk_order, doc_id) if it is
    given, then by id; ids are compared as texts there.
    """
    v = vector.select("qid", id_col, F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    w = keyword.select("qid", id_col, F.col("score").alias("keyword_score"), F.col("rank").alias("keyword_rank"))
    share = lambda r: F.coalesce(1 / (RRF_K + F.col(r)), F.lit(0.0))
    fused = v.join(w, ["qid", id_col], "full_outer").select(
        "qid",
        id_col,
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"),
        F.concat_ws(",", F.when(F.col("keyword_rank").isNotNull(), "keyword"), F.when(F.col("vector_rank").isNotNull(), "vector")).alias("channel_hits"),
        F.round((share("vector_rank") + share("keyword_rank")) / (2 / (RRF_K + 1)), 6).alias("fused_score"),
    )
    if places is None:
        return top_by(fused, k, F.desc("fused_score"), F.asc(id_col))
    at = places.select(id_col, chunk_order(F.col("chunk_order"), F.col(id_col).cast("string")).alias("at_place"), F.col("doc_id").cast("string").alias("at_doc"))
    return top_by(fused.join(at, id_col, "left"), k, F.desc("fused_score"), F.asc("at_place"), F.asc("at_doc"), F.asc(F.col(id_col).cast("string"))).drop("at_place", "at_doc")


#: Fields of a chunk that keyword search asks with their boosts, and that the rule reranker reads (fixed values).
KEYWORD_FIELDS = {"doc_name": 2.0, "section_path": 2.0, "content": 1.0}
RULE_FIELDS = ("doc_name", "section_path", "important_kwd", "important_tks", "question_kwd", "question_tks", "content")


def rule_rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = RULE_FIELDS, bonus: float = 0.1) -> DataFrame:
    """Candidates (qid, id, fused_score, keyword_score, vector_score) with rerank_score and rank.

    A tenth is added for full coverage of the query's terms by the tokens of all
    fields that the corpus has. Ties go by keyword score, chunk order, vector
    score and id. Corpus rows are fetched by id for the candidates alone.
    """
    asked = queries.select("qid", query_terms(F.col("text")).alias("terms"))
    own = F.array_distinct(F.concat(*field_tokens(corpus, [f for f in fields if f in corpus.columns])))
    place = chunk_order(F.col("chunk_order") if "chunk_order" in corpus.columns else F.lit(None).cast("int"), F.col(id_col).cast("string"))
    wanted = corpus.join(candidates.select(id_col).distinct(), id_col, "left_semi")
    texts = wanted.select(id_col, own.alias("own"), place.alias("at_place"))
    covered = F.when(F.size("terms") > 0, F.size(F.array_intersect("terms", "own")) / F.size("terms")).otherwise(F.lit(0.0))
    scored = candidates.join(texts, id_col).join(asked, "qid").withColumn("rerank_score", F.round(F.least(F.lit(1.0), F.col("fused_score") + bonus * covered), 6)).drop("terms", "own", "rank")
    order = [F.desc("rerank_score"), F.desc("keyword_score"), F.asc("at_place"), F.desc("vector_score"), F.asc(id_col)]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).drop("at_place")


def pair_text(doc_name: Column, section_path: Column, content: Column) -> Column:
    """What a cross encoder reads: name, section path and content, blanks left out."""
    path = F.array_join(section_path, " > ")
    parts = F.filter(F.array(F.trim(doc_name), path, content), lambda p: F.coalesce(F.trim(p), F.lit("")) != "")
    return F.array_join(parts, "\n")


def family_key(parent_id: Column, chunk_id: Column) -> Column:
    """The parent, or the chunk itself if its parent is null or empty."""
    return F.coalesce(F.nullif(parent_id.cast("string"), F.lit("")), chunk_id.cast("string"))


#: Scores that a family takes over from its members where they have them.
FAMILY_SCORES = ("score", "keyword_score", "vector_score", "fused_score", "rerank_score")


def expand_families(candidates: DataFrame, parents: DataFrame | None, how: str = "max") -> DataFrame:
    """Children (qid, chunk_id, family, score, keyword_score, rank) to families with rank.

    Every score is the mean or the greatest of the members'; the primary child
    is the best one. Parents (family, content) replace their children; a family
    whose parent is missing or empty keeps its primary child.
    """
    take = {"mean": F.avg, "max": F.max}[how]
    best = F.struct(F.col("score"), F.col("keyword_score"), (-F.col("rank")).alias("place"), F.col("chunk_id"))
    grouped = candidates.groupBy("qid", "family").agg(
        *(F.round(take(c), 6).alias(c) for c in FAMILY_SCORES if c in candidates.columns),
        F.count("*").alias("members"),
        F.max_by("chunk_id", best).alias("primary_child"),
        F.min("rank").alias("first_rank"),
    )
    if parents is not None:
        content = F.nullif(F.col("content"), F.lit(""))
        grouped = grouped.join(parents.select("family", content.alias("content")), "family", "left").withColumn("parent_found", F.col("content").isNotNull()).drop("content")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("keyword_score"), F.asc("first_rank"))
    return grouped.withColumn("rank", F.row_number().over(order)).drop("first_rank")


def rank_documents(candidates: DataFrame, how: str = "max", top_n: int = 3) -> DataFrame:
    """Children (qid, family, doc_id, score) to documents.

    A family has the mean of its children; a document its best family, or the
    mean of its ``top_n`` best.
    """
    families = candidates.groupBy("qid", "doc_id", "family").agg(F.avg("score").alias("score"))
    if how == "max":
        docs = families.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    else:
        ranked = families.withColumn("r", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "family"))).filter(F.col("r") <= top_n)
        docs = ranked.groupBy("qid", "doc_id").agg(F.avg("score").alias("score"))
    docs = docs.withColumn("score", F.round("score", 6))
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))


def dedupe_by_document(ranked: DataFrame) -> DataFrame:
    """(qid, doc_id, chunk_id, rank) to the best chunk of each document, ranks made contiguous."""
    best = ranked.withColumn("r", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("rank"))).filter("r = 1").drop("r")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def merge_step_back(first: DataFrame, second: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """Two result lists (qid, id, score): the better score of each chunk, the first list winning ties."""
    both = first.select("qid", id_col, "score", F.lit(0).alias("source")).unionByName(second.select("qid", id_col, "score", F.lit(1).alias("source")))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("qid", id_col).orderBy(F.desc("score"), "source"))).filter("r = 1").drop("r")
    return top_by(best, k, F.desc("score"), F.asc(id_col))


def threshold_funnel(candidates: DataFrame, threshold: float, top_k: int, samples: int = 10) -> DataFrame:
    """One row a query: candidates, kept, returned, mean of the returned and a sample of the rejected ids."""
    kept = F.col("score") >= threshold
    placed = candidates.withColumn("kept", kept).withColumn("place", F.row_number().over(Window.partitionBy("qid", "kept").orderBy("rank")))
    returned = F.col("kept") & (F.col("place") <= top_k)
    sample = F.sort_array(F.collect_list(F.when(~F.col("kept") & (F.col("place") <= samples), F.struct("place", "doc_id"))))
    return placed.groupBy("qid").agg(
        F.count("*").alias("n_candidates"),
        F.count_if("kept").alias("n_kept"),
        F.count_if(returned).alias("n_returned"),
        F.coalesce(F.round(F.avg(F.when(returned, F.col("score"))), 4), F.lit(0.0)).alias("avg_score"),
        F.array_join(F.transform(sample, lambda s: s["doc_id"].cast("string")), ",").alias("rejected"),
    )


def vector_topk_lsh(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", bucket: float = 1.0, tables: int = 6, radius: float = 1.6) -> DataFrame:
    """Approximate batch search: random projections of unit vectors; rows that share a bucket with a question are verified.

    Every row is hashed where it lies. Questions come in blocks with their hashes,
    and each task keeps its best rows of those that share a bucket in any table
    and are nearer than ``radius``: pairs are never written, only each task's best.
    Vectors that are null or not finite are left out.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..functions.vectors import normalized

    def units(rows: DataFrame, key: str, value: str) -> DataFrame:
        finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return rows.filter(F.coalesce(finite, F.lit(False))).select(key, array_to_vector(normalized(doubles(F.col(value)))).alias("features"))

    own, asked = units(corpus, id_col, vector), units(queries, "qid", "qvec")
    kind = queries.schema["qid"].dataType
    # Fitting reads the vectors' length, which an empty table doesn't have.
    model = None if own.isEmpty() else BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(own)
    if model is None:
        none = corpus.sparkSession.createDataFrame([], T.StructType([T.StructField("qid", kind), corpus.schema[id_col], T.StructField("score", T.DoubleType())]))
        return top_by(none, k, F.desc("score"), F.asc(id_col))

    def hashed(rows: DataFrame, key: str) -> DataFrame:
        return model.transform(rows).select(key, vector_to_array("features").alias("unit"), F.transform("hashes", lambda h: vector_to_array(h)[0]).alias("buckets"))

    parts = [search.near_in_buckets(hashed(own, id_col), [(r.qid, r.unit, r.buckets) for r in block], kind, k, id_col, radius) for block in search.in_blocks(hashed(asked, "qid"))]
    return top_by(reduce(DataFrame.unionByName, parts), k, F.desc("score"), F.asc(id_col))
