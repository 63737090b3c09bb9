"""A stored inverted index: BM25 without reading the texts again.

Documents lie in the buckets of their chunk table, and within a bucket in
segments of about equal size. Postings are blocks: the rows of one segment that
hold one term in one field, with what bounds their scores, the greatest count
and the least length. A block of the empty term has a segment's rows and tokens.
Blocks are sorted by term within a bucket's files, so a search reads the asked
terms'.

A search bounds what each segment can give each question from the blocks' bounds
alone, scores each question's most promising segments, and then those others
whose bound reaches the score that is last among the best so far. The result is
that of a search over all rows.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import query_terms, tokens_of
from ..sources.store import VersionedTable
from . import search
from .retrieval import B, K1, field_texts, top_by
from .search import saturation

#: Terms that are asked as a list of values; more are joined.
MOST_LISTED = 2000
#: Scores are rounded to six digits; what a bound may miss by that.
SLACK = 2e-6


class _ByHome(VersionedTable):
    """Rows lie in the bucket that their column names."""

    def _bucket(self, column: str | None = None) -> Column:
        return F.col(column or self.bucket_by)


class KeywordIndex:
    """The postings of a chunk table; ``fields`` are its searched columns with their boosts."""

    def __init__(self, spark: SparkSession, path: str, chunks: VersionedTable, fields: dict[str, float], id_col: str = "chunk_id", segment_rows: int = 512):
        self.chunks, self.fields, self.id_col, self.segment_rows = chunks, fields, id_col, segment_rows
        self.table = _ByHome(spark, path, "home", chunks.buckets, ("field", "term"))

    # --- building

    def postings(self, rows: DataFrame) -> DataFrame:
        """The blocks of chunk rows that are all of their buckets. Rows without an id are left out; null texts have no terms."""
        own = rows.filter(F.col(self.id_col).isNotNull()).select(self.chunks._bucket().alias("home"), F.col(self.id_col).alias("id"), *field_texts(rows, list(self.fields)))
        parts = own.groupBy("home").agg(F.ceil(F.count("*") / self.segment_rows).alias("parts"))
        dealt = own.join(F.broadcast(parts), "home").withColumn("segment", F.pmod(F.xxhash64("id", F.lit("segment")), F.col("parts")).cast("int")).drop("parts")
        fields, kind = list(self.fields), rows.schema[self.id_col].dataType
        ints = T.ArrayType(T.IntegerType())
        schema = T.StructType(
            [T.StructField("home", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.LongType())]
            + [T.StructField("most", T.IntegerType()), T.StructField("least", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("times", ints), T.StructField("lengths", ints)]
        )

        def blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for f in fields:
                held: dict[str, list] = {}
                total = 0
                for i, text in zip(rows["id"], rows[f]):
                    tokens = tokens_of(text)
                    total += len(tokens)
                    for term, times in Counter(tokens).items():
                        held.setdefault(term, []).append((i, times, len(tokens)))
                out.append((*key, f, "", len(rows), total, None, None, None, None, None))
                for term, found in held.items():
                    ids, times, lengths = zip(*found)
                    out.append((*key, f, term, len(ids), None, max(times), min(lengths), list(ids), list(times), list(lengths)))
            return pd.DataFrame(out, columns=schema.names).astype({"tokens": "Int64", "most": "Int32", "least": "Int32"})

        return dealt.groupBy("home", "segment").applyInPandas(blocks, schema)

    def build(self) -> int:
        """Index all of the chunk table; returns the index's version."""
        return self.table.write(self.postings(self.chunks.read()))

    def refresh(self, changed: DataFrame) -> int:
        """Index again the buckets of documents that the chunk table has changed; ``changed`` has its document column.

        Buckets that hold nothing any more lose their blocks.
        """
        homes = sorted(r.home for r in changed.select(self.chunks._bucket().alias("home")).distinct().collect())
        rows = self.chunks.read().filter(self.chunks._bucket().isin(homes))
        return self.table.commit(self.table.stage(self.postings(rows), homes))

    # --- searching

    def topk(self, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(qid, id, raw, rank) of the best rows, and (qid, segments, read): how many hold an asked term, how many were scored.

        Questions come as qid and text. Scores are BM25 of the best boosted field.
        """
        index, kind = self.table.read(), questions.schema["qid"].dataType
        asked = questions.select("qid", query_terms(F.col("text")).alias("terms"))
        found = [self._block(index, terms, kind, k) for terms in search.term_blocks(asked)]
        if not found:
            none = index.sparkSession.createDataFrame([], T.StructType([T.StructField("qid", kind), T.StructField(self.id_col, index.schema["ids"].dataType.elementType), T.StructField("raw", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
            return none, none.select("qid", F.lit(0).alias("segments"), F.lit(0).alias("read"))
        rows, traces = (reduce(DataFrame.unionByName, side) for side in zip(*found))
        return top_by(rows, k, F.desc("raw"), F.asc(self.id_col)), traces

    def _asked_blocks(self, index: DataFrame, terms: search.Terms) -> DataFrame:
        if len(terms.terms) <= MOST_LISTED:
            return index.filter(F.col("term").isin(terms.terms))
        listed = index.sparkSession.createDataFrame([(t,) for t in terms.terms], "term string")
        return index.join(F.broadcast(listed), "term", "left_semi")

    def _statistics(self, index: DataFrame, heads: DataFrame, terms: search.Terms) -> tuple[dict[str, float], dict[str, np.ndarray]]:
        """Mean length of each field, and each asked term's weight in it."""
        sizes = {r.field: (r.rows, r.tokens) for r in index.filter("term = ''").groupBy("field").agg(F.sum("n").alias("rows"), F.sum("tokens").alias("tokens")).collect()}
        df = {f: np.zeros(len(terms.terms)) for f in self.fields}
        for r in heads.groupBy("field", "term").agg(F.sum("n").alias("n")).collect():
            if r.field in df:
                df[r.field][terms.place[r.term]] = r.n
        means = {f: (sizes[f][1] / max(1, sizes[f][0]) if f in sizes else 0.0) for f in df}
        return means, {f: search.term_weights(sizes[f][0] if f in sizes else 0, df[f]) for f in df}

    def _block(self, index: DataFrame, terms: search.Terms, kind: T.DataType, k: int) -> tuple[DataFrame, DataFrame]:
        blocks = self._asked_blocks(index, terms)
        heads = blocks.select("home", "segment", "field", "term", "n", "most", "least")
        means, weights = self._statistics(index, heads, terms)
        boosts, qids, id_col = self.fields, terms.qids, self.id_col
        id_type = index.schema["ids"].dataType.elementType

        def best_field(rows: pd.DataFrame, row: np.ndarray, n: int, times: np.ndarray, lengths: np.ndarray, size: np.ndarray) -> np.ndarray:
            """n rows by questions: the best boosted field of the postings, which ``size`` deals over the blocks ``rows``."""
            field, term = np.repeat(rows["field"].to_numpy(), size), np.repeat(rows["term"].map(terms.place).to_numpy(np.int64), size)
            best = np.zeros((n, len(qids)))
            for f, boost in boosts.items():
                own = field == f
                value = saturation(times[own], lengths[own], means[f], K1, B) * weights[f][term[own]]
                np.maximum(best, boost * terms.summed(n, row[own], term[own], value), out=best)
            return best

        def bound(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            one = np.ones(len(rows), np.int64)
            most = best_field(rows, np.zeros(len(rows), np.int64), 1, rows["most"].to_numpy(float), rows["least"].to_numpy(float), one)[0]
            q = np.flatnonzero(most > 0)
            return pd.DataFrame({"home": key[0], "segment": key[1], "q": q.astype(np.int32), "most_score": most[q]})

        def score(key: tuple, rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
            size = rows["ids"].map(len).to_numpy() if len(rows) else np.zeros(0, np.int64)
            held, row = np.unique(np.concatenate(rows["ids"].to_list()), return_inverse=True) if len(rows) else (np.zeros(0), np.zeros(0, np.int64))
            numbers = lambda c: np.concatenate(rows[c].to_list()).astype(float) if len(rows) else np.zeros(0)
            found = np.round(best_field(rows, row.ravel(), len(held), numbers("times"), numbers("lengths"), size), 6)
            out = []
            for q in pairs["q"]:
                hit = np.flatnonzero(found[:, q] > 0)
                hit = hit[np.lexsort((hit, -found[hit, q]))][:k]
                out.append(pd.DataFrame({"q": np.full(len(hit), q, np.int32), id_col: held[hit], "raw": found[hit, q]}))
            return pd.concat(out) if out else pd.DataFrame({"q": [], id_col: [], "raw": []})

        bounds = heads.groupBy("home", "segment").applyInPandas(bound, "home int, segment int, q int, most_score double")
        scored = T.StructType([T.StructField("q", T.IntegerType()), T.StructField(id_col, id_type), T.StructField("raw", T.DoubleType())])

        def scores(pairs: DataFrame) -> DataFrame:
            wanted = blocks.join(pairs.select("home", "segment").distinct(), ["home", "segment"], "left_semi").select("home", "segment", "field", "term", "ids", "times", "lengths")
            return wanted.groupBy("home", "segment").cogroup(pairs.groupBy("home", "segment")).applyInPandas(score, scored)

        # The k most promising segments are scored first, as each may hold one of the best; the last of the k best is the least that counts.
        by_bound = bounds.withColumnRenamed("q", "qid")
        first = top_by(by_bound, k, F.desc("most_score"), F.asc("home"), F.asc("segment")).withColumnRenamed("qid", "q").drop("rank")
        early = search.kept(scores(first))
        least = top_by(early.withColumnRenamed("q", "qid"), k, F.desc("raw"), F.asc(id_col)).filter(F.col("rank") == k).select(F.col("qid").alias("q"), F.col("raw").alias("least_score"))
        rest = bounds.join(first.select("home", "segment", "q"), ["home", "segment", "q"], "left_anti").join(least, "q", "left").filter(F.col("most_score") + SLACK >= F.coalesce("least_score", F.lit(0.0)))
        names = index.sparkSession.createDataFrame(list(enumerate(qids)), T.StructType([T.StructField("q", T.IntegerType()), T.StructField("qid", kind)]))
        rows = early.unionByName(scores(rest)).join(F.broadcast(names), "q").select("qid", id_col, "raw")
        read = first.select("q").unionByName(rest.select("q")).groupBy("q").agg(F.count("*").alias("read"))
        trace = names.join(bounds.groupBy("q").agg(F.count("*").alias("segments")), "q", "left").join(read, "q", "left").select("qid", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("segments", "read")))
        return rows, trace
