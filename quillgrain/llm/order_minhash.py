"""Order MinHash: fingerprints whose likeness follows edit distance.

A text's k-mers are numbered by occurrence, so repeats count. Each of ``M`` hash
functions selects the ``L`` smallest numbered k-mers; the k-mers, in the order
in which the text holds them, are hashed to one number. Two texts agree in a
number if they share the k-mers and their order. Likeness is the share of
numbers that agree.

Each document is also compared with the next one and with a text put together
from both. Rows are dealt by ranges of the id, each task goes through its rows
in order, and only the rows at the edges of tasks are matched afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import cut

#: Code points of a k-mer, k-mers of a selection, hash functions.
K, L, M = 5, 2, 64
#: Hash values held at a time.
BLOCK = 1 << 17

BASE, STEP, NUMBER = (np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
#: A hash function multiplies a numbered k-mer's hash of 32 bits by its odd factor.
FACTORS = np.random.default_rng(42).integers(0, 1 << 31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
TOP = np.uint32((1 << 32) - 1)

RESULT = T.StructType(
    [
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.BinaryType()),
        T.StructField("edited_fingerprint", T.BinaryType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * STEP
    return (h ^ (h >> np.uint64(32))) * STEP


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def kmer_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each run of K code points; a shorter text is one run."""
    width = min(K, len(codes))
    h = np.zeros(len(codes) - width + 1 if width else 0, np.uint64)
    for j in range(width):
        h = h * BASE + codes[j : j + len(h)]
    return h


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes, of 32 bits, of k-mers and how often each came before."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    at = np.arange(len(hashes))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ranked[1:] != ranked[:-1]]), at, 0)) if len(at) else at
    out = np.empty(len(hashes), np.uint32)
    out[order] = _mixed(ranked + (at - first).astype(np.uint64) * NUMBER) >> np.uint64(32)
    return out


def signature(codes: np.ndarray) -> np.ndarray:
    """``M`` numbers of 16 bits; none for an empty text."""
    kmers = kmer_hashes(codes)
    if not len(kmers):
        return np.zeros(0, np.uint16)
    values, picks = numbered(kmers), min(L, len(kmers))
    step = max(1, BLOCK // len(values))
    places = np.empty((M, picks), np.int64)
    for a in range(0, M, step):
        hashed = values[None, :] * FACTORS[a : a + step, None]
        rows = np.arange(len(hashed))
        for j in range(picks):
            places[a : a + step, j] = least = hashed.argmin(axis=1)
            if j < picks - 1:
                hashed[rows, least] = TOP
    places.sort(axis=1)
    out = np.zeros(M, np.uint64)
    for j in range(picks):
        out = _mixed(out * BASE + kmers[places[:, j]] + np.uint64(1))
    return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal numbers; two empty texts are alike, an empty one and another aren't."""
    return float(np.mean(a == b)) if len(a) and len(b) else float(len(a) == len(b))


def _compared(codes: np.ndarray, own: np.ndarray, then: np.ndarray, following: np.ndarray) -> tuple:
    half = len(codes) // 2
    edited = np.concatenate([codes[: len(codes) - half], then[:half]])
    changed = signature(edited)
    digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return len(codes), digest, own.astype(">u2").tobytes(), changed.astype(">u2").tobytes(), likeness(own, changed), likeness(own, following)


@pandas_udf(RESULT)
def compared(text: pd.Series, following: pd.Series) -> pd.DataFrame:
    found = []
    for a, b in zip(map(code_points, text), map(code_points, following)):
        found.append(_compared(a, signature(a), b, signature(b)))
    return pd.DataFrame(found, columns=RESULT.names)


@pandas_udf(T.BinaryType())
def fingerprint_column(text: pd.Series) -> pd.Series:
    """The fingerprint of each text, ``2 * M`` bytes; none for an empty text."""
    return pd.Series([signature(code_points(t)).astype(">u2").tobytes() for t in text], dtype=object)


def _in_order(rows: DataFrame) -> DataFrame:
    """Results of all rows but the last of each task; the first and last texts of each task, marked 1 and 2."""
    schema = T.StructType([rows.schema["doc_id"], *RESULT.fields, T.StructField("part", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("text", T.StringType())])
    names = schema.names

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, arrow = TaskContext.get().partitionId(), None, None
        for batch in batches:
            ids, found = batch.column(0), []
            arrow = arrow or pa.schema([("doc_id", ids.type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                codes = code_points(text)
                own = signature(codes)
                if last is None:
                    found.append((ids[i].as_py(), *[None] * 6, part, 1, text))
                else:
                    found.append((last[0], *_compared(last[2], last[3], codes, own), part, 0, None))
                last = (ids[i].as_py(), text, codes, own)
            yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], arrow)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (last[0], *[None] * 6, part, 2, last[1])))], arrow)

    return rows.mapInArrow(go, schema)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, code points, fingerprints of its text and of its edited text, and their likeness.

    The next document is the one of the next smaller id, null ids come last,
    documents of one id by the hash of their texts; after the last comes the
    first (a single document follows itself). Null texts are empty. An empty
    text has an empty fingerprint, which is like another empty one only.
    Repeated rows come back repeated. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("said", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("said"), F.col("row")]
    placed = cut(_in_order(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")), "order-minhash", large=True)
    heads, tails = (placed.filter(F.col("edge") == edge).select("doc_id", "part", "text") for edge in (1, 2))
    parts = sorted(r.part for r in heads.select("part").collect())
    after = placed.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    closed = tails.join(after, "part").join(heads.select(F.col("part").alias("next"), F.col("text").alias("next_text")), "next").select("doc_id", compared("text", "next_text").alias("found")).select("doc_id", "found.*")
    both = placed.filter(F.col("edge") == 0).select(*closed.columns).unionByName(closed)
    as_text = lambda name: F.lower(F.hex(name)).alias(name)
    return both.select("doc_id", "n_chars", "edited_sha256", as_text("fingerprint"), as_text("edited_fingerprint"), "near_edited", "near_next")
