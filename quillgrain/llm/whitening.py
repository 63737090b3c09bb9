"""Whitening of embeddings by a covariance of two passes.

The first pass sums the scaled integers of each dimension, exactly. The second
sums outer products of the centred vectors, a matrix product for each block of
rows, merged as a tree. The driver has the square matrix only (128 MB at 4,096
dimensions), takes its eigenvectors and broadcasts the projection. A further
pass measures how far the whitened vectors' covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 1024, 100_000
#: Entries beyond this have no 64-bit integer and count as not finite.
LARGEST = 2.0**52
#: Entries of vectors in one block of rows.
BLOCK = 1 << 18
#: Bytes of partial matrices that may reach the driver at once.
MERGED = 256 << 20
#: A direction with less than this share of the variance has none within rounding.
NO_VARIANCE = 1e-12


def _whole_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, first entries, which rows are whole and finite, and all entries."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    bad = ~(np.abs(entries) * SCALE < LARGEST)
    whole = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    whole[np.repeat(np.arange(len(lengths)), lengths)[bad]] = False
    return lengths, np.cumsum(lengths) - lengths, whole, entries


def _blocks(column: pa.Array, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their integers) of the whole rows of one width, or of each width there is."""
    lengths, firsts, whole, entries = _whole_rows(column)
    for w in [width] if width else np.unique(lengths[whole]):
        rows, step = np.flatnonzero(whole & (lengths == w)), max(1, BLOCK // max(1, w))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            yield own, np.floor(entries[firsts[own][:, None] + np.arange(w)] * SCALE).astype(np.int64) + SHIFT


def _merged(rdd: RDD, zero, add: Callable, merge: Callable, item_bytes: int):
    """treeAggregate, as deep as keeps what reaches the driver at once within ``MERGED`` bytes."""
    depth = 2
    while depth < 12 and item_bytes * rdd.getNumPartitions() ** (1 / depth) > MERGED:
        depth += 1
    return rdd.treeAggregate(zero, add, merge, depth)


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are of the commonest width, and the sums of their integers.

    Of widths equally common the largest counts. Halves of 32 bits are summed
    apart, so nothing overflows.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(1)):
                own = found.setdefault(x.shape[1], [0, 0, 0])
                own[0] += len(x)
                own[1] = own[1] + (x >> 32).sum(axis=0)
                own[2] = own[2] + (x & 0xFFFFFFFF).sum(axis=0)
        rows = [{"width": w, "n": n, "high": np.atleast_1d(high).tolist(), "low": np.atleast_1d(low).tolist()} for w, (n, high, low) in found.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("width", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))

    def merge(a: dict, b: dict) -> dict:
        out = dict(a)
        for w, (n, total) in b.items():
            m, so_far = out.get(w, (0, [0] * w))
            out[w] = (m + n, [x + y for x, y in zip(so_far, total)])
        return out

    add = lambda a, r: merge(a, {r.width: (r.n, [(h << 32) + l for h, l in zip(r.high, r.low)])})
    rows = vectors.mapInArrow(sums, "width int, n long, high array<long>, low array<long>").rdd
    found = {w: f for w, f in _merged(rows, {}, add, merge, 1 << 16).items() if w}
    return max(((n, w, s) for w, (n, s) in found.items()), default=(0, 0, []))[::2]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the integers, divisor n, centred before multiplying."""
    width = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for _, x in _blocks(batch.column(1), width):
                c = _centred(x, n, sums)
                total += c.T @ c
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    zero, size = bytes(8 * width * width), 8 * width * width
    plus = lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes()
    total = _merged(vectors.mapInArrow(products, "total binary").rdd, zero, lambda a, r: plus(a, bytes(r.total)), plus, size)
    return np.frombuffer(total).reshape(width, width) / n


def directions(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over dimensions of (n*x - S)^2, exact; null beyond 38 digits."""
    whole = np.array([s // n for s in sums], np.int64)
    away = x - whole
    most = (int(np.abs(away).max(initial=0)) + 1) * n
    if most * most * len(sums) < 1 << 63:
        off = away * n - np.array([s % n for s in sums], np.int64)
        return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
    off = away.astype(object) * n - np.array([s % n for s in sums], object)
    return pa.array([Decimal(v) if v < 10**38 else None for v in (off * off).sum(axis=1)], pa.decimal128(38, 0))


def _identity_error(vectors: DataFrame, project: Callable, width: int, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, centred by their own means."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(components), np.zeros((components, components))
        for batch in batches:
            for _, x in _blocks(batch.column(1), width):
                w = project(x)
                own = w.mean(axis=0)
                n, mean, spread = merge((n, mean, spread), (len(w), own, (w - own).T @ (w - own)))
        yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tobytes()], "spread": [spread.tobytes()]})

    def merge(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        if not n:
            return a
        apart = b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)

    def add(a: tuple, r) -> tuple:
        return merge(a, (r.n, np.frombuffer(bytes(r.mean)), np.frombuffer(bytes(r.spread)).reshape(components, components)))

    zero = (0, np.zeros(components), np.zeros((components, components)))
    n, _, spread = _merged(vectors.mapInArrow(moments, "n long, mean binary, spread binary").rdd, zero, add, merge, 8 * components * (components + 1))
    return float(np.abs(spread / n - np.eye(components)).max())


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining vector and component, up to ``components`` or the dimensions there are.

    Columns: vec_id, component (from 1 by falling eigenvalue), n, deviation,
    whitened, explained, identity_error, deviation_exact. A vector that is null,
    holds null or not finite entries (or ones beyond 2^42, which have no exact
    integer) or isn't of the commonest width is dropped; repeated rows and ids
    count each, ids may be null. ``deviation`` is null where 64 bits don't hold
    it, ``deviation_exact`` where 38 digits don't. A direction without variance
    has whitened null and is left out of identity_error. No vectors, no rows.
    """
    spark = rows.sparkSession
    vectors = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    n, sums = exact_sums(vectors)
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("deviation_exact", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    width = len(sums)
    cov = covariance(vectors, n, sums) if n else np.zeros((0, 0))
    values, axes = directions(cov, components) if n else (np.zeros(0), np.zeros((0, 0)))
    trace = float(np.trace(cov))
    varied = values > NO_VARIANCE * trace
    sent = spark.sparkContext.broadcast((n, sums, axes[:, varied] / np.sqrt(values[varied])))

    def project(x: np.ndarray) -> np.ndarray:
        n, sums, projection = sent.value
        return _centred(x, n, sums) @ projection

    error = _identity_error(vectors, project, width, int(varied.sum())) if varied.any() else None

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in _blocks(batch.column(1), width) if n else ():
                flat = pa.array(project(x).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * int(varied.sum())), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), _deviations(x, *sent.value[:2]), lists], ["vec_id", "deviation_exact", "whitened"])

    places = np.where(varied, np.cumsum(varied), 0)
    told = [(k + 1, int(places[k]), float(values[k] / trace) if trace else None) for k in range(len(values))]
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("int").alias("component"), _entry(at).alias("whitened"), F.lit(e).cast("double").alias("explained")) for k, at, e in told)))
    fits = F.col("deviation_exact").between(0, (1 << 63) - 1)
    out = vectors.mapInArrow(whitened, schema)
    if not told:
        each = F.explode(F.array().cast("array<struct<component:int,whitened:double,explained:double>>"))
    return out.select("vec_id", "deviation_exact", each.alias("c")).select(
        "vec_id",
        "c.component",
        F.lit(n).cast("long").alias("n"),
        F.when(fits, F.col("deviation_exact").cast("long")).alias("deviation"),
        "c.whitened",
        "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
        "deviation_exact",
    )


def _entry(at: int) -> Column:
    return F.col("whitened")[at - 1] if at else F.lit(None).cast("double")
