import math

import numpy as np
from pyspark.sql import types as T

from quillgrain.llm import whitening as w

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def plain(vectors, components):
    """Exact sums in Python integers, covariance and projection in numpy over one matrix."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(column) for column in zip(*x)]
    deviations = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(row, s)] for row in x])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return deviations, centred @ axes / np.sqrt(values), values / np.trace(cov)


def test_against_one_matrix(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(good)]
    bad = [(900, None, 1), (901, [None] * 12, 1), (902, [1.0] * 11 + [float("nan")], 1), (903, [float("inf")] + [0.0] * 11, 1), (904, [], 1), (905, [1.0] * 5, 1), (906, [3e38] * 12, 1)]
    rows += [(None, good[3].tolist(), 2), (7, good[7].tolist(), 2), (7, good[7].tolist(), 2)]
    got = w.whiten(spark.createDataFrame(rows + bad, ROWS).repartition(5)).collect()
    vectors = [r[1] for r in rows]
    deviations, whitened, explained = plain(vectors, 8)
    assert len(got) == 8 * len(rows) and {r.n for r in got} == {len(rows)} and {r.identity_error for r in got}.pop() < 1e-9
    by_id = {(r.vec_id, r.component): r for r in got}
    signs = [np.sign(by_id[0, k + 1].whitened * whitened[0, k]) for k in range(8)]
    for i, (vec_id, _, _) in enumerate(rows[:300]):
        for k in range(8):
            r = by_id[vec_id, k + 1]
            assert r.deviation == int(r.deviation_exact) == deviations[i]
            assert abs(r.whitened - signs[k] * whitened[i, k]) < 1e-8 and abs(r.explained - explained[k]) < 1e-10
    assert by_id[None, 1].whitened == by_id[3, 1].whitened


def test_few_dimensions_no_variance_and_large_values(spark):
    frame = lambda vectors: spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], ROWS)
    flat = w.whiten(frame([[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])).collect()
    assert sorted({r.component for r in flat}) == [1, 2] and all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    one = w.whiten(frame([[1.0, 2.0, 3.0]])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 3
    large = w.whiten(frame([[4e9, 0.0], [-4e9, 1.0], [1.0, 2.0]])).collect()
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in ([4e9, 0.0], [-4e9, 1.0], [1.0, 2.0])]
    want = [sum((3 * a - sum(col)) ** 2 for a, col in zip(row, zip(*x))) for row in x]
    assert {r.vec_id: int(r.deviation_exact) for r in large} == dict(enumerate(want))
    assert all((r.deviation is None) == (want[r.vec_id] >= 1 << 63) for r in large) and any(r.deviation is None for r in large)


def test_empty_and_other_columns(spark):
    empty = w.whiten(spark.createDataFrame([], ROWS))
    assert empty.collect() == [] and w.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], ROWS)).collect() == []
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [c for c in empty.columns if c in names] == names
    rows = spark.createDataFrame([(i, [float(i), float(i * i % 7)], "x", "y") for i in range(9)], "vec_id long, embedding array<double>, vector string, whitened string")
    assert w.whiten(rows).count() == 18
