import zlib
from collections import Counter

import pytest
from data import crowded, document_rows, documents, empty
from pyspark.sql import functions as F

from quillgrain.llm import sharding as s


def test_rows_sizes_and_slots(spark):
    rows = s.shard_documents(documents(spark), [1.0] * 4, [1.0] * 5).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in document_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows}) and {r.law for r in rows} == {"key"}
    assert all(r.grown_shard in (r.shard, 4) for r in rows)


def test_few_rows_move_and_weights_hold(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    weights = [1.0, 2.0, 1.0, 0.0]
    rows = s.assign_shards(ids, weights).withColumn("more", s.rendezvous(s.record_key(F.col("doc_id")), [*weights, 1.0])["shard"]).collect()
    shares = Counter(r.shard for r in rows)
    assert shares[3] == 0 and abs(shares[1] - 10_000) < 400 and abs(shares[0] - 5_000) < 300
    moved = [r for r in rows if r.shard != r.more]
    assert {r.more for r in moved} == {4} and abs(len(moved) - 4_000) < 300


def test_slots_of_many_rows(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).cast("int").alias("shard"), F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    got = s.number_slots(rows, "shard", ["doc_id"], "h").groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert all((r.n, r.d, r.a, r.b) == (10_000, 10_000, 0, 9_999) for r in got)


def test_equal_rows_get_slots_of_their_own(spark, monkeypatch):
    """One row many times over is numbered without meeting in one task."""
    monkeypatch.setattr(s, "CROWDED_ROWS", 100)
    docs = spark.range(4000).selectExpr("if(id < 1500, 1L, if(id < 2500, 2L, id)) AS doc_id", "if(id < 2500, 'same', concat('t', id)) AS text")
    rows = s.shard_documents(docs, [1.0] * 3, [1.0] * 4).collect()
    assert len(rows) == 4000 and sum(r.doc_id == 1 for r in rows) == 1500
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and slots


def plain_xxh64(data, seed):
    import xxhash

    n = xxhash.xxh64_intdigest(data, seed)
    return n - (1 << 64) if n >> 63 else n


def test_shard_choice_against_plain_rendezvous(spark):
    """The winner of each key, found by hashing key and shard in plain Python."""
    import math
    import struct

    weights = [1.0, 2.0, 0.5, 1.0]
    ids = [None, -5, 0, 1, 7, 123456789012, *range(100, 160)]
    got = {r.doc_id: r.shard for r in s.assign_shards(spark.createDataFrame([(i,) for i in ids], "doc_id long"), weights).collect()}
    for i in ids:
        key = ("~" if i is None else f"={i}").encode()
        first = plain_xxh64(key, 42) & (1 << 64) - 1
        bids = []
        for shard, w in enumerate(weights):
            # A hash of several columns seeds each column with the hash before it.
            h = plain_xxh64(struct.pack("<i", shard), first) & (1 << 64) - 1
            bids.append((-math.log(((h >> 11) + 0.5) * 2.0**-53) / w, shard))
        assert got[i] == min(bids)[1]


def test_reruns_other_columns_and_empty(spark):
    a, b = (sorted(map(str, s.shard_documents(documents(spark).repartition(n), [1.0] * 4, [1.0] * 5).collect())) for n in (1, 3))
    assert a == b
    assert s.assign_shards(crowded(spark), [1.0] * 3).columns == crowded(spark).columns
    assert s.shard_documents(empty(spark), [1.0], [1.0, 1.0]).count() == 0
    with pytest.raises(ValueError):
        s.rendezvous(F.lit("x"), [0.0])
