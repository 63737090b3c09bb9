import random

import pytest
from pyspark.sql import functions as F

from quillgrain.functions.text import tokenize, tokens_of
from quillgrain.operators import keyword_index as ki
from quillgrain.operators import retrieval
from quillgrain.sources.store import VersionedTable

SF = "/root/testdata/sf0.001"
FIELDS = {"source": 2.0, "content": 1.0}


def test_tokens_in_python_and_as_columns(spark):
    rng = random.Random(4)
    alphabet = ["a", "B", "9", "_", ".", "+", "#", " ", "\n", "é", "中", "的", "文", "😀", "-", "Z"]
    texts = [None, "", *("".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(400))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokenize(F.col("t")).alias("x")).collect()
    assert all(tokens_of(texts[r.i]) == list(r.x) for r in rows)


def chunks_of(docs):
    return docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "source", F.col("text").alias("content"))


@pytest.fixture
def made(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/chunks", buckets=4)
    table.write(chunks_of(spark.read.parquet(f"{SF}/documents.parquet")))
    index = ki.KeywordIndex(spark, f"{tmp_path}/index", table, FIELDS, segment_rows=16)
    index.build()
    return table, index


def same(index, table, questions, k):
    got, trace = index.topk(questions, k)
    want = retrieval.keyword_topk(table.read(), questions, k, FIELDS, "chunk_id").drop("score")
    as_rows = lambda df: sorted((r.qid, r["rank"], r.chunk_id, r.raw) for r in df.collect())
    assert as_rows(got) == as_rows(want)
    return {r.qid: (r.segments, r.read) for r in trace.collect()}


def test_same_rows_as_a_search_over_the_texts(spark, made):
    table, index = made
    passages = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    short = passages.select((F.col("qid") + 1000).alias("qid"), F.array_join(F.slice(F.split("text", " "), 3, 2), " ").alias("text"))
    more = spark.createDataFrame([(5000, "src0"), (5001, "nosuchword"), (5002, ""), (5003, None)], "qid long, text string")
    same(index, table, passages.unionByName(short).unionByName(more), 10)


def test_an_upsert_rewrites_its_bucket(spark, made):
    table, index = made
    before = index.table._held(index.table.version())["folders"]
    fresh = spark.createDataFrame([("new", 7, "src0", "zebra zebra crossing"), ("new2", 7, "zoo", "a zebra")], "chunk_id string, doc_id long, source string, content string")
    table.replace_documents(fresh)
    index.refresh(fresh.select("doc_id"))
    after = index.table._held(index.table.version())["folders"]
    assert sum(before[b] != after[b] for b in after) == 1
    questions = spark.createDataFrame([(1, "zebra crossing"), (2, "zoo zebra")], "qid long, text string")
    same(index, table, questions, 5)
    gone = spark.createDataFrame([(7,)], "doc_id long")
    table.delete(gone, "doc_id")
    index.refresh(gone)
    assert index.topk(questions, 5)[0].filter("chunk_id like 'new%'").isEmpty()


def test_segments_that_cannot_win_are_not_read(spark, tmp_path):
    """Few rows say a rare word often; the common word alone can't reach them."""
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(300)]
    rows = [(f"{i:05d}", i, "s", "common " + " ".join(rng.choices(filler, k=30)) + (" rare rare" if i % 500 == 3 else "")) for i in range(4000)]
    table = VersionedTable(spark, f"{tmp_path}/chunks", buckets=4)
    table.write(spark.createDataFrame(rows, "chunk_id string, doc_id long, source string, content string"))
    index = ki.KeywordIndex(spark, f"{tmp_path}/index", table, FIELDS, segment_rows=50)
    index.build()
    questions = spark.createDataFrame([(1, "rare common"), (2, "common"), (3, "rare w7 common")], "qid long, text string")
    segments, read = same(index, table, questions, 5)[1]
    assert segments > 60 and read <= 12
    blocks = index._asked_blocks(index.table.read(), ki.search.Terms([(1, ["rare"])]))
    assert {r.term for r in blocks.select("term").collect()} == {"rare"} and "PushedFilters: [IsNotNull(term), EqualTo(term,rare)]" in blocks._jdf.queryExecution().toString().replace("In(term, [rare])", "EqualTo(term,rare)")


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    """No task sorts a whole bucket, whose share of the table is fixed; rows stay in the bucket of their document."""
    from pyspark.sql import functions as F

    from quillgrain.sources.store import VersionedTable

    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
        table = VersionedTable(spark, f"{tmp_path}/t", buckets=2, sort_by=("text",))
        table.write(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = table.read().select(F.input_file_name().alias("f"), table._bucket().alias("b"), "doc_id")
    found = files.groupBy("f").agg(F.count("*").alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi")).collect()
    assert len(found) >= 4 and sum(r.n for r in found) == 20_000 and all(r.lo == r.hi for r in found)
