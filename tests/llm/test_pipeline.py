from data import document_rows, documents
from pyspark.sql import functions as F

import corpus_pipeline as p
from quillgrain.llm import decontaminate, mixing, quality_rules, simhash
from quillgrain.llm.common import DOCUMENT_COLUMNS, written


def _write(spark, tmp_path):
    sf = str(tmp_path)
    extra = spark.createDataFrame([(500 + i, f"Leaked passage number {i}: " + "the quick brown fox jumps over the lazy dog while nine clever owls watch from a tall dark tree", "en", "a", 1) for i in range(3)], documents(spark).schema)
    documents(spark).unionByName(extra).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog while nine clever owls watch from a tall dark tree")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_stages_one_by_one(spark, tmp_path):
    sf = _write(spark, tmp_path)
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    at = docs
    for n, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, at, sf)
        if name == "quality_rules":
            assert ids(out) == sorted(str(r.doc_id) for r in quality_rules.judge_documents(at).collect() if r.kept)
        elif name == "simhash_near_dedup":
            assert set(ids(out)) == {str(r.component_id) for r in simhash.near_duplicates(at).collect()} and len(set(ids(out))) == len(ids(out))
        elif name == "benchmark_decontamination":
            hit = {str(r.doc_id) for r in decontaminate.contaminations(at, bench).collect()}
            assert hit and ids(out) == [i for i in ids(at) if i not in hit]
        elif name == "mixing":
            taken = {str(r.doc_id): r.taken // max(1, r["size"]) for r in mixing.mix_documents(at).collect()}
            assert ids(out) == sorted(i for i, k in taken.items() for _ in range(k))
        assert (out.columns == DOCUMENT_COLUMNS) if n < 4 else set(DOCUMENT_COLUMNS) < set(out.columns)
        out.write.parquet(f"{sf}/stage{n}")
        at = spark.read.parquet(f"{sf}/stage{n}")
    assert sorted(map(str, at.collect())) == sorted(map(str, p.run(spark, sf).collect()))


def test_nothing_but_the_last_stage_is_left(spark, tmp_path):
    before = written()
    rows = p.run(spark, _write(spark, tmp_path))
    assert len(written() - before) == 1 and rows.count() > 0


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    documents(spark).limit(0).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert p.run(spark, sf).count() == 0
    assert len(document_rows()) > 30 and F is not None
