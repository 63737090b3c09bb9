import pyarrow as pa
import pytest

from quillgrain.config import ChunkConfig, EvidenceConfig
from quillgrain.functions import batches
from quillgrain.operators import chunking, evidence, parsing
from quillgrain.plans import catalog


def test_parts_are_small_and_whole():
    texts = ["x" * 3000] * 2000 + ["y" * 500_000] * 6
    batch = pa.record_batch({"t": texts})
    parts = list(batches.parts(batch, 1 << 20))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= batches.PART_ROWS and (p.num_rows == 1 or p.nbytes <= 2 << 20) for p in parts)
    assert list(batches.parts(batch.slice(0, 0))) == [] and [len(s) for s in batches.array_parts(pa.array(range(5)), 2)] == [2, 2, 1]


def largest_out(made, batch: pa.RecordBatch) -> int:
    """Rows of the largest batch that the function of a mapInArrow or mapInPandas gives for one large batch."""
    func, taken = made
    return max(len(b) for b in func(iter([batch if taken == "arrow" else batch.to_pandas()])))


@pytest.mark.parametrize("step", ["chunks", "families", "windows", "prompts", "parsed"])
def test_a_large_batch_goes_through_in_small_parts(monkeypatch, step):
    """No step makes Python objects of all of a large batch at once."""
    seen = {}

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def mapInArrow(self, run, schema):
            seen["run"] = (run, "arrow")

        def mapInPandas(self, run, schema):
            seen["run"] = (run, "pandas")

    class Columns:
        def __getattr__(self, name):
            return lambda *a, **k: Columns()

        __le__ = lambda self, other: self

    n = 6000
    for module in (chunking, evidence, parsing):
        monkeypatch.setattr(module, "F", Columns())
    monkeypatch.setattr(parsing, "source_type", lambda c: c)
    block = {"text": "one two", "block_type": "paragraph", "section_path": [], "order": 1, "span": None}
    window = {"rank": 1, "chunk_id": "c", "window_no": 0, "doc_id": "d", "content": "abc", "first": 0, "last": 3, "match_first": None, "match_last": None, "whole": False}
    child = {"chunk_id": "k", "start": 0, "end": 2, "snippet": ""}
    parent = {"rank": 1, "chunk_id": "c", "doc_id": "d", "content": "abc", "children": [child], "primary_child": "k", "preserve_structure": False}
    call, row = {
        "chunks": (lambda: chunking.chunk_documents(Frame(), ChunkConfig()), {"doc_id": "d", "blocks": [block]}),
        "families": (lambda: chunking.chunk_families(Frame(), ChunkConfig()), {"doc_id": "d", "blocks": [block]}),
        "windows": (lambda: evidence.evidence_windows(Frame(), EvidenceConfig()), {"qid": "q"} | parent),
        "prompts": (lambda: evidence.fit_prompts(Frame(), EvidenceConfig()), {"qid": "q", "rows": [window]}),
        "parsed": (lambda: parsing.parse_documents(Frame()), {"doc_id": "d", "kind": "html", "content": "<p>one</p>"}),
    }[step]
    call()
    assert largest_out(seen["run"], pa.RecordBatch.from_pylist([row] * n)) <= 4 * batches.PART_ROWS


def test_image_references_come_in_small_parts():
    udf = parsing._refs_udf()
    out = list(udf.func(iter([pa.array(["![a](b.png)"] * 6000)])))
    assert sum(map(len, out)) == 6000 and max(map(len, out)) <= batches.PART_ROWS


def test_image_references_are_read_once(spark, tmp_path):
    """The query's plan reads each text in one Python step, not in one for a filter and one for the rows."""
    spark.createDataFrame([(1, "a", "s"), (2, "![x](y.png)", "t"), (3, "", "u")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    refs = catalog.image_refs(spark, str(tmp_path))
    plan = refs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("refs(") > 0 and plan.count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.n_refs, r.path, r.start_char) for r in refs.collect()) == [(1, 1, "img/s.png", 3), (2, 1, "y.png", 0), (3, 1, "img/u.png", 2)]
