"""Work that stops and goes on, writers that race, and errors that name their place."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quillgrain.functions.providers import hash_embedding
from quillgrain.operators import parsing as p
from quillgrain.sources import readers
from quillgrain.sources.embedding_log import EmbeddingLog
from quillgrain.sources.registry import Registry
from quillgrain.sources.store import VersionedTable


def chunks(spark, n=60, change=None):
    rows = [(f"c{i}", f"text {i}" + (" changed" if i == change else ""), i % 7 != 0) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, content string, retrieval_eligible boolean").repartition(3)


def test_embedding_goes_on_where_it_stopped(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def model(fail_at=None):
        def make():
            def embed(texts):
                if fail_at and any(f"text {fail_at}" == t for t in texts):
                    raise RuntimeError("killed")
                seen.add(len(texts))
                return hash_embedding(texts, 64)

            return embed

        return make

    log = lambda path: EmbeddingLog(spark, f"{tmp_path}/{path}", 64, {"model": "m"}, ranges=6)
    whole = log("whole").run(chunks(spark), model())
    eligible = 60 - 9
    assert whole["made"] == whole["rows"] == eligible == log("whole").vectors().count() and seen.value == eligible
    with pytest.raises(Exception, match="killed"):
        log("resumed").run(chunks(spark), model(17), at_once=1)
    done = log("resumed").committed()
    assert 0 < len(done) < 6
    before = sum(e["rows"] for e in done.values())
    seen.value = 0
    again = log("resumed").run(chunks(spark), model(), at_once=2)
    assert seen.value == eligible - before and again["ranges"] == 6 - len(done) and again["digest"] == whole["digest"]
    assert log("resumed").run(chunks(spark), model())["made"] == 0
    changed = log("resumed").run(chunks(spark, change=10), model())
    assert changed["ranges"] == 1 and changed["digest"] != whole["digest"] and changed["rows"] == eligible
    assert log("resumed").clean() == 1 and log("resumed").clean() == 0 and log("resumed").vectors().count() == eligible
    # A folder that is lost or damaged is made again.
    entry = log("whole").committed()[0]
    spark.createDataFrame([("c1", [0.5] * 64)], "chunk_id string, embedding array<float>").write.mode("overwrite").parquet(entry["folder"])
    mended = log("whole").run(chunks(spark), model())
    assert mended["ranges"] == 1 and mended["digest"] == whole["digest"]
    with pytest.raises(ValueError, match="configuration"):
        EmbeddingLog(spark, f"{tmp_path}/whole", 64, {"model": "other"}, ranges=6).run(chunks(spark), model())


def test_bad_lines_are_named_in_a_file_of_several_splits(spark, tmp_path):
    rng = random.Random(1)
    bad = {}
    for name in ("a.jsonl", "b.jsonl"):
        lines = [f'{{"a": {i}, "b": "{"x" * rng.randrange(60)}"}}' for i in range(4000)]
        for i in (0, 7, 2222, 3999):
            lines[i] = rng.choice(["{broken", '{"a": "no number"}', "[1]", '{"a": 1'])
        for i in (5, 100, 2221):
            lines[i] = "  "
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        bad |= {(name, i + 1): lines[i] for i in (0, 7, 2222, 3999)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = readers.bad_lines(spark, str(tmp_path), "a int, b string").collect()
        assert readers.numbered_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 10
        assert {(r.file.rpartition("/")[2], r.line): r.value for r in found} == bad
        with pytest.raises(ValueError, match=r"a\.jsonl line 1: .*a\.jsonl line 8: .*a\.jsonl line 2223: "):
            readers.read_jsonl(spark, str(tmp_path), "a int, b string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "c.jsonl").write_text('{"a": 1}\n\n{"a": null, "b": "y"}\n')
    assert sorted(map(str, readers.read_jsonl(spark, str(tmp_path / "ok"), "a int, b string").collect())) == ["Row(a=1, b=None)", "Row(a=None, b='y')"]


def registry(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/registry", buckets=2)
    table.write(spark.createDataFrame([(f"d{i}", "uploaded", f"/f{i}") for i in range(4)], "doc_id string, status string, file_path string"))
    return Registry(table)


def test_writers_that_race_for_a_document(spark, tmp_path):
    reg = registry(spark, tmp_path)
    outcomes, gate = [], threading.Barrier(2)

    def write():
        gate.wait()
        outcomes.append(reg.transition("d1", "indexing"))

    threads = [threading.Thread(target=write) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(outcomes) == [200, 409]
    assert reg.transition("d1", "ready", file_path="/new") == 200 and reg.transition("d1", "failed") == 409 and reg.transition("none", "indexing") == 404
    assert {r.doc_id: (r.status, r.file_path) for r in reg.table.read().collect()} == {"d0": ("uploaded", "/f0"), "d1": ("ready", "/new"), "d2": ("uploaded", "/f2"), "d3": ("uploaded", "/f3")}


def test_a_decision_on_an_old_state_is_taken_again(spark, tmp_path, monkeypatch):
    """The second writer reads before the first one writes; what it decided on is gone."""
    reg, late = registry(spark, tmp_path), registry(spark, tmp_path)
    real, calls = late._state, []

    def state(doc_id):
        found = real(doc_id)
        if not calls:
            assert reg.transition("d2", "indexing") == 200
        calls.append(doc_id)
        return found

    monkeypatch.setattr(late, "_state", state)
    assert late.transition("d2", "indexing") == 409 and len(calls) == 2


def test_delete_in_order(spark, tmp_path):
    reg = registry(spark, tmp_path)
    index = VersionedTable(spark, f"{tmp_path}/index", buckets=2)
    index.write(spark.createDataFrame([("d0", "c0"), ("d1", "c1")], "doc_id string, chunk_id string"))
    gone = []
    assert reg.delete("none", index, gone.append) == 404
    reg.transition("d1", "indexing")
    assert reg.delete("d1", index, gone.append) == 409 and index.read().count() == 2

    def fails(row):
        raise OSError("no disk")

    with pytest.raises(OSError):
        reg.delete("d0", index, fails)
    assert reg.table.read().filter("doc_id = 'd0'").count() == 1
    broken = VersionedTable(spark, f"{tmp_path}/index", buckets=5)
    with pytest.raises(ValueError):
        reg.delete("d0", broken, gone.append)
    assert not gone and reg.delete("d0", index, gone.append) == 200 and [r.file_path for r in gone] == ["/f0"]
    assert [r.doc_id for r in index.read().collect()] == ["d1"] and reg.table.read().filter("doc_id = 'd0'").isEmpty()


def plain_path(path):
    stack = []
    for part in path.split("/"):
        if part == "..":
            if not stack:
                return None
            stack.pop()
        elif part not in ("", "."):
            stack.append(part)
    return "/".join(stack)


def test_resolved_paths(spark):
    rng = random.Random(6)
    paths = ["a/../../b", "a/../b", "", ".", "..", "a//b/./c", *("/".join(rng.choices(["..", ".", "a", "b.png", ""], k=rng.randint(1, 7))) for _ in range(300))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(paths)], "i int, p string").select("i", p.resolved_path(F.col("p")).alias("r")).collect()
    assert {r.i: r.r for r in rows} == {i: plain_path(x) for i, x in enumerate(paths)}


def test_images_found_by_one_join(spark):
    refs = spark.createDataFrame([("/r", "a/../x.png"), ("/r/", "sub/y.JPG"), ("/r", "a/../../x.png"), ("/r", "gone.png"), ("/r", "x.txt"), ("/r", "https://h/x.png"), ("/r", None)], "root string, path string")
    files = spark.createDataFrame([("/r/x.png", 5), ("/r/sub/y.JPG", 7), ("/x.png", 9), ("/r/x.txt", 1)], "path string, length long")
    got = {r.path: (r.file, r.size_bytes if r.file else None, r.skip_reason) for r in p.resolve_images(refs, files).collect()}
    assert got == {"a/../x.png": ("/r/x.png", 5, None), "sub/y.JPG": ("/r/sub/y.JPG", 7, None), "a/../../x.png": (None, None, "path_traversal"), "gone.png": (None, None, "file_not_found"), "x.txt": (None, None, "unsupported_type"), "https://h/x.png": (None, None, "external_url"), None: (None, None, "empty_path")}


def grid_by_cell(rows):
    """Every cell marked in a set of taken places, one place after the other."""
    taken, out = set(), []
    for r, row in enumerate(rows):
        c = 0
        for height, width, text in row:
            while (r, c) in taken:
                c += 1
            height = len(rows) - r if height == 0 else min(height, len(rows) - r)
            w = 1
            while w < width and (r, c + w) not in taken:
                w += 1
            taken |= {(r + i, c + j) for i in range(height) for j in range(w)}
            out.append((r, c, height, w, text))
            c += w
    return out


def test_tables_with_spans_against_a_plain_grid(spark):
    rng = random.Random(3)
    for n in range(120):
        rows = [[(rng.choice([1, 1, 1, 2, 3, 0]), rng.choice([1, 1, 2, 3]), f"t{r}.{c}") for c in range(rng.randint(0, 5))] for r in range(rng.randint(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f'<td rowspan="{h}" colspan={w} class=x>{t}</td>' for h, w, t in row) + rng.choice(["</tr>", ""]) for row in rows) + "</table>"
        block = p.parse_html(f"<p>before</p>{html}<p>after</p>")
        table = next((b["text"] for b in block if b["block_type"] == "table"), "")
        cells = p.table_cells(table)
        assert [(c["row"], c["column"], c["rows"], c["columns"], c["text"]) for c in cells] == grid_by_cell(rows), (n, html)
        places = [(c["row"] + i, c["column"] + j) for c in cells for i in range(c["rows"]) for j in range(c["columns"])]
        assert len(places) == len(set(places))
    nested = "<table><tr><th>a &amp; b<td>out <table><tr><td>in</table> er</table>"
    assert [(c["header"], c["text"]) for c in p.table_cells(nested)] == [(True, "a & b"), (False, "out in er")] and p.table_cells(None) == []
    df = spark.createDataFrame([(nested,), (None,)], "t string").select(F.size(p.table_cells_column(F.col("t"))).alias("n"))
    assert [r.n for r in df.collect()] == [2, 0]
