"""Every command on a small corpus, from raw rows to a report."""

import json

import pytest

from quillgrain.__main__ import main
from quillgrain.sources import store


def test_from_rows_to_report(spark, tmp_path, capsys):
    p = lambda name: str(tmp_path / name)
    rows = [("t1", i, f"e{i}", "event", f"what about topic{i} and thing{i}?", f"answer {i}", f"A text on topic{i}.\nIt tells of thing{i} at length.") for i in range(6)]
    spark.createDataFrame(rows, "task string, position int, ID string, event string, questions string, answers string, news1 string").write.parquet(p("rows"))
    spark.createDataFrame([(f"Another text about something else, number {i}.",) for i in range(20)], "text string").write.parquet(p("other"))
    run = lambda *argv: main(argv, spark)
    run("build", "--input", p("rows"), "--distractors", p("other"), "--output", p("set"), "--tasks", '{"t1": 1}', "--per-task", "4", "--dev-per-task", "2", "--corpus-size", "10", "--hard", "3")
    capsys.readouterr()
    run("validate", "--input", p("set"), "--tasks", '{"t1": 1}', "--counts", '{"corpus": 10, "queries": 4, "dev": 2, "t1/test": 2}')
    assert json.loads(capsys.readouterr().out) == {}
    with pytest.raises(SystemExit):
        run("validate", "--input", p("set"), "--tasks", '{"t1": 1}', "--counts", '{"corpus": 11}')

    spark.read.parquet(p("set/corpus")).selectExpr("doc_id", "'txt' AS file_type", "text AS content", "'ready' AS status").write.parquet(p("docs"))
    run("rebuild", "--input", p("docs"), "--output", p("index"), "--dry-run")
    run("rebuild", "--input", p("docs"), "--output", p("index"))
    capsys.readouterr()
    run("index", "--input", p("docs"), "--output", p("index"))
    assert json.loads(capsys.readouterr().out) == {"version": 2}
    spark.read.parquet(p("set/queries")).selectExpr("query_id AS qid", "question AS text").write.parquet(p("asked"))
    run("run-retrieval", "--input", p("asked"), "--index", p("index"), "--output", p("run"), "--config", '{"top_k": 5}')
    run("score", "--input", p("run"), "--dataset", p("set"), "--output", p("metrics"))
    capsys.readouterr()
    run("report", "--input", p("metrics"))
    said = capsys.readouterr().out
    assert said.startswith("| group | hit_1") and said.splitlines()[2].split(" | ")[8] == "1.0000"  # recall_10
    run("run-qa", "--input", p("asked"), "--index", p("index"), "--output", p("answers"))
    assert {r.status for r in spark.read.parquet(p("answers")).collect()} == {"ok"}
    run("sweep", "--dataset", p("set"), "--index", p("index"), "--config", '{"top_k": 5}', "--axes", '{"mode": [{"mode": "keyword"}, {"mode": "vector"}]}')
    assert json.loads(capsys.readouterr().out)["locked"]["mode"] == "keyword"
    with pytest.raises(SystemExit, match="isn't sound"):
        run("score", "--input", p("run"), "--dataset", p("set"), "--output", p("metrics"), "--split", "dev")

    run("embed", "--index", p("index"), "--output", p("vectors"))
    first = json.loads(capsys.readouterr().out)
    run("embed", "--index", p("index"), "--output", p("vectors"))
    again = json.loads(capsys.readouterr().out)
    assert first["made"] == first["rows"] > 0 and again == first | {"made": 0, "ranges": 0}
    run("evaluate", "--input", p("vectors"), "--index", p("index"), "--dataset", p("set"))
    figures = json.loads(capsys.readouterr().out)
    assert figures["queries"] == 4 and figures["coverage"] == 1.0 and figures["recall_10"] == 1.0 and 0 < figures["ndcg_10"] <= 1
    assert store.dataset_changes(spark, p("set/lines")) == {}
    changed = next((tmp_path / "set" / "lines" / "queries.jsonl").glob("part-*"))
    changed.with_name(f".{changed.name}.crc").unlink()
    changed.write_text("{}\n")
    assert list(store.dataset_changes(spark, p("set/lines"))) == ["queries"]
