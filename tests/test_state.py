"""Tables, registries, sessions, datasets, metrics and streams."""

import pytest
from pyspark.sql import functions as F

from quillgrain.operators import conversation as v, datasets as d, metrics as m
from quillgrain.sources import readers, store
from quillgrain.streaming import ingest


def test_versioned_table(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"))
    row = lambda *x: spark.createDataFrame(list(x), "doc_id string, chunk_id string, n int")
    t.replace_documents(row(("a", "a1", 1), ("a", "a2", 1), ("b", "b1", 1)))
    old = t.read()
    t.replace_documents(row(("a", "a3", 2)))
    assert sorted(r.chunk_id for r in t.read().collect()) == ["a3", "b1"] and old.count() == 3
    t.upsert(row(("b", "b1", 5)), "chunk_id")
    t.delete(row(("a", "", 0)), "doc_id")
    assert [(r.chunk_id, r.n) for r in t.read().collect()] == [("b1", 5)] and t.version() == 4
    with pytest.raises(ValueError):
        t.upsert(row(("b", "b1", 5), ("b", "b1", 6)), "chunk_id")


def test_an_upsert_rewrites_one_bucket(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"), buckets=16)
    t.write(spark.range(400).selectExpr("concat('d', id) AS doc_id", "concat('c', id) AS chunk_id", "cast(id AS int) AS n"))
    files = lambda: {str(f) for f in (tmp_path / "t" / "data").rglob("part-*.parquet")}
    before, row = files(), spark.createDataFrame([("d7", "c7", -1)], "doc_id string, chunk_id string, n int")
    t.upsert(row, "chunk_id")
    assert len(before) == 16 and len(files() - before) == 1
    assert t.read().count() == 400 and t.read().filter("n = -1").count() == 1 and t.read(1).filter("n = -1").count() == 0
    t.delete(row.select("doc_id"), "doc_id")
    t.delete(spark.createDataFrame([("c9",)], "chunk_id string"), "chunk_id")
    assert t.read().count() == 398
    t.replace_documents(row.withColumn("more", F.lit("x")))
    assert t.read().filter("more = 'x'").count() == 1 and t.read().filter("more IS NULL").count() == 398
    assert t.vacuum(1) > 0 and t.read().count() == 399


def test_two_writers(spark, tmp_path):
    """Writers of unlike documents both count; of one document the second is refused, and no version is written over."""
    t = store.VersionedTable(spark, str(tmp_path / "t"), buckets=64)
    rows = lambda n, *docs: spark.createDataFrame([(d, n) for d in docs], "doc_id string, n int")
    t.write(rows(0, "a", "b", "c"))
    place = {d: spark.createDataFrame([(d,)], "doc_id string").select(t._bucket()).first()[0] for d in "ab"}
    one, two, three = t.stage(rows(1, "a"), [place["a"]]), t.stage(rows(2, "b"), [place["b"]]), t.stage(rows(3, "a"), [place["a"]])
    assert t.commit(one) == 2 and t.commit(two) == 3
    with pytest.raises(store.Conflict):
        t.commit(three)
    assert sorted((r.doc_id, r.n) for r in t.read().collect()) == [("a", 1), ("b", 2), ("c", 0)]
    # A writer that died after its claim leaves a number, not a version.
    (tmp_path / "t" / "_versions" / "4").write_text("")
    assert t.version() == 3 and t.write(rows(9, "z")) == 5 and t.read().count() == 1


def test_a_bad_rebuild_never_becomes_a_version(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "r"))
    docs = spark.createDataFrame([("a", "ready", "x"), ("b", "ready", "y")], "doc_id string, status string, content string")
    with pytest.raises(ValueError, match="missing"):
        store.rebuild(t, docs, lambda d: d.filter("doc_id = 'a'").select("doc_id"))
    assert t.version() == 0


def test_asset_bytes_and_vector_artifacts(spark, tmp_path):
    path = str(tmp_path / "assets")
    images = spark.createDataFrame([("d", bytearray(b"x"), ".png", 1), ("e", bytearray(b"x"), ".png", 1), ("e", bytearray(b"y"), ".jpg", 2)], "document_id string, content binary, extension string, created_at int")
    rows = store.save_assets(images, path).collect()
    store.save_assets(images, path)
    assert len(rows) == 3 and spark.read.parquet(path).count() == 2
    assert sorted(store.load_asset(spark, path, r.asset_id) for r in rows) == [b"x", b"x", b"y"] and store.load_asset(spark, path, "sha256:00") is None
    vectors, config = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 1.0])], "chunk_id string, embedding array<float>"), {"model": "m"}
    said = store.write_vectors(vectors, str(tmp_path / "v"), 2, config)
    assert said["rows"] == 2 and store.read_vectors(spark, str(tmp_path / "v"), 2, config).count() == 2
    for dim, other in ((3, config), (2, {"model": "n"})):
        with pytest.raises(ValueError, match="another configuration"):
            store.read_vectors(spark, str(tmp_path / "v"), dim, other)
    vectors.limit(1).write.mode("overwrite").parquet(str(tmp_path / "v" / "rows"))
    with pytest.raises(ValueError, match="manifest"):
        store.read_vectors(spark, str(tmp_path / "v"), 2, config)


def test_rebuild_and_cache(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "r"))
    docs = spark.createDataFrame([("a", "ready", "x y"), ("b", "ready", "z")], "doc_id string, status string, content string")
    chunk = lambda d: d.select("doc_id", F.explode(F.split("content", " ")).alias("chunk_id"), F.lit("child").alias("chunk_role"))
    with pytest.raises(ValueError):
        store.rebuild(t, docs.withColumn("content", F.lit(None).cast("string")), chunk)
    with pytest.raises(ValueError):
        store.rebuild(t, docs.withColumn("status", F.lit("indexing")), chunk)
    assert store.rebuild(t, docs, chunk, dry_run=True)["rows"] == 0 and t.version() == 0
    assert store.rebuild(t, docs, chunk) == {"documents": 2, "rows": 3}
    with pytest.raises(ValueError):
        store.rebuild(t, docs, chunk)
    cache = store.CachedChunks(t)
    assert cache.read() is cache.read() and cache.read().count() == 3
    t.delete(docs.filter("doc_id = 'b'"), "doc_id")
    assert cache.read().count() == 2
    expected = spark.createDataFrame([("a", 2), ("c", 1)], "doc_id string, indexed long")
    assert [r.doc_id for r in store.validate_index(t.read(), expected).collect()] == ["c"]


def test_bad_vectors_fail(spark):
    rows = spark.createDataFrame([("x", True, [1.0, 0.0]), ("y", False, None)], "chunk_id string, retrieval_eligible boolean, embedding array<float>")
    assert store.check_index_rows(rows, 2).count() == 2
    with pytest.raises(Exception, match="bad vector"):
        store.check_index_rows(rows, 3).collect()


def test_assets(spark):
    images = spark.createDataFrame([("d", b"x", ".png", 2), ("d", b"x", ".png", 1), ("e", b"x", ".png", 1)], "document_id string, content binary, extension string, created_at int")
    rows = store.asset_rows(images)
    assert sorted((r.document_id, r.created_at) for r in rows.collect()) == [("d", 1), ("e", 1)]
    assert store.register_assets(rows, rows).count() == 2
    keys = spark.createDataFrame([(k,) for k in ("ab/x.png", "", "/a", "a/../b", "a\\b", None)], "k string")
    assert [r[0] for r in keys.select(readers.asset_key_ok(F.col("k"))).collect()] == [True] + [False] * 5


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("# é")
    (tmp_path / "t" / "b.TXT").write_text("ignored by the filter")
    assert [(r.file_type, r.content) for r in readers.read_texts(spark, str(tmp_path / "t")).collect()] == [("md", "# é")]
    (tmp_path / "t" / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF"):
        readers.read_texts(spark, str(tmp_path / "t")).collect()
    assert readers.read_texts(spark, str(tmp_path / "t"), strict=False).count() == 1
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": null}\n')
    lines = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert lines.count() == 2
    with pytest.raises(Exception, match="missing fields: a"):
        readers.require(lines, "a").collect()
    (tmp_path / "tasks.json").write_text('{"t1": [{"ID": 1}, {"ID": 2}], "t2": []}')
    assert [(r.task, r.position, r.ID) for r in readers.read_tasks(spark, str(tmp_path / "tasks.json"), "ID:int").collect()] == [("t1", 0, 1), ("t1", 1, 2)]
    assert store.manifest(spark, str(tmp_path / "x.jsonl"))[0]["lines"] == 3


def test_turns_and_budget(spark):
    rows = [(1, 0, "assistant", "orphan"), (1, 1, "user", "aa"), (1, 2, "assistant", "bb"), (1, 3, "system", "s"), (1, 4, "user", "cccc"), (1, 5, "user", " ")]
    chats = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    turns = v.turn_sizes(chats, F.length("text"))
    assert sorted((r.turn_no, r["size"]) for r in turns.collect()) == [(1, 4), (2, 4)]
    assert [r.turn_no for r in v.recent_turns(turns, 1).collect()] == [2] and v.recent_turns(turns, 1, at_least_one=False).count() == 0
    assert v.recent_turns(turns, 100, max_turns=1).count() == 1


def test_requests(spark):
    rows = [("o", "r", "f", 1), ("o", "r", "f", 2), ("o", "r", "g", 3), ("p", "r", "g", 4)]
    got = v.begin_requests(spark.createDataFrame(rows, "owner string, request_id string, fingerprint string, seq int")).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["started", "replayed", "conflict", "started"]
    states = spark.createDataFrame([(True, "done", 0), (True, "pending", 950), (True, "pending", 0), (False, "done", 0)], "same boolean, status string, updated long")
    assert [r[0] for r in states.select(v.lease_outcome(F.col("same"), F.col("status"), F.col("updated"), F.lit(1000))).collect()] == ["replayed", "busy", "taken_over", "conflict"]


def test_sessions_are_made_within_capacity(spark):
    from quillgrain.operators import sessions as se

    old = spark.createDataFrame([("a", "o", 3, 50.0), ("b", "o", 1, 200.0)], "session_id string, owner string, version long, expires double")
    wanted = spark.createDataFrame([("b", "o"), ("c", "o"), ("d", "o")], "session_id string, owner string")
    after, outcome = se.create(old, wanted, F.lit(100), 2, 10)
    assert sorted((r.session_id, r.version, r.expires) for r in after.collect()) == [("b", 1, 200.0), ("c", 0, 110.0)]
    assert {r.session_id: r.outcome for r in outcome.collect()} == {"b": "conflict", "c": "created", "d": "capacity_reached"}
    rows = [(5.0, 1, 1, "pending", "t", "expired"), (50.0, 1, 2, "pending", "t", "version_conflict"), (50.0, 1, 1, "failed", "t", "request_not_pending"), (50.0, 1, 1, "pending", "u", "token_lost"), (50.0, 1, 1, "pending", "t", "committed")]
    df = spark.createDataFrame(rows, "expires double, version int, expected int, status string, held string, want string")
    got = df.select("want", se.commit_outcome(F.col("expires"), F.lit(10.0), F.col("version"), F.col("expected"), F.col("status"), F.col("held"), F.lit("t")).alias("o"))
    assert all(r.want == r.o for r in got.collect())


def test_requests_are_leased(spark):
    from quillgrain.operators import sessions as se

    table = spark.createDataFrame([("o", "done", "f", "done", 0, "x", "answer"), ("o", "held", "f", "pending", 950, "x", None), ("o", "stale", "f", "pending", 0, "x", None)], "owner string, request_id string, fingerprint string, status string, updated long, token string, result string")
    came = spark.createDataFrame([("o", "done", "f", "y"), ("o", "held", "f", "y"), ("o", "stale", "f", "y"), ("o", "new", "f", "y")], "owner string, request_id string, fingerprint string, token string")
    after, outcome = se.begin(table, came, F.lit(1000))
    assert {r.request_id: (r.outcome, r.result) for r in outcome.collect()} == {"done": ("replayed", "answer"), "held": ("busy", None), "stale": ("taken_over", None), "new": ("started", None)}
    assert {r.request_id: (r.status, r.token) for r in after.collect()} == {"done": ("done", "x"), "held": ("pending", "x"), "stale": ("pending", "y"), "new": ("pending", "y")}
    assert [r.outcome for r in se.begin(table, came.limit(1).withColumn("fingerprint", F.lit("g")), F.lit(1000))[1].collect()] == ["conflict"]


def test_history_under_two_budgets(spark):
    turns = spark.createDataFrame([(1, n, t, b) for n, t, b in ((1, 5, 10), (2, 5, 90), (3, 5, 10))], "conv_id int, turn_no int, tokens int, bytes int")
    pick = lambda *a: sorted(r.turn_no for r in v.history_within(turns, *a).collect())
    assert pick(9, 99, 999) == [1, 2, 3] and pick(9, 10, 999) == [2, 3] and pick(9, 99, 50) == [3] and pick(1, 99, 999) == [3] and pick(9, 4, 999) == []
    rows = spark.createDataFrame([("s", 1, "answered"), ("s", 2, "failed"), ("s", 3, "answered")], "session_id string, seq int, status string")
    assert [r.seq for r in v.working_turns(rows, spark.createDataFrame([("s", 1)], "session_id string, summarized_through int")).collect()] == [3]


def test_metrics(spark):
    queries = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u")], "qid int, task string")
    qrels = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "qid int, doc_id string")
    run = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3), (2, "c", 1)], "qid int, doc_id string, rank int")
    got = {r.qid: r for r in m.score_queries(queries, qrels, run).collect()}
    assert got[1].mrr_10 == 0.5 and got[1].recall_3 == 1.0 and got[1].hit_1 == 0.0 and got[2].ndcg_10 == 1.0
    assert got[3].ndcg_10 == got[3].recall_10 == got[3].mrr_10 == 0.0
    table = {r.task_group: r for r in m.macro_average(m.score_queries(queries, qrels, run), "task", ["mrr_10"]).collect()}
    assert table["overall"].queries == 3 and table["t"].mrr_10 == 0.75
    assert "unavailable" in m.render_report({"overall": {"a": 0.5}}, ["a", "b"]) and "0.5000" in m.render_report({"overall": {"a": 0.5}}, ["a"])


def test_datasets(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("b", 2, 2), ("a", 3, 3)], "task string, event_id int, position int")
    assert sorted((r.task, r.event_id) for r in d.quota(rows, 1, ["a", "b"], 42).collect())[1] == ("b", 2)
    corpus = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id int, text string")
    queries = spark.createDataFrame([(i, "text") for i in range(5)], "qid int, text string")
    qrels = spark.createDataFrame([(0, 3, 1), (1, 4, 1), (2, 5, 0)], "qid int, doc_id int, rel int")
    with pytest.raises(ValueError, match="only 2 of 5"):
        d.subsample(corpus, queries, qrels, 5, 6, 1)
    pool, chosen, own = d.subsample(corpus, queries, qrels, 2, 6, 1)
    assert sorted(r.qid for r in chosen.collect()) == [0, 1] and {3, 4} <= {r.doc_id for r in pool.collect()} and pool.count() == 6 and own.count() == 2
    bad = {r.rule: r.violations for r in d.violations(corpus.unionByName(corpus.limit(1)), queries, qrels).collect()}
    assert bad["corpus_id_unique"] == 1 and bad["query_has_positive"] == 3
    assert d.clamp_pool(3, 5, 30) == 5 and d.choose([{"r": 1}, {"r": 2, "x": 1}, {"r": 2}], ["r"]) == {"r": 2, "x": 1}
    assert not d.keep_rerank({"recall_10": 0.9, "mrr_10": 0.9}, {"recall_10": 0.95, "mrr_10": 0.8})


def test_run_rows(spark):
    schema = "query_id string, retrieved array<struct<doc_id:string,rank:int,score:double>>, latency_ms map<string,double>, status string, citations array<struct<doc_id:string>>"
    rows = [
        ("ok", [("a", 1, 0.5), ("b", 2, 0.4)], {"t": 1.0}, "ok", [("a",)]),
        ("gap", [("a", 2, 0.5)], {}, "ok", []),
        ("twice", [("a", 1, 0.5), ("a", 2, 0.4)], {}, "odd", []),
        ("late", [], {"t": -1.0}, "no_evidence", []),
        ("cites", [("a", 1, None)], {}, "ok", [("zz",)]),
        ("ok", [], {}, "ok", []),
    ]
    runs = spark.createDataFrame(rows, schema)
    assert {r.query_id for r in d.run_errors(runs).collect()} == {"gap", "twice", "late"}
    queries, corpus = spark.createDataFrame([(q,) for q in ("ok", "gap", "twice", "late", "never")], "query_id string"), spark.createDataFrame([("a",), ("b",)], "doc_id string")
    got = sorted((r.query_id, r.error) for r in d.run_errors(runs, queries, corpus).collect())
    assert got == [("cites", "unknown document"), ("cites", "unknown query"), ("gap", "ranks are not contiguous"), ("late", "latency_ms has no number of at least 0"), ("never", "the run lacks the query"), ("ok", "a query is there twice"), ("twice", "a document is there twice"), ("twice", "unknown status")]


def test_every_rule_of_a_dataset(spark):
    """A sound dataset breaks no rule; each single damage breaks its own."""
    from quillgrain.operators import runs

    rows = spark.createDataFrame([("t1", i, f"e{i}", "event", f"question {i}", f"answer {i}", f"news text {i}") for i in range(6)], "task string, position int, ID string, event string, questions string, answers string, news1 string")
    built = runs.build_dataset(rows, spark.createDataFrame([(f"other text {i}",) for i in range(20)], "text string"), {"t1": 1}, 4, 2, 10, 3)
    parts = {n: df.cache() for n, df in built.items()}
    counts = [("corpus", 10), ("queries", 4), ("qrels", 4), ("dev", 2), ("test", 2), ("t1", 4), ("t1/dev", 2), ("t1/test", 2), ("positive", 4), ("hard_negative", 3), ("random_negative", 3)]
    expected = spark.createDataFrame(counts, "name string, n long")
    broken = lambda e=expected, **more: {r.rule for r in d.dataset_violations(*((parts | more)[n] for n in ("corpus", "queries", "qrels", "references")), {"t1": 1}, e).collect() if r.violations}
    assert broken() == set()
    c, q, r, f = (parts[n] for n in ("corpus", "queries", "qrels", "references"))
    put = lambda df, name, value: df.withColumn(name, F.lit(value))
    worn = put(c.withColumn("text", F.concat("text", F.lit("!"))), "source", "odd")
    assert broken(corpus=worn.unionByName(worn.limit(1))) == {"corpus_id_stable", "corpus_id_unique", "corpus_text_unique", "corpus_source_known", "qrel_document_positive", "manifest_counts"}
    worn = put(put(put(put(q, "task", "t9"), "split", "x"), "event_id", "e"), "answer", " ")
    assert {"query_task_known", "query_split_known", "query_id_stable", "query_event_unique", "query_fields", "reference_answer", "manifest_counts"} == broken(queries=worn)
    assert {"qrel_query_known", "qrel_document_known", "qrel_relevance", "qrel_unique"} <= broken(qrels=r.unionByName(put(r, "relevance", 2)).unionByName(put(put(r, "query_id", "x"), "doc_id", "x")))
    assert {"query_has_qrels", "reference_documents"} <= broken(qrels=r.limit(1), references=f.unionByName(f))
    many = r.crossJoin(c.limit(3).select(F.col("doc_id").alias("other"))).select("query_id", F.col("other").alias("doc_id"), "relevance")
    assert {"query_qrels_of_task", "reference_of_each_query", "reference_unique", "reference_query_known"} <= broken(qrels=many, references=f.limit(1).unionByName(put(f, "query_id", "x")))
    assert broken(spark.createDataFrame([("corpus", 11)], "name string, n long")) == {"manifest_counts"}


def test_one_factor_sweep():
    axes = {"k": [{"candidate_top_k": 10}, {"candidate_top_k": 20}], "pool": [{"rerank_top_n": 50, "rerank": True}, {"rerank_top_n": 2, "rerank": True}]}
    seen = []
    out = d.sweep_axes(axes, lambda o: seen.append(o) or {"recall_10": o.get("candidate_top_k", 0), "mrr_10": -o.get("rerank_top_n", 0)}, ["recall_10", "mrr_10"])
    assert len(seen) == 4 and out["picks"] == {"k": {"candidate_top_k": 20}, "pool": {"rerank_top_n": 2, "rerank": True}}
    assert d.compose({"top_k": 5}, out["picks"], True) == {"top_k": 5, "candidate_top_k": 20, "rerank_top_n": 5, "rerank": True}
    assert d.compose({"top_k": 5}, out["picks"], False) == {"top_k": 5, "candidate_top_k": 20}


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    t = store.VersionedTable(spark, str(tmp_path / "out"))
    chunk = lambda docs: docs.select("doc_id", F.explode(F.split("content", " ")).alias("word"))

    def step(name, *lines):
        (source / name).write_text("\n".join(lines))
        ingest.ingest_stream(spark, str(source), t, str(tmp_path / "cp"), chunk).awaitTermination()
        return sorted((r.doc_id, r.word) for r in t.read().collect())

    assert step("1.json", '{"doc_id":"a","file_type":"txt","content":"x y"}', '{"doc_id":"b","file_type":"txt","content":"z"}') == [("a", "x"), ("a", "y"), ("b", "z")]
    assert step("2.json", '{"doc_id":"a","file_type":"txt","content":"q"}') == [("a", "q"), ("b", "z")]
    # Of several arrivals the last line counts, though it sorts first.
    assert step("3.json", '{"doc_id":"a","file_type":"txt","content":"zz"}', '{"doc_id":"a","file_type":"txt","content":"aa"}') == [("a", "aa"), ("b", "z")]


def test_stream_requests(spark, tmp_path):
    spark.createDataFrame([("o", "r", 1), ("o", "r", 2), ("o", "s", 3)], "owner string, request_id string, sec int").withColumn("ts", F.timestamp_seconds("sec")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("owner string, request_id string, sec int, ts timestamp").parquet(str(tmp_path / "in"))
    ingest.first_requests(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("firsts").count() == 2
