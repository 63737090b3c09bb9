"""Orchestration, providers, sessions, registry, images, datasets."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillgrain.config import RetrievalConfig
from quillgrain.functions.providers import isolated
from quillgrain.operators import images, retrieval, retrieve as rt, rewriting as rw, runs, sessions as ss
from quillgrain.sources import registry


def chunk_table(spark):
    kids = [("c1", "d1", "p1", "apple tree", [1.0, 0.0]), ("c2", "d1", "p1", "apple pie", [0.9, 0.1]), ("c3", "d2", "p2", "stone wall", [0.0, 1.0]), ("c4", "d3", None, "apple", [0.7, 0.7])]
    rows = [(c, d, p, "child", True, i, "doc", ["s"], t, v) for i, (c, d, p, t, v) in enumerate(kids)]
    rows += [("p1", "d1", None, "parent", False, 0, "doc", [], "apple parent text", None), ("x", "d1", "p1", "child", False, 9, "doc", [], "apple hidden", None)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, parent_id string, chunk_role string, retrieval_eligible boolean, chunk_order int, doc_name string, section_path array<string>, content string, embedding array<double>")


def questions(spark):
    return spark.createDataFrame([(1, "apple", [1.0, 0.0]), (2, " ", [0.0, 1.0])], "qid int, text string, qvec array<double>")


def test_channels_are_planned_only_if_asked(spark):
    for mode, kind in (("vector", {"vector"}), ("keyword", {"keyword"}), ("hybrid", {"vector", "keyword"})):
        assert set(rt.channels(questions(spark), chunk_table(spark).filter("chunk_role = 'child'"), RetrievalConfig(mode=mode))) == kind


def test_retrieve_end_to_end(spark):
    results, trace = rt.retrieve(questions(spark), chunk_table(spark), RetrievalConfig(top_k=2))
    rows = results.orderBy("rank").collect()
    assert [r.family for r in rows][0] == "p1" and rows[0].parent_found and {r.qid for r in rows} == {1}
    traced = {r.qid: r for r in trace.collect()}
    assert traced[2].status == "no_evidence" and traced[1].status == "ok" and traced[1].n_returned == 2
    filtered, _ = rt.retrieve(questions(spark), chunk_table(spark), RetrievalConfig(filters={"doc_id": ["d3"]}))
    assert {r.family for r in filtered.collect()} == {"c4"}


def test_cross_encoder_levels(spark):
    by_length = lambda: lambda pairs: [len(passage) / 10 - 2 for _, passage in pairs]
    child = RetrievalConfig(rerank=True, reranker="cross_encoder", top_k=2, threshold=0.0)
    best = rt.retrieve(questions(spark), chunk_table(spark), child, by_length)[0].orderBy("rank").collect()
    assert best[0].family in ("p1", "p2") and len(best) == 2
    parent = RetrievalConfig(rerank=True, reranker="cross_encoder", rerank_level="parent", top_k=3, threshold=0.0)
    rows = rt.retrieve(questions(spark), chunk_table(spark), parent, by_length)[0].collect()
    assert {r.family for r in rows} == {"p1"}


def test_failures_stand_alone():
    """A poisoned batch is halved; the calls follow its bad items, not its length."""
    calls = []

    def call(items):
        calls.append(len(items))
        if {13, 64} & set(items):
            raise RuntimeError("bad item")
        return [2 * i for i in items]

    got = isolated(call, list(range(100)))
    assert [(i, g) for i, g in enumerate(got) if g[1]] == [(13, (None, "RuntimeError: bad item")), (64, (None, "RuntimeError: bad item"))]
    assert all(g == (2 * i, None) for i, g in enumerate(got) if i not in (13, 64)) and len(calls) < 32
    assert [e for _, e in isolated(lambda items: [1], [1, 2, 3])] == [None] * 3
    assert all("another number" in e for _, e in isolated(lambda items: [], [1, 2, 3]))


def test_one_poisoned_pair_leaves_the_other_questions_reranked(spark):
    asked = questions(spark).filter("qid = 1")
    asked = asked.unionByName(asked.withColumn("qid", F.lit(5))).unionByName(asked.withColumn("qid", F.lit(6)).withColumn("text", F.concat("text", F.lit(" poison"))))

    def model():
        def scores(pairs):
            if any("poison" in q for q, _ in pairs):
                raise RuntimeError("poisoned")
            return [len(passage) / 10 - 2 for _, passage in pairs]

        return scores

    for level in ("child", "parent"):
        config = RetrievalConfig(rerank=True, reranker="cross_encoder", rerank_level=level, top_k=2, threshold=0.0)
        pick = lambda df: sorted((r.qid, r["rank"], r.family, r.score) for r in df.collect())
        results, trace = rt.retrieve(asked, chunk_table(spark), config, model)
        good = rt.retrieve(asked.filter("qid < 6"), chunk_table(spark), config, model)[0]
        plain = rt.retrieve(asked.filter("qid = 6"), chunk_table(spark), RetrievalConfig(top_k=2, threshold=0.0))[0]
        assert pick(results) == sorted(pick(good) + pick(plain)) and pick(good) != []
        assert {r.qid: r.fallback_reason for r in trace.collect()} == {1: None, 5: None, 6: "RuntimeError: poisoned"}


def test_described_images(spark):
    rows = [("a", b"good", None, "alt", "cap"), ("b", b"bad", None, "", None), ("c", b"x" * 50, None, "big", None), ("d", None, "remote", "far", None), ("e", b"prose", None, None, None), ("f", None, None, None, None)]
    images_ = spark.createDataFrame(rows, "asset_id string, content binary, skip_reason string, alt string, caption string").coalesce(1)

    def vision():
        def say(contents):
            if any(bytes(c) == b"bad" for c in contents):
                raise OSError("unreadable")
            return ["no json here" if bytes(c) == b"prose" else '{"ocr_text": "words"}' for c in contents]

        return say

    got = {r.asset_id: (r.status, r.reason) for r in images.describe(images_, vision, 20).collect()}
    assert got == {"a": ("success", None), "b": ("failed", "OSError: unreadable"), "c": ("failed", "too_large"), "d": ("skipped", "remote"), "e": ("failed", "no_description"), "f": ("failed", "no_content")}
    said = {r.asset_id: r.said for r in images.describe(images_, vision, 20).collect()}
    assert "words" in said["a"] and "cap" in said["a"] and said["d"].endswith("far（未索引：remote）")


def test_retrieve_survives_its_reranker(spark):
    """A provider that fails costs the reranking, not the answer; the trace says why."""

    def down():
        raise RuntimeError("no model")

    for level in ("child", "parent"):
        config = RetrievalConfig(rerank=True, reranker="cross_encoder", rerank_level=level, top_k=2)
        results, trace = rt.retrieve(questions(spark), chunk_table(spark), config, down)
        plain = rt.retrieve(questions(spark), chunk_table(spark), RetrievalConfig(top_k=2))[0]
        pick = lambda df: sorted((r.qid, r["rank"], r.family, r.score) for r in df.collect())
        assert pick(results) == pick(plain)
        row = trace.filter("qid = 1").first()
        assert "no model" in row.fallback_reason and row.rerank_level == level and row.aggregation == "max" and row.status == "ok"


def test_questions_to_cited_answers(spark):
    chunks = chunk_table(spark).withColumn("parent_char_start", F.when(F.col("parent_id").isNotNull(), 0)).withColumn("parent_char_end", F.when(F.col("parent_id").isNotNull(), 5))
    seen = []

    def answerer():
        return lambda prompts: [f"All said [1]. {p.count('[2]')}" for p in prompts]

    asked = questions(spark).drop("qvec")
    embedder = lambda: lambda texts: [[1.0, 0.0] for _ in texts]
    got = {r.qid: r for r in rt.ask(asked, chunks, answerer, RetrievalConfig(top_k=2), embedder=embedder, dim=2).collect()}
    assert got["1"].status == "ok" and got["1"].answer.startswith("All said [1]. 1") and [(c.citation_index, c.name) for c in got["1"].citations] == [(1, "doc")]
    assert got["2"].status == "no_evidence" and got["2"].citations == [] and not seen
    none = rt.ask(asked, chunks.limit(0), answerer, RetrievalConfig(mode="keyword"))
    assert {r.status for r in none.collect()} == {"no_evidence"}


def test_scores_are_checked(spark):
    ok = spark.createDataFrame([(0.5, None), (1.0, 0.0)], "score double, rerank_score double")
    assert rt.check_scores(ok).count() == 2
    with pytest.raises(Exception, match="between 0 and 1"):
        rt.check_scores(ok.withColumn("score", F.lit(1.5))).collect()


def test_lsh_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 16)))], "vec_id long, embedding array<double>")
    asked = corpus.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = {(r.qid, r.vec_id) for r in retrieval.vector_topk(corpus, asked, 10).collect()}
    near = {(r.qid, r.vec_id) for r in retrieval.vector_topk_lsh(corpus, asked, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_lsh_pairs_stay_in_their_task(spark):
    """No join and no shuffle but that of each task's best; bad vectors are left out."""
    rows = [(i, [1.0, float(i % 5), float(i % 3)]) for i in range(60)] + [(100, None), (101, [1.0, None, 0.0]), (102, [float("nan"), 1.0, 1.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = corpus.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    found = retrieval.vector_topk_lsh(corpus, asked, 10)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.qid, r.vec_id) for r in found.collect()} == {(r.qid, r.vec_id) for r in retrieval.vector_topk(corpus, asked, 10).collect()}
    assert retrieval.vector_topk_lsh(corpus.limit(0), asked, 10).collect() == []


def test_rewrite(spark):
    replies = {"a": '{"standalone_query": " new "}', "b": "no json", "c": '{"standalone_query": "' + "long " * 400 + '"}'}
    df = spark.createDataFrame([(k, "old " + k) for k in replies], "p string, q string")
    got = {r.p: r.r for r in df.select("p", rw.rewrite(F.col("p"), F.col("q"), lambda: lambda ps: [replies[p] for p in ps]).alias("r")).collect()}
    assert (got["a"].query, got["a"].status) == ("new", "success") and got["b"].query == "old b" and got["c"].reason == "too_long"


def test_summaries():
    turns = [{"seq": i, "question": "q " * 20, "answer": "a " * 20} for i in range(1, 6)]
    assert rw.prepare_history(turns, "", 10, 1000, 100, None)["status"] == "not_needed"
    out = rw.prepare_history(turns, "", 10, 150, 100, lambda s, t: "short")
    assert out["status"] == "compacted" and out["summarized_through"] == 3 and [t["seq"] for t in out["turns"]] == [4, 5]
    out = rw.prepare_history(turns, "", 10, 100, 100, lambda s, t: t + t)
    assert out["status"] == "failed" and out["dropped"] == [1, 2, 3] and out["summary"] == ""
    again = rw.prepare_history(turns, "", 10, 100, 100, None, tried={out["candidate"]})
    assert again["reason"] == "already_tried" and again["dropped"] == [1, 2, 3]
    assert [t["seq"] for t in rw.working_turns([*turns, {"seq": 9, "status": "failed"}], 3)] == [4, 5]
    with pytest.raises(ValueError):
        rw.prepare_history(turns[:1], "", 10, 20, 100, lambda s, t: "x")
    seen = []
    assert rw.summarise("", "word " * 50, lambda s, part: seen.append(part) or "s", 30, 10) == "s" and "".join(seen) == "word " * 50
    with pytest.raises(ValueError, match="summary_call_limit"):
        rw.summarise("", "word " * 500, lambda s, part: "s", 30, 10)


def test_answers(spark):
    asked = spark.createDataFrame([(1, "why"), (2, "what")], "qid int, text string")
    shown = spark.createDataFrame([(1, 2, "n2", "", "two"), (1, 1, "n1", "s", "one")], "qid int, place int, name string, path string, content string")
    got = {r.qid: r for r in rw.answer(asked, shown, lambda: lambda ps: ["[2] says so [7]" if p.startswith("[1] n1 / s\none\n\n[2] n2\ntwo") else "?" for p in ps]).collect()}
    assert got[1].citations[0].name == "n2" and len(got[1].citations) == 1 and got[2].status == "no_evidence"


def test_sessions_replay(spark):
    log = [(1, 0, 10, 0.0), (2, 0, 10, 1.0), (3, 1, 10, 2.0), (4, 2, 10, 100.0), (5, 2, 99, 3.0)]
    df = spark.createDataFrame([("s", *e) for e in log[:3]] + [("t", 1, 0, 10, 0.0), ("t", 2, 1, 10, 100.0), ("u", 1, 0, 60, 0.0), ("u", 2, 1, 60, 1.0)], "session_id string, seq long, expected_version long, bytes long, at double")
    got = {r.session_id: r for r in ss.replay_commits(df, max_turns=5, max_bytes=100, ttl=50).collect()}
    assert (got["s"].version, got["s"].conflicts) == (2, 1) and (got["t"].version, got["t"].expired) == (1, 1) and (got["u"].version, got["u"].full) == (1, 1)
    rows = spark.createDataFrame([("o", "r", "t1", "pending"), ("o", "q", "t2", "pending"), ("o", "z", "t3", "done")], "owner string, request_id string, token string, status string")
    out = {r.request_id: r.status for r in ss.abandon(rows, spark.createDataFrame([("o", "r", "t1"), ("o", "q", "bad"), ("o", "z", "t3")], "owner string, request_id string, token string")).collect()}
    assert out == {"r": "failed", "q": "pending", "z": "done"}


def test_registry(spark):
    log = spark.createDataFrame([("b", 1, "put", "uploaded"), ("a", 2, "put", "uploaded"), ("b", 3, "put", "ready"), ("c", 4, "put", "x"), ("c", 5, "delete", None)], "doc_id string, seq int, op string, status string")
    assert [(r.doc_id, r.status) for r in registry.current(log).orderBy("entered").collect()] == [("b", "ready"), ("a", "uploaded")]
    states = spark.createDataFrame([("uploaded", "indexing"), ("uploaded", "ready"), ("failed", "indexing")], "a string, b string")
    assert [r[0] for r in states.select(registry.may_become(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_image_descriptions(spark):
    df = spark.createDataFrame([('x {"ocr_text": 1, "subjects": ["a", " "], "chart_trends": "不适用"} y',), ("none",), ("[1]",)], "t string")
    rows = df.select(images.description(F.col("t")).alias("d"), images.page_text(images.description(F.col("t")), F.lit("alt"), F.lit("")).alias("p")).collect()
    assert rows[0].p == "[图片] alt\n主体：a" and rows[1].d is None and rows[2].d is None


def test_dataset_builder(spark):
    rows = spark.createDataFrame([(t, i, f"{t}{i % 4}", "e", f"question {i}", "answer", f"news {t} {i}") for t in ("a", "b") for i in range(6)], "task string, position int, ID string, event string, questions string, answers string, news1 string")
    distractors = spark.createDataFrame([(f"line {i} question",) for i in range(30)], "text string")
    built = runs.build_dataset(rows, distractors, {"a": 1, "b": 1}, 3, 1, 20, 5)
    corpus = built["corpus"].groupBy("source").count().collect()
    assert {r.source: r["count"] for r in corpus} == {"positive": 6, "hard_negative": 5, "random_negative": 9}
    assert built["queries"].filter("split = 'dev'").count() == 2 and built["queries"].select("query_id").distinct().count() == 6
    assert built["qrels"].join(built["corpus"], "doc_id", "left_anti").count() == 0


def test_dataset_builder_reads_each_text_once(spark):
    """Ids and sources take one pass over the texts; copies, also in other tasks, change no score."""
    rows = spark.createDataFrame([("a", i, f"e{i}", "e", f"red green blue {i}0", "answer", f"news {i}") for i in range(3)], "task string, position int, ID string, event string, questions string, answers string, news1 string")
    texts = ["red and green and blue things", "red green", "blue blue blue sky over the sea", "", "x", "news 1", *(f"other text {i} of many" for i in range(14))]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    held = texts + texts[:1] * 9 + texts[2:3] * 4
    built = runs.build_dataset(rows, spark.createDataFrame([(t,) for t in held], "text string").repartition(4).mapInPandas(counted, "text string"), {"a": 1}, 3, 1, 12, 4)
    got = {r.doc_id: r.source for r in built["corpus"].select("doc_id", "source").collect()}
    assert read.value == len(held)
    name = lambda t: "crud_" + hashlib.sha256(t.encode()).hexdigest()[:24]
    own = {name(t): set(re.findall("[a-z0-9]{2,}", t)) for t in texts if t != "news 1"}
    asked = {"red", "green", "blue", "00", "10", "20"}
    hard = sorted(own, key=lambda d: (-round(len(own[d] & asked) / max(1, len(own[d])) ** 0.5, 6), d))[:4]
    rest = sorted(set(own) - set(hard), key=lambda d: hashlib.md5(f"43:{d}".encode()).hexdigest())[:5]
    assert got == {name(f"news {i}"): "positive" for i in range(3)} | dict.fromkeys(hard, "hard_negative") | dict.fromkeys(rest, "random_negative")
    assert {r.doc_id: name(r.text) for r in built["corpus"].collect()} == {d: d for d in got}


def test_dataset_builder_wants_visible_texts(spark):
    """An event is used only if each of its task's texts has a character that isn't white space."""
    texts = {"e1": ("a", "b"), "e2": ("a", " \u3000\r\n\u2028"), "e3": (None, "b"), "e4": ("\u00a0", "b"), "e5": ("\x1c", "."), "e6": ("a", "")}
    rows = spark.createDataFrame([(t, i, f"{t}{e}", "e", "question", "answer", *texts[e]) for t in ("one", "two", "odd") for i, e in enumerate(texts)], "task string, position int, ID string, event string, questions string, answers string, news1 string, news2 string")
    built = runs.build_dataset(rows, spark.createDataFrame([("x y",)], "text string"), {"one": 1, "two": 2}, 9, 1, 9, 1)
    assert {r.event_id for r in built["queries"].collect()} == {"onee1", "onee2", "onee5", "onee6", "twoe1", "twoe5"}


def test_runs_and_lock(spark):
    queries = spark.createDataFrame([("1", "q"), ("2", "r")], "qid string, question string")
    results = spark.createDataFrame([("1", "d", 0.5, 1), ("1", "d", 0.4, 2), ("1", "e", 0.3, 3)], "qid string, doc_id string, score double, rank int")
    rows = {r.query_id: r for r in runs.run_rows(queries, results, "vector").collect()}
    assert [(x.doc_id, x["rank"]) for x in rows["1"].retrieved] == [("d", 1), ("e", 2)] and rows["2"].status == "no_evidence" and rows["2"].evidence_doc_ids == []
    usage = spark.createDataFrame([('{"prompt_tokens": 5, "total_tokens": "unavailable"}',)], "u string").select(runs.numeric_usage(F.col("u"))).first()[0]
    assert usage == {"prompt_tokens": 5.0}
    locked = runs.lock([{"k": 10, "recall_10": 0.5}, {"k": 30, "recall_10": 0.6}], ["recall_10"], {"recall_10": 0.5, "mrr_10": 0.5}, {"recall_10": 0.6, "mrr_10": 0.5})
    assert locked["chosen"]["k"] == 30 and locked["rerank"] and runs.lock_text(locked).startswith("{")
    assert runs.variants({"a": 1, "b": 2}, lambda c: spark.range(c)).groupBy("variant").count().count() == 2
    assert runs.run_meta({"x": 1}, "s", "v", "d", None)["git_commit"] == "unavailable"
