"""Command line: ``python -m quillgrain COMMAND [options]`` (or spark-submit with this file).

Each command reads and writes tables, and leaves the work to the operators.
Models are named as ``module:function``; without one, stand-ins are used.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrain.config import ChunkConfig, EvidenceConfig, RetrievalConfig
from quillgrain.functions import providers
from quillgrain.operators import chunking, datasets, evaluation, metrics, parsing, retrieve, runs
from quillgrain.sources import embedding_log, store

DIM = 32
METRICS = [*(f"hit_{k}" for k in metrics.CUTOFFS), *(f"recall_{k}" for k in metrics.CUTOFFS), "mrr_10", "ndcg_10"]


def provider(name: str | None, default: Callable[[], Any]) -> Callable[[], Any]:
    """A provider's factory by name; a relative path or missing module raises as it is."""
    if not name:
        return default
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or JSON lines where the path says so. Relative paths are the working folder's; nothing is made by reading."""
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def chunks_of(docs: DataFrame, embedder: Callable[[], providers.Embedder], dim: int, config: ChunkConfig) -> DataFrame:
    """Documents (doc_id, file_type, content, doc_name) to index rows: parsed, chunked, children embedded."""
    parsed = parsing.parse_documents(docs).filter("error IS NULL")
    made = chunking.chunk_documents(parsed, config)
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_name") if "doc_name" in docs.columns else F.col("doc_id").cast("string")).alias("doc_name"))
    vector = F.when(F.col("retrieval_eligible"), providers.embed(F.col("content"), embedder, dim))
    return made.join(named, "doc_id").withColumn("embedding", vector)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = chunks_of(table(spark, a.input), provider(a.embedder, lambda: providers.hash_embedding), a.dim, ChunkConfig())
    chunks = store.VersionedTable(spark, a.output)
    print(json.dumps({"version": chunks.replace_documents(rows)}))


def rebuild(spark: SparkSession, a: argparse.Namespace) -> None:
    embedder = provider(a.embedder, lambda: providers.hash_embedding)
    print(json.dumps(store.rebuild(store.VersionedTable(spark, a.output), table(spark, a.input), lambda docs: chunks_of(docs, embedder, a.dim, ChunkConfig()), a.dry_run)))


def _retrieved(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    chunks, questions = store.VersionedTable(spark, a.index).read(), table(spark, a.input)
    config = RetrievalConfig.of(json.loads(a.config))
    return retrieve.retrieve(questions, chunks, config, provider(a.predictor, lambda: None), provider(a.embedder, lambda: providers.hash_embedding), a.dim)


def run_retrieval(spark: SparkSession, a: argparse.Namespace) -> None:
    results, trace = _retrieved(spark, a)
    owner = store.VersionedTable(spark, a.index).read().select(F.col("chunk_id").alias("primary_child"), "doc_id")
    rows = runs.run_rows(table(spark, a.input).select("qid", F.col("text").alias("question")), results.join(owner, "primary_child").select("qid", "doc_id", "score", "rank"), json.loads(a.config).get("mode", "hybrid"))
    rows.write.mode("overwrite").parquet(a.output)
    trace.write.mode("overwrite").parquet(a.output.rstrip("/") + "-trace")


def run_qa(spark: SparkSession, a: argparse.Namespace) -> None:
    chunks, config = store.VersionedTable(spark, a.index).read(), RetrievalConfig.of(json.loads(a.config))
    answers = retrieve.ask(table(spark, a.input), chunks, provider(a.answerer, lambda: providers.first_passage_answer), config, EvidenceConfig(), embedder=provider(a.embedder, lambda: providers.hash_embedding), dim=a.dim, predictor=provider(a.predictor, lambda: None))
    answers.write.mode("overwrite").parquet(a.output)


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    made = runs.build_dataset(table(spark, a.input), table(spark, a.distractors), json.loads(a.tasks), a.per_task, a.dev_per_task, a.corpus_size, a.hard)
    for name, rows in made.items():
        rows.write.mode("overwrite").parquet(f"{a.output}/{name}")
    parameters = {"tasks": json.loads(a.tasks), "per_task": a.per_task, "dev_per_task": a.dev_per_task, "corpus_size": a.corpus_size, "hard": a.hard}
    store.write_dataset({name: spark.read.parquet(f"{a.output}/{name}") for name in made}, f"{a.output}/lines", parameters)


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [table(spark, f"{a.input}/{n}") for n in ("corpus", "queries", "qrels", "references")]
    expected = spark.createDataFrame(list(json.loads(a.counts).items()), "name string, n long")
    broken = {r.rule: r.violations for r in datasets.dataset_violations(*parts, json.loads(a.tasks), expected).collect() if r.violations}
    print(json.dumps(broken, sort_keys=True))
    if broken:
        raise SystemExit(1)


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    queries, corpus, run = table(spark, f"{a.dataset}/queries"), table(spark, f"{a.dataset}/corpus"), table(spark, a.input)
    chosen = queries if a.split == "all" else queries.filter(F.col("split") == a.split)
    faults = [tuple(r) for r in datasets.run_errors(run, chosen, corpus).head(20)]
    if faults:
        raise SystemExit(f"the run isn't sound: {faults}")
    flat = run.select(F.col("query_id").alias("qid"), F.inline("retrieved")).select("qid", "doc_id", "rank")
    per = metrics.score_queries(chosen.select(F.col("query_id").alias("qid"), "task"), table(spark, f"{a.dataset}/qrels").select(F.col("query_id").alias("qid"), "doc_id"), flat)
    metrics.macro_average(per, "task", METRICS).write.mode("overwrite").parquet(a.output)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    groups = {r.task_group: r.asDict() for r in table(spark, a.input).orderBy(F.col("task_group") != "overall", "task_group").collect()}
    print(metrics.render_report(groups, METRICS), end="")


def sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    """One factor at a time on the dev questions; the locked configuration is printed."""
    base, axes = json.loads(a.config), json.loads(a.axes)
    dev = table(spark, f"{a.dataset}/queries").filter("split = 'dev'").select(F.col("query_id").alias("qid"), F.col("question").alias("text"), "task")
    qrels = table(spark, f"{a.dataset}/qrels").select(F.col("query_id").alias("qid"), "doc_id")
    chunks = store.VersionedTable(spark, a.index).read()
    owner = chunks.select(F.col("chunk_id").alias("primary_child"), "doc_id")

    def evaluate(overrides: dict[str, Any]) -> dict[str, Any]:
        results, _ = retrieve.retrieve(dev.select("qid", "text"), chunks, RetrievalConfig.of(base | overrides), provider(a.predictor, lambda: None), provider(a.embedder, lambda: providers.hash_embedding), a.dim)
        ranked = results.join(owner, "primary_child").select("qid", "doc_id", "rank").groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
        return metrics.score_queries(dev.select("qid", "task"), qrels, ranked).agg(*(F.avg(m).alias(m) for m in METRICS)).first().asDict()

    out = datasets.sweep_axes(axes, evaluate, ["recall_10", "mrr_10", "ndcg_10"])
    without = evaluate({"rerank": False})
    reranked = datasets.compose(base, out["picks"], True)
    with_it = evaluate({k: v for k, v in reranked.items() if k not in base}) if reranked.get("rerank") else without
    print(json.dumps({"picks": out["picks"], "locked": datasets.compose(base, out["picks"], datasets.keep_rerank(without, with_it))}, sort_keys=True))


def embed(spark: SparkSession, a: argparse.Namespace) -> None:
    """Vectors of a chunk table, resumed where an earlier run stopped."""
    chunks = store.VersionedTable(spark, a.index).read().select("chunk_id", "content", "retrieval_eligible")
    log = embedding_log.EmbeddingLog(spark, a.output, a.dim, {"embedder": a.embedder or "hash"})
    print(json.dumps(log.run(chunks, provider(a.embedder, lambda: providers.hash_embedding)), sort_keys=True))


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Document search over the vectors that ``embed`` wrote to --input, scored on a dataset; --exclusions has documents that can't be parsed."""
    log = embedding_log.EmbeddingLog(spark, a.input, a.dim, {"embedder": a.embedder or "hash"})
    kids = store.VersionedTable(spark, a.index).read().filter("chunk_role = 'child' AND retrieval_eligible")
    chunks = kids.select("chunk_id", "doc_id", F.coalesce("parent_id", "chunk_id").alias("family")).join(log.vectors(), "chunk_id")
    corpus, queries, qrels = (table(spark, f"{a.dataset}/{n}") for n in ("corpus", "queries", "qrels"))
    asked = queries.select(F.col("query_id").alias("qid"), F.col("question").alias("text"))
    vectors = retrieve.embed_questions(asked, provider(a.embedder, lambda: providers.hash_embedding), a.dim)
    excluded = table(spark, a.exclusions).select("doc_id") if a.exclusions else corpus.select("doc_id").limit(0)
    judged = qrels.select(F.col("query_id").alias("qid"), "doc_id", F.col("relevance").alias("rel"))
    print(json.dumps(evaluation.evaluate(corpus, chunks, excluded, asked, vectors, judged).first().asDict(), sort_keys=True))


COMMANDS = {"embed": embed, "evaluate": evaluate, "index": index, "rebuild": rebuild, "run-retrieval": run_retrieval, "run-qa": run_qa, "build": build, "validate": validate, "score": score, "report": report, "sweep": sweep}
OPTIONS = {"input": None, "output": None, "index": None, "dataset": None, "distractors": None, "exclusions": None, "config": "{}", "axes": "{}", "tasks": "{}", "counts": "{}", "split": "all", "embedder": None, "predictor": None, "answerer": None}
NUMBERS = {"dim": DIM, "per-task": 100, "dev-per-task": 20, "corpus-size": 1000, "hard": 100}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillgrain")
    parser.add_argument("command", choices=sorted(COMMANDS))
    for name, default in OPTIONS.items():
        parser.add_argument(f"--{name}", default=default)
    for name, default in NUMBERS.items():
        parser.add_argument(f"--{name}", type=int, default=default)
    parser.add_argument("--dry-run", action="store_true")
    a = parser.parse_args(argv)
    COMMANDS[a.command](spark or SparkSession.builder.appName("quillgrain").getOrCreate(), a)


if __name__ == "__main__":
    main()
