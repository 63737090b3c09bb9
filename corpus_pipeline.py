"""The corpus pipeline: five operators of the llm subpackage, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgrain.llm import catalog, decontaminate, mixing, near_copies, quality_rules, sharding
from quillgrain.llm.common import DOCUMENT_COLUMNS, cut, forget_since, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles at 0.8 or more, or fingerprints within two bits."""
    return near_copies.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return mixing.mixed_copies(docs, catalog.MIX_WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return sharding.assign_shards(docs, [1.0] * catalog.SHARDS)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("mixing", mix), ("sharding", shard)]

#: Fingerprints need XXH64, which SQL lacks; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written and read again before the next one starts; what it and the stage before it wrote goes then."""
    docs, before = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS), written()
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name, large=True)
        forget_since(before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
