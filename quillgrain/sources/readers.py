"""Readers: text with strict UTF-8, JSON lines, nested JSON, distractors, assets, vectors."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_lines, source_type

TEXT_TYPES = ["md", "markdown", "txt", "text", "html", "htm"]
#: Read elsewhere: a text layer needs a PDF library, injected as a provider.
PROVIDED_TYPES = ["pdf"]


def describe_sources(rows: DataFrame) -> DataFrame:
    """(file_type, path, content, name) with the type normalised and the name defaulted to the file's."""
    file_name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.withColumn("file_type", source_type(F.col("file_type"))).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.nullif(file_name, F.lit("")), F.lit("document")))


def supported(file_type: Column) -> Column:
    return source_type(file_type).isin(TEXT_TYPES + PROVIDED_TYPES)


def read_texts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, file_type, content of whole text files; invalid UTF-8 raises, or is left out if not strict."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(TEXT_TYPES) + "}").load(path)
    said = F.col("content").cast("string")
    valid = files if strict else files.filter(F.is_valid_utf8(said))
    return valid.select("path", source_type(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("file_type"), (F.validate_utf8(said) if strict else said).alias("content"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at) of text files: block is where the line's split starts, at rises by one from line to line of a split."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def bad_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """(file, line, value) of the lines that are no JSON object of the schema; blank ones are none of them.

    Splits count their lines, and the counts of a file's earlier splits are
    summed, so a line has its number in the file though no task reads it whole.
    """
    kind = spark.createDataFrame([], schema).schema
    corrupt = "_corrupt"
    while corrupt in kind.names:
        corrupt = "_" + corrupt
    lines = numbered_lines(spark, path)
    parsed = F.from_json("value", T.StructType([*kind.fields, T.StructField(corrupt, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    bad = lines.withColumn("parsed", parsed).filter((F.trim("value") != "") & (F.col("parsed").isNull() | F.col(f"parsed.{corrupt}").isNotNull())).drop("parsed")
    earlier = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines")).withColumn("earlier", earlier)
    return bad.join(splits, ["file", "block"]).select("file", (F.col("earlier") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped, bad ones raise with the file and line of the first three."""
    bad = bad_lines(spark, path, schema).orderBy("file", "line").limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r.file} line {r.line}: {r.value[:80]!r} is no row of the schema" for r in bad))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def require(df: DataFrame, *fields: str) -> DataFrame:
    """``df`` if none of the fields is null; a null fails the row's task, naming the fields."""
    missing = F.array_join(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)), ",")
    return df.filter(F.when(missing == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("missing fields: "), missing))))


def read_tasks(spark: SparkSession, path: str, row: str) -> DataFrame:
    """A JSON object of task to list of rows, as (task, position, row fields)."""
    whole = spark.read.option("wholetext", True).text(path)
    tasks = whole.select(F.explode(F.from_json("value", f"map<string, array<struct<{row}>>>")).alias("task", "rows"))
    return tasks.select("task", F.posexplode("rows").alias("position", "r")).select("task", "position", "r.*")


def read_distractors(spark: SparkSession, path: str) -> DataFrame:
    """text: one normalised document a line, blank ones dropped."""
    return spark.read.text(path).select(normalize_lines(F.col("value")).alias("text")).filter("text <> ''")


def asset_key_ok(key: Column) -> Column:
    """Relative keys below the root: not empty, absolute, escaping or with backslashes."""
    return F.coalesce((key != "") & ~key.startswith("/") & ~key.contains("\\") & ~F.array_contains(F.split(key, "/"), ".."), F.lit(False))


def read_assets(spark: SparkSession, root: str, assets: DataFrame) -> DataFrame:
    """Registered assets (storage_key) with their bytes; keys that leave the root are refused."""
    checked = assets.filter(F.when(asset_key_ok(F.col("storage_key")), F.lit(True)).otherwise(F.raise_error(F.lit("bad asset key"))))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    key = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return checked.join(files.select(key.alias("storage_key"), F.col("content")), "storage_key")


def point_lookup(table: DataFrame, ids: list[Any], id_col: str = "chunk_id") -> DataFrame:
    """Rows of a few ids; missing ones are skipped, the vector stays behind."""
    return table.filter(F.col(id_col).isin(ids)).drop("embedding")
