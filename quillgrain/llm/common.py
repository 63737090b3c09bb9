"""What the operators of this subpackage share: tables, words and scratch tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words: space and the controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

_written: list[tuple[SparkSession, str]] = []
_private: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    A plain Column would be copied into every place that uses it, inside
    higher-order functions once for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over its tasks.

    Functions come to the workers by value, and their module's globals with them.
    """
    import sys
    import types

    name = "quillgrain_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where none is set, a local master (as in tests) gets a private one; a cluster
    would read back what little each machine wrote, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        context = spark.sparkContext
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _private:
            _private[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillgrain-")
        folder = _private[context.applicationId]
    return folder.rstrip("/")


def cut(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage.

    A lost executor then costs a re-read, never a re-run of the plan above. After
    a ``large`` one the driver collects its garbage, as Spark keeps the shuffle
    files of a finished plan until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgrain/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if large:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def forget(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames; nothing that is still to be computed may read them."""
    for df in frames:
        entry = (df.sparkSession, df.cut_path)
        if entry in _written:
            _written.remove(entry)
            _delete(*entry)


def written() -> set[str]:
    """What ``cut`` wrote and is still there."""
    return {path for _, path in _written}


def forget_since(before: set[str], kept: DataFrame) -> None:
    """Delete what was written since, but for ``kept``; nothing that is still to be computed may read it."""
    for entry in [e for e in _written if e[1] not in before and e[1] != kept.cut_path]:
        _written.remove(entry)
        _delete(*entry)


def release() -> None:
    """Delete all that ``cut`` wrote; results not yet read are gone afterwards."""
    while _written:
        _delete(*_written.pop())


def numbered(rows: DataFrame, keys: Sequence[str], name: str, table_name: str) -> DataFrame:
    """``rows`` with ``name``, gapless from 0 within equal ``keys``, in the order the rows come in.

    Rows are numbered within their task and the tasks' counts are summed, so a
    group of any size never meets in one task. Rows are written out first, as
    their order must not change in between.
    """
    task, at, before, of = (unused(rows, n) for n in ("in_task", "at_row", "rows_before", "of_task"))
    placed = cut(rows.withColumn(task, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), table_name)
    earlier = Window.partitionBy(*keys).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, task).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*keys, task).orderBy(at)) - 1
    sides = counts.select(F.col(task).alias(of), before, *(F.col(k).alias(f"{of}_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{of}_{k}")) for k in keys), F.col(task) == F.col(of))
    return placed.withColumn(at, own).join(sides, same).withColumn(name, (F.col(before) + F.col(at)).cast("long")).select(*rows.columns, name)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, built from the given one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
