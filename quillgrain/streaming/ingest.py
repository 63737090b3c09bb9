"""Streams: incremental ingestion, request idempotency, windowed latency."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import VersionedTable

DOCUMENTS = "doc_id string, file_type string, content string"


def newest_documents(batch: DataFrame, columns: list[str]) -> DataFrame:
    """The last arrival of each document: by time and name of its file, then by its place in the file."""
    arrived = batch.withColumn("arrived", F.struct("file_time", "file_path", F.monotonically_increasing_id().alias("place")))
    return arrived.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "arrived").alias("d")).select("doc_id", "d.*")


def ingest_stream(spark: SparkSession, source: str, table: VersionedTable, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], schema: str = DOCUMENTS) -> StreamingQuery:
    """New document files become chunks; each batch replaces its documents in one switch, so a replay is harmless.

    Of several arrivals of a document the last one counts, whatever it says.
    """
    read = spark.readStream.schema(schema).json(source)
    columns = [c for c in read.columns if c != "doc_id"]

    def store(batch: DataFrame, _: int) -> None:
        newest = newest_documents(batch, columns)
        if not newest.isEmpty():
            table.replace_documents(chunk(newest))

    located = read.select("*", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file_path"))
    return located.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_requests(requests: DataFrame, lateness: str = "15 minutes") -> DataFrame:
    """The first arrival of each (owner, request_id) within the lateness; state is dropped after it."""
    return requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["owner", "request_id"])


def latency_windows(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Count and mean of values by event type and tumbling window."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
