"""Embedding that goes on where it stopped.

The eligible chunks are dealt over ranges by a hash of their id. A range is
claimed, its vectors are written to a folder of its own, read back for their
digest, and committed in a log with what they were made of. A run that is killed
leaves claimed ranges without a commit: the next run makes these again, in new
folders, and no others. Committed ranges are verified before they count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.providers import Embedder, embed
from .store import VersionedTable, fingerprint


class EmbeddingLog:
    """Vectors of chunks (chunk_id, content, retrieval_eligible) below ``path``; ``config`` says what makes them."""

    def __init__(self, spark: SparkSession, path: str, dim: int, config: dict[str, Any], ranges: int = 64):
        self.spark, self.path, self.dim, self.ranges = spark, path.rstrip("/"), dim, ranges
        self.mark = fingerprint({"dim": dim, "ranges": ranges, "config": config})
        # The log's entries are claimed like a table's versions: only one writer can create a file.
        self._files = VersionedTable(spark, f"{self.path}/log")

    # --- log

    def _entry(self, name: str) -> dict[str, Any] | None:
        found = self._files._names(f"{self.path}/log/_versions")
        return self._files._manifest(name) if name in found else None

    def _start(self) -> None:
        if not self._files._claim("configuration", {"fingerprint": self.mark}) and (self._entry("configuration") or {}).get("fingerprint") != self.mark:
            raise ValueError("the vectors are of another configuration")

    def committed(self) -> dict[int, dict[str, Any]]:
        """The ranges that are done: folder, rows, digest of the vectors and of what they were made of."""
        done = {}
        for name in self._files._names(f"{self.path}/log/_versions"):
            if name.startswith("range-"):
                entry = self._files._manifest(name)
                if entry:
                    number, attempt = map(int, name.split("-")[1:])
                    if number not in done or attempt > done[number]["attempt"]:
                        done[number] = entry | {"attempt": attempt}
        return done

    # --- digests

    def _dealt(self, chunks: DataFrame) -> DataFrame:
        eligible = chunks.filter("retrieval_eligible").select("chunk_id", "content")
        return eligible.withColumn("range", F.pmod(F.xxhash64(F.col("chunk_id").cast("string")), F.lit(self.ranges)).cast("int"))

    @staticmethod
    def _digests(rows: DataFrame, *columns: Any) -> dict[int, tuple[int, str]]:
        said = rows.groupBy("range").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.col("chunk_id").cast("string"), *columns)).alias("digest"), F.count_distinct("chunk_id").alias("ids")).collect()
        if any(r.n != r.ids for r in said):
            raise ValueError("chunk ids are repeated")
        return {r["range"]: (r.n, f"{r.digest & (1 << 64) - 1:016x}") for r in said}

    def _read(self, entries: dict[int, dict[str, Any]]) -> DataFrame:
        """(chunk_id, embedding, range) of these ranges; folders that are gone have no rows."""
        folders = sorted(e["folder"] for e in entries.values() if self._files._names(e["folder"]))
        kind = "chunk_id string, embedding array<float>"
        rows = self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/range=(\d+)/", 1).cast("int") if folders else F.lit(0)
        return rows.select("chunk_id", "embedding", number.alias("range"))

    # --- runs

    def run(self, chunks: DataFrame, make: Callable[[], Embedder], at_once: int = 8) -> dict[str, Any]:
        """Embed what isn't done, ``at_once`` ranges a job, and say how many ranges and rows were made and what all amount to.

        A committed range whose chunks have changed, or whose vectors don't have
        their digest any more, is made again.
        """
        self._start()
        dealt = self._dealt(chunks)
        wanted = self._digests(dealt, F.col("content"))
        done = self.committed()
        held = self._digests(self._read(done), F.col("embedding")) if done else {}
        good = {r for r, e in done.items() if r in wanted and (e["rows"], e["source"]) == wanted[r] and held.get(r) == (e["rows"], e["digest"])}
        todo = sorted(set(wanted) - good)
        for at in range(0, len(todo), at_once):
            self._make(dealt, todo[at : at + at_once], wanted, done, make)
        total = self._digests(self.vectors().withColumn("range", F.lit(0)), F.col("embedding")).get(0, (0, "0" * 16))
        return {"ranges": len(todo), "made": sum(wanted[r][0] for r in todo), "rows": total[0], "digest": total[1]}

    def _make(self, dealt: DataFrame, numbers: list[int], wanted: dict, done: dict, make: Callable[[], Embedder]) -> None:
        root = f"{self.path}/rows/{uuid.uuid4().hex}"
        attempts = {r: done[r]["attempt"] + 1 if r in done else 0 for r in numbers}
        rows = dealt.filter(F.col("range").isin(numbers)).select("chunk_id", embed(F.col("content"), make, self.dim).alias("embedding"), "range")
        for r in numbers:
            self._files._claim(f"claim-{r}-{uuid.uuid4().hex}", {"range": r, "folder": root})
        rows.write.partitionBy("range").parquet(root)
        own = {r: {"folder": f"{root}/range={r}"} for r in numbers}
        made = self._digests(self.spark.read.schema("chunk_id string, embedding array<float>, range int").parquet(root), F.col("embedding"))
        for r in numbers:
            if made.get(r, (0, ""))[0] != wanted[r][0]:
                raise ValueError(f"range {r} has another number of vectors than chunks")
            entry = own[r] | {"rows": wanted[r][0], "source": wanted[r][1], "digest": made[r][1]}
            # Whoever commits an attempt first has made the range; another's rows are left aside.
            self._files._claim(f"range-{r}-{attempts[r]}", entry)

    def vectors(self) -> DataFrame:
        """(chunk_id, embedding) of all committed ranges."""
        return self._read(self.committed()).drop("range")

    def clean(self) -> int:
        """Delete what claims wrote and no commit names, and say how many folders went. Run without writers."""
        kept, gone = {e["folder"] for e in self.committed().values()}, 0
        for name in self._files._names(f"{self.path}/log/_versions"):
            claim = self._files._manifest(name) if name.startswith("claim-") else None
            if claim and (folder := f"{claim['folder']}/range={claim['range']}") not in kept:
                fs, p = self._files._fs(folder)
                gone += bool(fs.delete(p, True))
        return gone
