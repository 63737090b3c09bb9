"""Versioned Parquet tables: upserts and deletes without a table format.

Rows fall into buckets by a hash of their document. A version is a small list of
the folder that holds each bucket; a change reads and writes the buckets it
touches, and the next version names new folders for these and the old ones for
the rest. A reader sees the old or the new version, never a mix, and a lost
executor or driver leaves the old one in place.

A version's number is claimed by creating its file, which only one writer can
do. A writer that comes second goes on from the other's version if they touched
different buckets, and fails if not.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import is_valid


_private: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; a local master without one gets a private one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _private.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="quillgrain-")
        _private[context.applicationId] = folder
    return f"{folder.rstrip('/')}/quillgrain/{uuid.uuid4().hex}"


class Conflict(RuntimeError):
    """Another writer has changed the same buckets."""


class Staged(NamedTuple):
    """A change that is written but not yet part of the table: folder and schema of each touched bucket (None: no rows)."""

    base: int
    folders: dict[str, str | None]
    schema: dict[str, Any]


class VersionedTable:
    """``bucket_by`` names the column that places a row; rows with a null there share a bucket.

    Within a file rows lie in the order of ``sort_by``, so a filter on these
    columns skips most of it.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_by: str = "doc_id", buckets: int = 64, sort_by: tuple[str, ...] = ()):
        self.spark, self.path, self.bucket_by, self.buckets, self.sort_by = spark, path.rstrip("/"), bucket_by, buckets, sort_by

    # --- files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _manifest(self, version: int) -> dict[str, Any] | None:
        """A version's list, or None if its writer hasn't finished it."""
        fs, p = self._fs(f"{self.path}/_versions/{version}")
        stream = fs.open(p)
        try:
            said = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return json.loads(said) if said.endswith("}") else None

    def _claim(self, version: int, manifest: dict[str, Any]) -> bool:
        fs, p = self._fs(f"{self.path}/_versions/{version}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as error:
            if "exist" in str(error.java_exception).lower():
                return False
            raise
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        return True

    # --- versions

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path}/_versions") if n.isdigit())

    def version(self) -> int:
        """The current version, 0 if there is none."""
        return next((v for v in reversed(self._versions()) if self._manifest(v)), 0)

    def _held(self, version: int) -> dict[str, Any]:
        held = self._manifest(version) if version else None
        return held or {"folders": {}, "schema": None, "buckets": self.buckets}

    def _frame(self, folders: list[str], schema: dict[str, Any]) -> DataFrame:
        kind = T.StructType.fromJson(schema)
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        held = self._held(version or self.version())
        if held["schema"] is None:
            raise ValueError("the table has no version yet")
        return self._frame(sorted(held["folders"].values()), held["schema"])

    # --- changes

    def _bucket(self, column: str | None = None):
        return F.pmod(F.xxhash64(F.col(column or self.bucket_by).cast("string")), F.lit(self.buckets)).cast("int")

    def stage(self, df: DataFrame, touched: list[int] | None = None, base: int | None = None) -> Staged:
        """Write ``df``, which is all that the touched buckets (None: all) shall hold."""
        name = "_bucket"
        while name in df.columns:
            name = "_" + name
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        # Rebalanced, not repartitioned: a large bucket goes to several tasks, so none sorts a share of the table that grows with it.
        dealt = df.withColumn(name, self._bucket()).hint("rebalance", F.col(name))
        (dealt.sortWithinPartitions(name, *self.sort_by) if self.sort_by else dealt).write.partitionBy(name).parquet(folder)
        made = {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if "=" in n}
        return Staged(self.version() if base is None else base, {str(b): made.get(str(b)) for b in (range(self.buckets) if touched is None else touched)}, json.loads(df.schema.json()))

    def staged(self, change: Staged) -> DataFrame:
        return self._frame([f for f in change.folders.values() if f], change.schema)

    def commit(self, change: Staged) -> int:
        """Make a staged change the next version."""
        while True:
            now = self.version()
            held, old = self._held(now), self._held(change.base)
            if now != change.base and any(held["folders"].get(b) != old["folders"].get(b) for b in change.folders):
                raise Conflict(f"version {now} has changed the same documents")
            folders = {b: f for b, f in (held["folders"] | change.folders).items() if f}
            known = T.StructType.fromJson(held["schema"]).fields if held["schema"] else []
            fields = {f.name: f for f in [*known, *T.StructType.fromJson(change.schema).fields]}
            new = max(self._versions(), default=0) + 1
            if self._claim(new, {"buckets": self.buckets, "folders": folders, "schema": json.loads(T.StructType(list(fields.values())).json())}):
                return new

    def write(self, df: DataFrame) -> int:
        """``df`` becomes the whole table."""
        return self.commit(self.stage(df))

    def _change(self, keys: DataFrame, key: str, made: Callable[[DataFrame], DataFrame], fresh: DataFrame | None, base: int | None = None) -> int:
        """Rewrite the buckets that ``keys`` may touch: those of their documents, all if they don't name documents.

        With ``base`` the change counts on these buckets being as they were in
        that version, and raises a Conflict if they aren't.
        """
        base = self.version() if base is None else base
        if not base:
            return self.write(fresh) if fresh is not None else 0
        held = self._held(base)
        if held["buckets"] != self.buckets:
            raise ValueError(f"the table has {held['buckets']} buckets")
        touched = list(range(self.buckets))
        if self.bucket_by in keys.columns:
            # A bucket number for each document; there are no more of them than buckets.
            touched = sorted(r.b for r in keys.select(self._bucket().alias("b")).distinct().collect())
        old = self._frame([held["folders"][str(b)] for b in touched if str(b) in held["folders"]], held["schema"])
        return self.commit(self.stage(made(old), touched, base))

    def upsert(self, rows: DataFrame, key: str) -> int:
        """Rows replace those of their key; within the batch keys must be distinct. A key keeps its document."""
        if not rows.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"repeated {key} in one batch")
        return self._change(rows, key, lambda old: upserted(old, rows, key), rows)

    def replace_documents(self, rows: DataFrame, doc: str = "doc_id") -> int:
        """All rows of the documents in ``rows`` are replaced: stale chunks go with the same switch."""
        return self._change(rows, doc, lambda old: replaced(old, rows, doc), rows)

    def delete(self, keys: DataFrame, key: str, base: int | None = None) -> int:
        """Rows of these keys go. Only a key that is the document tells its bucket."""
        named = keys.select(key).distinct()
        return self._change(named, key, lambda old: old.join(named, key, "left_anti"), None, base)

    def update(self, keys: DataFrame, key: str, changes: dict[str, Any], base: int | None = None) -> int:
        """Rows of these keys get new values in some columns."""
        named = keys.select(key).distinct().withColumn("_named", F.lit(True))
        value = lambda old, c: F.when(F.col("_named"), F.lit(changes[c]).cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
        return self._change(named.drop("_named"), key, lambda old: old.join(named, key, "left").select(*(value(old, c) for c in old.columns)), None, base)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last ``keep`` versions names; readers of older ones fail. Run without writers."""
        kept = {f for v in self._versions()[-keep:] for f in self._held(v)["folders"].values()}
        gone = 0
        for batch in self._names(f"{self.path}/data"):
            for name in self._names(f"{self.path}/data/{batch}"):
                folder = f"{self.path}/data/{batch}/{name}"
                if "=" in name and folder not in kept:
                    fs, p = self._fs(folder)
                    gone += bool(fs.delete(p, True))
        return gone


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced(old: DataFrame, new: DataFrame, doc: str = "doc_id") -> DataFrame:
    return old.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new, allowMissingColumns=True)


def without_stale(old: DataFrame, kept: DataFrame, doc: str, key: str) -> DataFrame:
    """Of the documents in ``kept`` (doc, key), only the kept keys; other documents stay as they are."""
    touched = old.join(kept.select(doc).distinct(), doc, "left_semi").join(kept.select(key).distinct(), key, "left_semi")
    return old.join(kept.select(doc).distinct(), doc, "left_anti").unionByName(touched)


def check_index_rows(chunks: DataFrame, dim: int) -> DataFrame:
    """``chunks`` if a vector is there exactly for eligible rows and valid; a bad row fails its task."""
    ok = F.when(F.col("retrieval_eligible"), is_valid(F.col("embedding"), dim)).otherwise(F.col("embedding").isNull())
    return chunks.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad vector of "), F.col("chunk_id")))))


def bad_index_rows(chunks: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, reason) of the rows that may not be indexed."""
    eligible, vector = F.coalesce(F.col("retrieval_eligible"), F.lit(False)), F.col("embedding")
    reason = F.when(eligible & vector.isNull(), "no vector").when(eligible & ~is_valid(vector, dim), "invalid vector").when(~eligible & vector.isNotNull(), "vector of a row that isn't searched")
    return chunks.select("chunk_id", reason.alias("reason")).filter("reason IS NOT NULL")


def require_index_rows(chunks: DataFrame, dim: int, named: int = 3) -> DataFrame:
    """``chunks`` if all rows may be indexed; else an error that names the first of them, before anything is written."""
    bad = bad_index_rows(chunks, dim).orderBy("chunk_id").limit(named).collect()
    if bad:
        raise ValueError("; ".join(f"{r.chunk_id}: {r.reason}" for r in bad))
    return chunks


def index_counts(chunks: DataFrame) -> DataFrame:
    """Per document: rows, parents, children."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("chunk_role") == "parent").alias("parents"), F.count_if(F.col("chunk_role") == "child").alias("children"))


def validate_index(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """Documents whose rows don't add up: doc_id, n_rows, parents, children, indexed.

    ``expected`` has doc_id and indexed, the rows that ingestion counted. Rows must
    be parents and children, and as many as were counted.
    """
    joined = index_counts(chunks).join(expected.select("doc_id", "indexed"), "doc_id", "full_outer").fillna(0, ["n_rows", "parents", "children", "indexed"])
    return joined.filter((F.col("n_rows") != F.col("parents") + F.col("children")) | (F.col("n_rows") != F.col("indexed")))


def rebuild(table: VersionedTable, documents: DataFrame, chunk: Callable[[DataFrame], DataFrame], dry_run: bool = False) -> dict[str, int]:
    """A new index from the registry (doc_id, status, content), in a table that has no version yet.

    Documents being indexed or without content stop it before anything is
    written; what was written is validated before it becomes a version.
    """
    if table.version():
        raise ValueError("the index exists")
    if not documents.filter("status = 'indexing'").isEmpty():
        raise ValueError("a document is being indexed")
    missing = documents.filter(F.col("content").isNull()).count()
    if missing:
        raise ValueError(f"{missing} documents have no content")
    counts = {"documents": documents.count(), "rows": 0}
    if not dry_run:
        change = table.stage(chunk(documents))
        made = table.staged(change)
        counts["rows"] = made.count()
        if made.select("doc_id").distinct().count() != counts["documents"]:
            raise ValueError("documents are missing from the new index")
        table.commit(change)
    return counts


class CachedChunks:
    """The chunk table kept by the executors until its version changes, in memory and beyond that on their disks.

    A table of more than ``most_bytes`` on disk is read from its files each time.
    """

    def __init__(self, table: VersionedTable, most_bytes: int = 8 << 30):
        self.table, self.most_bytes, self.version, self.frame = table, most_bytes, 0, None

    def _bytes(self, frame: DataFrame) -> int:
        return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def read(self) -> DataFrame:
        now = self.table.version()
        if self.frame is None or now != self.version:
            if self.frame is not None:
                self.frame.unpersist()
            self.version, self.frame = now, self.table.read(now)
            if self._bytes(self.frame) <= self.most_bytes:
                self.frame.persist(StorageLevel.MEMORY_AND_DISK)
        return self.frame


def asset_rows(images: DataFrame) -> DataFrame:
    """(document_id, content, extension, created_at) to content-addressed assets, one row an asset and document.

    Of several registrations the earliest stays.
    """
    digest = F.sha2("content", 256)
    named = images.select(
        F.concat(F.lit("sha256:"), digest).alias("asset_id"),
        "document_id",
        F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, F.col("extension")).alias("storage_key"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        "created_at",
    )
    first = Window.partitionBy("asset_id", "document_id").orderBy("created_at", "storage_key")
    return named.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def register_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.join(old.select("asset_id", "document_id"), ["asset_id", "document_id"], "left_anti"))


def describe_assets(assets: DataFrame, news: DataFrame) -> DataFrame:
    """Status, model and prompt version of ``news`` laid on the assets."""
    fresh = news.select("asset_id", "document_id", *(F.col(c).alias("new_" + c) for c in ("description_status", "vlm_model", "vlm_prompt_version")))
    joined = assets.join(fresh, ["asset_id", "document_id"], "left")
    return joined.select(*(F.coalesce("new_" + c, c).alias(c) if c in ("description_status", "vlm_model", "vlm_prompt_version") else F.col(c) for c in assets.columns))


def owned_assets(assets: DataFrame, documents: DataFrame, owner: str) -> DataFrame:
    """Assets of documents whose JSON payload names the owner."""
    own = documents.filter(F.get_json_object("payload", "$.owner_id") == owner).select(F.col("doc_id").alias("document_id"))
    return assets.join(own, "document_id", "left_semi")


def write_jsonl(df: DataFrame, path: str) -> None:
    """UTF-8 JSON lines, keys in order of name."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def manifest(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """Name, bytes, lines and digest of each file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    lines = F.length(F.regexp_replace(F.col("content").cast("string"), "[^\n]", ""))
    rows = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), lines.alias("lines"), F.sha2("content", 256).alias("sha256")).orderBy("name")
    return [r.asDict() for r in rows.collect()]


def write_dataset(tables: dict[str, DataFrame], path: str, parameters: dict[str, Any]) -> dict[str, Any]:
    """Tables as JSON lines in the order of their first column, with a manifest: parameters, rows of each table and the digest of each file."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        # A range of keys a file, so files in order are the table in order.
        write_jsonl(rows.repartitionByRange(F.col(rows.columns[0])).sortWithinPartitions(*rows.columns[:1]), f"{path}/{name}.jsonl")
    said = {"parameters": parameters, "fingerprint": fingerprint(parameters), "tables": _table_digests(spark, path, list(tables))}
    spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return said


def _table_digests(spark: SparkSession, path: str, names: list[str]) -> dict[str, Any]:
    out = {}
    for name in sorted(names):
        files = [f for f in manifest(spark, f"{path}/{name}.jsonl") if f["bytes"] and f["name"].startswith("part-")]
        whole = hashlib.sha256("".join(f["sha256"] for f in files).encode()).hexdigest()
        out[name] = {"bytes": sum(f["bytes"] for f in files), "lines": sum(f["lines"] for f in files), "files": len(files), "sha256": whole}
    return out


def dataset_changes(spark: SparkSession, path: str) -> dict[str, Any]:
    """The tables of a written dataset that aren't what its manifest says, with what they are now."""
    said = json.loads(spark.read.text(f"{path}/manifest").first()[0])["tables"]
    return {name: now for name, now in _table_digests(spark, path, list(said)).items() if now != said[name]}


def fingerprint(config: dict[str, Any], digits: int = 16) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:digits]


def embed_missing(chunks: DataFrame, done: DataFrame | None, key: str = "chunk_id") -> DataFrame:
    """The chunks still to embed: a rerun goes on where the last one stopped."""
    eligible = chunks.filter("retrieval_eligible")
    return eligible if done is None else eligible.join(done.select(key), key, "left_anti")


def save_assets(images: DataFrame, path: str) -> DataFrame:
    """Store the bytes of content-addressed assets (``asset_rows`` and content), one row an asset, and return the rows without them.

    Bytes are Parquet rows in folders by the first two digits of the digest, so
    a lookup reads one folder; an asset that is there already is not written again.
    """
    spark = images.sparkSession
    named = asset_rows(images)
    digest = F.sha2("content", 256)
    bytes_ = images.select(F.concat(F.lit("sha256:"), digest).alias("asset_id"), F.substring(digest, 1, 2).alias("prefix"), "content").dropDuplicates(["asset_id"])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        bytes_ = bytes_.join(spark.read.parquet(path).select("asset_id"), "asset_id", "left_anti")
    bytes_.write.mode("append").partitionBy("prefix").parquet(path)
    return named


def load_asset(spark: SparkSession, path: str, asset_id: str) -> bytes | None:
    """The bytes of one asset, None if it isn't there; digests are checked again."""
    digest = asset_id.removeprefix("sha256:")
    row = spark.read.parquet(path).filter((F.col("prefix") == digest[:2]) & (F.col("asset_id") == asset_id)).select("content").first()
    if row is not None and hashlib.sha256(bytes(row.content)).hexdigest() != digest:
        raise ValueError("the asset's bytes are damaged")
    return None if row is None else bytes(row.content)


def write_vectors(vectors: DataFrame, path: str, dim: int, config: dict[str, Any]) -> dict[str, Any]:
    """Vectors next to their ids as one artifact: rows, dimension, digest of its rows and fingerprint of its configuration.

    Ids and vectors are one row, so nothing is joined by position. The digest
    doesn't depend on the order of rows.
    """
    spark = vectors.sparkSession
    vectors.write.mode("overwrite").parquet(f"{path}/rows")
    said = {"dim": dim, "fingerprint": fingerprint(config)} | vector_digest(spark.read.parquet(f"{path}/rows"))
    spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return said


def vector_digest(vectors: DataFrame, id_col: str = "chunk_id", vector: str = "embedding") -> dict[str, Any]:
    row = vectors.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(F.col(id_col).cast("string"), F.col(vector).cast("array<float>"))).alias("digest"), F.count_distinct(id_col).alias("ids")).first()
    return {"rows": row.rows, "ids": row.ids, "digest": f"{(row.digest or 0) & (1 << 64) - 1:016x}"}


def read_vectors(spark: SparkSession, path: str, dim: int, config: dict[str, Any]) -> DataFrame:
    """The rows of an artifact; another configuration, dimension, number of rows, repeated ids or damaged rows raise."""
    said = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    rows = spark.read.parquet(f"{path}/rows")
    if said["fingerprint"] != fingerprint(config) or said["dim"] != dim:
        raise ValueError("the vectors are of another configuration")
    found = vector_digest(rows)
    if found["ids"] != found["rows"] or any(said[k] != found[k] for k in ("rows", "digest")):
        raise ValueError("the vectors don't match their manifest")
    return rows.filter(F.when(is_valid(F.col("embedding"), dim), F.lit(True)).otherwise(F.raise_error(F.lit("an invalid vector"))))
