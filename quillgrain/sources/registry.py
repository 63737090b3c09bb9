"""The document registry: an append log of states, upload gates and access."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Conflict, VersionedTable

#: Types that may be uploaded, and MIME types that stand for them (fixed values).
ALLOWED = ["md", "markdown", "txt", "text", "html", "htm", "pdf"]
BY_MIME = {"text/markdown": "md", "text/plain": "txt", "text/html": "html", "application/pdf": "pdf"}


def upload_type(name: Column, mime: Column) -> Column:
    """Extension of an upload: the name's if it is allowed, else the MIME type's; null if neither is."""
    by_name = F.lower(F.regexp_extract(name, r"[^./]\.([^./]+)$", 1))
    by_mime = F.create_map(*(F.lit(x) for pair in BY_MIME.items() for x in pair))
    return F.when(by_name.isin(ALLOWED), by_name).otherwise(F.try_element_at(by_mime, F.lower(F.coalesce(mime, F.lit("")))))


def upload_error(name: Column, mime: Column, size: Column, max_bytes: int) -> Column:
    """Why an upload is refused, in order of the gates; null if it isn't."""
    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "INVALID_FILE_NAME")
        .when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE")
        .when(size > max_bytes, "FILE_TOO_LARGE")
        .when(upload_type(F.trim(name), mime).isNull(), "INVALID_FILE_TYPE")
    )


def current(log: DataFrame) -> DataFrame:
    """The registry of a log (seq, doc_id, op, payload...): the last state of each document, deleted ones gone, in order of first entry."""
    columns = [c for c in log.columns if c not in ("doc_id", "seq")]
    last = log.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "seq").alias("last"), F.min("seq").alias("entered"), F.max("seq").alias("seq"))
    return last.select("doc_id", "last.*", "entered", "seq").filter("op <> 'delete'")


def public_view(registry: DataFrame) -> DataFrame:
    return registry.drop("file_path")


#: What a state may become.
NEXT = {"uploaded": ["indexing"], "indexing": ["ready", "failed"], "ready": ["indexing"], "failed": ["indexing"]}


def may_become(now: Column, then: Column) -> Column:
    test = F.lit(False)
    for state, after in NEXT.items():
        test = test | ((now == state) & then.isin(after))
    return test


def delete_outcome(status: Column) -> Column:
    """404 for unknown documents, 409 while one is being indexed."""
    return F.when(status.isNull(), 404).when(status == "indexing", 409).otherwise(200)


class Registry:
    """Documents (doc_id, status, ...) in a versioned table; each change holds only for the state it was decided on."""

    def __init__(self, table: VersionedTable):
        self.table = table

    def _state(self, doc_id: Any) -> tuple[int, DataFrame, Any]:
        version = self.table.version()
        kind = self.table.read(version).schema["doc_id"]
        named = self.table.spark.createDataFrame([(doc_id,)], T.StructType([kind]))
        return version, named, self.table.read(version).filter(F.col("doc_id") == F.lit(doc_id)).first()

    def transition(self, doc_id: Any, status: str, **changes: Any) -> int:
        """200 if the document has become ``status``, 404 if it isn't there, 409 if it may not, or not any more.

        Of writers that race only one finds the state it decided on; the others
        decide again on what that one left.
        """
        while True:
            version, named, row = self._state(doc_id)
            if row is None:
                return 404
            if status not in NEXT.get(row.status, []):
                return 409
            try:
                self.table.update(named, "doc_id", {"status": status, **changes}, version)
                return 200
            except Conflict:
                continue

    def delete(self, doc_id: Any, index: VersionedTable, delete_file: Callable[[Row], None]) -> int:
        """200 once the document's rows, then its file, then its record are gone; 404 or 409 if it may not be deleted.

        If a step fails it raises, and the record stays to delete by again; so it
        does, with 409, if the document has moved on meanwhile.
        """
        version, named, row = self._state(doc_id)
        if row is None or row.status == "indexing":
            return 404 if row is None else 409
        index.delete(named, "doc_id")
        delete_file(row)
        while True:
            try:
                self.table.delete(named, "doc_id", version)
                return 200
            except Conflict:
                version, _, now = self._state(doc_id)
                if now is None or now != row:
                    return 404 if now is None else 409


def preview_outcome(asset_id: Column, document_id: Column, registered: Column, owner: Column, asker: Column) -> Column:
    """400 for a bad request, 404 for an asset that isn't there, 403 for another's, else 200."""
    ask = F.coalesce(asset_id.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False)) & (F.coalesce(document_id, F.lit("")) != "")
    return F.when(~ask, 400).when(~F.coalesce(registered, F.lit(False)), 404).when(~owner.eqNullSafe(asker), 403).otherwise(200)
