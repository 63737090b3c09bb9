"""Arrow batches in small parts, so that a worker's memory follows the part and not the batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa

#: Bytes and rows of a batch that become Python objects at a time. One row may be larger.
PART_BYTES, PART_ROWS = 1 << 20, 512


def parts(batch: pa.RecordBatch, most_bytes: int = PART_BYTES, most_rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, of about ``most_bytes`` each if its rows are alike; nothing is copied."""
    step = max(1, min(most_rows, batch.num_rows * most_bytes // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.nbytes > 2 * most_bytes:
            yield from parts(part, most_bytes, max(1, part.num_rows // 2))
        else:
            yield part


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict[str, Any]]]:
    """The rows of batches, those of a part at a time."""
    for batch in batches:
        for part in parts(batch):
            yield part.to_pylist()


def array_parts(values: pa.Array, rows: int = PART_ROWS) -> Iterator[pa.Array]:
    for at in range(0, len(values), rows):
        yield values.slice(at, rows)


def records(rows: list[dict[str, Any]], schema: pa.Schema, size: int = 4 * PART_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``size`` rows."""
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist(rows[at : at + size], schema)
