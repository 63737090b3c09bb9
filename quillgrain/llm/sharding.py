"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every shard i draws u in (0, 1) from the hash of (record key, i); the record
goes to the shard of least -ln(u) / weight. A shard's draw never depends on the
others, so a new shard only takes records (about its weight's share) and a
removed one only gives up its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, unused

#: Rows a cell of a shard should hold at most when slots are numbered.
CELL_ROWS = 2000
#: A cell of more rows may hold one row many times over.
CROWDED_ROWS = 32 * CELL_ROWS


def _bid(key: Column, shard: int, weight: float) -> Column:
    draw = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return F.struct((-F.log(draw) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def record_key(*columns: Column) -> Column:
    """A stable string key; null and missing parts are told apart from empty ones."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct<cost, shard>: the winning shard of a string key; shards of weight 0 take nothing."""
    bids = [_bid(key, i, w) for i, w in enumerate(weights) if w > 0]
    if not bids:
        raise ValueError("at least one shard needs a positive weight")
    return F.array_min(F.array(*bids))


def assign_shards(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """``docs`` with its shard, from the key alone: no shuffle, all other columns kept.

    Rows of equal key share a shard. A null key is a key of its own. A column
    already named like ``shard_col`` is replaced.
    """
    return docs.withColumn(shard_col, rendezvous(record_key(F.col(id_col)), weights)["shard"])


def number_slots(rows: DataFrame, shard_col: str, order: Sequence[str], hash_col: str) -> DataFrame:
    """``rows`` with a gapless ``slot`` from 0 within each shard, by (hash_col, order...).

    A shard is never one task: its rows fall into cells by the high bits of the
    hash, cells are counted, and a row's slot is the rows of earlier cells and
    its rank in its own. The number of cells follows the number of rows. Rows
    of one hash that are too many for a cell are equal rows; they come last in
    their shard, numbered where they lie.
    """
    count, shards = rows.agg(F.count("*"), F.count_distinct(shard_col)).first()
    bits = min(20, max(6, math.ceil(math.log2(max(1, count) / max(1, shards) / CELL_ROWS + 1))))
    cell, before, of = unused(rows, "cell"), unused(rows, "before"), unused(rows, "of_hash")
    placed = rows.withColumn(cell, F.shiftrightunsigned(F.col(hash_col), 64 - bits))

    def in_cells(part: DataFrame) -> DataFrame:
        earlier = Window.partitionBy(shard_col).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        offsets = part.groupBy(shard_col, cell).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
        rank = F.row_number().over(Window.partitionBy(shard_col, cell).orderBy(hash_col, *order))
        return part.join(offsets, [shard_col, cell]).withColumn("slot", (F.col(before) + rank - 1).cast("long")).drop(cell, before)

    crowded = placed.groupBy(shard_col, cell).agg(F.count("*").alias(before)).filter(F.col(before) > CROWDED_ROWS)
    if crowded.isEmpty():
        return in_cells(placed)
    many = cut(placed.join(crowded.drop(before), [shard_col, cell], "left_semi").groupBy(shard_col, hash_col).agg(F.count("*").alias(before)).filter(F.col(before) > CROWDED_ROWS), "equal-rows")
    rest = placed.join(many, [shard_col, hash_col], "left_anti")
    earlier = Window.partitionBy(shard_col).orderBy(hash_col).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rest.groupBy(shard_col).agg(F.count("*").alias(cell))
    bases = many.join(sizes, shard_col, "left").select(F.col(shard_col).alias(of + "_shard"), F.col(hash_col).alias(of), (F.coalesce(cell, F.lit(0)) + F.coalesce(F.sum(before).over(earlier), F.lit(0))).alias(before))
    equal = numbered(placed.join(many, [shard_col, hash_col], "left_semi").select(*placed.columns), [shard_col, hash_col], "slot", "equal-slots")
    put = equal.join(bases, (F.col(shard_col) == F.col(of + "_shard")) & (F.col(hash_col) == F.col(of))).withColumn("slot", F.col("slot") + F.col(before))
    return in_cells(rest.select(*placed.columns)).unionByName(put.drop(cell, before, of, of + "_shard"))


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    The law is ``key``: the key and the shards decide. Null texts count as
    empty (size 16, checksum 0). Repeated rows get the same shard and slots of
    their own. An empty table gives no rows.
    """
    key = record_key(F.col(id_col))
    # A long hash of key and text: rows of one key spread over cells when they differ.
    spread = F.xxhash64(F.lit("slot"), key, F.col(text_col))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
            rendezvous(key, weights)["shard"].alias("shard"),
            rendezvous(key, grown_weights)["shard"].alias("grown_shard"),
            spread.alias("spread"),
        ),
        "shards",
    )
    slots = number_slots(rows, "shard", ["doc_id", "text_crc32", "size"], "spread")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
