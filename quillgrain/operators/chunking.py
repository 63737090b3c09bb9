"""Budgeted splitting: blocks to parents, parents to children.

One document is one call, and one row in and out of Python; documents are never
grouped, so a document's blocks stay where its row is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import ChunkConfig
from ..functions.batches import records, rows_of
from ..functions.tokens import Counter, Ruler, approximate_tokens, ruler, token_count

#: Name of the chunk profile, and where a text may be cut (fixed values).
PROFILE = "parent-child-v3"
_BREAK_CODES = np.array(sorted({*map(ord, "。！？!?；;\n"), *(i for i in range(0x3001) if chr(i).isspace())}), np.uint32)
_ALONE_BEFORE = {"heading", "frontmatter", "hr"}
#: What stands between the pieces of a parent (fixed value).
JOINT = "\n\n"

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("chunk_role", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("child_ids", T.ArrayType(T.StringType())),
        T.StructField("chunk_order", T.IntegerType()),
        T.StructField("retrieval_eligible", T.BooleanType()),
        T.StructField("content", T.StringType()),
        T.StructField("section_path", T.ArrayType(T.StringType())),
        T.StructField("block_types", T.ArrayType(T.StringType())),
        T.StructField("block_orders", T.ArrayType(T.IntegerType())),
        T.StructField("parent_char_start", T.IntegerType()),
        T.StructField("parent_char_end", T.IntegerType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("accuracy", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("preserve_structure", T.BooleanType()),
    ]
)


def profile_hash(config: ChunkConfig) -> str:
    said = json.dumps(asdict(config) | {"profile": PROFILE}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(said.encode()).hexdigest()[:12]


def split_text(text: str, target: int, most: int, count: Counter = approximate_tokens) -> list[tuple[int, int]]:
    """Ranges that tile the text, each within ``most`` tokens.

    A piece ends at the last break (mark or white space) within the target that
    leaves it at least half as long, else at the first break after it, else at the limit.
    """
    return _split(ruler(text, count), target, most)


def _breaks(codes: np.ndarray) -> np.ndarray:
    """Offsets behind each character that a text may be cut after."""
    marks = np.isin(codes, _BREAK_CODES)
    return np.flatnonzero(marks) + 1


def _split(measure: Ruler, target: int, most: int) -> list[tuple[int, int]]:
    if not 0 < target <= most:
        raise ValueError("0 < target <= most is needed")
    size, breaks = len(measure.codes), _breaks(measure.codes)
    ranges, at = [], 0
    while at < size:
        limit = measure.reach(at, size, most)
        if limit == at:
            raise ValueError("the budget doesn't hold a single character")
        stop = limit
        if limit < size:
            aim = measure.reach(at, limit, target)
            low, mid, high = np.searchsorted(breaks, [at + max(1, (aim - at) // 2) + 1, aim + 1, limit + 1])
            # The last break up to the aim, or the first one behind it.
            pick = mid - 1 if mid > low else mid
            stop = int(breaks[pick]) if low <= pick < high else limit
        ranges.append((at, stop))
        at = stop
    return ranges


@dataclass
class Piece:
    """A part of a block that is merged as a whole."""

    text: str
    block: dict[str, Any]
    offset: int
    kept_whole: bool
    size: int


@dataclass
class Parent:
    pieces: list[Piece]
    kept_whole: bool = False
    text: str = field(init=False)
    segments: list[tuple[int, int, Piece]] = field(init=False)

    def __post_init__(self):
        self.text = JOINT.join(p.text for p in self.pieces)
        ends = accumulate(len(p.text) + len(JOINT) for p in self.pieces)
        self.segments = [(end - len(JOINT) - len(p.text), end - len(JOINT), p) for end, p in zip(ends, self.pieces)]


def pieces_of(blocks: Sequence[dict[str, Any]], config: ChunkConfig, count: Counter) -> list[Piece]:
    out = []
    for b in blocks:
        text = b["text"] or ""
        if not text.strip():
            continue
        if (b["block_type"] == "code" and config.preserve_code) or (b["block_type"] == "table" and config.preserve_table):
            out.append(Piece(text, b, 0, True, count(text)))
            continue
        lead, text = len(text) - len(text.lstrip()), text.strip()
        measure = ruler(text, count)
        out += [Piece(text[s:e], b, lead + s, False, measure.count(s, e)) for s, e in _split(measure, config.parent_target_tokens, config.parent_max_tokens)]
    return out


def merge_parents(pieces: Sequence[Piece], config: ChunkConfig, count: Counter) -> list[Parent]:
    """Greedy merging in order.

    Headings and the like start a parent, images and kept structures stand
    alone, and a parent ends when the next piece would pass the target. The
    default counter's sizes add up; for another one the joined text is counted.
    """
    parents: list[Parent] = []
    held: list[Piece] = []
    size = 0

    def close() -> None:
        nonlocal size
        if held:
            parents.append(Parent(list(held)))
            held.clear()
        size = 0

    for p in pieces:
        kind = p.block["block_type"]
        if p.kept_whole:
            close()
            parents.append(Parent([p], kept_whole=True))
            continue
        if kind == "image" or (config.align_to_boundary and kind in _ALONE_BEFORE):
            close()
        more = size + p.size if count is approximate_tokens or not held else count(JOINT.join(x.text for x in [*held, p]))
        if held and more > config.parent_target_tokens:
            close()
            more = p.size
        held.append(p)
        size = more
        if size > config.parent_max_tokens:
            raise ValueError("a parent passed its budget")
        if kind == "image" or size >= config.parent_target_tokens:
            close()
    close()
    return parents


def _span(segments: Sequence[tuple[int, int, Piece]], start: int, end: int) -> dict[str, Any]:
    """Source offsets of a range of a parent; exact only if all its blocks are and stand in the source as in the parent."""
    inside = [s for s in segments if s[1] > start and s[0] < end] or list(segments[:1])
    spans = [s[2].block.get("span") or {} for s in inside]
    located = [x for x in spans if x.get("start_char") is not None]
    accuracy = "exact" if spans and all(x.get("accuracy") == "exact" for x in spans) else "line_only" if located else "unavailable"
    first, last = (located[0]["start_char"], located[-1]["end_char"]) if located else (None, None)
    if accuracy == "exact":
        a, b = inside[0], inside[-1]
        first = a[2].block["span"]["start_char"] + a[2].offset + max(0, start - a[0])
        last = b[2].block["span"]["start_char"] + b[2].offset + min(end, b[1]) - b[0]
        # Blocks may lie further apart in the source than in their parent.
        accuracy = "exact" if last - first == end - start else "line_only"
    return {"start_char": first, "end_char": last, "accuracy": accuracy, "blocks": [s[2].block for s in inside]}


def chunk_document(doc_id: str, blocks: Sequence[dict[str, Any]], config: ChunkConfig = ChunkConfig(), count: Counter = approximate_tokens) -> list[dict[str, Any]]:
    """Parents and children of one document, each parent before its children."""
    stem, rows = f"{doc_id}_v3_{profile_hash(config)}", []

    def row(role: str, text: str, span: dict[str, Any], parent: Parent, tokens: int, **more: Any) -> dict[str, Any]:
        own = {b["order"]: b for b in span["blocks"]}
        made = {
            "doc_id": doc_id,
            "chunk_id": f"{stem}_{len(rows)}",
            "chunk_role": role,
            "parent_id": None,
            "child_ids": [],
            "chunk_order": len(rows),
            "retrieval_eligible": role == "child",
            "content": text,
            "section_path": list(span["blocks"][0].get("section_path") or []),
            "block_types": list(dict.fromkeys(b["block_type"] for b in own.values())),
            "block_orders": list(own),
            "parent_char_start": None,
            "parent_char_end": None,
            "start_char": span["start_char"],
            "end_char": span["end_char"],
            "accuracy": span["accuracy"],
            "token_count": tokens,
            "preserve_structure": parent.kept_whole,
        } | more
        rows.append(made)
        return made

    for parent in merge_parents(pieces_of(blocks, config, count), config, count):
        measure, size = ruler(parent.text, count), len(parent.text)
        head = row("parent", parent.text, _span(parent.segments, 0, size), parent, measure.count(0, size))
        ranges = [(0, size)] if parent.kept_whole else _split(measure, config.child_target_tokens, config.child_max_tokens)
        for s, e in ranges:
            child = row("child", parent.text[s:e], _span(parent.segments, s, e), parent, measure.count(s, e), parent_id=head["chunk_id"], parent_char_start=s, parent_char_end=e)
            head["child_ids"].append(child["chunk_id"])
    return rows


def chunk_documents(docs: DataFrame, config: ChunkConfig = ChunkConfig(), count: Counter = approximate_tokens) -> DataFrame:
    """doc_id and blocks (array of structs) to chunk rows."""

    schema = to_arrow_schema(CHUNK_SCHEMA)

    def run(batches):
        for rows in rows_of(batches):
            yield from records([c for r in rows for c in chunk_document(str(r["doc_id"]), [_plain(x) for x in r["blocks"]], config, count)], schema)

    return docs.select("doc_id", "blocks").mapInArrow(run, CHUNK_SCHEMA)


FAMILY_SCHEMA = "doc_id string, chunk_id string, content string, preserve_structure boolean, children array<struct<chunk_id:string,start:int,end:int,snippet:string>>"
FAMILIES = pa.schema(
    [("doc_id", pa.string()), ("chunk_id", pa.string()), ("content", pa.string()), ("preserve_structure", pa.bool_()), ("children", pa.list_(pa.struct([("chunk_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("snippet", pa.string())])))]
)


def chunk_families(docs: DataFrame, config: ChunkConfig = ChunkConfig(), count: Counter = approximate_tokens) -> DataFrame:
    """Parents with their children's places and contents: what evidence is built from, made where the document is chunked."""

    def families(doc_id: str, blocks: Sequence[dict[str, Any]]) -> list[dict[str, Any]]:
        kids: dict[str, list[dict[str, Any]]] = {}
        chunks = chunk_document(doc_id, [_plain(x) for x in blocks], config, count)
        for c in chunks:
            if c["parent_id"]:
                kids.setdefault(c["parent_id"], []).append({"chunk_id": c["chunk_id"], "start": c["parent_char_start"], "end": c["parent_char_end"], "snippet": c["content"]})
        return [{"doc_id": c["doc_id"], "chunk_id": c["chunk_id"], "content": c["content"], "preserve_structure": c["preserve_structure"], "children": kids.get(c["chunk_id"], [])} for c in chunks if c["chunk_role"] == "parent"]

    def run(batches):
        for rows in rows_of(batches):
            yield from records([f for r in rows for f in families(str(r["doc_id"]), r["blocks"])], FAMILIES)

    return docs.select("doc_id", "blocks").mapInArrow(run, FAMILY_SCHEMA)


def _plain(block: Any) -> dict[str, Any]:
    block = block if isinstance(block, dict) else block.asDict(recursive=True)
    return block | {"section_path": list(block.get("section_path") if block.get("section_path") is not None else [])}


def paragraph_blocks(text: Column) -> Column:
    """Plain text as paragraph blocks between blank lines, in the shape ``chunk_documents`` reads."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    null = F.lit(None).cast("int")
    span = F.struct(null.alias("start_char"), null.alias("end_char"), F.lit("unavailable").alias("accuracy"))
    return F.transform(parts, lambda p, i: F.struct(p.alias("text"), F.lit("paragraph").alias("block_type"), F.array().cast("array<string>").alias("section_path"), (i + 1).cast("int").alias("order"), span.alias("span")))


def invariant_violations(chunks: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(rule, violations): children tile their parents, budgets hold, ids are distinct, links go both ways."""
    is_parent = F.col("chunk_role") == "parent"
    budget = F.col("preserve_structure") | (F.col("token_count") <= F.when(is_parent, config.parent_max_tokens).otherwise(config.child_max_tokens))
    piece = F.struct(F.col("parent_char_start").alias("at"), F.col("content").alias("content"), F.col("chunk_id").alias("id"))
    # A family is a parent and its children; one pass over the chunks gathers all that is asked.
    families = chunks.groupBy(F.coalesce("parent_id", "chunk_id").alias("family")).agg(
        F.max(F.when(is_parent, F.col("content"))).alias("content"),
        F.max_by("child_ids", F.when(is_parent, F.lit(1))).alias("child_ids"),
        F.sort_array(F.collect_list(F.when(~is_parent, piece))).alias("pieces"),
        F.count_if(~budget).alias("over"),
        (F.count("*") - F.size(F.collect_set("chunk_id"))).alias("repeated"),
    )
    joined = F.array_join(F.transform("pieces", lambda p: p["content"]), "")
    ids = F.sort_array(F.transform("pieces", lambda p: p["id"]))
    counts = families.agg(
        F.count_if(~joined.eqNullSafe(F.col("content"))).alias("children_tile_parent"),
        F.count_if(~ids.eqNullSafe(F.sort_array("child_ids"))).alias("links_both_ways"),
        F.coalesce(F.sum("over"), F.lit(0)).cast("long").alias("token_budget"),
        F.coalesce(F.sum("repeated"), F.lit(0)).cast("long").alias("distinct_ids"),
    )
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in counts.columns))))


def overlapping(segments: Column, start: Column, end: Column) -> Column:
    """Segments (start, end half open) that overlap a range."""
    return F.filter(segments, lambda s: (s["end"] > start) & (s["start"] < end))


def embedding_outcomes(chunks: DataFrame, model_limit: int, chunk_budget: int, count: Counter = approximate_tokens) -> DataFrame:
    """``chunks`` with tokens and outcome: blank, over_model_limit, over_chunk_budget (kept structures may be) or ok.

    Nothing is cut to fit; ``check_embeddable`` fails on what isn't ok.
    """
    counted = chunks.withColumn("tokens", token_count(F.col("content"), count))
    outcome = (
        F.when(F.trim("content") == "", "blank")
        .when(F.col("tokens") > model_limit, "over_model_limit")
        .when(~F.col("preserve_structure") & (F.col("tokens") > chunk_budget), "over_chunk_budget")
        .otherwise("ok")
    )
    return counted.withColumn("outcome", outcome)


def check_embeddable(chunks: DataFrame, model_limit: int, chunk_budget: int, count: Counter = approximate_tokens) -> DataFrame:
    """``chunks`` as they are; one that can't be embedded whole fails its task."""
    judged = embedding_outcomes(chunks, model_limit, chunk_budget, count)
    ok = F.when(F.col("outcome") == "ok", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("chunk can't be embedded: "), F.col("outcome"))))
    return judged.filter(ok).select(*chunks.columns)
