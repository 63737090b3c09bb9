"""Evidence windows around matched children, and the prompt budget.

A window is an interval of its parent's text. Each match is given the widest
interval around it that fits the budget, intervals that overlap become one while
that fits, and the rest of the module turns intervals into rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EvidenceConfig
from ..functions.batches import records, rows_of
from ..functions.tokens import Counter, Ruler, approximate_tokens, ruler

#: Tokens left free when a window is narrowed (fixed value).
SLACK = 24
WINDOWS = "qid string, rank int, chunk_id string, doc_id string, window_no int, content string, first int, last int, children array<string>, match_first int, match_last int, whole boolean"

WINDOW_ROWS = pa.schema(
    [("qid", pa.string()), ("rank", pa.int32()), ("chunk_id", pa.string()), ("doc_id", pa.string()), ("window_no", pa.int32()), ("content", pa.string()), ("first", pa.int32()), ("last", pa.int32())]
    + [("children", pa.list_(pa.string())), ("match_first", pa.int32()), ("match_last", pa.int32()), ("whole", pa.bool_())]
)
PROMPTS = pa.schema(
    [("qid", pa.string()), ("n_evidence", pa.int64()), ("n_dropped", pa.int64()), ("used_tokens", pa.int64()), ("evidence", pa.list_(pa.string())), ("shown", pa.list_(pa.struct([("rank", pa.int32()), ("content", pa.string()), ("narrowed", pa.bool_())])))]
)

Span = tuple[int, int]


class OverBudget(ValueError):
    """A match that can't be shown whole within the budget."""


@dataclass(frozen=True)
class Child:
    """A matched child; ``span`` is its place in the parent, None if it isn't known."""

    chunk_id: str
    span: Span | None
    snippet: str = ""


@dataclass(frozen=True)
class Parent:
    chunk_id: str
    doc_id: str
    content: str
    children: tuple[Child, ...]
    primary: str | None = None
    whole: bool = False


@dataclass(frozen=True)
class Window:
    """``span`` is its place in the parent, ``match`` that of what must stay visible; both None for a bare snippet."""

    chunk_id: str
    doc_id: str
    content: str
    span: Span | None
    match: Span | None
    children: tuple[str, ...] = ()
    whole: bool = False


# --- intervals -------------------------------------------------------------------------------------------------------


def widest(size: int, match: Span, budget: int, tokens: Ruler) -> Span:
    """The match with as many characters on either side as the budget allows, clipped to the text of that size."""
    if not 0 <= match[0] < match[1] <= size:
        raise ValueError("the matched child lies outside its parent")

    def grown(by: int) -> Span:
        return max(0, match[0] - by), min(size, match[1] + by)

    fits = bisect.bisect_right(range(max(match[0], size - match[1]) + 1), budget, key=lambda by: tokens.count(*grown(by)))
    if not fits:
        raise OverBudget("the matched child passes the budget")
    return grown(fits - 1)


def merged(spans: Sequence[Span], fits) -> list[Span]:
    """Intervals in order of place; one that overlaps its predecessor joins it if the union fits."""
    out: list[Span] = []
    for span in sorted(spans):
        union = (out[-1][0], max(out[-1][1], span[1])) if out and span[0] <= out[-1][1] else None
        if union and fits(union):
            out[-1] = union
        else:
            out.append(span)
    return out


# --- windows ---------------------------------------------------------------------------------------------------------


def _primary(parent: Parent) -> Child | None:
    named = [c for c in parent.children if c.chunk_id == parent.primary]
    return (named or [*parent.children, None])[0]


def _show(parent: Parent, span: Span) -> Window:
    """The interval as a window; its match is the primary child if that is inside, else the first child that is."""
    inside = [c for c in parent.children if c.span and c.span[0] < span[1] and c.span[1] > span[0]]
    anchor = next((c for c in inside if c.chunk_id == parent.primary), inside[0] if inside else None)
    return Window(parent.chunk_id, parent.doc_id, parent.content[slice(*span)], span, anchor.span if anchor else None, tuple(c.chunk_id for c in inside), parent.whole)


def _snippet(parent: Parent, child: Child, budget: int, count: Counter) -> Window:
    if count(child.snippet) > budget:
        raise OverBudget("the matched child passes the budget")
    return Window(child.chunk_id, parent.doc_id, child.snippet, None, None, (child.chunk_id,))


def windows_of(parent: Parent, budget: int, count: Counter = approximate_tokens) -> list[Window]:
    """The windows of a parent, by place.

    A kept structure, and a parent within the budget, is one window. Children
    whose place isn't known are shown as their snippets, if no window shows them.
    """
    tokens = ruler(parent.content, count)
    everything = (0, len(parent.content))
    fits = tokens.count(*everything) <= budget
    placed, lost = [c for c in parent.children if c.span], [c for c in parent.children if not c.span]
    if parent.whole or (fits and (placed or not lost)):
        return [_show(parent, everything)]
    if fits:
        return [_snippet(parent, _primary(parent), budget, count)]
    if not parent.children:
        raise ValueError("no matched child to stay around")
    spans = merged([widest(len(parent.content), c.span, budget, tokens) for c in placed], lambda s: tokens.count(*s) <= budget)
    return [_show(parent, s) for s in spans] + [_snippet(parent, c, budget, count) for c in lost]


def narrow(window: Window, budget: int, count: Counter = approximate_tokens) -> Window:
    """The window if it fits, else what fits around its match; offsets stay those of the parent."""
    if count(window.content) <= budget:
        return window
    if window.whole or window.span is None or window.match is None:
        raise OverBudget("nothing of the window can be left out")
    start = window.span[0]
    inside = (max(window.match[0], start) - start, min(window.match[1], window.span[1]) - start)
    a, b = widest(len(window.content), inside, budget, ruler(window.content, count))
    return replace(window, content=window.content[a:b], span=(start + a, start + b))


def prompt_text(taken: Sequence[Window]) -> str:
    return "\n\n".join(f"[{i}] {w.content}" for i, w in enumerate(taken, 1))


def fit_prompt(fixed: int, candidates: Sequence[Window], config: EvidenceConfig, count: Counter = approximate_tokens, provider_limit: int = 0) -> tuple[list[Window], list[str], int]:
    """Windows taken in order while the prompt fits, narrowed where needed; the ids dropped; the prompt's tokens.

    ``fixed`` is the size of the prompt without evidence.
    """
    limit = min(config.prompt_limit(provider_limit) - 1, fixed + config.evidence_max_tokens)
    taken: list[Window] = []
    dropped: list[str] = []
    used = fixed
    for w in candidates:
        new, size = w, fixed + count(prompt_text([*taken, w]))
        if size > limit and config.mode != "child_only":
            try:
                new = narrow(w, max(1, limit - used - SLACK), count)
                size = fixed + count(prompt_text([*taken, new]))
            except OverBudget:
                pass
        if size <= limit:
            taken, used = [*taken, new], size
        else:
            dropped.append(w.chunk_id)
    return taken, dropped, used


# --- tables ----------------------------------------------------------------------------------------------------------


def _parent(row: Any) -> Parent:
    place = lambda c: None if c["start"] is None or c["end"] is None else (int(c["start"]), int(c["end"]))
    children = tuple(Child(str(c["chunk_id"]), place(c), c["snippet"] or "") for c in row["children"])
    return Parent(str(row["chunk_id"]), str(row["doc_id"]), row["content"], children, row["primary_child"], bool(row["preserve_structure"]))


def _shown(parent: Parent, config: EvidenceConfig, count: Counter) -> list[Window]:
    child = _primary(parent)
    if config.mode == "child_only" and child:
        return [Window(child.chunk_id, parent.doc_id, child.snippet, None, None, (child.chunk_id,))]
    return windows_of(parent, config.window_tokens, count) if config.mode == "window" else [_show(parent, (0, len(parent.content)))]


def evidence_windows(results: DataFrame, config: EvidenceConfig = EvidenceConfig(), count: Counter = approximate_tokens) -> DataFrame:
    """Windows of ranked parents (qid, rank, chunk_id, doc_id, content, children, primary_child, preserve_structure).

    One row a parent in, its windows out; rows stay where they are.
    """

    def run(batches):
        for rows in rows_of(batches):
            shown = [
                (str(r["qid"]), r["rank"], w.chunk_id, w.doc_id, n, w.content, *(w.span or (None, None)), list(w.children), *(w.match or (None, None)), w.whole)
                for r in rows
                for n, w in enumerate(_shown(_parent(r), config, count))
            ]
            yield from records([dict(zip(WINDOW_ROWS.names, s)) for s in shown], WINDOW_ROWS)

    top = results.filter(F.col("rank") <= config.context_top_k)
    return top.select("qid", "rank", "chunk_id", "doc_id", "content", "children", "primary_child", "preserve_structure").mapInArrow(run, WINDOWS)


def fit_prompts(windows: DataFrame, config: EvidenceConfig, fixed_tokens: int = 100, count: Counter = approximate_tokens) -> DataFrame:
    """qid, n_evidence, n_dropped, used_tokens, evidence (the chunk ids taken, in order) and shown (their ranks, contents and whether these were narrowed) of each question.

    ``windows`` are those of ``evidence_windows``; they go in by rank of their
    parent, then by place. Taking them is sequential within a question, which
    holds at most the windows of its ``context_top_k`` parents.
    """

    def span(a: int | None, b: int | None) -> Span | None:
        return None if a is None else (a, b)

    def one(rows: list[dict[str, Any]]) -> tuple[int, int, int, list[str], list[dict[str, Any]]]:
        parts = [Window(r["chunk_id"], r["doc_id"], r["content"], span(r["first"], r["last"]), span(r["match_first"], r["match_last"]), (), bool(r["whole"])) for r in rows]
        ranks = {(r["chunk_id"], r["doc_id"]): r["rank"] for r in rows}
        taken, dropped, used = fit_prompt(fixed_tokens, parts, config, count)
        whole = set(parts)
        return len(taken), len(dropped), used, [w.chunk_id for w in taken], [{"rank": ranks[w.chunk_id, w.doc_id], "content": w.content, "narrowed": w not in whole} for w in taken]

    def run(batches):
        for asked in rows_of(batches):
            yield from records([dict(zip(PROMPTS.names, (a["qid"], *one(a["rows"])))) for a in asked], PROMPTS)

    fields = ["rank", "chunk_id", "window_no", "doc_id", "content", "first", "last", "match_first", "match_last", "whole"]
    gathered = windows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    return gathered.select(F.col("qid").cast("string").alias("qid"), "rows").mapInArrow(run, "qid string, n_evidence long, n_dropped long, used_tokens long, evidence array<string>, shown array<struct<rank:int,content:string,narrowed:boolean>>")
