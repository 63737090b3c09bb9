"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are token sequences (runs of letters and digits,
lower-cased). Windows of five tokens that a text shares with an item are seeds.
Where the seeds could cover enough of the item, greedy string tiling by running
Karp-Rabin marks the longest common runs of tokens not yet marked on either
side, then the next longest, down to five tokens. Rolling hashes give windows of
any length at once, so each search length is a pass over both sequences, however
often they repeat themselves. Tiles may come in any order, so reordered passages
count; a text is contaminated by an item if its tiles cover enough of the item.

Each text is judged alone: no shuffle, and no group of copies or common passage
can grow a task. The benchmark goes to the workers in blocks of bounded size,
of which the driver holds one at a time; a larger benchmark means more passes,
not more memory. A block of 8 million characters (20,000 items of 60 words)
takes about 0.1 GB in a worker.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import cut, forget, worker_cache

MIN_MATCH = 5
THRESHOLD = 0.8
BLOCK_CHARS = 8_000_000
BASE = 0x9E3779B97F4A7C15
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Tile(NamedTuple):
    doc: int
    item: int
    length: int


_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1024, 2 * n)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


class Rolling:
    """Karp-Rabin hashes of all windows of a token sequence, for any length in one vector operation.

    The hash of tokens t_0..t_w-1 is the sum of t_k BASE^k modulo 2^64, so it is
    the difference of two prefix sums over the power at its start.
    """

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        forth, self.back = _power_table(len(ids))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * forth[: len(ids)], dtype=np.uint64)])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.ids) - width + 1
        return (self.sums[width:] - self.sums[:n]) * self.back[:n] if n > 0 else np.zeros(0, np.uint64)


class Marked(Rolling):
    """A sequence whose tokens get marked."""

    def __init__(self, ids: np.ndarray):
        super().__init__(ids)
        self.marks = np.zeros(len(ids), bool)

    def mark(self, at: int, length: int) -> None:
        self.marks[at : at + length] = True

    def open_starts(self, width: int) -> np.ndarray:
        """Starts of the windows without a marked token."""
        upto = np.concatenate([[0], np.cumsum(self.marks)])
        return np.flatnonzero(upto[width:] == upto[: len(upto) - width]) if len(self.ids) >= width else np.zeros(0, np.int64)


def _shared(doc: Marked, item: Marked, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Open starts in doc whose window is an open one of item, and the open starts in item."""
    d, p = doc.open_starts(width), item.open_starts(width)
    return d[np.isin(doc.windows(width)[d], item.windows(width)[p])], p


def _longest(doc: Marked, item: Marked, least: int, most: int) -> int:
    """The greatest length, ``most`` at most, of a common run of unmarked tokens; 0 if that is under ``least``."""
    if most < least or not len(_shared(doc, item, least)[0]):
        return 0
    low, high = least, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if len(_shared(doc, item, middle)[0]) else (low, middle - 1)
    return low


def _mark_all(doc: Marked, item: Marked, length: int) -> list[Tile]:
    """Mark the matches of this length in order of their place in doc, then in item."""
    starts, places = _shared(doc, item, length)
    hashes = item.windows(length)
    order = places[np.argsort(hashes[places], kind="stable")]
    known, first = np.unique(hashes[order], return_index=True)
    heads, ends = first.tolist(), [*first[1:].tolist(), len(order)]
    group = np.searchsorted(known, doc.windows(length)[starts]).tolist()
    blocked = np.zeros(len(hashes), bool)
    tiles, free = [], 0
    for d, g in zip(starts.tolist(), group):
        if d < free:
            continue
        while heads[g] < ends[g] and blocked[order[heads[g]]]:
            heads[g] += 1
        for p in order[heads[g] : ends[g]].tolist():
            if not blocked[p] and np.array_equal(doc.ids[d : d + length], item.ids[p : p + length]):
                doc.mark(d, length)
                item.mark(p, length)
                blocked[max(0, p - length + 1) : p + length] = True
                tiles.append(Tile(d, p, length))
                free = d + length
                break
    return tiles


def greedy_tiles(doc: Sequence[int], item: Sequence[int], min_match: int = MIN_MATCH) -> list[Tile]:
    """Tiles of greedy string tiling, longest first; equal lengths go by place in doc, then item."""
    a, b = Marked(np.asarray(doc, np.uint64)), Marked(np.asarray(item, np.uint64))
    tiles: list[Tile] = []
    length = min(len(a.ids), len(b.ids))
    while length := _longest(a, b, min_match, length):
        tiles += _mark_all(a, b, length)
        length -= 1
    return tiles


class Benchmark:
    """Items of a block, their vocabulary and the seeds that lead to them, as flat arrays."""

    def __init__(self, items: Sequence[tuple[Any, str | None]], min_match: int = MIN_MATCH, threshold: float = THRESHOLD):
        self.min_match, self.threshold = min_match, threshold
        self.vocabulary: dict[str, int] = {}
        self.item_ids: list[Any] = []
        texts: list[np.ndarray] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)]
            if ids:
                self.item_ids.append(item_id)
                texts.append(np.array(ids, np.uint64))
        self.tokens = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        self.offsets = np.cumsum([0, *map(len, texts)])
        self.lengths = np.diff(self.offsets)
        #: Of each width: hashes in order, and the token (over all items) at which each seed starts.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({self.width(n) for n in self.lengths.tolist()}):
            own = [n for n, size in enumerate(self.lengths.tolist()) if self.width(size) == width]
            hashes = np.concatenate([Rolling(texts[n]).windows(width) for n in own])
            starts = np.concatenate([np.arange(self.offsets[n], self.offsets[n + 1] - width + 1) for n in own])
            order = np.argsort(hashes, kind="stable")
            self.seeds[width] = hashes[order], starts[order]

    def width(self, length: int) -> int:
        """Items shorter than the least match are compared whole."""
        return min(self.min_match, length)

    def candidates(self, width: int, found: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items that seeds with these hashes (distinct) could cover to the threshold, and the hashes of their seeds."""
        hashes, starts = self.seeds[width]
        first, last = np.searchsorted(hashes, found), np.searchsorted(hashes, found, side="right")
        count = last - first
        at = np.arange(count.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        at = at[np.argsort(starts[at])]
        places = starts[at]
        item = np.searchsorted(self.offsets, places, side="right") - 1
        edges = np.flatnonzero(np.diff(item, prepend=-1))
        # A seed covers its width, or up to the next seed of its item.
        reach = np.minimum(width, np.append(np.diff(places), width))
        reach[np.append(edges[1:] - 1, len(places) - 1)] = width
        covered = np.add.reduceat(reach, edges)
        for n, a, b, most in zip(item[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(places)], covered.tolist()):
            if most >= self.threshold * self.lengths[n]:
                yield n, hashes[at[a:b]]

    def search(self, text: str | None) -> list[dict[str, Any]]:
        """Items that the text's tiles cover to the threshold, by item id, null last."""
        get, words = self.vocabulary.get, tokens(text)
        ids = np.fromiter((get(t, 0) for t in words), np.uint64, len(words))
        rolling, found = Rolling(ids), []
        for width, (known, _) in self.seeds.items():
            hashes = rolling.windows(width)
            if not len(hashes):
                continue
            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
            if not len(hit):
                continue
            for n, own in self.candidates(width, np.unique(hashes[hit])):
                # Only tokens under a seed can be in a tile; a gap keeps runs apart.
                starts, keep = hit[np.isin(hashes[hit], own)], np.zeros(len(ids) + 1, bool)
                for k in range(width):
                    keep[starts + k] = True
                runs = np.where(keep[:-1], ids, 0)[keep[:-1] | np.roll(keep, 1)[:-1]]
                size = int(self.lengths[n])
                tiles = greedy_tiles(runs, self.tokens[self.offsets[n] : self.offsets[n + 1]], width)
                covered = sum(t.length for t in tiles)
                if covered >= self.threshold * size:
                    found.append({"item_id": self.item_ids[n], "n_tiles": len(tiles), "covered_tokens": covered, "item_tokens": size, "coverage": covered / size})
        return sorted(found, key=lambda f: (1,) if f["item_id"] is None else (0, f["item_id"]))


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[tuple[Any, str]]]]:
    """(number of blocks, items) for each block of about ``block_chars`` characters, one at a time.

    Null texts are left out, null ids are kept; ids are of any type.
    """
    items = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for b in range(blocks):
        yield blocks, [tuple(r) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()]


def _found_type(benchmark: DataFrame, id_col: str) -> str:
    return f"array<struct<item_id:{benchmark.schema[id_col].dataType.simpleString()},n_tiles:int,covered_tokens:int,item_tokens:int,coverage:double>>"


def _matcher(docs: DataFrame, block: list[tuple[Any, str]], found_type: str, threshold: float):
    """A column function that finds the block's items, and the broadcast behind it."""
    sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    @pandas_udf(found_type)
    def found(text: pd.Series) -> pd.Series:
        # A worker keeps the index it made last: tasks of one block follow each other.
        cache = worker_cache()
        if cache.get("block") != name:
            cache |= {"block": name, "index": Benchmark(sent.value, threshold=threshold)}
        return pd.Series([cache["index"].search(t) for t in text])

    return found, sent


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS, item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_tiles, covered_tokens, item_tokens, coverage of each contaminated pair.

    Null and empty texts match nothing. Repeated rows give repeated pairs; two
    texts under one item id are two items. No benchmark, no pairs. The pairs of
    a benchmark of several blocks are written block by block.
    """
    kind, whole = _found_type(benchmark, item_col), None
    for blocks, block in benchmark_blocks(benchmark, item_col, block_chars=block_chars):
        found, sent = _matcher(docs, block, kind, threshold)
        part = docs.select(F.col(id_col).alias("doc_id"), F.explode(found(F.col(text_col))).alias("f"))
        if blocks > 1:
            part = cut(part, "contaminations")
            sent.unpersist()
        whole = part if whole is None else whole.unionByName(part)
    if whole is None:
        whole = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array().cast(kind)).alias("f"))
    return whole.select("doc_id", "f.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS, item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, columns unchanged: one filter for each block."""
    kind, clean = _found_type(benchmark, item_col), docs
    for blocks, block in benchmark_blocks(benchmark, item_col, block_chars=block_chars):
        found, sent = _matcher(docs, block, kind, threshold)
        rest = clean.filter(F.size(found(F.col(text_col))) == 0)
        if blocks > 1:
            rest = cut(rest, "clean")
            sent.unpersist()
            if clean is not docs:
                forget(clean)
        clean = rest
    return clean
