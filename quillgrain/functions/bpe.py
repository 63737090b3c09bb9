"""Token counts of a byte-pair vocabulary, which is injected as a table of tokens and ranks.

A text is cut into pieces by a pattern; within a piece the neighbours whose
union has the least rank are joined, the leftmost first, until none has one.
Neighbours wait in a heap, so a piece of n bytes takes n log n steps however
long it is.
"""

from __future__ import annotations

import heapq

import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: How a text is cut into pieces unless another pattern is given (fixed value).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose count a worker remembers, of at most so many characters.
REMEMBERED, SHORT = 1 << 17, 32


def joined(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece; bytes that no rank joins stay alone."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int) -> tuple[int, int, int] | None:
        """Rank, place and end of the token at i and its successor."""
        if after[i] >= n:
            return None
        end = after[after[i]]
        rank = ranks.get(piece[i:end])
        return None if rank is None else (rank, i, end)

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        # Stale if either token has been joined with another since.
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        gone = after[i]
        alive[gone] = False
        after[i] = end
        if end < n:
            before[end] = i
        for j in (i, before[i]):
            if j >= 0 and (p := pair(j)):
                heapq.heappush(heap, p)
    starts = [i for i in range(n) if alive[i]]
    return [piece[a:b] for a, b in zip(starts, [*starts[1:], n])]


class BytePairCounter:
    """A counter of tokens for every operator that takes one; null and empty texts have none.

    It travels as a broadcast of the vocabulary, which a worker reads once, and
    remembers the counts of short pieces as long as the worker lives.
    """

    def __init__(self, ranks: Broadcast, pattern: str = PIECES):
        self.ranks, self.pattern = ranks, pattern
        self._pieces, self._known = None, {}

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "_pieces": None, "_known": {}}

    def __call__(self, text: str | None) -> int:
        if self._pieces is None:
            self._pieces = regex.compile(self.pattern)
        return sum(map(self._count, self._pieces.findall(text or "")))

    def _count(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            # A character without a UTF-8 form counts as the one that stands for it.
            raw = piece.encode("utf-8", "replace")
            ranks = self.ranks.value
            n = 1 if raw in ranks else len(joined(raw, ranks))
            if len(piece) <= SHORT:
                if len(self._known) >= REMEMBERED:
                    self._known.clear()
                self._known[piece] = n
        return n


def byte_pair_counter(vocabulary: DataFrame, pattern: str = PIECES, most_tokens: int = 1_000_000) -> BytePairCounter:
    """A counter from rows (token binary, rank int); a larger vocabulary than ``most_tokens``, repeated tokens and missing bytes raise."""
    rows = vocabulary.select("token", "rank").limit(most_tokens + 1).collect()
    ranks = {bytes(r.token): r.rank for r in rows}
    if len(rows) > most_tokens:
        raise ValueError(f"the vocabulary has more than {most_tokens} tokens")
    if len(ranks) < len(rows):
        raise ValueError("the vocabulary repeats a token")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks a single byte")
    return BytePairCounter(vocabulary.sparkSession.sparkContext.broadcast(ranks), pattern)


def read_vocabulary(spark, path: str) -> DataFrame:
    """(token, rank) of a file of lines 'base64 rank'."""
    return spark.read.text(path).filter("trim(value) <> ''").selectExpr("unbase64(split(value, ' ')[0]) AS token", "int(split(value, ' ')[1]) AS rank")
