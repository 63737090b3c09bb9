"""Token counting. The counter is injected; the default needs no vocabulary."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

Counter = Callable[[str], int]
#: A CJK character, up to four letters of a word, or a mark: one token each.
_PIECE = re.compile(r"[㐀-鿿]|[^\W㐀-鿿]{1,4}|[^\w\s]")
#: The same as a pattern of the engine's own functions.
TOKEN_SQL = r"[\x{3400}-\x{9fff}]|[[\p{L}\p{N}_]&&[^\x{3400}-\x{9fff}]]{1,4}|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
_SPACE, _LETTER, _ALONE = 0, 1, 2


def approximate_tokens(text: str) -> int:
    """One a CJK character or mark, one each started four letters of a word; monotone in prefixes."""
    return len(_PIECE.findall(text))


def _kind(c: str) -> int:
    if c.isspace():
        return _SPACE
    return _LETTER if (c.isalnum() or c == "_") and not "㐀" <= c <= "鿿" else _ALONE


_kinds: list[np.ndarray] = []


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is white space, a letter of a word or a token alone."""
    if not _kinds:
        _kinds.append(np.fromiter((_kind(chr(i)) for i in range(0x10000)), np.uint8, 0x10000))
    out = _kinds[0][np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    out[far] = [_kind(chr(i)) for i in codes[far].tolist()]
    return out


class Ruler:
    """Where the default counter's tokens of a text start, so that any range is measured without reading it again.

    A token's cost falls on its first character. A range that starts within a
    word begins a token there, so the rest of that word is counted anew.
    """

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _kinds_of(self.codes)
        letter = kinds == _LETTER
        begins = letter & ~np.concatenate([[False], letter[:-1]])
        at = np.arange(len(kinds))
        self.word = np.maximum.accumulate(np.where(begins, at, 0))  # start of the word of each letter
        ends = np.where(letter, len(kinds), at)
        self.word_end = np.minimum.accumulate(ends[::-1])[::-1] if len(kinds) else ends
        self.letter = letter
        starts = (kinds == _ALONE) | (letter & ((at - self.word) % 4 == 0))
        self.upto = np.concatenate([[0], np.cumsum(starts)])

    def _head(self, start: int, stop: int) -> tuple[int, int]:
        """End of the word that ``start`` cuts, and its letters' tokens from there; (start, 0) if it cuts none."""
        if start >= len(self.codes) or not self.letter[start] or self.word[start] == start:
            return start, 0
        end = min(stop, int(self.word_end[start]))
        return end, -(-(end - start) // 4)

    def count(self, start: int, stop: int) -> int:
        end, head = self._head(start, stop)
        return head + int(self.upto[stop] - self.upto[end])

    def reach(self, start: int, stop: int, budget: int) -> int:
        """The furthest end at which the range stays within the budget."""
        end, head = self._head(start, stop)
        if head > budget:
            return start + 4 * budget
        # The end of the last token that fits, and what is free behind it.
        return min(stop, max(end, int(np.searchsorted(self.upto, self.upto[end] + budget - head, side="right")) - 1))


class Counted(Ruler):
    """The same for any other counter, which has to read the range."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def count(self, start: int, stop: int) -> int:
        return self.counter(self.text[start:stop])

    def reach(self, start: int, stop: int, budget: int) -> int:
        """The reach is doubled before it is searched, so the work follows the piece, not the text."""
        reach = min(stop, start + max(16, 4 * budget))
        while reach < stop and self.count(start, reach) <= budget:
            reach = min(stop, 2 * reach - start)
        return start + bisect.bisect_right(range(start + 1, reach + 1), budget, key=lambda end: self.count(start, end))


def ruler(text: str, counter: Counter) -> Ruler:
    return Ruler(text) if counter is approximate_tokens else Counted(text, counter)


def token_count(text: Column, count: Counter = approximate_tokens) -> Column:
    """Tokens of a text, 0 for null; the default counter is one pattern and needs no Python."""
    whole = F.coalesce(text, F.lit(""))
    if count is approximate_tokens:
        return F.regexp_count(whole, F.lit(TOKEN_SQL))

    @pandas_udf(T.IntegerType())
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count(t) if t else 0).fillna(0).astype("int32")

    return counted(whole)


def message_tokens(role: Column, content: Column, count: Counter = approximate_tokens) -> Column:
    """Aggregate: tokens of a list of messages, two for the list and four for each."""
    return F.coalesce(F.sum(4 + token_count(role, count) + token_count(content, count)), F.lit(0)) + 2
