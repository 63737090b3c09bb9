"""Text functions as Columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Characters dropped from CJK runs (fixed values).
CJK_STOP = "的了吗呢啊是我你他她它们为请可以和及在对给把个一下这那中"
#: Terms dropped from queries (fixed values).
QUERY_STOP = ["介", "绍", "介绍", "讲", "说", "说明", "请", "请问", "一下", "可以", "能", "不能", "能否", "帮", "帮我"]

#: What a token is, and what is CJK in one (fixed values).
TOKEN_PATTERN = r"[A-Za-z0-9_+#.]+|[\x{4e00}-\x{9fff}]+"
#: An ASCII run from its first to its last character that isn't a dot or low line.
STRIPPED_RUN = r"[A-Za-z0-9+#](?:[A-Za-z0-9_+#.]*[A-Za-z0-9+#])?"
CJK_PATTERN = r"[\x{4e00}-\x{9fff}]"


def _grams(chars: Column) -> Column:
    """Single characters, then pairs of neighbours."""
    pairs = F.when(F.size(chars) > 1, F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat(F.element_at(chars, i), F.element_at(chars, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(chars, pairs)


def tokenize(text: Column) -> Column:
    """Tokens of ASCII runs (lower-cased, stripped of ``._``) and of CJK runs (characters and pairs)."""

    def of(run: Column) -> Column:
        kept = F.filter(F.split(F.translate(run, CJK_STOP, ""), ""), lambda c: c != "")
        ascii_token = F.regexp_replace(F.lower(run), r"^[._]+|[._]+$", "")
        return F.when(run.rlike(CJK_PATTERN), _grams(kept)).when(ascii_token != "", F.array(ascii_token)).otherwise(F.array().cast("array<string>"))

    whole = F.coalesce(text, F.lit(""))
    # Without CJK the stripped runs are one expression; no function runs for each token.
    plain = F.array_join(F.regexp_extract_all(whole, F.lit(STRIPPED_RUN), F.lit(0)), " ")
    fast = F.array_remove(F.split(F.lower(plain), " "), "")
    return F.when(whole.rlike(CJK_PATTERN), F.flatten(F.transform(F.regexp_extract_all(whole, F.lit(TOKEN_PATTERN), F.lit(0)), of))).otherwise(fast)


_RUN = re.compile("[A-Za-z0-9_+#.]+|[一-鿿]+")


def tokens_of(text: str | None) -> list[str]:
    """What ``tokenize`` makes of one text, for functions that run in Python anyway."""
    out: list[str] = []
    for run in _RUN.findall(text or ""):
        if run[0] < "一":
            token = run.lower().strip("._")
            if token:
                out.append(token)
        else:
            chars = [c for c in run if c not in CJK_STOP]
            out += chars
            out += [a + b for a, b in zip(chars, chars[1:])]
    return out


def query_terms(text: Column) -> Column:
    """Distinct tokens without the query stop terms."""
    return F.array_except(F.array_distinct(tokenize(text)), F.array(*map(F.lit, QUERY_STOP)))


def builder_tokens(text: Column) -> Column:
    """Distinct ASCII words of two or more characters, and pairs over all CJK characters, gaps ignored."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9]{2,}"), F.lit(0))
    # The look-ahead gives the pair at each character in one pass; a lambda would extract the characters anew for each pair.
    pairs = F.regexp_extract_all(F.regexp_replace(low, r"[^\x{3400}-\x{9fff}]+", ""), F.lit("(?=(..))"), F.lit(1))
    return F.array_distinct(F.when(low.rlike(r"[\x{3400}-\x{9fff}]"), F.concat(words, pairs)).otherwise(words))


def overlap_score(doc_tokens: Column, query_tokens: Column) -> Column:
    """Shared tokens over the root of the document's."""
    return F.size(F.array_intersect(doc_tokens, query_tokens)) / F.sqrt(F.greatest(F.lit(1), F.size(doc_tokens)))


@pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_lines(text: Column) -> Column:
    """Line ends unified, white space collapsed in each line, blank lines dropped."""
    lines = F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != ""), "\n")


def normalize_text(text: Column) -> Column:
    """NFKC, then ``normalize_lines``. NFKC has no built-in, so it takes Python."""
    return normalize_lines(_nfkc(text))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 24 hex digits of the parts' digest."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"</?[A-Za-z][^>]*>")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset in code points."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def source_type(name: Column) -> Column:
    """A file type as it is compared: trimmed, lower case, without leading dots."""
    return F.regexp_replace(F.lower(F.trim(name)), r"^\.+", "")


def snippet(text: Column, limit: int = 160) -> Column:
    """White space collapsed; beyond the limit cut, right-trimmed and marked."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")
    return F.when(F.length(flat) > limit, F.concat(F.regexp_replace(F.substring(flat, 1, limit), r"(?U)\s+$", ""), F.lit("..."))).otherwise(flat)


def model_json(text: Column, key: str) -> Column:
    """The one string value of a model's JSON answer; null if it is anything else."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)^.*</think>", ""), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    keys = F.json_object_keys(bare)
    value = F.trim(F.get_json_object(bare, f"$.{key}"))
    return F.when((F.size(keys) == 1) & (F.element_at(keys, 1) == key) & (value != ""), value)
