"""Document quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a rejecting predicate over counts of the text; a count is made where a
rule asks for it, so what lies behind the first rejection is never computed. One
job over a bounded sample times every rule on every sampled text and counts how
many documents it rejects; rules are then tried in order of rejection per cost.
The verdict is a conjunction, so the order changes the work, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from statistics import median
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
SAMPLE_ROWS = 2000
SAMPLE_ONE_IN = 64
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

Counts = Mapping[str, Column]


class Rule(NamedTuple):
    """``rejects`` takes the counts by name (see ``counts``)."""

    name: str
    rejects: Callable[[Counts], Column]


def repeated_words(tokens: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the array.

    Windows are hashed; only if some hash comes twice are (hash, position) pairs
    sorted, equal neighbours kept, and the covered positions counted.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            hit = F.filter(s, lambda p, k: same(F.get(s, k - 1), p) | same(F.get(s, k + 1), p))
            return F.sort_array(F.transform(hit, lambda p: p["i"]))

        def span(at: Column) -> Column:
            widths = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(pairs, lambda s: let(twice(s), span))

    def of(tokens: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return let(tokens, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(of(w)))


def line_counts(text: Column) -> Column:
    """struct<n_lines, n_dup_lines>: lines with a word, and those equal to an earlier one."""
    own = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(own, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def counts(w: Column, text: Column) -> dict[str, Column]:
    """Every count as an expression of its own over the words and the text; unused ones cost nothing."""
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        "lines": line_counts(text),
        "n_repeat_words": repeated_words(w),
        "n_stutters": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long"),
        "n_marks": F.regexp_count(text, F.lit("!")),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
    }


def base_rules() -> list[Rule]:
    return [
        Rule("too_short", lambda m: m["n_words"] < 10),
        Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ]


def more_rules() -> list[Rule]:
    """The rules beside the base ones; all ratios are taken over the whole text."""
    return [
        Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
        Rule("repeated_lines", lambda m: let(m["lines"], lambda x: 2 * x["n_dup_lines"] > x["n_lines"])),
        Rule("stutter", lambda m: 10 * m["n_stutters"] > 3 * m["n_words"]),
        Rule("word_length", lambda m: let(m["word_chars"], lambda n: (n < 2 * m["n_words"]) | (n > 20 * m["n_words"]))),
        Rule("shouting", lambda m: 2 * m["n_marks"] > m["n_words"]),
        Rule("letters", lambda m: 2 * m["n_letters"] < m["word_chars"]),
    ]


def _now() -> Column:
    return F.java_method(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


class Estimate(NamedTuple):
    """Of a rule on the sample: nanoseconds of a text (median) and share of rejected texts."""

    nanoseconds: float
    rejected: float


def estimates(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> dict[str, Estimate]:
    """Each rule timed and tried on a sample of ``docs`` (plain documents).

    At most ``SAMPLE_ROWS`` rows, taken from one row in ``SAMPLE_ONE_IN`` by a
    hash of the text. A text goes through the rules one after the other, with
    the clock read between them, inside one expression.
    """
    text = F.col("t")

    def timed(w: Column) -> Column:
        m, fields = counts(w, text), [_now().alias("c0")]
        for i, r in enumerate(rules):
            fields += [F.coalesce(r.rejects(m), F.lit(False)).alias(f"r{i}"), _now().alias(f"c{i + 1}")]
        return F.struct(*fields)

    sample = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE_ONE_IN)) == 0).select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # Partitions are read one after the other until there are enough rows; only clocks and verdicts leave the executors.
    rows = [r.x for r in sample.select(let(words(text), timed).alias("x")).head(SAMPLE_ROWS)]
    if not rows:
        return {r.name: Estimate(1.0, 0.0) for r in rules}
    return {r.name: Estimate(max(1.0, median(x[f"c{i + 1}"] - x[f"c{i}"] for x in rows)), sum(x[f"r{i}"] for x in rows) / len(rows)) for i, r in enumerate(rules)}


def order_rules(rules: Sequence[Rule], found: Mapping[str, Estimate]) -> list[Rule]:
    """Rules by rejected documents per cost, cheaper ones first among equals."""
    return sorted(rules, key=lambda r: (-found[r.name].rejected / found[r.name].nanoseconds, found[r.name].nanoseconds, r.name))


def cascade(rules: Sequence[Rule], m: Counts) -> Column:
    """Name of the first rule, in the given order, that rejects; null if none does. Later rules are then not computed."""
    chain = F.when(F.lit(False), F.lit(""))
    for r in rules:
        chain = chain.when(r.rejects(m), F.lit(r.name))
    return chain


def judge_documents(docs: DataFrame, rules: Sequence[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every row.

    The counts are results, so they are made for every row and rules read them;
    the other rules are tried in order, for rows that the base rules pass.
    Null, empty and blank texts have no words and fail. Repeated rows are judged
    each. An empty table gives no rows.
    """
    rules = more_rules() if rules is None else rules
    ordered = order_rules(rules, estimates(docs, rules, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def judged(w: Column) -> Column:
        lazy = counts(w, text)
        made = F.struct(*(lazy[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "lines")))

        def verdict(c: Column) -> Column:
            m = lazy | {n: c[n] for n in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "lines")}
            base = cascade(base_rules(), m).isNotNull()
            shown = [(c["lines"]["n_dup_lines"] if n == "n_dup_lines" else c[n]).alias(n) for n in COUNTS]
            return let(base, lambda failed: F.struct(*shown, failed.alias("base_failed"), F.when(failed, False).otherwise(cascade(ordered, m).isNull()).alias("kept")))

        return let(made, verdict)

    # One expression a row, so plans can't compute a count twice.
    return docs.select(F.col(id_col).alias("doc_id"), let(words(text), judged).alias("j")).select("doc_id", *(F.col("j")[n].alias(n) for n in [*COUNTS, "base_failed", "kept"]))


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged; a filter without a shuffle.

    Base rules are ordered among the others, and a rejected text costs no more
    than the rules up to the one that rejects it.
    """
    rules = [*base_rules(), *more_rules()] if rules is None else rules
    ordered = order_rules(rules, estimates(docs, rules, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.filter(let(words(text), lambda w: cascade(ordered, counts(w, text)).isNull()))
