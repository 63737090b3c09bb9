"""Citation markers in answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cited_indexes(answer: Column) -> Column:
    """Distinct [n] markers in order of first use."""
    return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: F.length(x) < 10), lambda x: x.cast("int")))


def valid_indexes(indexes: Column, n_evidence: Column) -> Column:
    return F.filter(indexes, lambda i: (i >= 1) & (i <= n_evidence))


def citations(answer: Column, evidence: Column) -> Column:
    """Evidence structs that the answer cites, each with its citation_index."""
    return F.transform(valid_indexes(cited_indexes(answer), F.size(evidence)), lambda i: F.struct(i.alias("citation_index"), F.element_at(evidence, i).alias("evidence")))


def average_score(scores: Column) -> Column:
    """Mean to four digits; 0 if there is none."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    return F.round(F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(0.0), 4)


def scrub_markers(answer: Column, confirmed: Column, mark: str = "") -> Column:
    """Replace the confirmed markers only; others may be text."""
    return F.aggregate(confirmed, answer, lambda s, i: F.replace(s, F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.lit(mark)))


def render_prompt(evidence: Column) -> Column:
    """``[i] name / path`` and content of each evidence struct (name, path, content), blank lines between."""
    block = lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.concat_ws(" / ", e["name"], F.nullif(e["path"], F.lit(""))), F.lit("\n"), e["content"])
    return F.array_join(F.transform(evidence, block), "\n\n")
