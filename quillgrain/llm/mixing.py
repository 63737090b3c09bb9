"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source has a target in words, its share of a budget by weight; no target
passes ``cap`` times its source, what it can't take is shared again by weight.

Within a source a document is due a number of copies by its size class: class k
holds sizes from 16^k, and its copies are in proportion to 2^k (about the fourth
root of the size), up to ``cap``, so that the copies' words make the target. The
whole part of these copies is certain. The fraction p is an inclusion
probability: documents are ranked by their random odds u / (1 - u) over their
inclusion odds p / (1 - p), and taken in that order up to the words that whole
copies leave (the cut is the one nearest to it).

Ranks need no sort of a source: ranks fall into cells, cells are summed, the cell
with the cut is divided again, and only its few rows are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, unused, word_count

#: A cell is divided in so many, ``MOST_DEPTH`` times at most.
CELLS = 4096
MOST_DEPTH = 4
#: Rows of a source that may be put in order.
EDGE_ROWS = 2000


class Plan(NamedTuple):
    """``classes`` has source, k, source_size, target, whole, chance; ``cuts`` source, rest, cell, before; cells are of ``depth``."""

    classes: DataFrame
    cuts: DataFrame
    depth: int
    edge_rows: int


def random_key(id_col: str, text_col: str, seed: int) -> Column:
    """u in (0, 1) of a row, from the digest of seed, id and text: reruns agree."""
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return (F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def size_class(size: Column) -> Column:
    return F.floor((F.length(F.bin(size)) - 1) / 4).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """From (source, source_size): target of each source.

    Sources take the weights in turn, in order of code point, null last. The
    level (words a unit of weight) rises until no source below its limit would
    pass it; each step is one aggregate, so any number of sources will do.
    """
    ordered = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    turn = F.pmod(F.col("turn"), F.lit(len(weights)))
    weighed = numbered(ordered, [], "turn", "mix-sources").withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    weighed = weighed.select("source", "source_size", "weight", (F.col("source_size") * F.lit(float(cap))).alias("most"))
    budget = (weighed.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    full, left, open_weight = F.lit(False), budget, -1.0
    while True:
        taken, weight = weighed.agg(F.sum(F.when(full, F.col("most")).otherwise(F.lit(0.0))), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight")))).first()
        left, before, open_weight = budget - (taken or 0.0), open_weight, weight or 0.0
        if open_weight in (before, 0.0):
            break
        full = full | (F.col("most") * F.lit(open_weight) <= F.col("weight") * F.lit(left))
    level = left / open_weight if open_weight else 0.0
    return weighed.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def due_copies(classes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(source, k, words) to source, k, source_size, target, whole, chance: what a document of the class is due.

    Classes are filled from the greatest weight down: one is full if the level
    that the words left allow would give it ``cap`` copies or more. A source has
    a handful of classes.
    """
    weight = F.pow(F.lit(2.0), F.col("k"))
    of = targets.select(F.col("source").alias("of"), "source_size", "target")
    own = Window.partitionBy("source")
    earlier = own.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    weighed = classes.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("weight", weight).withColumn("load", F.col("weight") * F.col("words"))
    levels = (
        weighed.withColumn("left", F.col("target") - F.lit(float(cap)) * F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .withColumn("open", F.sum("load").over(own) - F.coalesce(F.sum("load").over(earlier), F.lit(0.0)))
        .withColumn("full", F.col("weight") * F.col("left") >= F.lit(float(cap)) * F.col("open"))
    )
    level = F.max(F.when(~F.col("full"), F.col("left") / F.col("open"))).over(own)
    copies = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.col("weight") * level)
    whole = F.floor(F.col("copies") + F.lit(1e-9)).cast("int")
    part = F.col("copies") - F.col("whole")
    due = levels.withColumn("copies", copies).withColumn("whole", whole)
    return due.select("source", "k", "words", "source_size", "target", "whole", F.when(part < 1e-9, F.lit(0.0)).otherwise(F.least(part, F.lit(1 - 1e-9))).alias("chance"))


def pareto_rank(u: Column, chance: Column) -> Column:
    """Pareto's ranking variable q, as q / (1 + q), which lies in (0, 1); ``chance`` is above 0."""
    q = (u / (1 - u)) / (chance / (1 - chance))
    return q / (1 + q)


def _cell(rank: Column, depth: int) -> Column:
    """Cell of a rank; a cell of one depth is ``CELLS`` of the next one."""
    return F.floor(rank * F.lit(float(CELLS**depth)))


def _first_over(cells: DataFrame, rests: DataFrame) -> DataFrame:
    """source, rest, cell, before, rows: each source's first cell at whose end more words than its rest are reached.

    ``rests`` has source, rest and before, the words in front of these cells; a source has at most ``CELLS``.
    """
    of = rests.select(F.col("source").alias("of"), "rest", F.col("before").alias("base"))
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    over = cells.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("upto", upto).filter("upto > rest")
    return over.groupBy("source", "rest").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"), "rows"), "cell").alias("c")).select("source", "rest", "c.*")


def _ranked(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (source, size, u, ...) with mix_k, source_size, target, whole, chance and mix_rank (null without a chance)."""
    of = classes.select(F.col("source").alias("mix_of"), F.col("k").alias("mix_of_k"), "source_size", "target", "whole", "chance")
    joined = rows.join(of, F.col("source").eqNullSafe(F.col("mix_of")) & (size_class(F.col("size")) == F.col("mix_of_k"))).drop("mix_of", "mix_of_k")
    return joined.withColumn("mix_rank", F.when(F.col("chance") > 0, pareto_rank(F.col("u"), F.col("chance"))))


def plan_mix(rows: DataFrame, weights: Sequence[float], share: float = 1.5, cap: float = 2.0) -> Plan:
    """What each size class of each source is due, and where each source's sample is cut. All rows count.

    ``rows`` has source, size (words) and u. Sources of one class table fit in
    memory only by their number times a handful; they are joined, not collected.
    """
    classes = cut(rows.groupBy("source", size_class(F.col("size")).alias("k")).agg(F.sum("size").cast("long").alias("words")), "mix-classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    due = cut(due_copies(classes, source_targets(sizes, weights, share, cap), cap), "mix-due")
    rest = F.max("target") - F.sum(F.col("whole") * F.col("words"))
    cuts = cut(due.groupBy("source").agg(F.greatest(F.lit(0.0), rest).alias("rest")).withColumn("before", F.lit(0).cast("long")), "mix-rests")
    drawn = _ranked(rows.select("source", "size", "u"), due).filter(F.col("mix_rank").isNotNull())
    for depth in range(1, MOST_DEPTH + 1):
        inside = drawn
        if depth > 1:
            of = cuts.select(F.col("source").alias("of"), F.col("cell").alias("outer"))
            inside = drawn.join(of, F.col("source").eqNullSafe(F.col("of")) & (_cell(F.col("mix_rank"), depth - 1) == F.col("outer"))).drop("of", "outer")
        cells = inside.groupBy("source", _cell(F.col("mix_rank"), depth).alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        cuts = cut(_first_over(cells, cuts), "mix-cuts")
        most = cuts.agg(F.max("rows")).first()[0] or 0
        if most <= EDGE_ROWS:
            break
    return Plan(due, cuts, depth, most)


def apply_mix(rows: DataFrame, plan: Plan, tie_break: Sequence[str]) -> DataFrame:
    """``rows`` (source, size, u, ...) with source_size, target and copies.

    The plan has a handful of rows a source; a source's rows are only ordered
    within its cut cell. Should more rows than fit one task have one rank, they
    are equal, and which of them are taken makes no difference.
    """
    kept = [*rows.columns, "source_size", "target"]
    ranked = _ranked(rows, plan.classes)
    of = plan.cuts.select(F.col("source").alias("mix_of"), F.col("rest").alias("mix_rest"), F.col("cell").alias("mix_cut"), F.col("before").alias("mix_before"))
    joined = ranked.join(of, F.col("source").eqNullSafe(F.col("mix_of")), "left").drop("mix_of").withColumn("mix_cell", _cell(F.col("mix_rank"), plan.depth))
    # Without a cell that passes the rest, all that have a chance are taken.
    drawn = F.col("mix_rank").isNotNull() & F.coalesce(F.col("mix_cell") < F.col("mix_cut"), F.lit(True))
    at_edge = F.coalesce(F.col("mix_cell") == F.col("mix_cut"), F.lit(False))
    clear = joined.filter(~at_edge).select(*kept, (F.col("whole") + drawn.cast("int")).alias("copies"))
    edge = joined.filter(at_edge)
    if plan.edge_rows <= EDGE_ROWS:
        order = Window.partitionBy("source").orderBy("mix_rank", "u", *tie_break).rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.withColumn("mix_upto", F.col("mix_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    else:
        edge = numbered(edge, ["source"], "mix_number", "mix-equal").withColumn("mix_upto", F.col("mix_before") + F.col("mix_number") * F.col("size"))
    taken = 2 * F.col("mix_upto") + F.col("size") <= 2 * F.col("mix_rest")
    return clear.union(edge.select(*kept, (F.col("whole") + taken.cast("int")).alias("copies")))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    Null and blank texts have size 0 and take nothing. Sources without words get
    target 0. Repeated rows are rows of their own. An empty table gives no rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_key(id_col, text_col, seed).alias("u")), "mix-rows")
    mixed = apply_mix(rows, plan_mix(rows, weights, share, cap), ["doc_id", "size"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, columns unchanged.

    Texts are never shuffled but in the cells where a source's cut lies.
    """
    names = {n: unused(docs, "mix_" + n) for n in ("all", "copy")}
    inner = docs.select(F.struct(*docs.columns).alias(names["all"]), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_key(id_col, text_col, seed).alias("u"))
    plan = plan_mix(cut(inner.select("source", "size", "u"), "mix-sizes"), weights, share, cap)
    # A sort can't order by maps; the digest behind u already holds id and text.
    mixed = apply_mix(inner, plan, ["size"]).filter("copies > 0")
    return mixed.select(names["all"], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(names["copy"])).select(f"{names['all']}.*")
