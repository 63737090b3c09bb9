"""Turns, history windows, sessions and idempotent requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionise(messages: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """``messages`` with turn_no: each user message starts a turn; what comes before the first is dropped.

    Only user and assistant messages with text count.
    """
    clean = messages.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    turn = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy(conv).orderBy(order))
    return clean.withColumn("turn_no", turn.cast("long")).filter("turn_no > 0")


def turn_sizes(messages: DataFrame, size: Column, conv: str = "conv_id") -> DataFrame:
    return sessionise(messages, conv).groupBy(conv, "turn_no").agg(F.sum(size).cast("long").alias("size"))


def recent_turns(turns: DataFrame, budget: int, max_turns: int | None = None, at_least_one: bool = True, conv: str = "conv_id") -> DataFrame:
    """The latest whole turns within a budget: from the end, up to the first that doesn't fit.

    Running sums only grow, so a filter on them stops where the walk would.
    """
    back = Window.partitionBy(conv).orderBy(F.desc("turn_no"))
    placed = turns.withColumn("used", F.sum("size").over(back)).withColumn("age", F.row_number().over(back))
    fits = F.col("used") <= budget
    if at_least_one:
        fits = fits | (F.col("age") == 1)
    if max_turns is not None:
        fits = fits & (F.col("age") <= max_turns)
    return placed.filter(fits).drop("used")


def latest(log: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row of each key of an append log."""
    newest = F.max_by(F.struct(*columns), F.struct(order, *columns))
    return log.groupBy(key).agg(newest.alias("last")).select(key, "last.*")


def begin_requests(requests: DataFrame) -> DataFrame:
    """(owner, request_id, fingerprint, seq) with the outcome of each arrival.

    The first arrival of a key starts it, later ones replay it if they say the
    same and conflict if they don't.
    """
    first = F.first("fingerprint").over(Window.partitionBy("owner", "request_id").orderBy("seq"))
    place = F.row_number().over(Window.partitionBy("owner", "request_id").orderBy("seq"))
    return requests.withColumn("outcome", F.when(place == 1, "started").when(F.col("fingerprint") == first, "replayed").otherwise("conflict"))


def lease_outcome(fingerprint_matches: Column, status: Column, updated: Column, now: Column, lease_seconds: int = 900) -> Column:
    """Outcome of a request that already has a row."""
    held = (now.cast("double") - updated.cast("double")) < lease_seconds
    return F.when(~fingerprint_matches, "conflict").when(status == "done", "replayed").when((status == "pending") & held, "busy").otherwise("taken_over")


def read_outcome(found: Column, owned: Column, expires: Column, now: Column) -> Column:
    """404 before 403 before 410."""
    return F.when(~found, 404).when(~owned, 403).when(expires <= now, 410).otherwise(200)


def completion_state(finish_reason: Column) -> Column:
    return F.when(F.coalesce(finish_reason, F.lit("stop")).isin("stop", "end_turn"), "answered").otherwise("incomplete")


def storage_bytes(rows: DataFrame, key: str, payload: str) -> DataFrame:
    return rows.groupBy(key).agg(F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).cast("long").alias("bytes"))


def working_turns(turns: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Answered turns that their session's summary doesn't hold yet (turns: seq, status; sessions: summarized_through)."""
    through = sessions.select(session, F.coalesce("summarized_through", F.lit(0)).alias("through"))
    return turns.join(through, session).filter((F.col("seq") > F.col("through")) & (F.col("status") == "answered")).drop("through")


def history_within(turns: DataFrame, max_turns: int, token_budget: int, byte_budget: int, conv: str = "conv_id") -> DataFrame:
    """(conv, turn_no, tokens, bytes): the latest whole turns, at most ``max_turns``, within both budgets; none if the last one doesn't fit."""
    back = Window.partitionBy(conv).orderBy(F.desc("turn_no"))
    placed = turns.withColumn("used_tokens", F.sum("tokens").over(back)).withColumn("used_bytes", F.sum("bytes").over(back)).withColumn("age", F.row_number().over(back))
    return placed.filter((F.col("age") <= max_turns) & (F.col("used_tokens") <= token_budget) & (F.col("used_bytes") <= byte_budget)).drop("used_tokens", "used_bytes")
