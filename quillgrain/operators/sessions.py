"""Sessions and requests as tables, and the replay of a commit log through keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_SECONDS = 30 * 24 * 3600
MAX_TURNS = 2000
MAX_BYTES = 16 * 1024 * 1024


def replay_commits(events: DataFrame, max_turns: int = MAX_TURNS, max_bytes: int = MAX_BYTES, ttl: int = TTL_SECONDS) -> DataFrame:
    """(session_id, seq, expected_version, bytes, at) to the session's version, turns, bytes, expiry and refusals.

    A commit counts if its version is the current one, the session hasn't
    expired and capacity holds; it adds a turn, raises the version and renews
    the expiry. Rows of one session go through keyed state in the order of seq.
    """
    from ..streaming.sessions import session_states

    kind = events.schema["session_id"].dataType
    found = session_states(events.withColumn("op", F.lit("turn")), ttl=ttl, max_turns=max_turns, max_bytes=max_bytes)
    return found.filter("outcome = 'state'").select(F.col("session_id").cast(kind).alias("session_id"), "version", "turns", "bytes", "expires", "conflicts", "expired", "full")


def compact_ok(through: Column, covered: Column, n_turns: Column, summary: Column) -> Column:
    """Coverage never shrinks nor passes the turns; what it newly covers needs a summary."""
    return (through >= covered) & (through <= n_turns) & ((through == covered) | (F.trim(F.coalesce(summary, F.lit(""))) != ""))


def abandon(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """(owner, request_id, token, status) with pending requests failed whose own token gives them up."""
    own = tokens.select("owner", "request_id", F.col("token").alias("given"))
    given = F.coalesce((F.col("status") == "pending") & (F.col("token") == F.col("given")), F.lit(False))
    return requests.join(own, ["owner", "request_id"], "left").withColumn("status", F.when(given, "failed").otherwise(F.col("status"))).drop("given")


def live(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("expires") > now)


def create(sessions: DataFrame, wanted: DataFrame, now: Column, capacity: int, ttl: int = TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """The sessions after expired ones are purged and ``wanted`` (session_id, owner) are added while there is room, and what became of each.

    New sessions have version 0 and expire ``ttl`` seconds from ``now`` (seconds).
    Room goes by session id. An id that is there already is refused as a conflict.
    """
    kept = live(sessions, now)
    fresh = wanted.join(kept.select("session_id"), "session_id", "left_anti").dropDuplicates(["session_id"])
    room = max(0, capacity - kept.count())
    added = fresh.orderBy("session_id").limit(room)
    rows = added.select("session_id", "owner", F.lit(0).cast("long").alias("version"), (now.cast("double") + ttl).alias("expires"))
    outcome = wanted.join(added.select("session_id", F.lit(True).alias("made")), "session_id", "left").join(fresh.select("session_id", F.lit(True).alias("fresh")), "session_id", "left")
    said = F.when(F.col("made"), "created").when(F.col("fresh"), "capacity_reached").otherwise("conflict")
    return kept.unionByName(rows, allowMissingColumns=True), outcome.select("session_id", said.alias("outcome"))


def commit_outcome(expires: Column, now: Column, version: Column, expected: Column, request_status: Column, request_token: Column, token: Column) -> Column:
    """Whether a turn may be committed: its session lives, the version is the expected one, and its own pending request still holds the token."""
    return (
        F.when(expires <= now, "expired")
        .when(~version.eqNullSafe(expected), "version_conflict")
        .when(~request_status.eqNullSafe(F.lit("pending")), "request_not_pending")
        .when(~request_token.eqNullSafe(token), "token_lost")
        .otherwise("committed")
    )


def begin(requests: DataFrame, arrivals: DataFrame, now: Column, lease_seconds: int = 900) -> tuple[DataFrame, DataFrame]:
    """The request table after one batch of arrivals, and the outcome of each.

    requests: owner, request_id, fingerprint, status, updated, token, result;
    arrivals: owner, request_id, fingerprint, token, at most one a key. A new key
    starts pending under its token; a finished one gives back its result; a
    pending one is busy while its lease holds and is taken over after it; an
    arrival that says something else is a conflict.
    """
    from .conversation import lease_outcome

    a = arrivals.select("owner", "request_id", F.col("fingerprint").alias("said"), F.col("token").alias("given"))
    both = a.join(requests, ["owner", "request_id"], "left")
    outcome = F.when(F.col("status").isNull(), "started").otherwise(lease_outcome(F.col("said") == F.col("fingerprint"), F.col("status"), F.col("updated"), now, lease_seconds))
    judged = both.withColumn("outcome", outcome)
    takes = judged.filter(F.col("outcome").isin("started", "taken_over"))
    held = takes.select("owner", "request_id", F.col("said").alias("fingerprint"), F.lit("pending").alias("status"), now.cast("long").alias("updated"), F.col("given").alias("token"), F.lit(None).cast(requests.schema["result"].dataType).alias("result"))
    rest = requests.join(held.select("owner", "request_id"), ["owner", "request_id"], "left_anti")
    return rest.unionByName(held.select(*requests.columns)), judged.select("owner", "request_id", "outcome", F.when(F.col("outcome") == "replayed", F.col("result")).alias("result"))
