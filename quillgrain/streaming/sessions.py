"""Sessions and their requests as keyed state, over a stream of operations or over a log of them.

A session's state is one value (owner, version, turns, bytes, expiry, counts of
refusals) and a map of its requests (fingerprint, token, status, time). An
operation reads and writes its own request only, and rows come in batches, so
memory doesn't follow the length of a session. In a stream a timer drops the
state of a session when it expires.

Operations (op) and their outcomes:

* create (owner): created, conflict if a live session is there;
* begin (owner, request_id, fingerprint, token): started; of a request that is
  there: conflict if the fingerprint differs, replayed if it is done, busy while
  its lease holds, else taken_over by the new token; capacity_reached;
* commit (owner, request_id, token, expected_version, bytes): committed if the
  version is the expected one and the pending request holds the token, else
  conflict; full if turns or bytes pass their limit. It renews the expiry;
* abandon (request_id, token): abandoned if the pending request holds the token, else ignored;
* turn (expected_version, bytes): a commit of a log that knows neither owners nor requests; the first one makes the session.

create and turn aside: not_found, then forbidden for another owner, then expired.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPERATIONS = "session_id string, seq long, op string, at double, owner string, request_id string, fingerprint string, token string, expected_version long, bytes long"
OUTCOMES = "session_id string, seq long, outcome string, version long, turns long, bytes long, expires double, conflicts long, expired long, full long"
STATE = "owner string, version long, turns long, bytes long, expires double, conflicts long, expired long, full long, requests long"
FIELDS = [f.split()[0] for f in STATE.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    def __init__(self, ttl: float, lease: float, max_turns: int, max_bytes: int, max_requests: int, timed: bool):
        self.ttl, self.lease, self.max_turns, self.max_bytes, self.max_requests, self.timed = ttl, lease, max_turns, max_bytes, max_requests, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE)
        self.requests = handle.getMapState("requests", "request_id string", "fingerprint string, token string, status string, updated double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = dict(zip(FIELDS, self.session.get())) if self.session.exists() else None
        before = now and now["expires"]
        for batch in rows:
            out = []
            for e in batch.sort_values("seq", kind="stable").astype(object).where(batch.notna(), None).to_dict("records"):
                now, outcome = self._step(now, e)
                out.append(self._row(key[0], e["seq"], outcome, now))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOMES.split(", ")])
        if now is not None:
            self.session.update(tuple(now[f] for f in FIELDS))
            if self.timed and now["expires"] != before and now["expires"] is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(int(now["expires"] * 1000))
        yield pd.DataFrame([self._row(key[0], None, "state", now)], columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.session.clear()
        self.requests.clear()
        yield pd.DataFrame([self._row(key[0], None, "dropped", None)], columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: str, seq: int | None, outcome: str, now: dict | None) -> tuple:
        return (key, seq, outcome, *((now[c] for c in ("version", "turns", "bytes", "expires", "conflicts", "expired", "full")) if now else [None] * 7))

    def _new(self, owner: str | None, expires: float | None) -> dict:
        return dict(zip(FIELDS, (owner, 0, 0, 0, expires, 0, 0, 0, 0)))

    def _step(self, now: dict | None, e: dict) -> tuple[dict | None, str]:
        op, at = e["op"], e["at"]
        over = now is not None and now["expires"] is not None and at >= now["expires"]
        if op == "create":
            if now is not None and not over:
                return now, "conflict"
            self.requests.clear()
            return self._new(e["owner"], at + self.ttl), "created"
        if op == "turn":
            now = now or self._new(None, None)
        elif now is None:
            return now, "not_found"
        elif op != "abandon" and now["owner"] != e["owner"]:
            return now, "forbidden"
        if over:
            return now | {"expired": now["expired"] + 1}, "expired"
        if op == "turn":
            return self._commit(now, e)
        return getattr(self, "_" + op)(now, e)

    def _request(self, e: dict) -> dict | None:
        key = (e["request_id"],)
        return dict(zip(("fingerprint", "token", "status", "updated"), self.requests.getValue(key))) if self.requests.containsKey(key) else None

    def _keep(self, e: dict, fingerprint: str, token: str, status: str) -> None:
        self.requests.updateValue((e["request_id"],), (fingerprint, token, status, e["at"]))

    def _begin(self, now: dict, e: dict) -> tuple[dict, str]:
        held = self._request(e)
        if held is None:
            if now["requests"] >= self.max_requests:
                return now, "capacity_reached"
            self._keep(e, e["fingerprint"], e["token"], "pending")
            return now | {"requests": now["requests"] + 1}, "started"
        if held["fingerprint"] != e["fingerprint"]:
            return now, "conflict"
        if held["status"] == "done":
            return now, "replayed"
        if held["status"] == "pending" and e["at"] - held["updated"] < self.lease:
            return now, "busy"
        self._keep(e, e["fingerprint"], e["token"], "pending")
        return now, "taken_over"

    def _commit(self, now: dict, e: dict) -> tuple[dict, str]:
        held = self._request(e) if e["op"] == "commit" else None
        holds = e["op"] == "turn" or (held is not None and held["status"] == "pending" and held["token"] == e["token"])
        if e["expected_version"] != now["version"] or not holds:
            return now | {"conflicts": now["conflicts"] + 1}, "conflict"
        if now["turns"] + 1 > self.max_turns or now["bytes"] + e["bytes"] > self.max_bytes:
            return now | {"full": now["full"] + 1}, "full"
        if held is not None:
            self._keep(e, held["fingerprint"], held["token"], "done")
        return now | {"version": now["version"] + 1, "turns": now["turns"] + 1, "bytes": now["bytes"] + e["bytes"], "expires": e["at"] + self.ttl}, "committed"

    def _abandon(self, now: dict, e: dict) -> tuple[dict, str]:
        held = self._request(e)
        if held is None or held["status"] != "pending" or held["token"] != e["token"]:
            return now, "ignored"
        self._keep(e, held["fingerprint"], held["token"], "failed")
        return now, "abandoned"


def session_states(operations: DataFrame, ttl: float = 30 * 24 * 3600, lease: float = 900, max_turns: int = 2000, max_bytes: int = 16 << 20, max_requests: int = 2000, event_time: str | None = None) -> DataFrame:
    """The outcome of each operation with the session's state after it, and a row with outcome 'state' for each session of a batch.

    ``operations`` has the columns of ``OPERATIONS`` (missing ones are null); the
    operations of a session count in the order of seq, in a stream within each
    batch. ``event_time`` names a watermarked column of a stream by which
    sessions expire and are dropped (outcome 'dropped'). Rows without a session
    are left out. State is kept in RocksDB, which is set for the session.
    """
    spark = operations.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.streams.active  # noqa: B018  starts what coordinates state stores, which a batch query needs too
    names = [c.split() for c in OPERATIONS.split(", ")]
    own = operations.filter("session_id IS NOT NULL").select(*((F.col(c) if c in operations.columns else F.lit(None)).cast(kind).alias(c) for c, kind in names), *([event_time] if event_time else []))
    if not own.isStreaming:
        own = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session_id").sortWithinPartitions("session_id", "seq")
    machine = Sessions(ttl, lease, max_turns, max_bytes, max_requests, event_time is not None)
    return own.groupBy("session_id").transformWithStateInPandas(machine, OUTCOMES, "Update", "EventTime" if event_time else "None")
