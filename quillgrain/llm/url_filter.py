"""URL rules by a sort-merge range join on reversed hosts.

A host's canonical key is its labels in reverse, each ended by a zero character:
``www.example.com`` is ``com\\0example\\0www\\0``. A rule's host and all its
subdomains are then one interval of keys, and intervals are nested or apart. URLs
are dealt by range of (key, spread), sorted, and swept once with the sorted
rules: a stack holds the rules whose interval holds the current key. Of those
whose path starts the URL's, the longest decides.

The spread splits a host that has many rows over several ranges. Rules are sent
to every task only in blocks of ``block_rules``; more rules mean more sweeps
over the same sorted rows, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def key(self) -> str:
        return host_key(self.host)


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def host_key(host: str) -> str:
    return "".join(label + "\0" for label in reversed(host.split("."))) if host else ""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key_column(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\0"), F.lit("\0")))


def sweep(rows: Iterable[tuple[str, str]], rules: Sequence[Rule]) -> Iterator[Rule | None]:
    """The deciding rule of each (key, path); rows come in order of key."""
    waiting = sorted(((r.key, r) for r in rules), key=lambda x: x[0])
    at, stack = 0, []
    for key, path in rows:
        while at < len(waiting) and waiting[at][0] <= key:
            while stack and not waiting[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(waiting[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        yield max((r for _, r in stack if path.startswith(r.path)), key=lambda r: (len(r.host), len(r.path), r.name), default=None) if key else None


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", block_rules: int = 50_000) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A URL without a fitting rule, null ones too, has rule null and verdict
    ``default``. Equal rules with unlike verdicts are refused. Repeated rows are
    judged each. An empty table gives no rows.
    """
    distinct = {r.name: r for r in rules}
    if any(distinct[r.name] != r for r in rules):
        raise ValueError("a rule has two verdicts")
    ordered = sorted(distinct.values(), key=lambda r: r.key)
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.xxhash64(id_col, url_col).alias("spread"))
    # Sorting by UTF-8 bytes is sorting by code point, as Python compares strings.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("key", host_key_column(F.col("host"))).repartitionByRange(parts, "key", "spread").sortWithinPartitions("key")
    rows = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    for start in range(0, len(ordered), block_rules):
        rows = rows.mapInArrow(_sweeper(ordered[start : start + block_rules]), rows.schema)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _sweeper(rules: list[Rule]):
    def longer(a: str, b: str) -> bool:
        weigh = lambda name: (len(name.partition("/")[0]), len(name))
        return weigh(a) > weigh(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed: list[pa.RecordBatch] = []

        def rows():
            for batch in batches:
                feed.append(batch)
                yield from zip(batch.column("key").to_pylist(), batch.column("path").to_pylist())

        found: list[Rule | None] = []
        for rule in sweep(rows(), rules):
            found.append(rule)
            if len(found) == feed[0].num_rows:
                yield merged(feed.pop(0), found)
                found = []

    def merged(batch: pa.RecordBatch, found: list[Rule | None]) -> pa.RecordBatch:
        old = list(zip(batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()))
        new = [(r.name, r.verdict) if r and (o[0] is None or longer(r.name, o[0])) else o for r, o in zip(found, old)]
        rest = {n: batch.column(n) for n in batch.schema.names}
        rest |= {"rule": pa.array([n for n, _ in new], pa.string()), "verdict": pa.array([v for _, v in new], pa.string())}
        return pa.RecordBatch.from_pydict(rest)

    return run
