"""Near-duplicate detection: 64-bit SimHash fingerprints linked through Golay-code keys.

A fingerprint is cut into three segments (22, 21 and 21 bits). Two differing
bits leave a segment j without an error whose follower i = j + 1 (mod 3) has at
most one: with errors (2, 0, 0) the second segment and its follower are clean,
with (1, 1, 0) the third is clean and its follower has one error, and so on
round the circle. A key is therefore (j, bits of j, codeword index of i) where
the index comes from the perfect binary Golay code [23, 12, 7]:

* a word within two errors of its codeword is only near that one codeword, and
  each word one bit away still decodes to it: one key;
* a word at three errors has five more codewords at distance four, the only
  ones a word one bit away may decode to: six keys.

So any two fingerprints within two bits share a key. Fingerprints that share a
key are compared; links then go through alternating star contraction.

Keys of up to ``max_bucket`` fingerprints are compared pair by pair. For larger
ones (a group of near copies can hold a third of a corpus) each fingerprint
lists the 65 words within one bit of it: fingerprints on one such word are at
most two bits apart, at most 65 in number, and any two at most two bits apart
share one. That is exact and linear, so no key is skipped or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import cut, forget, unused, worker_cache
from .components import components

SEED = 42
SHINGLE = 3
BLOCK = 1 << 15
#: Generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1 (fixed value).
GENERATOR = 0xAE3
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_lower(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def window_digests(parts: list[bytes], width: int) -> Iterator[bytes]:
    """XXH64 digests (8 bytes each) of all runs of ``width`` words, in blocks; a shorter sequence is one run."""
    import xxhash

    digest, joined = xxhash.xxh64_digest, b" ".join(parts)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in parts)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    stops = ends[width - 1 :] or ends[-1:]
    for at in range(0, len(stops), BLOCK):
        yield b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])])


def fingerprint_of(parts: list[bytes]) -> int:
    """Signed 64-bit SimHash of words; 0 for none."""
    if not parts:
        return 0
    counts, total = np.zeros(64, np.int64), 0
    for hashes in window_digests(parts, SHINGLE):
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
        total += len(bits)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of one text; 0 for a text without words."""
    return fingerprint_of(ascii_lower(text))


@pandas_udf(T.LongType())
def fingerprint_column(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in text], dtype="int64")


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Decoding tables, all made from the generator polynomial."""

    def __init__(self):
        self.high = np.array([_syndrome(i << 12) for i in range(2048)], np.int64)
        self.low = np.array([_syndrome(i) for i in range(4096)], np.int64)
        patterns = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)]
        self.error = np.zeros(2048, np.int64)
        for p in patterns:
            self.error[_syndrome(p)] = p
        weight7 = [w for m in range(4096) if (w := m << 11 | _syndrome(m << 11)).bit_count() == 7]
        #: For a pattern of three errors, the five codewords of weight seven over it.
        self.over = np.zeros((2048, 5), np.int64)
        self.triple = np.zeros(2048, bool)
        for p in patterns:
            if p.bit_count() == 3:
                self.over[_syndrome(p)] = [w for w in weight7 if w & p == p]
                self.triple[_syndrome(p)] = True

    def indices(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Six codeword indices a word, and which of them count."""
        s = self.high[word >> 12] ^ self.low[word & 4095]
        home = word ^ self.error[s]
        found = np.concatenate([home[:, None], home[:, None] ^ self.over[s]], axis=1) >> 11
        use = np.ones(found.shape, bool)
        use[:, 1:] = self.triple[s][:, None]
        return found, use


def golay_keys(prints: np.ndarray) -> list[np.ndarray]:
    """The keys of each fingerprint (uint64): 3 to 18."""
    cache = worker_cache()
    if "golay" not in cache:
        cache["golay"] = Golay()
    golay = cache["golay"]
    parts = [((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]
    keys, use = [], []
    for j in range(3):
        found, counts = golay.indices(parts[(j + 1) % 3])
        keys.append((np.int64(j) << 34) | (parts[j][:, None] << 12) | found)
        use.append(counts)
    keys, use = np.concatenate(keys, axis=1), np.concatenate(use, axis=1)
    return [k[u] for k, u in zip(keys, use)]


@pandas_udf(T.ArrayType(T.LongType()))
def golay_keys_column(fp: pd.Series) -> pd.Series:
    return pd.Series(golay_keys(fp.to_numpy(np.int64).view(np.uint64)))


def links(prints: DataFrame, max_distance: int = 2, max_bucket: int = 64) -> DataFrame:
    """Links (u, v) that connect all fingerprints at up to two differing bits.

    ``prints`` has distinct fingerprints in ``fp``. Within a large bucket the
    links are stars, not all pairs: they have the same connected components.
    """
    if max_distance != 2:
        raise ValueError("the keys are made for two differing bits")
    keyed = cut(prints.select("fp", F.explode(golay_keys_column("fp")).alias("key")), "golay-keys")
    large = keyed.groupBy("key").count().filter(F.col("count") > max_bucket).select("key")
    bucket = keyed.join(large, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_distance
    pairs = F.flatten(
        F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("u"), y.alias("v"))))
    )
    small = bucket.select(F.inline(pairs))
    crowd = keyed.join(large, "key", "left_semi").select("fp").distinct()
    one_off = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)))
    stars = (
        crowd.select("fp", F.explode(one_off).alias("mid"))
        .groupBy("mid")
        .agg(F.collect_set("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
        .filter("u < v")
    )
    return small.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 2, max_bucket: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed 64 bits), component_id.

    component_id is the smallest id reachable over links, the row's own
    included; ids of null are never the smallest unless there are no others.
    Null, empty and blank texts have fingerprint zero and are linked by it like
    any other. Repeated rows come back repeated. An empty table gives no rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    labels = components(links(prints, max_distance, max_bucket))
    groups = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = groups.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_print = groups.select("fp", "label").join(named, "label").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of ``docs`` of the smallest id in each group, null last; then that whose text hash is least.

    ``found`` has doc_id, said (XXH64 of the text) and label for every row.
    Rows of one id and text in one group count as one.
    """
    gone, said, picked, many = (unused(docs, n) for n in ("gone_id", "said_key", "picked_row", "many_id"))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "said")
    rows = cut(found.groupBy("label", "doc_id", "said").agg(F.count("*").alias("rows")), "group-rows")
    firsts = cut(rows.groupBy("label").agg(F.min(row).alias("first")), "group-firsts")
    judged = cut(rows.join(firsts, "label").select("doc_id", "said", "rows", (row == F.col("first")).alias("stays")), "judged")
    forget(rows, firsts)
    as_docs = lambda df, name: df.select(F.col("doc_id").alias(name), F.col("said").alias(said + "_of"))
    same = lambda name: F.col(id_col).eqNullSafe(F.col(name)) & (F.col(said) == F.col(said + "_of"))
    kept = docs.withColumn(said, F.xxhash64(text_col)).join(as_docs(judged.filter(~F.col("stays")), gone), same(gone), "left_anti")
    twice = as_docs(judged.filter(F.col("stays") & (F.col("rows") > 1)), many)
    if twice.isEmpty():
        return kept.drop(said)
    rest = [c for c in docs.columns if c != id_col]
    one = kept.join(twice, same(many), "left_semi").groupBy(id_col, said).agg(F.min_by(F.struct(*rest), F.struct(F.xxhash64(text_col), *rest)).alias(picked))
    return kept.join(twice, same(many), "left_anti").select(*docs.columns).unionByName(one.select(id_col, *(F.col(picked)[c].alias(c) for c in rest)).select(*docs.columns))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each component, that of the smallest id, null last.

    Columns are kept as they are. Components are those of the fingerprints, so
    unlike texts under one id, or under none, each stay.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("said"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    labels = components(links(rows.select("fp").distinct()))
    return one_of_each(docs, rows.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), id_col, text_col)
