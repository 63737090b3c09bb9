"""Near copies by word shingles: all groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from prefix filtering. Shingles stand in one order for all
texts; of n shingles the first n - ceil(0.8 n) + 1 are the text's keys, and two
texts at 0.8 or more share a key. The order is that of the hashes, but shingles
found in many texts of a sample come last, so a passage in a third of a corpus
is no key of texts that have words of their own. The order never changes which
pairs are found.

Large groups are linked by stars first: in each round a key has one leader, each
text is compared with the two leaders that most of its keys name, and links are
merged into components. What is left are pairs of a key in unlike components.
All of them count, none is skipped or capped: with c keys in common, texts of a
and b shingles can share c + max(a - keys of a, b - keys of b) at most, and c is
at most the keys that either shares with any other component. Pairs that could
still reach 0.8 are held against each other's whole sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import cut, forget
from .components import components
from .simhash import ascii_lower, fingerprint_of, links, one_of_each, window_digests

WORDS = 5
ROUNDS = 2
#: Leaders that a text is compared with in a round.
LEADERS = 2
SAMPLE_ONE_IN = 16
#: A shingle of more rows than this is put last, as far as the sample tells.
COMMON_ROWS = 64
#: So many common shingles are put last; more stay in place, which costs work and no pair.
MOST_COMMON = 50_000
#: Names of texts (8 bytes each) that are sent to every task at most.
MOST_SENT = 500_000
#: Bytes of a shingle's hash that whole sets are compared by.
HASH_BYTES = 5
SKETCH = T.StructType(
    [
        T.StructField("fp", T.LongType()),
        T.StructField("sig", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("hashes", T.BinaryType()),
    ]
)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes (int64) of the lower-cased five-word windows; a shorter text is one shingle."""
    parts = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return np.unique(np.concatenate([np.frombuffer(d, np.int64) for d in window_digests(parts, WORDS)])) if parts else np.zeros(0, np.int64)


def prefix_length(n: int) -> int:
    """Keys of a text of n shingles; two texts of fewer than nine in all are only alike if they are equal."""
    return n - (4 * n + 4) // 5 + 1 if n > 4 else 0


def _prefix_column(n: Column) -> Column:
    return n - F.floor((4 * n + 4) / 5) + 1


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The text's keys; ``common`` is in order."""
    late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles if len(common) else np.zeros(len(shingles), bool)
    return np.concatenate([shingles[~late], shingles[late]])[: prefix_length(len(shingles))]


def pack(shingles: np.ndarray) -> bytes:
    """The highest 40 bits of each hash, which is what whole sets are compared by."""
    return np.ascontiguousarray(shingles.astype(">i8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, HASH_BYTES)
    return wide.view(">i8").ravel()


@pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of a and b shingles at least 4 (a + b) / 9 are common: Jaccard 0.8 or more."""

    def alike(x: bytes, y: bytes) -> bool:
        return 9 * len(np.intersect1d(unpack(x), unpack(y))) >= 4 * (len(x) + len(y)) // HASH_BYTES

    return pd.Series([alike(x, y) for x, y in zip(a, b)], dtype=bool)


def common_shingles(docs: DataFrame, text_col: str = "text", one_in: int = SAMPLE_ONE_IN, rows: int = COMMON_ROWS, most: int = MOST_COMMON) -> np.ndarray:
    """Hashes of shingles that more than about ``rows`` rows have, by a sample of the texts: at most ``most``, so they fit anywhere."""

    @pandas_udf(T.ArrayType(T.LongType()))
    def shingles(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t) for t in text], dtype=object)

    some = docs.filter(F.pmod(F.xxhash64(text_col), F.lit(one_in)) == 0).select(F.explode(shingles(F.col(text_col))).alias("key"))
    often = some.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > max(1, rows // one_in))
    return np.sort(np.array([r.key for r in often.orderBy(F.desc("rows"), "key").select("key").head(most)], np.int64))


def sketches(docs: DataFrame, text_col: str, common: np.ndarray) -> Column:
    """struct<fp, sig, n, keys, hashes> of each text; sig names the set of shingles."""
    import xxhash

    late = docs.sparkSession.sparkContext.broadcast(common)

    @pandas_udf(SKETCH)
    def sketch(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            s = shingle_set(t)
            rows.append((fingerprint_of(ascii_lower(t)), xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), len(s), prefix(s, late.value), pack(s)))
        fp, sig, n, keys, hashes = zip(*rows) if rows else ((), (), (), (), ())
        return pd.DataFrame({"fp": np.array(fp, np.int64), "sig": np.array(sig, np.int64), "n": np.array(n, np.int32), "keys": pd.Series(keys, dtype=object), "hashes": pd.Series(hashes, dtype=object)})

    return sketch(F.col(text_col))


def _verified(made: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct pairs (u, v) whose whole sets reach 0.8. Only sets that some pair needs are moved, each once a pair."""
    pairs = cut(pairs, "candidates")
    names = wanted = cut(pairs.select(F.explode(F.array("u", "v")).alias("sig")).distinct(), "wanted")
    if wanted.count() <= MOST_SENT:
        # Few enough names to send to every task: then only the sets asked for move, else all do once.
        wanted = F.broadcast(wanted)
    sets = cut(made.select("sig", "hashes").join(wanted, "sig", "left_semi").groupBy("sig").agg(F.first("hashes").alias("hashes")), "sets", large=True)
    a, b = (sets.select(F.col("sig").alias(x), F.col("hashes").alias(x + "_set")) for x in ("u", "v"))
    found = cut(pairs.join(a, "u").join(b, "v").filter(_near("u_set", "v_set")).select("u", "v"), "near-pairs", large=True)
    forget(pairs, sets, names)
    return found


def _needed(a: Column, b: Column) -> Column:
    """Common shingles of texts of a and b shingles at Jaccard 0.8."""
    return F.ceil(4 * (a + b) / 9)


def _sizes_allow(a: Column, b: Column) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _labelled(postings: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The postings (key, sig, n) of keys in more than one component, with their component and how many such keys the text holds."""
    labels = components(found)
    known = postings.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", "n", F.coalesce("label", "sig").alias("label"))
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    out = cut(known.join(mixed, "key", "left_semi").withColumn("held", F.count("*").over(Window.partitionBy("sig"))), name, large=True)
    forget(labels)
    return out


def _beyond(a: Column, b: Column) -> Column:
    """Shingles that may be common though they are no common key.

    The prefix that ends first in the order is wholly decided by common keys, so
    only what follows it in its own text is open.
    """
    return F.greatest(a - _prefix_column(a), b - _prefix_column(b))


def _may_meet(a: str, b: str) -> Column:
    """Whether postings a and b are of unlike components and hold enough keys of others to reach 0.8."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return (x("label") != y("label")) & _sizes_allow(x("n"), y("n")) & (F.least(x("held"), y("held")) + _beyond(x("n"), y("n")) >= _needed(x("n"), y("n")))


def _stars(known: DataFrame, turn: int) -> DataFrame:
    """(u, v): each text with the leaders that most of its keys name.

    The first turn's leader of a key is the text most of whose keys others hold,
    which is the middle of a group of edited copies; later ones go by a hash of
    the turn.
    """
    by = F.struct(-(F.col("held") / F.col("n")), F.xxhash64("sig")) if turn == 0 else F.xxhash64("sig", F.lit(turn))
    leaders = known.groupBy("key").agg(F.min_by(F.struct("sig", "n", "label", "held"), by).alias("l")).select("key", "l.*")
    named = known.alias("a").join(leaders.alias("b"), (F.col("a.key") == F.col("b.key")) & _may_meet("a", "b")).select(F.col("a.sig").alias("sig"), F.col("b.sig").alias("other")).groupBy("sig", "other").agg(F.count("*").alias("keys"))
    best = named.groupBy("sig").agg(F.slice(F.sort_array(F.collect_list(F.struct("keys", "other")), asc=False), 1, LEADERS).alias("best"))
    pair = best.select("sig", F.explode("best").alias("b")).select("sig", F.col("b.other").alias("other"))
    return pair.select(F.least("sig", "other").alias("u"), F.greatest("sig", "other").alias("v")).distinct()


def _across(known: DataFrame) -> DataFrame:
    """(u, v): all pairs of unlike components that share enough keys to reach 0.8.

    The members of a key's largest component meet the others of the key, never
    each other.
    """
    largest = known.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    placed = known.join(largest, "key").select("key", "sig", "n", "label", "held", (F.col("label") == F.col("largest")).alias("main"))
    a, b = placed.filter("not main").alias("a"), placed.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("b.main") | (F.col("a.sig") < F.col("b.sig"))) & _may_meet("a", "b"))
    pair = met.select(F.least("a.sig", "b.sig").alias("u"), F.greatest("a.sig", "b.sig").alias("v"), (_needed(F.col("a.n"), F.col("b.n")) - _beyond(F.col("a.n"), F.col("b.n"))).alias("need"))
    return pair.groupBy("u", "v", "need").count().filter("count >= need").select("u", "v")


def near_links(made: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Links (u, v) that connect all texts at 0.8 or more; ``made`` has sig, n, keys and hashes, rows may repeat."""
    one = cut(made.filter(F.size("keys") > 0).groupBy("sig").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "prefixes", large=True)
    keys = one.select("sig", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1").select("key")
    postings = cut(keys.join(shared, "key", "left_semi"), "postings", large=True)
    forget(one)
    found = made.sparkSession.createDataFrame([], "u long, v long")
    for turn in range(rounds):
        known = _labelled(postings, found, f"round-{turn}")
        new = _verified(made, _stars(known, turn))
        forget(known)
        if new.isEmpty():
            break
        found = found.union(new)
    known = _labelled(postings, found, "rest")
    found = found.union(_verified(made, _across(known)))
    forget(known, postings)
    return found


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each group of near copies, columns unchanged.

    Groups are connected by shingle similarity of 0.8 or more and by
    fingerprints at most two bits apart. Texts without words are one group.
    """
    sketched = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("said"), sketches(docs, text_col, common_shingles(docs, text_col)).alias("s"))
    rows = cut(sketched.select("doc_id", "said", "s.*"), "sketches", large=True)
    # A fingerprint is stood for by the least of its texts.
    own = cut(rows.select("fp", "sig").distinct(), "own-fingerprints")
    stands = cut(own.groupBy("fp").agg(F.min("sig").alias("rep")), "distinct-fingerprints")
    a, b = (stands.select(F.col("fp").alias(x), F.col("rep").alias(f"{x}_rep")) for x in ("u", "v"))
    by_print = own.join(stands, "fp").filter("sig <> rep").select("sig", "rep").union(links(stands.select("fp")).join(a, "u").join(b, "v").select("u_rep", "v_rep"))
    labels = components(by_print.toDF("u", "v").union(near_links(rows.select("sig", "n", "keys", "hashes"))))
    found = cut(rows.select("doc_id", "said", "sig").join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("doc_id", "said", F.coalesce("label", "sig").alias("label")), "grouped")
    forget(rows, own, stands)
    return one_of_each(docs, found, id_col, text_col)
