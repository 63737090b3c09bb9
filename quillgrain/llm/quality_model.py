"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Fitting takes a bounded sample of labelled rows (``sample_rows``, by a hash of
the id). Every word has a fixed sparse random index vector; a word's vector is
the sum of the index vectors found within two words of it over the sample. A
document is the weighted mean of its words' vectors, with the length of that
mean, variety, size, capitals, immediate repeats, the share of
the commonest token and of marks beside it. A
network of one hidden layer, in numpy, gives a logit, and a temperature fitted
on rows kept from its training turns that into a probability.

Scoring covers every row and whole texts; it uses nothing but the text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SAMPLE_ROWS = 6000
#: Bytes of text that the fit takes at most.
SAMPLE_BYTES = 128 << 20
BUCKETS = 1 << 15
DIMS = 48
NONZERO = 4
WINDOW = 2
MIN_DOCUMENTS = 5
HIDDEN = 24
COMMON = 1e-3
TOKEN = re.compile(r"\w+|[^\w\s]+")
PIECE = 1 << 20


def counted(text: str | None) -> tuple[Counter, int, int, int]:
    """Tokens of the whole text, words in capitals, tokens said twice running and all tokens."""
    found: Counter = Counter()
    text, again = text or "", 0
    for at in range(0, len(text), PIECE):
        part = TOKEN.findall(text[at : at + PIECE])
        found.update(part)
        again += sum(map(eq, part, islice(part, 1, None)))
    loud = sum(n for t, n in found.items() if len(t) > 1 and t.isupper())
    return found, loud, again, sum(found.values())


def bucket(token: str) -> int:
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS


class QualityModel:
    """Fitted on (text, label) pairs; without both labels it gives the base rate."""

    def __init__(self, seed: int = 11):
        self.seed, self.temperature, self.base = seed, 1.0, 0.5
        self.net: dict[str, np.ndarray] | None = None
        rng = np.random.default_rng(seed)
        self.index = np.zeros((BUCKETS, DIMS), np.float32)
        rows = np.repeat(np.arange(BUCKETS), NONZERO)
        self.index[rows, rng.integers(0, DIMS, len(rows))] = rng.choice([-1.0, 1.0], len(rows))
        self.vectors, self.weight = self.index, np.ones(BUCKETS, np.float32)
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "index": None}

    def _id(self, token: str) -> int:
        at = self.cache.get(token)
        if at is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            at = self.cache[token] = bucket(token)
        return at

    def features(self, text: str | None) -> np.ndarray:
        found, loud, again, total = counted(text)
        out = np.zeros(DIMS + 7, np.float32)
        if total:
            ids = np.fromiter(map(self._id, found), np.int64, len(found))
            counts = np.fromiter(found.values(), np.float32, len(found)) * self.weight[ids]
            mean = (counts @ self.vectors[ids]) / max(float(counts.sum()), 1e-9)
            out[:DIMS] = mean
            out[DIMS:] = (float(np.linalg.norm(mean)), len(found) / total**0.75, math.log1p(total), loud / total, again / total, max(found.values()) / total, sum(n for t, n in found.items() if not t[0].isalnum()) / total)
        return out

    def _learn_vectors(self, texts: Sequence[str]) -> None:
        sums, seen, docs = np.zeros((BUCKETS, DIMS), np.float32), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for text in texts:
            ids = np.array([self._id(t) for t in TOKEN.findall(text or "")], np.int64)
            for at in range(0, len(ids), PIECE // 16):
                part = ids[at : at + PIECE // 16]
                own = self.index[part]
                around = np.zeros_like(own)
                for k in range(1, WINDOW + 1):
                    around[k:] += own[:-k]
                    around[:-k] += own[k:]
                order = np.argsort(part, kind="stable")
                which, starts = np.unique(part[order], return_index=True)
                sums[which] += np.add.reduceat(around[order], starts, axis=0)
                seen += np.bincount(part, minlength=BUCKETS)
            docs[np.unique(ids)] += 1
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        # A word of few documents would know their labels; it says nothing, like one that the sample lacks.
        self.vectors = np.where((docs >= MIN_DOCUMENTS)[:, None], sums / np.maximum(norms, 1e-9), 0).astype(np.float32)
        share = seen / max(1, seen.sum())
        self.weight = (COMMON / (COMMON + share)).astype(np.float32)

    def fit(self, texts: Sequence[str], labels: Sequence[int]) -> QualityModel:
        y = np.asarray(labels, np.float32)
        self.base = float((y.sum() + 1) / (len(y) + 2))
        if len(set(y.tolist())) < 2:
            return self
        self._learn_vectors(texts)
        x = np.stack([self.features(t) for t in texts])
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(y))
        kept, train = order[: max(2, len(y) // 5)], order[max(2, len(y) // 5) :]
        mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
        net = {
            "mean": mean,
            "scale": scale,
            "w1": rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self._train(net, self._standard(net, x[train]), y[train], rng)
        self.net = net
        logits, kept_y = self._logits(x[kept]), y[kept]
        loss = lambda t: float(np.mean(np.logaddexp(0, logits / t) - kept_y * logits / t))
        self.temperature = min((0.5 * 1.05**k for k in range(61)), key=loss)
        return self

    @staticmethod
    def _train(net: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 40, steps: int = 2500, batch: int = 64, rate: float = 3e-3, prior: float = 0.3) -> None:
        """Adam for the given epochs, or as many as make the given steps; the fewer rows, the more the prior weighs."""
        decay = prior / len(y)
        epochs = max(epochs, -(-steps * batch // len(y)))
        learnt = ("w1", "b1", "w2", "b2")
        first, second, step = {k: np.zeros_like(net[k]) for k in learnt}, {k: np.zeros_like(net[k]) for k in learnt}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                part = order[at : at + batch]
                hidden = np.tanh(x[part] @ net["w1"] + net["b1"])
                wrong = (1 / (1 + np.exp(-np.clip(hidden @ net["w2"] + net["b2"], -30, 30))) - y[part]) / len(part)
                back = np.outer(wrong, net["w2"]) * (1 - hidden**2)
                slopes = {"w1": x[part].T @ back + decay * net["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ wrong + decay * net["w2"], "b2": wrong.sum(keepdims=True)}
                step += 1
                for k in learnt:
                    first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                    second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
                    net[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        net = self.net
        return np.tanh(self._standard(net, x) @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]

    @staticmethod
    def _standard(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
        """Features in standard units; clipped, as a feature that hardly varies in the sample may be far out elsewhere."""
        return np.clip((x - net["mean"]) / net["scale"], -6, 6)

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if self.net is None:
            return np.full(len(texts), self.base)
        x = np.stack([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self._logits(x).astype(np.float64) / self.temperature, -500, 500)))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """True if crc32 of the id as text leaves no remainder; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """A model of at most ``sample_rows`` labelled rows outside the held-out fold, ``sample_bytes`` of text in all.

    The ids are chosen by hash, at most ``sample_rows`` of them, so they can be
    broadcast; rows come in order of id, label and text, so refits agree.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    chosen = usable.select(F.col(id_col).alias("chosen_id"), F.col(label_col).alias("chosen_label")).distinct().orderBy(F.xxhash64("chosen_id"), "chosen_id", "chosen_label").limit(sample_rows)
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"))
    order = [F.xxhash64("own_id"), F.col("own_id"), F.col("chosen_label"), F.xxhash64("own_text")]
    some = own.join(F.broadcast(chosen), F.col("own_id") == F.col("chosen_id")).orderBy(*order).limit(sample_rows)
    upto = F.sum(F.coalesce(F.octet_length("own_text"), F.lit(0))).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = some.withColumn("upto", upto).filter(F.col("upto") <= sample_bytes).orderBy(*order).select("own_text", "chosen_label").collect()
    return QualityModel().fit([r[0] for r in rows], [int(r[1]) for r in rows])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_at: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts are scored as texts without tokens. Without usable
    labels every score is the base rate, 0.5 for none. Repeated rows score
    alike. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_on_labels(docs, labels, id_col, text_col, sample_rows=sample_rows))

    @pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(list(text)))

    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut_at).cast("int"))
