"""Phrase collocations per language, mined from n-gram counts.

Each text's n-grams become rows, hash-aggregated per language. A phrase seen
``least`` times is made of phrases seen that often, so passes over the texts
narrow down what has to be aggregated: words; then pairs of frequent words; then
longer phrases all of whose pairs are frequent. These passes count hashes of 40
bits in place of phrases. A hash counts at least as often as each of its
phrases, so none that is frequent is lost; the last pass counts the phrases
whose hash is frequent. What a pass knows of the ones before are bitmaps whose
size is a parameter and doesn't grow with the corpus.

Scores are exact: products are decimals of 38 digits, which hold 1000 * a * n
for corpora of up to 10^17 words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes of text that are turned into n-grams at a time.
BLOCK = 1 << 20
#: Bits of the hashes that are counted.
KEY_BITS = 40
#: A language's best phrases are first ranked within this many shares of them.
SHARES = 64
#: What bitmap_bucket_number counts in (fixed value).
BUCKET = 32768

SPACE, STOP = 32, 46
#: A-Z lower-cased, tabs as spaces, everything that ends a piece as a full stop.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9] = SPACE
FOLD[[*b",;:!?", 10, 11, 12, 13]] = STOP

BASE, BACK, STEP = (np.uint64(n) for n in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 0xD6E8FEB86659FD93))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * STEP
    return (h ^ (h >> np.uint64(32))) * STEP


class Words:
    """The words of a block of texts in one row, with the piece and the text that each is in."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        folded = FOLD[raw]
        ends_piece = folded == STOP
        inside = ~(ends_piece | (folded == SPACE))
        first = np.zeros(len(folded) + 1, bool)
        first[bounds] = True
        begins = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        self.piece = np.cumsum(ends_piece | first[:-1], dtype=np.int64)[begins]
        self.text = np.searchsorted(bounds, begins, "right") - 1
        self._bytes = folded[inside]
        self._offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
        self.words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(self._offsets), pa.py_buffer(self._bytes))

    def hashes(self, salts: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word and its text's salt."""
        at = np.full(len(self._bytes), BASE)
        if len(at):
            at[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self._bytes + np.uint64(1)) * np.multiply.accumulate(at))])
        down = np.full(len(self._bytes) + 1, BACK)
        down[0] = 1
        polynomial = (sums[self._offsets[1:]] - sums[self._offsets[:-1]]) * np.multiply.accumulate(down)[self._offsets[:-1]]
        return _mixed(polynomial ^ salts[self.text])

    def runs(self, width: int) -> np.ndarray:
        """Which words begin a run of ``width`` words of one piece."""
        return self.piece[: max(0, len(self.piece) - width + 1)] == self.piece[width - 1 :]

    def phrases(self, at: np.ndarray, width: int) -> pa.Array:
        return self.words.take(pa.array(at)) if width == 1 else pc.binary_join_element_wise(*(self.words.take(pa.array(at + j)) for j in range(width)), pa.scalar(" ", pa.large_string()))


def _run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    size = max(0, len(hashes) - width + 1)
    out = hashes[:size]
    for j in range(1, width):
        out = _mixed(out * BASE + hashes[j : j + size])
    return out


def _salts(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    own = np.array([zlib.crc32(s.encode()) for s in coded.dictionary.to_pylist()] or [0], np.uint64)
    return _mixed(own[coded.indices.to_numpy(zero_copy_only=False)]) if len(langs) else own


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // BLOCK
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _frequent(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _hash_rows(docs: DataFrame, widths: Sequence[int], known: int, bitmap) -> DataFrame:
    """(key, a): hashes of the n-grams of the given widths, counted within a block of texts.

    ``bitmap`` is a broadcast of the frequent phrases of ``known`` words; an
    n-gram that holds another is left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                found = Words(part.column("text"))
                hashes = found.hashes(_salts(part.column("lang")))
                frequent = _frequent(bitmap.value, _run_hashes(hashes, known)) if bitmap else None
                keys = []
                for width in widths:
                    use = found.runs(width)
                    for j in range(width - known + 1) if bitmap else ():
                        use = use & frequent[j : j + len(use)]
                    keys.append(_run_hashes(hashes, width)[use] >> np.uint64(64 - KEY_BITS))
                key, counts = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.astype(np.int64)), "a": pa.array(counts.astype(np.int64))})

    return docs.mapInArrow(rows, "key long, a long")


def _bitmap(counted: DataFrame, least: int, filter_bits: int):
    """A broadcast bitmap of the hashes that count ``least`` times or more, 2^filter_bits bits in all."""
    place = F.shiftright("key", KEY_BITS - filter_bits) + 1
    frequent = counted.groupBy("key").agg(F.sum("a").alias("a")).filter(F.col("a") >= least).select(place.alias("place"))
    parts = frequent.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    bits = np.zeros((1 << filter_bits) // 8, np.uint8)
    for r in parts:
        bits[(r.bucket - 1) * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return counted.sparkSession.sparkContext.broadcast(bits)


def _phrase_rows(docs: DataFrame, max_n: int, bitmaps: Sequence) -> DataFrame:
    """(lang, phrase, a): the n-grams whose hash is frequent, counted within a block; an empty phrase carries the number of words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                found = Words(part.column("text"))
                langs = part.column("lang")
                hashes = found.hashes(_salts(langs))
                yield from _counted(langs.take(pa.array(found.text)), pa.nulls(len(found.text), pa.large_string()).fill_null(""))
                for width in range(1, max_n + 1):
                    at = np.flatnonzero(found.runs(width) & _frequent(bitmaps[min(width, len(bitmaps)) - 1].value, _run_hashes(hashes, width)))
                    yield from _counted(langs.take(pa.array(found.text[at])), found.phrases(at, width))

    return docs.mapInArrow(rows, "lang string, phrase string, a long")


def _counted(langs: pa.Array, phrases: pa.Array) -> list[pa.RecordBatch]:
    counted = pa.table({"lang": langs, "phrase": phrases}).group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")])
    return pa.table({"lang": counted["lang"].cast(pa.string()), "phrase": counted["phrase"].cast(pa.string()), "a": counted["count_all"].cast(pa.int64())}).to_batches(1 << 17)


def frequent_phrases(docs: DataFrame, least: int, max_n: int, text_col: str = "text", lang_col: str = "lang", filter_bits: int = 26) -> DataFrame:
    """(lang, phrase, a) of all phrases of 1 to ``max_n`` words found ``least`` times or more.

    The empty phrase of each language has its number of words.
    """
    if not 15 <= filter_bits <= KEY_BITS:
        raise ValueError(f"a bitmap has 2^15 to 2^{KEY_BITS} bits")
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    bitmaps: list = []
    for widths in ((1,), (2,), tuple(range(3, max_n + 1))):
        if widths and widths[0] <= max_n:
            bitmaps.append(_bitmap(_hash_rows(own, widths, len(bitmaps), bitmaps[-1] if bitmaps else None), least, filter_bits))
    counted = _phrase_rows(own, max_n, bitmaps).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return cut(counted.filter((F.col("a") >= least) | (F.col("phrase") == "")), "phrases", large=True)


def _joined(parts: Column, first, length) -> Column:
    return F.array_join(F.slice(parts, first, length), " ")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(20,0)")


def collocations(docs: DataFrame, top: int = 2000, max_n: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang", filter_bits: int = 26) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``max_n`` words.

    A phrase's score is that of its lowest-scoring cut in two, floor(1000 * a *
    n / (l * r)); equal scores go to the earliest cut. A phrase inside a longer
    one with as many occurrences is dropped. Null texts are empty, a null
    language is 'und', repeated rows count each. An empty table gives no rows.
    """
    counts = frequent_phrases(docs, least, max_n, text_col, lang_col, filter_bits)
    totals = counts.filter("phrase = ''").select("lang", F.col("a").alias("n"))
    counts = counts.filter("phrase <> ''")
    parts = F.split("phrase", " ", -1)
    longer = counts.withColumn("parts", parts).withColumn("size", F.size("parts")).filter("size > 1")
    cuts = longer.select("lang", "phrase", "a", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _joined(F.col("parts"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("parts"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right")
    )
    known = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
    scored = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    scored = scored.withColumn("up", F.lit(1000).cast("decimal(4,0)") * (_exact("a") * _exact("n"))).withColumn("down", _exact("l") * _exact("r"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.array(_joined(F.col("parts"), F.lit(1), F.col("size") - 1), _joined(F.col("parts"), F.lit(2), F.col("size") - 1))
    covered = longer.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").distinct()
    kept = lowest.join(covered, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = kept.withColumn("share", share).withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
