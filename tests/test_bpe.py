import base64
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillgrain.config import ChunkConfig
from quillgrain.functions import bpe
from quillgrain.functions.tokens import token_count
from quillgrain.operators import chunking

FILE = os.environ.get("TEST_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def small_ranks(seed=1, joins=120):
    """Single bytes and unions of two earlier tokens, in random order."""
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    letters = [b"a", b"b", b"c", b" ", "é".encode()[:1], "é".encode()[1:]]
    while len(tokens) < 256 + joins:
        new = rng.choice(letters) + rng.choice(letters)
        letters.append(new)
        if new not in tokens:
            tokens.append(new)
    return {t: i for i, t in enumerate(tokens)}


def naive(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_joins_against_naive_merging():
    rng = random.Random(2)
    for seed in range(6):
        ranks = small_ranks(seed)
        for _ in range(300):
            piece = "".join(rng.choices("abcé ", k=rng.randint(0, 30))).encode()
            assert bpe.joined(piece, ranks) == naive(piece, ranks)
        assert bpe.joined(b"a" * 41, ranks) == naive(b"a" * 41, ranks)


def test_long_words_take_no_longer_a_byte():
    ranks = small_ranks()
    took = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        bpe.joined(b"abcab" * (n // 5), ranks)
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] * 3


def vocabulary(spark, ranks):
    return spark.createDataFrame([(bytearray(t), r) for t, r in ranks.items()], "token binary, rank int")


def test_counts_and_bad_vocabularies(spark):
    ranks = small_ranks()
    count = bpe.byte_pair_counter(vocabulary(spark, ranks))
    texts = [None, "", "abc cab", "é é", "x" * 300, " a  b\n"]
    want = [sum(len(naive(p.encode(), ranks)) for p in bpe.regex.findall(bpe.PIECES, t or "")) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3).select("i", token_count(F.col("t"), count).alias("n")).collect()
    assert [n for _, n in sorted((r.i, r.n) for r in rows)] == want == [count(t) for t in texts]
    for bad in (vocabulary(spark, {t: r for t, r in ranks.items() if t != b"q"}), vocabulary(spark, ranks).unionByName(vocabulary(spark, {b"a": 9}))):
        with pytest.raises(ValueError):
            bpe.byte_pair_counter(bad)
    with pytest.raises(ValueError):
        bpe.byte_pair_counter(vocabulary(spark, ranks), most_tokens=10)


def test_chunks_keep_their_invariants(spark):
    count = bpe.byte_pair_counter(vocabulary(spark, small_ranks()))
    config = ChunkConfig()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25)
    blocks = docs.select("doc_id", chunking.paragraph_blocks(F.col("text")).alias("blocks"))
    chunks = chunking.chunk_documents(blocks, config, count).collect()
    assert chunks and all(c.token_count == count(c.content) for c in chunks)
    assert all(r.violations == 0 for r in chunking.invariant_violations(spark.createDataFrame(chunks, chunking.chunk_documents(blocks, config, count).schema), config).collect())


@pytest.mark.skipif(not os.path.exists(FILE), reason="no public vocabulary")
def test_a_public_vocabulary(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    own = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})
    count = bpe.byte_pair_counter(bpe.read_vocabulary(spark, FILE))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()] + ["naïve 😀 文字 don't we'll\n\n x", "unbroken" * 200]
    assert [count(t) for t in texts] == [len(own.encode_ordinary(t or "")) for t in texts]
