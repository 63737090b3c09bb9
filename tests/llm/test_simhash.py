from collections import defaultdict

import numpy as np
import pytest
import xxhash
from data import crowded, document_rows, documents, empty, prose

from quillgrain.llm import components, simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Smallest id reachable, from all pairs."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for p, ids in prints.items():
        known = [i for i in ids if i is not None]
        if known:
            least[find(p)] = min(least.get(find(p), min(known)), min(known))
    return {p: least.get(find(p)) for p in prints}


def test_fingerprint_equals_definition():
    for text in [None, "", " \n", "One", "one TWO", "a b c", "É a É b", prose(1, 500)]:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_any_two_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    keys = [set(k.tolist()) for k in simhash.golay_keys(words)]
    for a in range(0, 64, 3):
        for b in range(64):
            near = words ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))
            assert all(k & set(o.tolist()) for k, o in zip(keys, simhash.golay_keys(near)))


def test_golay_covers_every_word_within_three():
    code = simhash.Golay()
    word = np.arange(1 << 12, dtype=np.int64) * 1031 & (1 << 23) - 1
    found, _ = code.indices(word)
    home = word ^ code.error[code.high[word >> 12] ^ code.low[word & 4095]]
    assert (code.high[home >> 12] ^ code.low[home & 4095] == 0).all() and (found[:, 0] == home >> 11).all()


@pytest.mark.parametrize("max_bucket", [64, 2])
def test_links_against_all_pairs(spark, max_bucket):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    words = {int(c) for c in centre}
    for c in centre:
        x = int(c)
        for _ in range(12):  # chains: each at most two bits from the last
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            words.add(x)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    links = simhash.links(spark.createDataFrame([(w,) for w in signed], "fp long"), 2, max_bucket)
    labels = {r.node: r.label for r in components.components(links).collect()}
    truth = brute_components({w & (1 << 64) - 1: [w] for w in signed})
    for w in signed:
        assert labels.get(w, w) == truth[w & (1 << 64) - 1]


def test_near_duplicates_whole(spark):
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(documents(spark)).collect()), key=str)
    prints = defaultdict(list)
    for d, text, *_ in document_rows():
        prints[plain_fingerprint(text)].append(d)
    truth = brute_components(prints)
    want = sorted(((d, plain_fingerprint(t), truth[plain_fingerprint(t)]) for d, t, *_ in document_rows()), key=str)
    assert got == want


def test_one_of_each_group_stays(spark):
    kept = simhash.drop_near_duplicates(crowded(spark))
    assert kept.columns == crowded(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(spark)).collect()}
    named = {c for _, c in found if c is not None}
    assert [i for i in ids if i is not None] == sorted(named, key=str)
    assert ids.count(None) == sum(1 for d, c in found if d is None and c is None)


def test_an_id_with_two_texts(spark):
    a, b = prose(7, 50), prose(8, 50)
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text == b) for r in simhash.drop_near_duplicates(docs).collect()) == [(1, False), (2, True)]


def test_unlike_texts_without_or_under_one_id_stay(spark):
    rows = [(None, prose(900 + i, 40)) for i in range(5)] + [(None, prose(900, 40)), (7, prose(950, 40)), (7, prose(951, 40)), (7, prose(951, 40))]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted({str(r) for r in spark.createDataFrame(rows, "doc_id long, text string").collect()})


def test_empty(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0
