import random

import pytest
from data import crowded, prose

import corpus_pipeline
from quillgrain.llm import components, near_copies, simhash


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_pairs(texts):
    sets = [plain_set(t) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def groups(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in pairs:
        label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def edited(text, seed, edits):
    rng, w = random.Random(seed), text.split()
    for k in range(edits):
        w[rng.randrange(len(w))] = f"edit{seed}x{k}"
    return " ".join(w)


def corpus():
    """Near copies at all similarities, a common passage, texts that are mostly common, short texts."""
    texts = [edited(prose(s, 120), s * 31 + k, k) for s in range(12) for k in range(9)]
    passage = prose(77, 30)
    texts += [prose(200 + k, 25) + " " + passage + " " + prose(300 + k, 20) for k in range(20)]
    texts += [passage + " " + prose(400 + k, 3) for k in range(8)] + [edited(passage, k, 1) for k in range(12)] + [passage.upper()]
    return texts + ["one two", "One  TWO", "one three", prose(5, 5), prose(5, 6)]


@pytest.mark.parametrize(("rows", "rounds"), [(64, 2), (3, 2), (3, 0)])
def test_links_against_all_pairs(spark, rows, rounds):
    """Neither what counts as common nor the star rounds change which texts are linked."""
    texts = corpus()
    docs = spark.createDataFrame([(t,) for t in texts for _ in range(2)], "text string")
    common = near_copies.common_shingles(docs, one_in=1, rows=rows)
    made = docs.select("text", near_copies.sketches(docs, "text", common).alias("s")).select("text", "s.*").cache()
    sig = {r.text: r.sig for r in made.collect()}
    labels = {r.node: r.label for r in components.components(near_copies.near_links(made, rounds)).collect()}
    sets, label = [sig[t] for t in texts], lambda s: labels.get(s, s)
    found = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if label(sets[i]) == label(sets[j])])
    assert found == groups(len(texts), brute_pairs(texts))


def test_prefix_and_packing():
    import numpy as np

    s = near_copies.shingle_set(prose(9, 200))
    common = s[::3]
    keys = near_copies.prefix(s, common)
    assert len(keys) == len(s) - -(-4 * len(s) // 5) + 1 and not np.isin(keys, common).any()
    assert (near_copies.unpack(near_copies.pack(s)) == s >> 24 << 24).all()
    assert near_copies.prefix_length(4) == 0 and near_copies.prefix_length(5) == 2


def test_stage_drops_near_copies_beyond_two_bits(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [simhash.fingerprint(t) & (1 << 64) - 1 for t in texts]
    near, bits = brute_pairs(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert sum(p not in set(bits) for p in near) > 30
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(groups(len(texts), near + bits)))


def test_columns_and_ids_stay(spark):
    docs = crowded(spark)
    kept, before = near_copies.drop_near_copies(docs), simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, before.collect()))
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0
