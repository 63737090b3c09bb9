import random
import re
from collections import Counter

import pytest
from data import crowded, document_rows, documents, empty

from quillgrain.llm import mixing as m


def brute_targets(sizes, weights, share, cap):
    """Share, stop what is full, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, budget = set(), share * sum(sizes.values())
    while True:
        rest = budget - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        total = sum(w[s] for s in open_)
        target = {s: cap * sizes[s] if s in full else rest * w[s] / total for s in order}
        above = {s for s in open_ if target[s] > cap * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


def test_targets_against_resharing(spark):
    rng = random.Random(3)
    for n in (1, 2, 7, 20):
        sizes = {f"s{i:02d}" if i else None: rng.choice([0, 10, 100, 5000, rng.randint(1, 900)]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in m.source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        want = brute_targets(sizes, (5, 2, 1), 1.5, 2.0)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_taken_words(spark):
    rows = m.mix_documents(documents(spark)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted((str(d), count(t)) for d, t, *_ in document_rows())
    for target, total in {(r.target, sum(x.taken for x in rows if x.target == r.target)) for r in rows}:
        largest = max(r["size"] for r in rows if r.target == target)
        assert abs(total - target) <= largest / 2 + 1
    assert all(r.taken <= 2 * r["size"] for r in rows)


def due(sizes, target, cap):
    """Copies a size class is due: in proportion to 2^k, raised until the target is met, ``cap`` at most."""
    words, copies = Counter(), {}
    for n in sizes:
        words[(max(n, 1).bit_length() - 1) // 4] += n
    while True:
        left = target - sum(cap * words[k] for k in copies)
        open_ = {k: w for k, w in words.items() if k not in copies}
        total = sum(2**k * w for k, w in open_.items())
        got = {k: 2**k * left / total if total else cap for k in open_}
        above = {k for k, c in got.items() if c >= cap}
        if not above:
            return copies | got
        copies |= {k: cap for k in above}


def mixture(spark, n=4000):
    rng = random.Random(8)
    data = [(i, "w " * rng.choice([rng.randint(0, 14), rng.randint(16, 90), rng.randint(256, 400)]), "ab"[i % 7 == 0]) for i in range(n)]
    return spark.createDataFrame(data, "doc_id long, text string, source string")


@pytest.mark.parametrize(("cells", "edge"), [(4096, 2000), (8, 20)])
def test_cut_against_one_sort(spark, monkeypatch, cells, edge):
    """Cells, divided again or not, find the same cut as sorting a source by Pareto's ratio of odds."""
    monkeypatch.setattr(m, "CELLS", cells)
    monkeypatch.setattr(m, "EDGE_ROWS", edge)
    docs = mixture(spark)
    got = {r.doc_id: r.taken for r in m.mix_documents(docs, (1, 9), 0.7, 2.0).collect()}
    rows = docs.select("doc_id", "source", m.word_count(docs["text"]).alias("size"), m.random_key("doc_id", "text", 7).alias("u")).collect()
    target = brute_targets({s: sum(r["size"] for r in rows if r.source == s) for s in "ab"}, (1, 9), 0.7, 2.0)
    for s in "ab":
        own = [r for r in rows if r.source == s]
        copies = due([r["size"] for r in own], target[s], 2.0)
        k = lambda r: (max(r["size"], 1).bit_length() - 1) // 4
        whole, p = {c: int(x + 1e-9) for c, x in copies.items()}, {c: max(0.0, x - int(x + 1e-9)) for c, x in copies.items()}
        assert s == "b" or len({round(x, 6) for x in p.values() if x}) > 1  # unequal inclusion probabilities
        rest, before = target[s] - sum(whole[k(r)] * r["size"] for r in own), 0
        chosen = set()
        for r in sorted((r for r in own if p[k(r)] > 1e-9), key=lambda r: (r.u / (1 - r.u)) / (p[k(r)] / (1 - p[k(r)]))):
            if 2 * before + r["size"] <= 2 * rest:
                chosen.add(r.doc_id)
            before += r["size"]
        assert all(got[r.doc_id] == (whole[k(r)] + (r.doc_id in chosen)) * r["size"] for r in own)


def test_inclusion_follows_the_odds_not_the_random_number_alone(spark):
    docs = mixture(spark, 12_000)
    rows = docs.select("doc_id", "source", m.word_count(docs["text"]).alias("size"), m.random_key("doc_id", "text", 7).alias("u"))
    plan = m.plan_mix(rows, (1, 9), 0.5, 2.0)
    chance = {(r.source, r.k): r.whole + r.chance for r in plan.classes.collect()}
    taken, all_ = Counter(), Counter()
    for r in m.apply_mix(rows, plan, ["doc_id"]).collect():
        key = (r.source, (max(r["size"], 1).bit_length() - 1) // 4)
        taken[key] += r.copies
        all_[key] += 1
    big = [key for key in all_ if all_[key] > 300]
    assert len(big) > 4
    for key in big:
        assert abs(taken[key] / all_[key] - chance[key]) < 4 * (0.25 / all_[key]) ** 0.5 + 0.01
    # Sorting by u alone would give every class of a source the same share.
    assert max(chance[k] for k in big if k[0] == "a") > 2 * min(chance[k] for k in big if k[0] == "a")


def test_equal_rows_are_taken_by_number(spark, monkeypatch):
    """A source of one row many times over is cut like any other, though no order tells its rows apart."""
    monkeypatch.setattr(m, "EDGE_ROWS", 50)
    docs = spark.range(3000).selectExpr("1L AS doc_id", "'three words here' AS text", "if(id < 2000, 'a', 'b') AS source")
    rows = m.mix_documents(docs, (1, 1), 0.5, 2.0).groupBy("source_size").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 3 for r in rows) and len(rows) == 2


def test_reruns_copies_and_empty(spark):
    a, b = (sorted(map(str, m.mix_documents(documents(spark).repartition(n)).collect())) for n in (1, 3))
    assert a == b
    copies = m.mixed_copies(crowded(spark))
    assert copies.columns == crowded(spark).columns
    words = {}
    for r in copies.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    taken = {}
    for r in m.mix_documents(documents(spark)).join(documents(spark).select("doc_id", "source").distinct(), "doc_id").collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert words["b"] == taken["b"] and words["big"] == taken["big"]
    assert m.mix_documents(empty(spark)).count() == 0 and m.mixed_copies(empty(spark)).count() == 0
    blank = documents(spark).filter("doc_id IN (4, 5)")
    assert [r.taken for r in m.mix_documents(blank).collect()] == [0, 0]
