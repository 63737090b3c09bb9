import random
import time

from data import crowded, documents, empty, prose

from quillgrain.llm import decontaminate as d


def plain_tiles(doc, item, least):
    """Greedy string tiling by its definition."""
    dm, im, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = least - 1, []
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not dm[i + k] and not im[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best and k >= least:
                    found.append((i, j, k))
        if not found:
            return tiles
        for i, j, k in found:
            if not any(dm[i : i + k]) and not any(im[j : j + k]):
                dm[i : i + k], im[j : j + k] = [True] * k, [True] * k
                tiles.append((i, j, k))


def test_tiles_against_definition():
    rng = random.Random(2)
    for _ in range(150):
        doc = [rng.randint(1, 3) for _ in range(rng.randint(0, 40))]
        item = [rng.randint(1, 3) for _ in range(rng.randint(1, 20))]
        got = d.greedy_tiles(doc, item, 3)
        assert sorted(got) == sorted(plain_tiles(doc, item, 3)), (doc, item)


def test_search_finds_whole_reordered_and_spares_parts():
    item = prose(1, 40)
    words = item.split()
    bench = d.Benchmark([(7, item), (8, prose(2, 40)), (9, "")])
    swapped = " ".join(words[20:] + ["between"] + words[:20])
    for text in (item, item.upper().replace(" ", ", "), "x " * 3000 + swapped + " y" * 3000):
        (hit,) = bench.search(text)
        assert hit["item_id"] == 7 and hit["coverage"] == 1.0
    assert bench.search(swapped)[0]["n_tiles"] == 2
    assert not bench.search(" ".join(words[:20])) and not bench.search(None) and not bench.search(prose(3, 500))


def test_short_item_and_two_texts_of_one_id():
    bench = d.Benchmark([(1, "only three words"), (1, prose(4, 30))])
    assert [f["item_tokens"] for f in bench.search("here are only three words of it")] == [3]
    assert [f["item_tokens"] for f in bench.search(prose(4, 30))] == [30]


def test_search_equals_tiling_of_the_whole_text():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(6)]
    for _ in range(60):
        item = [rng.choice(words) for _ in range(25)]
        doc = [rng.choice(words) for _ in range(30)] + item[10:] + ["zz"] + item[:10]
        bench = d.Benchmark([(1, " ".join(item))], threshold=0.0)
        whole = sum(t[2] for t in plain_tiles(doc, item, 5))
        found = bench.search(" ".join(doc))
        assert (found[0]["covered_tokens"] if found else 0) == whole


def test_query_and_filter(spark):
    text = prose(100, 30)
    bench = spark.createDataFrame([(1, text), (2, None), (None, prose(101, 30)), (3, "")], "item_id long, text string")
    extra = spark.createDataFrame([(900, "start " + text + " end", "en", "a", 1)], documents(spark).schema)
    docs = documents(spark).unionByName(extra).unionByName(extra)
    assert [(r.doc_id, r.item_id, r.coverage) for r in d.contaminations(docs, bench).collect()] == [(900, 1, 1.0)] * 2
    assert d.drop_contaminated(docs, bench).count() == documents(spark).count()
    assert d.drop_contaminated(crowded(spark), bench).columns == crowded(spark).columns
    assert d.contaminations(empty(spark), bench).count() == 0 and d.contaminations(docs, bench.limit(0)).count() == 0


def test_blocks_see_every_item(spark):
    bench = spark.createDataFrame([(f"set-{i}", prose(i, 20)) for i in range(30)], "item_id string, text string")
    blocks = list(d.benchmark_blocks(bench, block_chars=500))
    assert len(blocks) > 3 and sorted(i for _, b in blocks for i, _ in b) == sorted(f"set-{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"{prose(i, 20)} {prose(i + 1, 20)}") for i in range(0, 40, 2)], "doc_id long, text string")
    one, many = ([tuple(r) for r in d.contaminations(docs, bench, block_chars=n).orderBy("doc_id", "item_id").collect()] for n in (10**6, 500))
    assert one == many and [r[1] for r in one[:2]] == ["set-0", "set-1"] and len(one) == 30
    assert d.drop_contaminated(docs, bench, block_chars=500).count() == d.drop_contaminated(docs, bench).count() == 5


def test_texts_that_repeat_themselves_stay_fast():
    rng = random.Random(4)
    two = ["a", "b"]
    cases = [("a b " * 10_000, "a b " * 500), (" ".join(rng.choices(two, k=20_000)), " ".join(rng.choices(two, k=1000))), ("a " * 20_000, "a " * 20_000)]
    for text, item in cases:
        began = time.perf_counter()
        found = d.Benchmark([(1, item)]).search(text)
        assert time.perf_counter() - began < 4
        assert found and found[0]["coverage"] > 0.9


def test_one_seed_of_many_items_is_no_work(spark):
    """Items that share a phrase with a text but can't be covered are never tiled."""
    bench = d.Benchmark([(i, f"what is the capital of {prose(i, 30)}") for i in range(2000)])
    began = time.perf_counter()
    assert not bench.search("what is the capital of " * 200) and time.perf_counter() - began < 1


def test_rolling_hashes():
    import numpy as np

    ids = np.array([3, 1, 4, 1, 5, 9, 2, 6, 3, 1, 4, 1, 5], np.uint64)
    for width in (1, 3, 5):
        plain = [sum(int(t) * pow(d.BASE, k, 1 << 64) for k, t in enumerate(ids[i : i + width])) % (1 << 64) for i in range(len(ids) - width + 1)]
        assert d.Rolling(ids).windows(width).tolist() == plain


def test_items_without_an_id_count(spark):
    a, b = prose(100, 30), prose(101, 30)
    bench = spark.createDataFrame([(1, a), (None, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, b), (2, f"{b} {a} {b}"), (3, prose(5, 30))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.contaminations(docs, bench).orderBy("doc_id").collect()] == [(1, None), (2, 1), (2, None)]
    assert [r.doc_id for r in d.drop_contaminated(docs, bench).collect()] == [3]
