import random
import re
from collections import Counter

import pyarrow as pa
from data import DOCS, crowded, documents, empty

from quillgrain.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top, max_n, least):
    """The definition, written out: all n-grams of all pieces, all cuts, all longer phrases."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
    often = {g: a for g, a in counts.items() if a >= least}
    out = {}
    for (lang, *w), a in often.items():
        if len(w) < 2:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if not any(x[0] == lang and len(x) - 1 > len(w) and b >= a and inside(list(x[1:])) for x, b in often.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[(lang, *w[:k])], counts[(lang, *w[k:])]))
    return {(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])}


def noise(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "É", "é", "New", "York", "city", "the", "naïve", "😀", "x\x00y", "z"]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", "]) for _ in range(n))


def check(spark, rows, top=1000, max_n=5, least=3, **more):
    docs = spark.createDataFrame([(i, t, lang, None, None) for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    got = [tuple(r) for r in c.collocations(docs, top, max_n, least, **more).collect()]
    want = plain(rows, top, max_n, least)
    assert len(got) == len(set(got)) == len(want) and set(got) == want


def test_against_the_definition(spark):
    rows = [(noise(i, 80), ["en", None, "und", "", "fr\tca"][i % 5]) for i in range(25)] + [(None, "en"), ("", "en"), (" \t. ", "de"), ("one", "de"), ("new york city " * 50, "en"), ("new york city " * 50, "en")]
    check(spark, rows)
    check(spark, rows, top=7, max_n=3)


def test_a_full_bitmap_and_small_blocks_lose_nothing(spark, monkeypatch):
    """Every bit is set sooner or later; then all n-grams are counted, with the same result."""
    rows = [(" ".join(f"w{random.Random(i).randrange(9)}{j % 7}" for j in range(200)), "en") for i in range(12)] + [(noise(7, 300), "en")]
    monkeypatch.setattr(c, "BLOCK", 400)
    check(spark, rows, filter_bits=15)


def test_blocks_of_words():
    texts = pa.array(["Ab c.D", None, "", "é\tF", "..", "g"])
    found = c.Words(texts.slice(0, 6))
    assert found.words.to_pylist() == ["ab", "c", "d", "é", "f", "g"] and found.text.tolist() == [0, 0, 0, 3, 3, 5]
    assert found.runs(2).tolist() == [True, False, False, True, False] and found.phrases(found.runs(2).nonzero()[0], 2).to_pylist() == ["ab c", "é f"]
    assert c.Words(texts.slice(3, 2)).words.to_pylist() == ["é", "f"] and len(c.Words(pa.array([], pa.string())).words) == 0


def test_other_columns_and_empty(spark):
    assert c.collocations(crowded(spark), least=2).count() == c.collocations(documents(spark), least=2).count() > 0
    assert c.collocations(empty(spark)).collect() == []
