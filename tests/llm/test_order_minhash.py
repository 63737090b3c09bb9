import hashlib
from collections import Counter

import numpy as np
import pytest
from data import crowded, document_rows, documents, empty, prose

from quillgrain.llm import order_minhash as o

ALL = (1 << 64) - 1


def mixed(h):
    h = (h ^ h >> 32) * int(o.STEP) & ALL
    return (h ^ h >> 32) * int(o.STEP) & ALL


def plain_signature(text):
    """Each k-mer, its number of occurrence and place, one at a time."""
    k = min(o.K, len(text))
    seen, grams = Counter(), []
    for i in range(len(text) - k + 1 if k else 0):
        h = 0
        for ch in text[i : i + k]:
            h = (h * int(o.BASE) + ord(ch)) & ALL
        grams.append((mixed((h + seen[h] * int(o.NUMBER)) & ALL) >> 32, i, h))
        seen[h] += 1
    out = []
    for f in o.FACTORS.tolist() if grams else []:
        least = sorted((v * f & (1 << 32) - 1, i, h) for v, i, h in grams)[: o.L]
        t = 0
        for _, _, h in sorted(least, key=lambda x: x[1]):
            t = mixed((t * int(o.BASE) + h + 1) & ALL)
        out.append(t >> 48)
    return out


@pytest.mark.parametrize("text", ["", "a", "abc", "abcde", "abcdef", "aaaaaaaaaa", "é😀 ünï" * 3, prose(5, 120), "ab " * 400])
def test_signature_by_definition(text):
    assert o.signature(o.code_points(text)).tolist() == plain_signature(text)


def test_long_texts_in_blocks(monkeypatch):
    whole = o.signature(o.code_points(prose(6, 400))).tolist()
    monkeypatch.setattr(o, "BLOCK", 1000)
    assert o.signature(o.code_points(prose(6, 400))).tolist() == whole


def test_likeness_follows_edits_and_order():
    text = prose(7, 400)
    at = [text, "".join("x" if i % 100 == 50 else ch for i, ch in enumerate(text)), text[: len(text) // 2] + prose(8, 200), prose(9, 400)]
    like = [o.likeness(o.signature(o.code_points(text)), o.signature(o.code_points(t))) for t in at]
    assert like[0] == 1 and like[0] > like[1] > 0.7 and like[1] > like[2] > 0.05 and like[3] == 0
    words = text.split()
    moved = " ".join(words[200:] + words[:200])
    assert o.likeness(o.signature(o.code_points(text)), o.signature(o.code_points(moved))) < like[1] - 0.2


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_documents_by_brute_force(spark, parts):
    rows = [(d, t) for d, t, *_ in document_rows() if d != 1] + [(1, "twice"), (1, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = o.fingerprint_documents(docs).collect()
    hashed = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = Counter()
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        prints = [o.signature(o.code_points(x)) for x in (t, edited, after)]
        as_hex = ["".join(f"{v:04x}" for v in p) for p in prints]
        want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_hex[0], as_hex[1], o.likeness(prints[0], prints[1]), o.likeness(prints[0], prints[2])] += 1
    assert Counter(map(tuple, got)) == want


def test_one_document_other_columns_and_empty(spark):
    one = o.fingerprint_documents(spark.createDataFrame([("k", "abcdef")], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [("k", hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    assert o.fingerprint_documents(crowded(spark)).count() == documents(spark).count()
    assert o.fingerprint_documents(empty(spark)).collect() == []
    prints = documents(spark).select(o.fingerprint_column("text").alias("f")).collect()
    assert {len(r.f) for r in prints} == {0, 2 * o.M} and np.all([r.f is not None for r in prints])
