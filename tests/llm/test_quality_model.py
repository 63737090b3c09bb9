import zlib

import numpy as np
from data import documents, empty, prose

from quillgrain.llm import quality_model as q


def labelled(n):
    good = [(i, prose(i, 60)) for i in range(n)]
    bad = [(n + i, " ".join(w + "&&&" for w in prose(n + i, 60).split())) for i in range(n // 2)]
    return good, bad


def test_held_out_accuracy_and_calibration(spark):
    good, bad = labelled(600)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in good + bad], documents(spark).schema)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    rows = q.score_documents(docs, labels).collect()
    truth = {i: 1 for i, _ in good} | {i: 0 for i, _ in bad}
    assert len(rows) == 900
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.97
    assert [r.score for r in q.score_documents(docs, labels).collect()] == [r.score for r in rows]


def test_labels_of_the_held_out_fold_are_never_used(spark):
    good, bad = labelled(60)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in good + bad], documents(spark).schema)
    truth = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad]
    lied = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in truth]
    scores = [[r.score for r in q.score_documents(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()] for x in (truth, lied)]
    assert scores[0] == scores[1]


def test_odd_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = q.score_documents(documents(spark), none).collect()
    assert len(rows) == documents(spark).count() and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(100, 120)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in q.score_documents(documents(spark), one).collect())
    both = spark.createDataFrame([(i, i % 2) for i in range(100, 120)] + [(3, None), (None, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in q.score_documents(documents(spark), both).collect())
    assert q.score_documents(empty(spark), both).count() == 0


def test_long_text_is_read_whole():
    text = prose(1, 50) + " end&&&"
    found, *_ , total = q.counted(text * 40_000)
    assert found["&&&"] > 39_000 and total > 2_000_000


def test_scores_against_a_plain_forward_pass():
    """Word vectors, pooling, network and temperature, written out without arrays."""
    import math

    good, bad = labelled(120)
    texts, labels = [t for _, t in good + bad], [1] * len(good) + [0] * len(bad)
    model = q.QualityModel().fit(texts, labels)
    # A word's vector: the index vectors within two words of it over the sample, at unit length.
    index, word = q.QualityModel().index.tolist(), q.bucket(q.TOKEN.findall(texts[0])[3])
    total, documents_with = [0.0] * q.DIMS, 0
    for t in texts:
        ids = [q.bucket(x) for x in q.TOKEN.findall(t)]
        documents_with += word in ids
        for i, w in enumerate(ids):
            if w == word:
                for j in range(max(0, i - q.WINDOW), min(len(ids), i + q.WINDOW + 1)):
                    if j != i:
                        total = [a + b for a, b in zip(total, index[ids[j]])]
    size = math.sqrt(sum(x * x for x in total))
    want = [x / size for x in total] if documents_with >= q.MIN_DOCUMENTS else [0.0] * q.DIMS
    assert np.allclose(model.vectors[word], want, atol=1e-5)
    for text in [texts[0], texts[-1], "", "one", "a a A!! 7"]:
        tokens = q.TOKEN.findall(text)
        x = [0.0] * (q.DIMS + 7)
        if tokens:
            weights = [float(model.weight[q.bucket(t)]) for t in tokens]
            mean = [sum(w * float(model.vectors[q.bucket(t)][d]) for w, t in zip(weights, tokens)) / sum(weights) for d in range(q.DIMS)]
            n, kinds = len(tokens), set(tokens)
            x = [*mean, math.sqrt(sum(m * m for m in mean)), len(kinds) / n**0.75, math.log1p(n), sum(len(t) > 1 and t.isupper() for t in tokens) / n, sum(a == b for a, b in zip(tokens, tokens[1:])) / n, max(map(tokens.count, kinds)) / n, sum(not t[0].isalnum() for t in tokens) / n]
        net = {k: v.tolist() for k, v in model.net.items()}
        z = [max(-6.0, min(6.0, (a - m) / s)) for a, m, s in zip(x, net["mean"], net["scale"])]
        hidden = [math.tanh(sum(a * net["w1"][i][h] for i, a in enumerate(z)) + net["b1"][h]) for h in range(q.HIDDEN)]
        logit = sum(a * b for a, b in zip(hidden, net["w2"])) + net["b2"][0]
        assert abs(model.score([text])[0] - 1 / (1 + math.exp(-logit / model.temperature))) < 1e-4


def test_sample_is_bounded_in_bytes(spark):
    good, bad = labelled(60)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in good + bad], documents(spark).schema)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    assert q.fit_on_labels(docs, labels, sample_bytes=100).net is None
    assert q.fit_on_labels(docs, labels).net is not None
