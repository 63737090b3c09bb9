import random
import re
from collections import Counter

import pytest
from data import crowded, document_rows, documents, empty
from pyspark.sql import functions as F

from quillgrain.llm import quality_rules as r
from quillgrain.llm.common import let, words


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_against_definition(spark):
    rng = random.Random(6)
    more = [(1000 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\na b\na b"])) for i in range(150)]
    rows = [(d, t) for d, t, *_ in document_rows()] + more
    got = r.judge_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda x: (str(x[0]), x[1:])
    assert sorted(((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got), key=key) == sorted(((d, *plain(t)) for d, t in rows), key=key)
    for g in got:
        assert g.base_failed == (g.n_words < 10 or 100 * g.n_repeat_words > 20 * g.n_words)
        assert not (g.kept and g.base_failed)


def _first_rejections(spark, rules):
    text = F.coalesce("text", F.lit(""))
    return [x[0] for x in documents(spark).select(let(words(text), lambda w: r.cascade(rules, r.counts(w, text)))).collect()]


def test_verdict_is_the_same_in_any_order(spark):
    rules = [*r.base_rules(), *r.more_rules()]
    forth, back = _first_rejections(spark, rules), _first_rejections(spark, rules[::-1])
    assert [x is None for x in forth] == [x is None for x in back] and forth != back
    assert None in forth and len(set(forth)) >= 3


def test_cascade_stops_at_the_first_rejection(spark):
    """A rule behind a rejecting one is never computed: here it would fail the job."""
    broken = r.Rule("broken", lambda m: F.raise_error(F.concat(F.lit("computed "), m["n_words"].cast("string"))).isNotNull())
    everything = r.Rule("all", lambda m: m["n_words"] >= 0)
    assert set(_first_rejections(spark, [everything, broken])) == {"all"}
    with pytest.raises(Exception, match="computed"):
        _first_rejections(spark, [broken, everything])


def test_rules_catch_junk(spark):
    clean = "This is a plain document of enough different words to be kept by every rule there is."
    junk = {1: clean.replace(" ", "### "), 2: clean.upper().replace(" ", "!! "), 3: " ".join(w for w in clean.split() for _ in "ab"), 4: "\n".join(["one more line of text " + x for x in "aab"]), 5: "1234 " * 3 + "5678 90 12 34 56 78 90 11 22"}
    docs = spark.createDataFrame([(0, clean), *junk.items()], "doc_id long, text string")
    kept = {x.doc_id for x in r.judge_documents(docs).collect() if x.kept}
    assert 0 in kept and not kept & {1, 2, 3, 5}


def test_order_by_rejection_per_measured_cost(spark):
    docs = spark.range(3000).select(F.concat(F.lit("text "), F.col("id"), F.repeat(F.lit(" of words that come again"), 30)).alias("text"))
    rules = [
        r.Rule("dear", lambda m: (m["n_repeat_words"] >= 0) & (m["n_letters"] >= 0)),
        r.Rule("never", lambda m: m["n_words"] < 0),
        r.Rule("cheap", lambda m: m["n_words"] >= 0),
    ]
    found = r.estimates(docs, rules)
    assert found["dear"].nanoseconds > 5 * found["cheap"].nanoseconds and [found[n].rejected for n in ("dear", "never", "cheap")] == [1.0, 0.0, 1.0]
    assert [x.name for x in r.order_rules(rules, found)] == ["cheap", "dear", "never"]
    # A dear rule that rejects much goes before a cheap one that rejects little.
    assert [x.name for x in r.order_rules(rules[:2], {"dear": r.Estimate(100.0, 0.5), "never": r.Estimate(10.0, 0.01)})] == ["dear", "never"]


def test_filter_keeps_columns(spark):
    kept = r.keep_good(crowded(spark))
    assert kept.columns == crowded(spark).columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x.doc_id) for x in r.judge_documents(documents(spark)).collect() if x.kept)
    assert r.judge_documents(empty(spark)).count() == 0 and r.keep_good(empty(spark)).count() == 0
