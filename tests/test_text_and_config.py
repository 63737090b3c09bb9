import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrain.config import ChunkConfig, EvidenceConfig, RetrievalConfig, merge_settings
from quillgrain.functions import providers, text as tx
from quillgrain.functions.tokens import approximate_tokens, ruler, token_count
from quillgrain.functions.vectors import is_valid, normalized


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Hello, C++ v1.2. _x_", ["hello", "c++", "v1.2", "x"]),
        ("数据的库", ["数", "据", "库", "数据", "据库"]),
        ("的", []),
        ("Ünï A", ["n", "a"]),
        (None, []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, text, tx.tokenize) == tokens


def test_query_terms(spark):
    assert set(one(spark, "请问 spark spark 介绍", tx.query_terms)) == {"spark", "问"}


def test_normalize_and_snippet(spark):
    assert one(spark, "a　 b\r\n\r\n  ｃ \r", tx.normalize_text) == "a b\nc"
    assert one(spark, " a \n b ", tx.snippet) == "a b"
    long = one(spark, "ab " * 100, tx.snippet)
    assert long.endswith("...") and len(long) <= 163


def test_line_of_and_types(spark):
    assert one(spark, "a\nb\nc", lambda c: tx.line_of(c, F.lit(3))) == 2
    assert one(spark, " .HTML ", tx.source_type) == "html"
    assert one(spark, "x <b>y", tx.looks_like_html) and not one(spark, "1 < 2 > 0", tx.looks_like_html)


@pytest.mark.parametrize(("said", "got"), [('<think>x</think>```json\n{"q": " a "}\n```', "a"), ('{"q": "a", "r": 1}', None), ("no json", None), ('{"q": ""}', None)])
def test_model_json(spark, said, got):
    assert one(spark, said, lambda c: tx.model_json(c, "q")) == got


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(is_valid(F.col("v"), 2)).collect()] == [True, False, False, False, False]
    assert df.select(normalized(F.col("v"))).first()[0] == [0.6, 0.8]


def test_tokens():
    assert approximate_tokens("") == 0 and approximate_tokens("数据 abcde.") == 5
    text = "word " * 50
    end = ruler(text, approximate_tokens).reach(0, len(text), 10)
    assert approximate_tokens(text[:end]) <= 10 < approximate_tokens(text[: end + 2])


@settings(max_examples=200, deadline=None)
@given(st.text("ab_9 \n.é数据😀\x1c", max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(1, 9))
def test_ruler_measures_like_counting(text, a, b, budget):
    """Ranges that start or end within a word included; the reach is the furthest end within the budget."""
    start, stop = sorted((min(a, len(text)), min(b, len(text))))
    default, other = ruler(text, approximate_tokens), ruler(text, lambda t: approximate_tokens(t))
    assert default.count(start, stop) == approximate_tokens(text[start:stop]) == other.count(start, stop)
    assert default.reach(start, stop, budget) == other.reach(start, stop, budget)


def test_token_column(spark):
    rows = ["", None, "数据 abcde.", "a\x1cb é9_ü\u00a0x\u3000y", "long_word_of_many_letters, 12345!"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(token_count(F.col("t"))).collect()] == [approximate_tokens(r or "") for r in rows]


def test_providers(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "t string")
    vectors = [r[0] for r in df.select(providers.embed(F.col("t"), lambda: providers.hash_embedding, 32)).collect()]
    assert all(len(v) == 32 and abs(sum(x * x for x in v) - 1) < 1e-6 for v in vectors)
    scored = lambda model: [tuple(r[0]) for r in df.select(providers.cross_scores(F.col("t"), F.col("t"), lambda: model)).collect()]
    assert scored(lambda pairs: [0.0] * len(pairs)) == [(0.5, None)] * 2
    # A score that isn't finite is its pair's failure, not the batch's.
    found = scored(lambda pairs: [float("inf") if q == "c" else 0.0 for q, _ in pairs])
    assert found[0] == (0.5, None) and found[1][0] is None and "one finite score" in found[1][1]


def test_config_is_strict():
    assert RetrievalConfig.of({"mode": " Hybrid "}).mode == "hybrid" and RetrievalConfig().pool == 30
    for bad in ({"top_k": True}, {"top_k": 40}, {"mode": "x"}, {"vector_weight": 0.5}, {"threshold": float("nan")}, {"rerank_level": "parent"}, {"rerank_top_n": 3}):
        with pytest.raises(ValueError):
            RetrievalConfig.of(bad)
    for bad in ({"child_max_tokens": 200}, {"parent_target_tokens": 800}, {"child_target_tokens": 0}):
        with pytest.raises(ValueError):
            ChunkConfig.of(bad)
    assert EvidenceConfig().prompt_limit() == 216_000 and EvidenceConfig().prompt_limit(9) == 9
    assert merge_settings({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    for bad in ({"x": 1}, {"a": 1}, {"a": {"z": 1}}):
        with pytest.raises(ValueError):
            merge_settings({"a": {"b": 1}}, bad)


def test_builder_tokens_of_odd_and_long_texts(spark):
    """Pairs over gaps, runs of one character, and 40,000 CJK characters in one pass."""

    def plain(text):
        low = (text or "").lower()
        chars = re.findall("[\u3400-\u9fff]", low)
        return list(dict.fromkeys([w for w in re.findall("[a-z0-9]+", low) if len(w) > 1] + [a + b for a, b in zip(chars, chars[1:])]))

    texts = [None, "", "a", "AB a1 ab-AB_c9", "中", "中 x文\n国\u2028文 ab国", "é中ÀB鿿㐀", "中中中", "😀中😀文 z" + "q" * 3, "".join(chr(0x4E00 + i * 7919 % 20000) + "。 " for i in range(40_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in df.select("i", tx.builder_tokens(F.col("t"))).orderBy("i").collect()] == [plain(t) for t in texts]


def test_normalize_lines_of_odd_texts(spark):
    texts = [None, "", " ", "\r", "\r\n\r", "a\r\rb\r\nc\n\rd", "  a \t b\u00a0\u3000c \n\x0b\n \u2028 d\u0085", "a\x1c b", "x" + " " * 50_000 + "y"]
    space = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    plain = lambda t: "\n".join(x for line in re.sub("\r\n?", "\n", t).split("\n") if (x := re.sub(space, " ", line).strip(" ")))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in df.select("i", tx.normalize_lines(F.col("t"))).orderBy("i").collect()] == [None if t is None else plain(t) for t in texts]
