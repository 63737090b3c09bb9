"""Models as injected providers, and stand-ins that need none."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

Embedder = Callable[[list[str]], list[list[float]]]
Predictor = Callable[[list[tuple[str, str]]], list[float]]
Answerer = Callable[[list[str]], list[str]]


def hash_embedding(texts: list[str], dim: int = 32) -> list[list[float]]:
    """Signed hashed words, of unit length."""
    out = []
    for text in texts:
        vector = np.zeros(dim)
        for word in re.findall(r"\w+", text.lower()):
            digest = hashlib.sha256(word.encode()).digest()
            vector[digest[0] % dim] += 1.0 if digest[1] % 2 == 0 else -1.0
        out.append((vector / (np.linalg.norm(vector) or 1.0)).tolist())
    return out


def first_passage_answer(prompts: list[str]) -> list[str]:
    """A stand-in that cites the first evidence, or says there is none."""
    return ["According to the evidence [1]." if "[1]" in p else "No evidence." for p in prompts]


def embed(text: Column, make: Callable[[], Embedder], dim: int, batch: int = 16) -> Column:
    """Vectors from a provider built once a task; wrong counts, lengths and values raise."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            found: list[list[float]] = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch].tolist()
                got = model(part)
                if len(got) != len(part):
                    raise ValueError("the embedding provider returned another number of vectors")
                for v in got:
                    if len(v) != dim or not np.isfinite(v).all() or not np.any(v):
                        raise ValueError("the embedding provider returned an invalid vector")
                found += got
            yield pd.Series(found)

    return vectors(text)


def isolated(call: Callable[[list], list], items: list) -> list[tuple[Any, str | None]]:
    """(result, error) of each item: a batch that fails is halved until the items that fail stand alone.

    One bad item costs about twice the logarithm of the batch in further calls;
    if all fail, each is tried once by itself.
    """
    try:
        got = list(call(items))
        if len(got) != len(items):
            raise ValueError("the provider returned another number of results")
        return [(g, None) for g in got]
    except Exception as error:  # noqa: BLE001  any failure stays with its item
        if len(items) == 1:
            return [(None, f"{type(error).__name__}: {error}"[:200])]
        half = len(items) // 2
        return isolated(call, items[:half]) + isolated(call, items[half:])


def _made(make: Callable[[], Callable]) -> Callable[[list], list]:
    """The provider; one that can't be built fails each call with what it said."""
    try:
        return make()
    except Exception as error:  # noqa: BLE001
        message, kind = str(error), type(error)

        def down(_: list) -> list:
            raise kind(message)

        return down


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])
SAID = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def cross_scores(query: Column, passage: Column, make: Callable[[], Predictor]) -> Column:
    """struct<score, error>: sigmoid scores of (query, passage) pairs, clamped to [0, 1], or why a pair has none."""

    @pandas_udf(SCORED)
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = _made(make)

        def call(pairs: list) -> list[float]:
            raw = np.asarray(model(pairs), dtype=float)
            if raw.shape != (len(pairs),) or not np.isfinite(raw).all():
                raise ValueError("the cross encoder must return one finite score a pair")
            return np.clip(1 / (1 + np.exp(-raw)), 0.0, 1.0).tolist()

        for queries, passages in batches:
            yield pd.DataFrame(isolated(call, list(zip(queries, passages))), columns=SCORED.names).astype({"score": float})

    return scores(query, passage)


def generate_or_error(prompt: Column, make: Callable[[], Callable[[list], list[str]]]) -> Column:
    """struct<text, error>: what a provider says of each prompt (texts or bytes), or why it says nothing; null prompts aren't sent."""

    @pandas_udf(SAID)
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _made(make)

        def call(prompts: list) -> list[str]:
            got = list(model(prompts))
            if len(got) == len(prompts) and any(not (a or "").strip() for a in got):
                raise ValueError("the provider returned an empty answer")
            return got

        for prompts in batches:
            out = pd.DataFrame({"text": None, "error": None}, index=prompts.index, dtype=object)
            sent = prompts[prompts.notna()]
            if len(sent):
                out.loc[sent.index] = pd.DataFrame(isolated(call, sent.tolist()), columns=SAID.names, index=sent.index, dtype=object)
            yield out

    return said(prompt)


def generate(prompt: Column, make: Callable[[], Answerer]) -> Column:
    """Answers from a provider; an empty one raises."""

    @pandas_udf(T.StringType())
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for prompts in batches:
            said = model(prompts.tolist())
            if any(not (a or "").strip() for a in said):
                raise ValueError("the chat provider returned an empty answer")
            yield pd.Series(said)

    return answers(prompt)
