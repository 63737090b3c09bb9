"""Strict, frozen configuration: wrong types, unknown fields and broken relations are refused."""

from __future__ import annotations

import dataclasses
import math
from typing import Any, Self


def _strict(value: Any, kind: type, name: str) -> None:
    ok = isinstance(value, bool) if kind is bool else isinstance(value, kind) and not isinstance(value, bool)
    if not ok or (isinstance(value, float) and not math.isfinite(value)):
        raise ValueError(f"{name}: expected {kind.__name__}, got {value!r}")


@dataclasses.dataclass(frozen=True, kw_only=True)
class _Config:
    @classmethod
    def of(cls, given: Self | dict[str, Any] | None = None, **more: Any) -> Self:
        """A validated object, from another one (passed through), a dict and keywords."""
        if isinstance(given, cls) and not more:
            return given
        fields = (dataclasses.asdict(given) if isinstance(given, cls) else dict(given or {})) | more
        if unknown := set(fields) - {f.name for f in dataclasses.fields(cls)}:
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        return cls(**fields)

    def _need(self, holds: bool, said: str) -> None:
        if not holds:
            raise ValueError(said)


@dataclasses.dataclass(frozen=True, kw_only=True)
class ChunkConfig(_Config):
    parent_target_tokens: int = 512
    parent_max_tokens: int = 768
    child_target_tokens: int = 128
    child_max_tokens: int = 192
    embedding_budget: int = 192
    align_to_boundary: bool = True
    preserve_code: bool = True
    preserve_table: bool = True

    def __post_init__(self):
        for f in dataclasses.fields(self):
            _strict(getattr(self, f.name), bool if f.name.startswith(("align", "preserve")) else int, f.name)
        self._need(0 < self.parent_target_tokens <= self.parent_max_tokens, "parent target must be positive and at most the maximum")
        self._need(0 < self.child_target_tokens <= self.child_max_tokens <= self.embedding_budget, "child target <= child maximum <= embedding budget")


@dataclasses.dataclass(frozen=True, kw_only=True)
class RetrievalConfig(_Config):
    top_k: int = 5
    candidate_top_k: int = 30
    threshold: float = 0.1
    mode: str = "hybrid"
    rerank: bool = False
    reranker: str = "rule"
    rerank_level: str = "child"
    aggregation: str = "max"
    rerank_top_n: int | None = None
    filters: dict[str, Any] | None = None

    def __post_init__(self):
        for name in ("mode", "reranker", "rerank_level", "aggregation"):
            _strict(getattr(self, name), str, name)
            object.__setattr__(self, name, getattr(self, name).strip().lower())
        for name in ("top_k", "candidate_top_k"):
            _strict(getattr(self, name), int, name)
            self._need(getattr(self, name) > 0, f"{name} must be positive")
        _strict(float(self.threshold) if isinstance(self.threshold, int) and not isinstance(self.threshold, bool) else self.threshold, float, "threshold")
        _strict(self.rerank, bool, "rerank")
        self._need(0 <= self.threshold <= 1, "threshold must lie in [0, 1]")
        for name, choices in (("mode", ("vector", "keyword", "hybrid")), ("reranker", ("rule", "cross_encoder")), ("rerank_level", ("child", "parent")), ("aggregation", ("mean", "max"))):
            self._need(getattr(self, name) in choices, f"{name} must be one of {choices}")
        self._need(self.rerank_level == "child" or self.reranker == "cross_encoder", "parents are reranked by a cross encoder only")
        if self.rerank_top_n is not None:
            _strict(self.rerank_top_n, int, "rerank_top_n")
        self._need(self.top_k <= self.pool <= self.candidate_top_k, "top_k <= rerank_top_n <= candidate_top_k")

    @property
    def pool(self) -> int:
        return self.candidate_top_k if self.rerank_top_n is None else self.rerank_top_n


@dataclasses.dataclass(frozen=True, kw_only=True)
class EvidenceConfig(_Config):
    mode: str = "window"
    context_top_k: int = 5
    window_tokens: int = 384
    context_limit: int = 256_000
    completion_reserve: int = 32_000
    safety: int = 8_000
    evidence_max_tokens: int = 16_000

    def __post_init__(self):
        self._need(self.mode in ("child_only", "window", "full_parent"), "unknown evidence mode")
        for f in dataclasses.fields(self):
            if f.name != "mode":
                _strict(getattr(self, f.name), int, f.name)
                self._need(getattr(self, f.name) > 0, f"{f.name} must be positive")

    def prompt_limit(self, provider_limit: int = 0) -> int:
        """Tokens left for a prompt; a provider's own limit of more than 0 also holds."""
        left = self.context_limit - self.completion_reserve - self.safety
        return min(left, provider_limit) if provider_limit > 0 else left


def merge_settings(base: dict[str, Any], over: dict[str, Any], path: str = "") -> dict[str, Any]:
    """``over`` laid on ``base`` level by level; keys that base lacks and non-mappings over sections raise."""
    merged = dict(base)
    for key, value in over.items():
        where = f"{path}.{key}" if path else key
        if key not in base:
            raise ValueError(f"unknown setting: {where}")
        if isinstance(base[key], dict):
            if not isinstance(value, dict):
                raise ValueError(f"section expected: {where}")
            value = merge_settings(base[key], value, where)
        merged[key] = value
    return merged


def read_settings(spark, *paths: str) -> dict[str, Any]:
    """Settings of JSON or TOML files, read through Spark; each file is laid on the ones before it, whose keys it may not add to."""
    import json
    import tomllib

    merged: dict[str, Any] | None = None
    for path in paths:
        text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
        try:
            own = tomllib.loads(text) if path.endswith(".toml") else json.loads(text)
        except ValueError as error:
            raise ValueError(f"{path}: {error}") from error
        if not isinstance(own, dict):
            raise ValueError(f"{path}: a section is expected")
        merged = own if merged is None else merge_settings(merged, own)
    return merged or {}
