"""Options shared by the retrieval, re-ranking and request jobs."""

from __future__ import annotations

from dataclasses import dataclass

# The ranking methods a request may name.
METHODS = ("tfidf", "bm25", "embedding", "hybrid", "rerank", "ltr")


@dataclass(frozen=True)
class SearchOptions:
    default_top_k: int = 10
    max_top_k: int = 100
    candidate_pool_size: int = 100
    candidate_depth: int = 50
    alpha: float = 0.4
    beta: float = 0.6
    pair_max_chars: int | None = None
    bm25_saturation: float = 8.0
    min_query_length: int = 1
    max_query_length: int = 256
    methods: tuple[str, ...] = METHODS

    def __post_init__(self) -> None:
        problems = []
        if self.default_top_k < 1 or self.max_top_k < self.default_top_k:
            problems.append("need 1 <= default_top_k <= max_top_k")
        if self.candidate_pool_size < 10:
            problems.append("candidate_pool_size must be at least 10")
        if not 1 <= self.candidate_depth <= self.candidate_pool_size:
            problems.append("need 1 <= candidate_depth <= candidate_pool_size")
        if not 1 <= self.min_query_length <= self.max_query_length:
            problems.append("need 1 <= min_query_length <= max_query_length")
        if not (0.0 <= self.alpha <= 1.0 and 0.0 <= self.beta <= 1.0):
            problems.append("alpha and beta must lie in [0, 1]")
        if self.pair_max_chars is not None and self.pair_max_chars < 1:
            problems.append("pair_max_chars must be positive")
        if self.bm25_saturation <= 0:
            problems.append("bm25_saturation must be positive")
        if problems:
            raise ValueError("; ".join(problems))
