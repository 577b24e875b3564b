"""Tunables with their defaults and range checks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_token_min: int = 50
    chunk_token_max: int = 400
    chunk_overlap_ratio: float = 0.3
    max_distance: float = 4.0
    search_mode: str = "two_stage"
    use_topics: bool = True
    topic_weight: float = 0.3
    topic_min_similarity: float = 0.5
    l2_top_k: int = 5
    chunk_top_k: int = 50
    min_cluster_size: int = 2
    min_samples: int = 1
    metric: str = "cosine"
    selection: str = "eom"
    selection_epsilon: float = 0.0
    max_context_tokens: int = 14000
    max_context_chars: int = 8000
    embed_batch: int = 128
    embed_dim: int = 64

    def __post_init__(self):
        checks = {
            "chunk_token_min": self.chunk_token_min >= 0,
            "chunk_token_max": self.chunk_token_max > 0 and self.chunk_token_max >= self.chunk_token_min,
            "chunk_overlap_ratio": 0.0 <= self.chunk_overlap_ratio <= 1.0,
            "max_distance": self.max_distance >= 0.0,
            "search_mode": self.search_mode in ("two_stage", "direct"),
            "topic_weight": 0.0 <= self.topic_weight <= 1.0,
            "min_cluster_size": self.min_cluster_size >= 2,
            "min_samples": self.min_samples >= 1,
            "metric": self.metric in ("cosine", "euclidean", "manhattan"),
            "selection": self.selection in ("eom", "leaf"),
            "embed_batch": self.embed_batch > 0,
            "embed_dim": self.embed_dim > 0,
        }
        bad = [name for name, ok in checks.items() if not ok]
        if bad:
            raise ValueError("out of range: " + ", ".join(bad))
