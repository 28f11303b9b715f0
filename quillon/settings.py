"""Settings with their defaults; each may be set by an environment variable QUILLON_<NAME>."""

from __future__ import annotations

import dataclasses
import functools
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """What a deployment may change; `Engine` reads all of it. Numbers are the defaults of the operators."""

    retriever: str = "hybrid"
    strategy: str = "passage"
    top_k: int = 5
    candidate_k: int = 20
    rrf_constant: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    embedding_dim: int = 64
    graph_candidates: int = 40
    graph_neighbours: int = 15
    graph_damping: float = 0.3
    grep_candidates: int = 50

    @staticmethod
    def load(environment: dict[str, str] | None = None) -> Settings:
        env, given = os.environ if environment is None else environment, {}
        for field in dataclasses.fields(Settings):
            value = env.get(f"QUILLON_{field.name.upper()}")
            if value is not None:
                given[field.name] = type(field.default)(value)
        return Settings(**given)


@functools.cache
def settings() -> Settings:
    """The settings of this process."""
    return Settings.load()
