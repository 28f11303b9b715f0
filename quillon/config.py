"""A retrieval configuration and its label."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

#: The parts of a label.
RETRIEVERS = ("bm25", "dense", "hybrid", "grep", "kg")
TRANSFORMS = ("none", "hyde", "multi_query", "decompose")
EXPANSIONS = ("none", "window", "parent")


@dataclass(frozen=True)
class RetrievalConfig:
    strategy: str = "passage"
    retriever: str = "hybrid"
    transform: str = "none"
    rerank: bool = False
    expansion: str = "none"
    top_k: int = 5
    candidate_k: int = 20

    def __post_init__(self) -> None:
        for name, of in (("retriever", RETRIEVERS), ("transform", TRANSFORMS), ("expansion", EXPANSIONS)):
            if getattr(self, name) not in of:
                raise ValueError(f"unknown {name}: {getattr(self, name)}")
        if not 1 <= self.top_k <= 20 or not 1 <= self.candidate_k <= 100:
            raise ValueError("top_k goes from 1 to 20, candidate_k from 1 to 100")

    @property
    def label(self) -> str:
        parts = [self.strategy, self.retriever, self.transform if self.transform != "none" else "", "rerank" if self.rerank else "", self.expansion if self.expansion != "none" else ""]
        return "+".join(p for p in parts if p)

    @property
    def depth(self) -> int:
        """Hits to retrieve: more where a reranker chooses among them."""
        return self.candidate_k if self.rerank else self.top_k

    @staticmethod
    def parse(label: str, **options) -> RetrievalConfig:
        strategy, retriever, *layers = label.split("+")
        if bad := [x for x in layers if x not in (*TRANSFORMS, *EXPANSIONS, "rerank")]:
            raise ValueError(f"unknown layers: {bad}")
        pick = lambda of: next((x for x in layers if x in of), "none")
        return RetrievalConfig(strategy, retriever, pick(TRANSFORMS), "rerank" in layers, pick(EXPANSIONS), **options)


def matrix(strategies, retrievers, transforms=("none",), rerank=(False,), expansions=("none",), **options) -> list[RetrievalConfig]:
    """Every combination of the axes."""
    return [RetrievalConfig(s, r, t, k, e, **options) for s, r, t, k, e in itertools.product(strategies, retrievers, transforms, rerank, expansions)]


def validated_question(text: str) -> str:
    if not 3 <= len(text) <= 1000:
        raise ValueError("a question has 3 to 1000 characters")
    return text
