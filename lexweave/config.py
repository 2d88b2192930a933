"""All tunables in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # chunking
    chunk_tokens: int = 1200
    chunk_carry: bool = True
    # retrieval
    top_k: int = 25
    rrf_k: int = 60
    tfidf_terms: int = 512
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    rerank: bool = True
    rerank_alpha: float = 0.4
    hyde_dense_k: int = 0
    hyde_dense_weight: float = 0.3
    hyde_chars: int = 300
    ce_top_n: int = 0
    ce_beta: float = 0.7
    ce_doc_chars: int = 1500
    specificity_weight: float = 0.0
    # expansion and traversal
    chunk_discount: float = 0.95
    neighbour_discount: float = 0.8
    edge_discount: float = 0.7
    concept_floor: float = 1.2
    expansion_base: float = 1.5
    expansion_step: float = 0.1
    source_texts: int = 5
    source_chars: int = 2000
    top_communities: int = 5
    # answer
    max_sections: int = 2
    floor_share: float = 0.55
    gap: float = 0.15
    primary_extras: int = 4
    secondary_extras: int = 3
    # evaluation
    retrieved_sections: int = 20

    @property
    def fetch(self) -> int:
        return 10 * self.top_k

    @property
    def pool(self) -> int:
        return max(10 * self.top_k, 100)

    @property
    def returned(self) -> int:
        return 5 * self.top_k

    @property
    def traversal(self) -> int:
        return 3 * self.top_k


DEFAULT = Settings()
