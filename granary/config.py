"""Engine settings, passed explicitly to whatever uses them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    top_k: int = 5
    chunk_max_chars: int = 2000
    chunk_new_after: int = 1500
    chunk_combine_under: int = 200
    min_chunk_words: int = 50
    window_words: int = 350
    window_overlap: int = 75
    num_perm: int = 128
    shingle_k: int = 3
    lsh_bands: int = 128
    lsh_rows: int = 1
    preselect: int = 50
    exact_rerank: int = 50
    simhash_threshold: int = 10
    near_dup_hamming: int = 4
    alpha: float = 0.5
    beta: float = 0.5
    fusion_retrieval: float = 0.7
    fusion_pagerank: float = 0.3
    pagerank_alpha: float = 0.85
    pagerank_iterations: int = 100
    pagerank_tolerance: float = 1e-6
    fim_support: int = 3
    fim_triple_support: int = 3
    fim_top_n: int = 3
    fim_min_idf: float = 3.0
    expand_queries: bool = False
    max_features: int = 20000
    min_df: int = 2
    max_df: float = 0.85
    min_text_quality: float = 0.25

    def __post_init__(self) -> None:
        if self.lsh_bands * self.lsh_rows != self.num_perm:
            raise ValueError("lsh_bands * lsh_rows must be num_perm")
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be between 1 and 50")
