"""Settings of the ranking pipeline."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from math import isfinite


@dataclass(frozen=True)
class PipelineConfig:
    rrf_k: int = 60
    seed_k: int = 2
    result_limit: int = 3
    lexical_weight: float = 0.5
    rrf_weight: float = 0.3
    graph_weight: float = 0.2

    def __post_init__(self) -> None:
        if self.rrf_k < 0:
            raise ValueError("rrf_k must be non-negative")
        if self.seed_k < 1 or self.result_limit < 1:
            raise ValueError("seed_k and result_limit must be positive")
        weights = (self.lexical_weight, self.rrf_weight, self.graph_weight)
        if any(not isfinite(w) or w < 0 for w in weights) or sum(weights) <= 0:
            raise ValueError("weights must be finite, non-negative and not all zero")


def load_config(path: str) -> PipelineConfig:
    """Settings from a TOML file; ``[weights]`` holds ``lexical``, ``rrf`` and ``graph``."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    weights = data.pop("weights", {})
    if not isinstance(weights, dict):
        raise ValueError("[weights] must be a table")
    names = {"lexical": "lexical_weight", "rrf": "rrf_weight", "graph": "graph_weight"}
    return PipelineConfig(**{k: int(data[k]) for k in ("rrf_k", "seed_k", "result_limit") if k in data}, **{v: float(weights[k]) for k, v in names.items() if k in weights})
