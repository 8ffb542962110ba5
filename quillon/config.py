"""Engine settings and errors."""

from __future__ import annotations

from dataclasses import asdict, dataclass


class EngineError(Exception):
    """Base of the engine's errors."""


class InvalidArgument(EngineError):
    """A value that can never be right: a wrong dimension, a corrupt checkpoint."""


class NotFound(EngineError):
    """A key or checkpoint that does not exist."""


class AlreadyExists(EngineError):
    """A target that must not exist yet."""


class ResourceExhausted(EngineError):
    """A new key in a shard that is full."""


class Internal(EngineError):
    """A state that should not occur."""


class Unavailable(EngineError):
    """The engine is closed."""


#: Defaults of the public contract. Fixed values.
@dataclass(frozen=True)
class EngineConfig:
    dim: int = 0
    num_shards: int = 1
    similarity: str = "dot"  # or "cosine"
    topk_default: int = 10
    max_points_per_shard: int = 0  # 0: no limit
    index: str = "flat"  # "hnsw", "ivf_flat", "ivf_sq8"
    hnsw_m: int = 16
    hnsw_ef_construction: int = 200
    hnsw_ef_search: int = 50
    hnsw_seed: int = 42
    ivf_nlist: int = 100
    ivf_nprobe: int = 10
    max_candidates: int = 2000
    rerank_factor: int = 4
    global_seed: int = 0
    contract_version: int = 3

    def checked(self) -> EngineConfig:
        if self.dim <= 0 or self.num_shards <= 0:
            raise InvalidArgument("dim and num_shards must be above 0")
        if self.similarity not in ("dot", "cosine"):
            raise InvalidArgument(f"unknown similarity {self.similarity!r}")
        if self.index not in ("flat", "hnsw", "ivf_flat", "ivf_sq8"):
            raise InvalidArgument(f"unknown index {self.index!r}")
        return self

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class QueryPolicy:
    """max_latency_ms and recall_bias are accepted and have no effect."""

    max_latency_ms: int = 0
    max_candidates: int = 0
    recall_bias: float = 0.0
    fusion_method: str = "weighted_sum"  # or "rrf"


def resolve_topk(topk: int | None, cfg: EngineConfig) -> int:
    """Values of 0 or below stand for the default."""
    return topk if topk and topk > 0 else cfg.topk_default


def candidate_bound(topk: int, cfg: EngineConfig) -> tuple[int, int]:
    """(rows to return, candidates to gather)."""
    bounded = min(topk, cfg.max_candidates)
    return bounded, min(max(bounded * cfg.rerank_factor, bounded), cfg.max_candidates)
