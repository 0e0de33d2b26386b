"""Settings of the engine, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass


def _need(ok: bool, rule: str) -> None:
    if not ok:
        raise ValueError(rule)


@dataclass(frozen=True)
class DynamicsConfig:
    half_life: int = 120
    registration_gain: float = 3.0
    retrieval_gain: float = 0.75
    familiarity_gain: float = 0.08
    mass_gain: float = 0.15
    diffusion: float = 0.12
    active_budget: int = 256
    floor: float = 1e-4
    territory_threshold: float = 0.55
    territory_members: int = 256

    def __post_init__(self):
        _need(self.half_life >= 1, "half_life: 1 tick or more")
        for name in ("registration_gain", "retrieval_gain", "familiarity_gain", "mass_gain"):
            _need(getattr(self, name) >= 0, f"{name}: not negative")
        _need(0 <= self.diffusion < 1, "diffusion: from 0 to below 1")
        _need(self.active_budget >= 1, "active_budget: 1 or more")
        _need(self.floor > 0, "floor: above 0")
        _need(-1 <= self.territory_threshold <= 1, "territory_threshold: from -1 to 1")
        _need(self.territory_members >= 1, "territory_members: 1 or more")


@dataclass(frozen=True)
class QueryConfig:
    top_k: int = 8
    territories: int = 3
    candidates: int = 256
    hops: int = 1
    graph_candidates: int = 128
    state_weight: float = 0.05

    def __post_init__(self):
        _need(self.top_k >= 1, "top_k: 1 or more")
        _need(self.territories >= 1, "territories: 1 or more")
        _need(self.candidates >= self.top_k, "candidates: at least top_k")
        _need(self.hops >= 0 and self.graph_candidates >= 0, "hops, graph_candidates: not negative")
        _need(0 <= self.state_weight <= 0.25, "state_weight: from 0 to 0.25")


@dataclass(frozen=True)
class EngineConfig:
    tick_seconds: float = 3.0
    snapshot_ticks: int = 100
    chunk_chars: int = 1800
    least_chunk_chars: int = 64
    similarity_threshold: float = 0.55
    similarity_candidates: int = 200
    settle_window: int = 8
    settle_heat: float = 1e-3
    stimulus_batch: int = 256
    grace_seconds: float = 5.0

    def __post_init__(self):
        _need(self.tick_seconds > 0 and self.grace_seconds > 0, "tick_seconds, grace_seconds: above 0")
        _need(self.snapshot_ticks >= 1 and self.stimulus_batch >= 1, "snapshot_ticks, stimulus_batch: 1 or more")
        _need(self.chunk_chars >= self.least_chunk_chars, "chunk_chars: at least least_chunk_chars")
        _need(-1 <= self.similarity_threshold <= 1, "similarity_threshold: from -1 to 1")
        _need(self.similarity_candidates >= 1, "similarity_candidates: 1 or more")
        _need(self.settle_window >= 1 and self.settle_heat >= 0, "settle_window: 1 or more, settle_heat: not negative")
