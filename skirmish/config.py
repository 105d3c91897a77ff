"""Settings of the engines.  Fixed values: the names and defaults are the public interface."""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

SECONDS_PER_DAY = 86400.0


@dataclass(frozen=True)
class DecayConfig:
    half_life_days: float = 30.0

    @property
    def decay_rate(self) -> float:
        return math.log(2) / self.half_life_days if self.half_life_days > 0 else 0.0


@dataclass(frozen=True)
class PageRankConfig:
    alpha: float = 0.85
    tol: float = 1e-8
    max_iter: int = 200
    orientation: str = "row"
    redistribute_dangling: bool = True


@dataclass
class EngineConfig:
    beta: float = 1.0
    min_exposure: float | None = None
    score_decay_delay_days: float = 30.0
    score_decay_rate: float = 0.01
    lambda_smooth: float | None = None
    gamma: float = 0.02
    cap_ratio: float = 1.0
    verbose: bool = False


@dataclass
class TickTockConfig:
    engine: EngineConfig = field(default_factory=EngineConfig)
    pagerank: PageRankConfig = field(default_factory=PageRankConfig)
    decay: DecayConfig = field(default_factory=DecayConfig)
    max_ticks: int = 5
    convergence_tol: float = 1e-4
    teleport_mode: str = "volume_inverse"
    smoothing_mode: str = "wins_proportional"
    influence_method: str = "arithmetic"
    compute_retrospective: bool = True
    retrospective_decay_rate: float = 0.005


@dataclass
class ExposureLogOddsConfig:
    engine: EngineConfig = field(default_factory=EngineConfig)
    pagerank: PageRankConfig = field(default_factory=PageRankConfig)
    decay: DecayConfig = field(default_factory=DecayConfig)
    tick_tock: TickTockConfig = field(default_factory=TickTockConfig)
    use_surprisal: bool = False
    surprisal_mode: str = "basic"
    use_tick_tock_active: bool = True
    active_threshold_days: float = 90.0
    lambda_mode: str = "auto"
    fixed_lambda: float | None = None
    apply_log_transform: bool = True
    score_scale: float = 1.0


def merge_configs(*configs: dict[str, Any]) -> dict[str, Any]:
    """A shallow merge of any number of settings: the last wins."""
    return {key: value for some in configs for key, value in some.items()}
