"""Smoothing strategies: the denominator of a loser's edges, from its loss and win weights."""
from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class SmoothingStrategy(Protocol):
    def __call__(self, loss: Column, win: Column) -> Column: ...


def no_smoothing() -> SmoothingStrategy:
    return lambda loss, win: loss


def wins_proportional(gamma: float = 0.02, cap_ratio: float = 1.0) -> SmoothingStrategy:
    if math.isinf(cap_ratio):
        return lambda loss, win: loss + gamma * win
    return lambda loss, win: loss + F.least(gamma * win, cap_ratio * loss)


def constant(epsilon: float = 1e-6) -> SmoothingStrategy:
    return lambda loss, win: loss + epsilon


def adaptive(base: float = 0.1, scale: float = 100.0) -> SmoothingStrategy:
    return lambda loss, win: loss + win * base / (1 + (loss + win) / scale)


def hybrid(epsilon: float = 1e-6, gamma: float = 0.01) -> SmoothingStrategy:
    return lambda loss, win: loss + epsilon + gamma * win


_KINDS: dict[str, tuple[Callable[..., SmoothingStrategy], tuple[str, ...]]] = {
    "none": (no_smoothing, ()),
    "wins_proportional": (wins_proportional, ("gamma", "cap_ratio")),
    "constant": (constant, ("epsilon",)),
    "adaptive": (adaptive, ("base", "scale")),
    "hybrid": (hybrid, ("epsilon", "gamma")),
}


def smoothing_strategy(kind: str, **settings: Any) -> SmoothingStrategy:
    """A strategy by name; settings that it doesn't have are ignored."""
    if kind not in _KINDS:
        raise ValueError(f"Unknown smoothing mode: {kind}. Known: {', '.join(_KINDS)}")
    make, names = _KINDS[kind]
    return make(**{k: v for k, v in settings.items() if k in names})
