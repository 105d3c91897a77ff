"""Scores and ranks from the two PageRanks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.operators.numbering import numbered


def resolve_lambda(pr: DataFrame, mode: str = "auto", fixed: float | None = None, fallback: float | None = None) -> float:
    """From win_pr and teleport: 0.025 of the ratio of medians, unless fixed."""
    if fixed is not None:
        return fixed
    if mode != "auto":
        return fallback or 0.0
    win, rho = pr.agg(F.percentile("win_pr", 0.5), F.percentile("teleport", 0.5)).first()
    return max(0.025 * win / rho, 0.0) if rho else 0.0


def log_odds(lam: Column | float, log: bool = True) -> Column:
    smooth = lambda c: F.col(c) + F.lit(lam) * F.col("teleport")
    ratio = smooth("win_pr") / smooth("loss_pr")
    return F.ln(ratio) if log else ratio


def quality_mass(lam: float) -> Column:
    win, loss = F.col("win_pr") + lam * F.col("teleport"), F.col("loss_pr") + lam * F.col("teleport")
    return win / (win + loss)


def floored_score(alpha: float, lam: float) -> Column:
    """The score that leaving matches out is measured by: with a floor under both ranks."""
    floor = F.lit(0.5 * (1 - alpha)) * F.col("teleport")
    side = lambda c: F.greatest(F.col(c), floor) + lam * F.col("teleport")
    return F.ln(side("win_pr") / side("loss_pr"))


def last_activity(ts: Column, now: float) -> Column:
    return F.when(F.coalesce(ts, F.lit(0.0)) == 0, F.lit(float(now))).otherwise(ts)


def ranked(df: DataFrame, min_exposure: float | None = None) -> DataFrame:
    """player_rank by score, ties by id."""
    kept = df.where(F.col("exposure") >= min_exposure) if min_exposure is not None else df
    return numbered(kept, F.desc("score"), F.col("entity_id")).select((F.col("idx") + 1).alias("player_rank"), *kept.columns)


def top_n(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("score"), "entity_id").limit(n)
