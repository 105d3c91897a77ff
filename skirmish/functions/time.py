"""Time and decay expressions.  Times are epoch seconds; the present is always a literal."""
from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.config import SECONDS_PER_DAY


@dataclass
class Clock:
    """The present, fixed if given (0 counts as given)."""

    now_timestamp: float | None = None

    @property
    def now(self) -> float:
        return time.time() if self.now_timestamp is None else float(self.now_timestamp)

    def days_ago(self, days: float) -> float:
        return self.now - days * SECONDS_PER_DAY

    def days_since(self, timestamp: float) -> float:
        return (self.now - timestamp) / SECONDS_PER_DAY


def epoch(df: DataFrame, name: str) -> Column:
    """A column of numbers or timestamps as seconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType | T.DateType):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def event_ts(df: DataFrame, default: float, names: Sequence[str] = ("completed_at", "created_at", "last_game_finished_at", "match_created_at", "timestamp", "ts")) -> Column:
    """The first time that a row has, else the default."""
    return F.coalesce(*(epoch(df, c) for c in names if c in df.columns), F.lit(float(default)))


def decay(ts: Column, now: float, rate: float) -> Column:
    return F.exp(-F.lit(rate) * (F.lit(float(now)) - ts) / SECONDS_PER_DAY)


def half_life_decay(days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), days / half_life) if half_life > 0 else F.lit(1.0)


def inactivity_decay(score: Column, last: Column, now: float, delay_days: float, rate: float) -> Column:
    """Scores move towards zero once an entity has rested longer than the delay."""
    return score * F.exp(-F.lit(rate) * F.greatest(F.lit(0.0), (F.lit(float(now)) - last) / SECONDS_PER_DAY - delay_days))


def filter_by_recency(df: DataFrame, ts: str, now: float, max_days: float) -> DataFrame:
    return df.where(epoch(df, ts) >= now - max_days * SECONDS_PER_DAY)


def add_time_features(df: DataFrame, ts: str, now: float) -> DataFrame:
    """days_ago, week_of_year (ISO), day_of_week (1 is Monday) and is_weekend (from Friday on, as day 5 counts)."""
    seconds = epoch(df, ts)
    moment = F.timestamp_micros((seconds * 1_000_000).cast("long"))
    day = F.weekday(moment) + 1
    return df.withColumns({"days_ago": (F.lit(float(now)) - seconds) / SECONDS_PER_DAY, "week_of_year": F.weekofyear(moment), "day_of_week": day, "is_weekend": day >= 5})


def time_windows(spark: SparkSession, start: float, end: float, size_days: float, stride_days: float | None = None) -> DataFrame:
    """Windows [start, min(start + size, end)) in steps of the stride."""
    size, step = size_days * SECONDS_PER_DAY, (stride_days or size_days) * SECONDS_PER_DAY
    many = max(0, -int(-(end - start) // step))
    at = F.lit(float(start)) + F.col("id") * step
    return spark.range(many).select(at.alias("window_start"), F.least(at + size, F.lit(float(end))).alias("window_end")).where(F.col("window_start") < end)
