"""What an engine's run gives: the scores as a table, and facts about the run."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPTIONAL = ("win_pr", "loss_pr", "exposure", "teleport")


@dataclass(frozen=True)
class RankResult:
    """``scores`` has an entity, its score and any of OPTIONAL."""

    scores: DataFrame
    lambda_used: float | None = None
    iterations: int | None = None
    converged: bool = True
    computation_time: float | None = None
    stage_timings: dict[str, float] = field(default_factory=dict)

    def to_dataframe(self, id_column: str = "entity_id", score_column: str = "score") -> DataFrame:
        more = [c for c in OPTIONAL if c in self.scores.columns]
        return self.scores.select(F.col("entity_id").alias(id_column), F.col("score").alias(score_column), *more)

    def get_top_n(self, count: int = 10) -> DataFrame:
        """The best, ties by id."""
        return self.to_dataframe().orderBy(F.desc("score"), "entity_id").limit(count)
