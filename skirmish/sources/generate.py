"""A synthetic competition of any size, made on the executors."""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skirmish.sources.schema import RankInputs

NOW = 1_700_000_000.0


def synthetic(spark: SparkSession, events: int, teams_per_event: int, matches_per_event: int, roster_size: int, seed: int) -> RankInputs:
    """Matches between two different random groups of an event, completed within 180 days; the same for the same seed.

    Groups are event * 10,000 + place, entities event * 1,000,000 + place * roster_size + place on the roster."""
    if teams_per_event < 2:
        raise ValueError("an event needs two groups at least")
    draw = lambda name, bound: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(bound))
    event = (F.col("id") / matches_per_event).cast("long") + 1
    win = draw("winner", teams_per_event)
    lose = F.pmod(win + 1 + draw("loser", teams_per_event - 1), F.lit(teams_per_event))
    group = lambda place: F.col("event_id") * 10_000 + place
    matches = spark.range(events * matches_per_event).withColumns({"event_id": event, "match_id": F.col("id") + 1, "w": win, "l": lose, "completed_at": F.lit(NOW) - draw("day", 180).cast("double") * 86_400.0})
    each = teams_per_event * roster_size
    places = spark.range(events * each).select(((F.col("id") / each).cast("long") + 1).alias("event_id"), (F.col("id") % each).alias("p"))
    members = places.select("event_id", group((F.col("p") / roster_size).cast("long")).alias("group_id"), (F.col("event_id") * 1_000_000 + F.col("p")).alias("entity_id"))
    return RankInputs(matches.select("event_id", "match_id", group(F.col("w")).alias("winner_id"), group(F.col("l")).alias("loser_id"), "completed_at"), members)


def quality_events(events, mode: str = "none"):  # noqa: ANN001, ANN201
    """Events fit for a benchmark, from a table with is_ranked, team_count, participated_users_count, match_count, name."""
    ranked = F.coalesce(F.col("is_ranked"), F.lit(False)) if mode != "none" else F.lit(True)
    if mode in ("none", "ranked_only"):
        return events.where(ranked)
    if mode != "ranked_quality":
        raise ValueError(f"Unsupported window filter mode: {mode}")
    # fixed values: the thresholds and words of the mode
    large = (F.col("team_count") >= 4) & (F.col("participated_users_count") >= 16) & (F.col("match_count") >= 10)
    return events.where(ranked & large & ~F.col("name").rlike("(?i)test|debug|demo|practice"))
