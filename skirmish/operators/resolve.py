"""From matches to weighted matches with the entities of both sides."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.functions import time as times
from skirmish.session import cut


def competitive(matches: DataFrame) -> DataFrame:
    """Matches with both sides that aren't walkovers."""
    bye = next((c for c in ("walkover", "is_bye") if c in matches.columns), None)
    kept = matches.where("winner_id IS NOT NULL AND loser_id IS NOT NULL")
    return kept.where(~F.coalesce(F.col(bye), F.lit(False))) if bye else kept


def weighted_matches(matches: DataFrame, now: float, decay_rate: float, beta: float = 1.0, influence: DataFrame | None = None, legacy_fill: bool = False, timestamp: str | None = None) -> DataFrame:
    """Adds ts and weight.  ``influence`` is (event_id, strength), 1 where an event is missing.  ``legacy_fill`` takes
    missing times for the beginning of time rather than for now, as the paths of row and group edges do where events have
    an influence (the tick-tock engine's always have)."""
    df = competitive(matches)
    if legacy_fill:
        df = df.withColumns({c: F.coalesce(times.epoch(df, c), F.lit(1.0)) for c in {"completed_at", "created_at", timestamp} if c in df.columns})
    if timestamp and timestamp in df.columns:
        ts = times.epoch(df, timestamp)
    else:
        ts = times.event_ts(df, now, ("completed_at", "created_at"))
    df = df.withColumn("ts", ts)
    if influence is not None:
        df = df.join(influence.select("event_id", F.col("strength").cast("double")), "event_id", "left")
    strength = F.coalesce("strength", F.lit(1.0)) if influence is not None else F.lit(1.0)
    df = df.withColumn("strength", strength)
    weight = times.decay(F.col("ts"), now, decay_rate)
    return df.withColumn("weight", weight if beta == 0 else weight * F.pow("strength", F.lit(float(beta))))


def rosters(participants: DataFrame) -> DataFrame:
    """(event_id, group_id, members, size); nulls count in the size.  Grouped ones pass through."""
    if isinstance(participants.schema["entity_id"].dataType, T.ArrayType):
        return participants.select("event_id", "group_id", F.col("entity_id").alias("members"), F.size("entity_id").cast("long").alias("size"))
    return participants.groupBy("event_id", "group_id").agg(F.sort_array(F.collect_list("entity_id")).alias("members"), F.count("*").alias("size"))


def several_groups(participants: DataFrame) -> DataFrame:
    """Entities that are in more than one group of an event."""
    return participants.groupBy("event_id", "entity_id").agg(F.countDistinct("group_id").alias("n_groups")).where("n_groups > 1")


def samples(df: DataFrame, *columns: str) -> str:
    """Up to five rows for an error's text."""
    rows = df.select(*columns).distinct().orderBy(*columns).limit(5).collect()
    return ", ".join("/".join(str(x) for x in r) for r in rows)


def _named(appearances: DataFrame, participants: DataFrame) -> DataFrame:
    """With group_id, which is taken from the rosters where the column is missing, if that is clear."""
    if "group_id" in appearances.columns:
        return appearances
    twice = several_groups(participants)
    if not twice.isEmpty():
        raise ValueError(f"appearances need group_id: some entities are in several groups of an event ({samples(twice, 'event_id', 'entity_id')})")
    return appearances.join(participants.select("event_id", "entity_id", "group_id").dropDuplicates(["event_id", "entity_id"]), ["event_id", "entity_id"], "left")


def _all_named(appearances: DataFrame) -> None:
    lost = appearances.where("group_id IS NULL")
    if not lost.isEmpty():
        raise ValueError(f"Could not infer group_id for some appearances ({samples(lost, 'event_id', 'match_id', 'entity_id')})")


def appearance_groups(appearances: DataFrame, participants: DataFrame) -> DataFrame:
    """(event_id, match_id, group_id, members, size).  Without group_id it is taken from the rosters, if that is clear."""
    if isinstance(appearances.schema["entity_id"].dataType, T.ArrayType):
        return appearances.select("event_id", "match_id", "group_id", F.col("entity_id").alias("members"), F.size("entity_id").cast("long").alias("size"))
    appearances = _named(appearances, participants)
    _all_named(appearances)
    return appearances.groupBy("event_id", "match_id", "group_id").agg(F.sort_array(F.collect_list("entity_id")).alias("members"), F.count("*").alias("size"))


SIDES = (("winner", "winners"), ("loser", "losers"))


def _by_appearances(out: DataFrame, appearances: DataFrame, participants: DataFrame) -> DataFrame:
    """Both sides by their appearances, null where they have none, computed and kept: a match's rows are gathered and joined
    once for both."""
    if isinstance(appearances.schema["entity_id"].dataType, T.ArrayType):
        groups = appearance_groups(appearances, participants)
        for side, name in SIDES:
            out = out.join(groups.select("event_id", "match_id", F.col("group_id").alias(f"{side}_id"), F.col("members").alias(name), F.col("size").alias(f"{side}_count")), ["event_id", "match_id", f"{side}_id"], "left")
        return cut(out)
    appearances = _named(appearances, participants)
    group = F.coalesce("group_id", F.raise_error("an appearance has no group_id")).alias("group_id")  # found while reading, not by a run of its own
    lists = appearances.groupBy("event_id", "match_id").agg(F.collect_list(F.struct(group, "entity_id")).alias("rows"))
    out = out.join(lists, ["event_id", "match_id"], "left")

    def own(side: str) -> Column:
        return F.filter("rows", lambda x: x["group_id"] == F.col(f"{side}_id"))

    some = lambda side, value: F.when(F.size(own(side)) > 0, value)
    ids = lambda side: F.sort_array(F.filter(F.transform(own(side), lambda x: x["entity_id"]), lambda x: x.isNotNull()))
    out = out.withColumns({k: v for side, name in SIDES for k, v in {name: some(side, ids(side)), f"{side}_count": some(side, F.size(own(side)).cast("long"))}.items()}).drop("rows")
    try:
        return cut(out)
    except PySparkException:
        _all_named(appearances)
        raise


def resolve(weighted: DataFrame, participants: DataFrame, appearances: DataFrame | None = None, share: bool = True, check: bool = True, keep: bool = False) -> DataFrame:
    """match_id, event_id, winners, losers, weight, ts[, winner_count, loser_count, share].  Each side has the match's
    appearances, else the event's roster; a side without members is an error.  Rosters are read only for sides without
    appearances.  ``keep`` cuts the result's lineage."""
    out = weighted.select("event_id", "match_id", "winner_id", "loser_id", "weight", "ts")
    whole, kept = None, False
    if appearances is not None:
        out, kept = _by_appearances(out, appearances, participants), True
        lacks = F.expr("winners IS NULL OR losers IS NULL")
        if out.where(lacks).isEmpty():
            check = False
        else:
            whole, out, kept = out.where(~lacks), out.where(lacks).withColumnsRenamed({"winners": "winners_seen", "winner_count": "winner_n", "losers": "losers_seen", "loser_count": "loser_n"}), False
    if not kept:
        roster = rosters(participants)
        for side, name in SIDES:
            out = out.join(roster.select("event_id", F.col("group_id").alias(f"{side}_id"), F.col("members").alias(name), F.col("size").alias(f"{side}_count")), ["event_id", f"{side}_id"], "left")
            if whole is not None:
                out = out.withColumns({name: F.coalesce(f"{name}_seen", name), f"{side}_count": F.coalesce(f"{side}_n", f"{side}_count")}).drop(f"{name}_seen", f"{side}_n")
        out = whole.unionByName(out) if whole is not None else out
        out = cut(out) if keep else out
    if check:
        lost = out.where("coalesce(winner_count, 0) = 0 OR coalesce(loser_count, 0) = 0")
        if not lost.isEmpty():
            raise ValueError(f"Could not resolve winner/loser participants for some matches ({samples(lost, 'event_id', 'match_id')})")
    out = out.withColumn("share", F.col("weight") / (F.col("winner_count") * F.col("loser_count")))
    names = ["match_id", "event_id", "winners", "losers", "weight", "ts"]
    return out.select(*names, "winner_count", "loser_count", "share") if share else out.select(*names)


def keep_entities(resolved: DataFrame, kept: DataFrame) -> DataFrame:
    """Matches all of whose members are among the kept (id)."""
    members = resolved.select("event_id", "match_id", F.explode(F.concat("winners", "losers")).alias("id")).where("id IS NOT NULL")
    return resolved.join(members.join(kept.select("id"), "id", "left_anti").select("event_id", "match_id").distinct(), ["event_id", "match_id"], "left_anti")


def participants_by_event(resolved: DataFrame) -> DataFrame:
    """(event_id, members): the different entities of an event's matches."""
    each = resolved.select("event_id", F.explode(F.concat("winners", "losers")).alias("id")).where("id IS NOT NULL").distinct()
    return each.groupBy("event_id").agg(F.sort_array(F.collect_list("id")).alias("members"))


def match_records(resolved: DataFrame) -> list[dict]:
    """Rows for callers that want dictionaries; for small results."""
    return [{"winners": r["winners"], "losers": r["losers"], "weight": r["weight"], "tournament_id": r["event_id"], "match_id": r["match_id"], "timestamp": r["ts"]} for r in resolved.collect()]


def group_match_records(weighted: DataFrame) -> list[dict]:
    """As match_records, of the groups themselves."""
    return [{"winners": [r["winner_id"]], "losers": [r["loser_id"]], "weight": r["weight"], "tournament_id": r["event_id"], "match_id": r["match_id"], "timestamp": r["ts"]} for r in weighted.collect()]


@dataclass(frozen=True)
class Membership:
    valid: DataFrame
    invalid: DataFrame


def membership(appearances: DataFrame, participants: DataFrame) -> Membership:
    """Appearances that the rosters bear out, and the others."""
    keys = ["event_id", "group_id", "entity_id"]
    known = participants.select(*keys).distinct()
    return Membership(appearances.join(known, keys, "left_semi"), appearances.join(known, keys, "left_anti"))
