"""Graphs too large for one task's arrays, whose weights change by event: dealt out once, then weighed anew by factors.

Both kinds give ``flow``, what flows along win and loss edges for a row of ranks over sums each, and ``sums``, the weight that
leaves each node on either.  ``factors`` has a number per event of ``events``.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.operators.blocks import Blocks, Index
from skirmish.operators.numbering import numbered
from skirmish.session import cut

ONE = "all"


def factors(events: np.ndarray, strength: DataFrame | None, beta: float) -> np.ndarray:
    """Strengths to the power of beta, 1 for events without one."""
    out = np.ones(len(events))
    if strength is not None and len(events):
        got = strength.select("event_id", F.col("strength").cast("double")).dropna().toArrow()
        ids, values = got["event_id"].to_numpy(), got["strength"].to_numpy()
        at = np.minimum(np.searchsorted(events, ids), len(events) - 1)
        known = events[at] == ids
        out[at[known]] = values[known] ** beta
    return out


def event_ids(df: DataFrame) -> np.ndarray:
    return np.sort(df.select("event_id").distinct().toArrow()["event_id"].to_numpy())


class PairFlows:
    """Pairs (event_id, loser_id, winner_id, base), row edges only."""

    def __init__(self, pairs: DataFrame, nodes: np.ndarray) -> None:
        self.pairs, self.events = pairs, event_ids(pairs)
        index = Index({ONE: nodes})
        entries = pairs.select(F.lit(ONE).alias("graph"), "loser_id", "winner_id", F.col("base").alias("w"), F.col("event_id").alias("tag"))
        self.forth = Blocks.build(entries, index, index, "loser_id", "winner_id", self.events)
        self.back = Blocks.build(entries, index, index, "winner_id", "loser_id", self.events)

    def flow(self, x: np.ndarray, factors: np.ndarray) -> np.ndarray:
        return self.forth.apply(x, factors)

    def sums(self, factors: np.ndarray) -> np.ndarray:
        return self.back.apply(np.ones((1, self.back.rows)), factors)

    def edges(self) -> DataFrame:
        """(node, n): how many winners each loser has."""
        return self.pairs.select("loser_id", "winner_id").distinct().groupBy(F.col("loser_id").alias("node")).agg(F.count("*").alias("n"))


class RosterFlows:
    """All pairs of two rosters that met, as a product of memberships, matches and memberships; no pairs are made."""

    def __init__(self, weighted: DataFrame, participants: DataFrame, share: bool = False) -> None:
        sides = weighted.select("event_id", "winner_id", "loser_id", "weight", "ts")
        keys = sides.select("event_id", F.explode(F.array("winner_id", "loser_id")).alias("group_id")).distinct()
        self.units = cut(numbered(keys, "event_id", "group_id", name="unit"))
        rows = cut(participants.select("event_id", "group_id", "entity_id").join(self.units, ["event_id", "group_id"]).select("unit", "event_id", F.col("entity_id").alias("id")))
        self.rows = rows.where("id IS NOT NULL")
        units = self.units.join(rows.groupBy("unit").agg(F.count("*").alias("n")), "unit", "left")
        for side in ("winner", "loser"):
            sides = sides.join(units.select("event_id", F.col("group_id").alias(f"{side}_id"), F.col("unit").alias(side), F.col("n").alias(f"{side}_n")), ["event_id", f"{side}_id"])
        value = F.col("weight") / (F.col("winner_n") * F.col("loser_n")) if share else F.col("weight")
        self.matches = cut(sides.select("event_id", "winner", "loser", value.alias("w"), "weight", "ts", (F.col("winner_n") * F.col("loser_n")).alias("pairs")))
        found = self.units.select("unit", "event_id").toArrow()
        self.events = np.unique(found["event_id"].to_numpy())
        self.event_of = np.zeros(len(found), np.int32)
        self.event_of[found["unit"].to_numpy()] = np.searchsorted(self.events, found["event_id"].to_numpy())

    @property
    def complete(self) -> bool:
        """Whether each side of each match has members."""
        return self.matches.where("pairs IS NULL OR pairs = 0").isEmpty()

    def deal(self, nodes: np.ndarray) -> None:
        """Makes the matrices for these nodes."""
        who, units = Index({ONE: nodes}), Index({ONE: np.arange(len(self.event_of))})
        entries = self.rows.select(F.lit(ONE).alias("graph"), "id", "unit", F.lit(1.0).alias("w"))
        self.gather, self.scatter = Blocks.build(entries, who, units, "id", "unit"), Blocks.build(entries, units, who, "unit", "id")
        met = self.matches.select(F.lit(ONE).alias("graph"), "winner", "loser", "w")
        self.win, self.loss = Blocks.build(met, units, units, "loser", "winner"), Blocks.build(met, units, units, "winner", "loser")

    def flow(self, x: np.ndarray, factors: np.ndarray) -> np.ndarray:
        s = self.gather.apply(x)
        for row, matches in zip(s, (self.win, self.loss), strict=False):
            row[:] = matches.apply(row) * factors[self.event_of]
        return self.scatter.apply(s)

    def sums(self, factors: np.ndarray, graphs: int = 1) -> np.ndarray:
        size = self.gather.apply(np.ones(self.scatter.rows))
        each = [matches.apply(size) * factors[self.event_of] for matches in (self.loss, self.win)[:graphs]]
        return self.scatter.apply(np.stack(each))

    def edges(self) -> DataFrame:
        """(node, n): how many different winners each loser has.  Its opponents' rosters are gathered and counted once."""
        met = self.matches.select("loser", "winner").distinct()
        faced = self.rows.select(F.col("unit").alias("loser"), F.col("id").alias("node")).join(met, "loser").select("node", "winner").distinct()
        lists = self.rows.groupBy(F.col("unit").alias("winner")).agg(F.collect_set("id").alias("ids"))
        all_ids = F.array_distinct(F.flatten(F.collect_list("ids")))
        return faced.join(lists, "winner").groupBy("node").agg(F.size(all_ids).cast("long").alias("n"))

    def metrics(self, strength: DataFrame | None, beta: float) -> DataFrame:
        """(id, share, weight, ts) as of entity_metrics; ``share`` must have been asked for."""
        m = self.matches
        if strength is not None:
            m = m.join(F.broadcast(strength.select("event_id", F.pow(F.col("strength").cast("double"), F.lit(float(beta))).alias("f"))), "event_id", "left")
            m = m.withColumns({c: F.col(c) * F.coalesce("f", F.lit(1.0)) for c in ("w", "weight")})
        unit = m.select(F.explode(F.array("winner", "loser")).alias("unit"), "w", "weight", "ts").groupBy("unit").agg(F.sum("w").alias("w"), F.sum("weight").alias("weight"), F.max("ts").alias("ts"))
        return self.rows.join(unit, "unit").groupBy("id").agg(F.sum("w").alias("share"), F.sum("weight").alias("weight"), F.max("ts").alias("ts"))
