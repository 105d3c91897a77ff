"""Edges and metrics from resolved matches."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.functions.smoothing import SmoothingStrategy
from skirmish.operators.numbering import numbered


def entity_metrics(resolved: DataFrame) -> DataFrame:
    """(id, share, weight, ts): sums over an entity's matches, and the last time."""
    both = F.explode(F.concat("winners", "losers")).alias("id")
    return resolved.select(both, "share", "weight", "ts").where("id IS NOT NULL").groupBy("id").agg(F.sum("share").alias("share"), F.sum("weight").alias("weight"), F.max("ts").alias("ts"))


def appeared(resolved: DataFrame) -> DataFrame:
    return resolved.select(F.explode(F.concat("winners", "losers")).alias("id")).where("id IS NOT NULL").distinct()


def merged_nodes(resolved: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(id) of all that appeared or are active."""
    out = appeared(resolved)
    return out.union(active.select("id").where("id IS NOT NULL")).distinct() if active is not None else out


def index_mapping(nodes: DataFrame) -> DataFrame:
    """(id, idx): places in order of id.  For kernels only; joins use ids."""
    return numbered(nodes.where("id IS NOT NULL").select("id").distinct(), "id")


def pairs(resolved: DataFrame, value: str) -> DataFrame:
    each = resolved.select(F.explode("winners").alias("winner_id"), "losers", value).select("winner_id", F.explode("losers").alias("loser_id"), value)
    return each.where("winner_id IS NOT NULL AND loser_id IS NOT NULL")


def pair_edges(resolved: DataFrame) -> DataFrame:
    """(winner_id, loser_id, share)"""
    return pairs(resolved, "share").groupBy("winner_id", "loser_id").agg(F.sum("share").alias("share"))


def row_edges(resolved: DataFrame) -> DataFrame:
    """(loser_id, winner_id, weight_sum)"""
    return pairs(resolved, "weight").groupBy("loser_id", "winner_id").agg(F.sum("weight").alias("weight_sum"))


def event_row_edges(resolved: DataFrame) -> DataFrame:
    """(event_id, loser_id, winner_id, base): re-weighted by event without joining and exploding again."""
    each = resolved.select("event_id", F.explode("winners").alias("winner_id"), "losers", "weight").select("event_id", "winner_id", F.explode("losers").alias("loser_id"), "weight")
    return each.where("winner_id IS NOT NULL AND loser_id IS NOT NULL").groupBy("event_id", "loser_id", "winner_id").agg(F.sum("weight").alias("base"))


def group_edges(weighted: DataFrame) -> DataFrame:
    """(loser_id, winner_id, weight_sum) between groups."""
    return weighted.groupBy("loser_id", "winner_id").agg(F.sum("weight").alias("weight_sum"))


def triplets(edges: DataFrame, nodes: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(row, col, value) by place; edges of unknown ids are left out."""
    index = index_mapping(nodes)
    a, b = index.select(F.col("id").alias(row), F.col("idx").alias("row")), index.select(F.col("id").alias(col), F.col("idx").alias("col"))
    return edges.join(a, row).join(b, col).select("row", "col", F.col(value).alias("value"))


def denominators(edges: DataFrame, strategy: SmoothingStrategy) -> DataFrame:
    """(node, loss, win, denom, lambda) of every loser."""
    loss = edges.groupBy(F.col("loser_id").alias("node")).agg(F.sum("weight_sum").alias("loss"))
    win = edges.groupBy(F.col("winner_id").alias("node")).agg(F.sum("weight_sum").alias("win"))
    out = loss.join(win, "node", "left").withColumn("win", F.coalesce("win", F.lit(0.0)))
    out = out.withColumn("denom", strategy(F.col("loss"), F.col("win")))
    return out.withColumn("lambda", F.col("denom") - F.col("loss"))


def normalize(edges: DataFrame, denoms: DataFrame) -> DataFrame:
    """Adds denom (1 if unknown) and normalized_weight (0 for a zero denom)."""
    out = edges.join(denoms.select(F.col("node").alias("loser_id"), "denom"), "loser_id", "left").withColumn("denom", F.coalesce("denom", F.lit(1.0)))
    return out.withColumn("normalized_weight", F.when(F.col("denom") != 0, F.col("weight_sum") / F.col("denom")).otherwise(0.0))
