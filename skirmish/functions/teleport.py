"""Teleport vectors: (node, t) summing to one."""
from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TeleportStrategy(Protocol):
    def __call__(self, nodes: DataFrame, edges: DataFrame, source: str) -> DataFrame: ...


def _shares(weighted: DataFrame) -> DataFrame:
    """(node, t) scaled to one; uniform if the sum isn't a positive number."""
    total = weighted.agg(F.sum("t").alias("s"), F.count("*").alias("n")).select(F.when((F.col("s") > 0) & (F.col("s") < float("inf")), F.col("s")).alias("s"), "n")
    return weighted.join(F.broadcast(total)).select("node", F.when(F.col("s").isNull(), F.lit(1.0) / F.col("n")).otherwise(F.col("t") / F.col("s")).alias("t"))


def uniform(nodes: DataFrame, edges: DataFrame | None = None, source: str = "src") -> DataFrame:
    return _shares(nodes.select("node", F.lit(1.0).alias("t")))


#: Stands for a mode that knows active players; it is uniform.
active_players = uniform


def volume_inverse(nodes: DataFrame, edges: DataFrame, source: str = "src") -> DataFrame:
    """One over the root of a node's edges, one edge at least."""
    return inverse_root(nodes, edges.groupBy(F.col(source).alias("node")).agg(F.count("*").alias("n")))


def inverse_root(nodes: DataFrame, many: DataFrame) -> DataFrame:
    """The same from counts (node, n)."""
    return _shares(nodes.select("node").join(many, "node", "left").select("node", (F.lit(1.0) / F.sqrt(F.coalesce("n", F.lit(1)).cast("double"))).alias("t")))


def custom(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights (node, w); 1 where none is given."""
    return _shares(nodes.select("node").join(weights.select("node", "w"), "node", "left").select("node", F.coalesce("w", F.lit(1.0)).alias("t")))


def from_share(nodes: DataFrame, metrics: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """In proportion to the share of each entity, a little more for all."""
    return _shares(nodes.select("node").join(metrics.select(F.col("id").alias("node"), "share"), "node", "left").select("node", (F.coalesce("share", F.lit(0.0)) + epsilon).alias("t")))
