"""Influence of events from the scores of those who took part.  Tables: members (event_id, id), scores (id, score)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scored(members: DataFrame, scores: DataFrame, prior: float | None = None) -> DataFrame:
    out = members.select("event_id", "id").join(scores.select("id", "score"), "id", "left")
    if prior is not None:
        out = out.withColumn("score", F.coalesce("score", F.lit(float(prior))))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc_nulls_last("score"), "id")))


def _top(n: int, value: Column) -> Column:
    return F.when(F.col("place") <= n, value)


def tournament_influence(members: DataFrame, scores: DataFrame, method: str = "arithmetic") -> DataFrame:
    """(event_id, strength): arithmetic or geometric mean of all or of the 20 best; 1 for events without scores."""
    x, log = F.col("score"), F.ln(F.col("score") + 1e-10)
    ways = {"arithmetic": F.avg(x), "geometric": F.exp(F.avg(log)), "top_20_sum": F.avg(_top(20, x)), "top_20_geom": F.exp(F.avg(_top(20, log)))}
    if method not in ways:
        raise ValueError(f"Unknown influence method: {method}")
    return _scored(members, scores).groupBy("event_id").agg(F.coalesce(ways[method], F.lit(1.0)).alias("strength"))


def compat_influence(members: DataFrame, scores: DataFrame, method: str, prior: float, normalize: bool = True) -> DataFrame:
    """The variant that the alternating engine uses: missing scores count as the prior; scaled to a mean of one."""
    x = F.col("score")
    top20, top10 = F.sum(_top(20, x)), F.sum(_top(10, x))
    ways = {"mean": F.avg(x), "arithmetic": F.avg(x), "sum": F.sum(x), "median": F.percentile(x, 0.5), "top_20_sum": top20, "log_top_20_sum": top20, "sqrt_top_20_sum": F.sqrt(top20), "top_10_sum": top10, "top_20_mean": F.avg(_top(20, x))}
    if method not in ways:
        raise ValueError(f"Unknown influence method: {method}")
    out = _scored(members, scores, prior).groupBy("event_id").agg(ways[method].alias("strength"))
    if normalize:
        out = mean_one(out)
        if method.startswith("log_"):
            out = mean_one(out.withColumn("strength", F.log1p("strength")))
    return out


def mean_one(influence: DataFrame) -> DataFrame:
    mean = influence.agg(F.avg("strength").alias("mean"))
    return influence.join(F.broadcast(mean)).select("event_id", F.when(F.col("mean") > 0, F.col("strength") / F.col("mean")).otherwise(F.lit(1.0)).alias("strength"))


def normalize_influence(influence: DataFrame, method: str = "minmax") -> DataFrame:
    s = F.col("strength")
    if method == "none":
        return influence
    if method not in ("minmax", "zscore", "log"):
        raise ValueError(f"Unknown normalization method: {method}")
    seen = influence.agg(F.min("strength").alias("lo"), F.max("strength").alias("hi"), F.avg("strength").alias("mean"), F.stddev_pop("strength").alias("sd"))
    one = F.lit(1.0)
    ways = {
        "minmax": F.when(F.col("hi") > F.col("lo"), 0.5 + 1.5 * (s - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(one),
        "zscore": F.when(F.col("sd") > 0, 1 + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (s - F.col("mean")) / F.col("sd"))) / 2).otherwise(one),
        "log": F.log1p(s),
    }
    return influence.join(F.broadcast(seen)).select("event_id", ways[method].alias("strength"))


def multi_round(rounds: DataFrame, weights: DataFrame) -> DataFrame:
    """(event_id, strength) from (round, event_id, strength) and (round, weight): weighted means over the rounds with it."""
    return rounds.join(F.broadcast(weights), "round").groupBy("event_id").agg((F.sum(F.col("weight") * F.col("strength")) / F.sum("weight")).alias("strength"))


def retrospective_strength(edges: DataFrame, ranks: DataFrame, rate: float = 0.1) -> DataFrame:
    """(id, strength): of each winner, the sum of its losers' ranks times weight times exp(-rate weight)."""
    w = F.col("weight_sum")
    return edges.join(ranks.select(F.col("node").alias("loser_id"), "rank"), "loser_id").groupBy(F.col("winner_id").alias("id")).agg(F.sum(F.col("rank") * w * F.exp(-F.lit(rate) * w)).alias("strength"))
