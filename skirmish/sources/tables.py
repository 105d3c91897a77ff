"""CSV and Parquet by suffix, and the driver's tables seen as competitions."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.sources.schema import RankInputs

NOW = 996624000.0
HALF_LIFE = 365.0


def read_table(spark: SparkSession, path: str) -> DataFrame:
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file format: {path}")


def write_table(df: DataFrame, path: str) -> None:
    """A single file for .csv (rankings are small), a table for .parquet."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        df.toPandas().to_csv(path, index=False)
    elif suffix == ".parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"Unsupported file format: {path}")


def competition(spark: SparkSession, sf_dir: str) -> RankInputs:
    """Orders as matches between suppliers: the dearest line wins, the cheapest loses; parts are the entities."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("match_id"), "o_orderdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("group_id"), F.col("l_partkey").alias("entity_id"), "l_extendedprice")
    date = F.col("o_orderdate")
    li = lines.join(orders, "match_id").select("*", (F.year(date) * 100 + F.month(date)).cast("long").alias("event_id"), date.cast("timestamp").cast("double").alias("completed_at"))
    price, rest = F.col("l_extendedprice"), ("line", "entity_id", "group_id", "event_id", "completed_at")
    high = F.min(F.struct(price.isNull(), ~F.isnan(price), -price, *rest))
    low = F.min(F.struct(price, *rest))
    # both ends in one row of one order (by dates too, should an order be listed twice)
    ended = F.expr("hi.event_id <=> lo.event_id AND hi.completed_at <=> lo.completed_at AND hi.group_id <> lo.group_id")
    ends = li.groupBy("match_id").agg(high.alias("hi"), low.alias("lo")).where(ended)
    matches = ends.select("hi.event_id", "match_id", F.col("hi.group_id").alias("winner_id"), F.col("lo.group_id").alias("loser_id"), "hi.completed_at")
    # one exchange by the keys of the rosters, which are grouped by them next
    participants = li.select("event_id", "group_id", "entity_id").repartition("event_id", "group_id").distinct()
    same = Window.partitionBy("match_id")
    appearances = li.withColumns({"hi": high.over(same), "lo": low.over(same)}).where(ended).select("event_id", "match_id", "group_id", "entity_id").distinct()
    return RankInputs(matches, participants, appearances)
