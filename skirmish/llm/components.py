"""Connected components of a table of links, in rounds of joins: nothing is gathered on the driver or in one task."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import NARROW, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; a component is named by its smallest node.

    Each round first points the larger neighbours of a node, then the node and its smaller neighbours, at the smallest of
    them; the links then form stars.  Rounds grow with the logarithm of the nodes.  Loops and repeated links do no harm;
    without links the result is empty.
    """
    now = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links", NARROW)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        now = stored(smaller, "links", NARROW)
        # done when each node points at one other that points at none
        heads = now.select(F.col("v").alias("u")).distinct().withColumn("head", F.lit(True))
        if now.groupBy("u").agg(F.count("*").alias("n")).join(heads, "u", "left").where("n > 1 OR head").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
