"""Places in an order, counted without putting all rows into one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.session import cut


def numbered(df: DataFrame, *by: str | Column, name: str = "idx") -> DataFrame:
    """df with its places from 0 in the order of the columns, which must tell all rows apart: rows are dealt to partitions by
    ranges of the order, places are counted inside each, and the sizes of those before (a row each) are added."""
    parts = cut(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    out = parts.withColumn("__place", place).join(F.broadcast(before), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__place") - 1).cast("long")).drop("__part", "__place", "__before")
