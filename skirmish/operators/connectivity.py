"""Components of the pair graph."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.session import cut


def components(edges: DataFrame, a: str = "winner_id", b: str = "loser_id") -> DataFrame:
    """(id, component): the smallest id reachable, for every id on an edge."""
    ids = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(ids.union(ids.select("v", "u")).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")))
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = label.join(near, "u").select("u", "c", F.least("c", "m").alias("n"))
        jump = step.select(F.col("u").alias("n"), F.col("n").alias("j"))
        new = cut(step.join(jump, "n").select("u", "c", F.least("n", "j").alias("n")))
        if new.where("c <> n").isEmpty():
            return label.select(F.col("u").alias("id"), F.col("c").alias("component"))
        label = new.select("u", F.col("n").alias("c"))


@dataclass(frozen=True)
class ConnectivityReport:
    component_count: int
    node_count: int
    largest_nodes: int
    largest_share_fraction: float
    largest_weight_fraction: float
    largest_node_fraction: float
    largest_component: int | None

    @property
    def is_disconnected(self) -> bool:
        return self.component_count > 1

    @property
    def disconnected_share(self) -> float:
        return max(0.0, 1.0 - self.largest_share_fraction)


def summary(labels: DataFrame, metrics: DataFrame) -> DataFrame:
    """(component, nodes, share, weight); entities without an edge are components of their own."""
    full = metrics.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return full.groupBy("component").agg(F.count("*").alias("nodes"), F.sum("share").alias("share"), F.sum("weight").alias("weight"))


def analyze(labels: DataFrame, metrics: DataFrame) -> ConnectivityReport:
    """The largest component has the largest share, of equal ones the smallest id."""
    parts = cut(summary(labels, metrics))
    total = parts.agg(F.count("*"), F.sum("nodes"), F.sum("share"), F.sum("weight"), F.max("weight")).first()
    if not total[0]:
        return ConnectivityReport(0, 0, 0, 0.0, 0.0, 0.0, None)
    top = parts.orderBy(F.desc(F.round("share", 12)), "component").first()
    part = lambda x, y: float(x / y) if y else 0.0
    return ConnectivityReport(int(total[0]), int(total[1]), int(top["nodes"]), part(top["share"], total[2]), part(total[4], total[3]), part(top["nodes"], total[1]), top["component"])


def message(report: ConnectivityReport, policy: str) -> str:
    kept = "Only its largest component is ranked." if policy == "keep_largest" else "All components are ranked; scores of different components can't be compared."
    return f"The comparison graph is disconnected: {report.component_count} components; the largest holds {report.largest_share_fraction:.1%} of the share. {kept}"
