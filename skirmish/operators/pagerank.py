"""PageRank of several graphs at once, by arrays, by blocks of a matrix or by joins, and resolvents.

``edges`` is (graph, src, dst, w): rank flows from src to dst.  ``nodes`` is (graph, node, t), t the teleport share.  Ranks
of nodes without outgoing weight are dealt by teleport if ``redistribute``.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.operators.blocks import Blocks, Index
from skirmish.session import cut

#: Distinct edges up to which a graph is handed to one task as arrays.
ARRAY_EDGES = 5_000_000
#: Nodes of all graphs up to which vectors are kept whole (8 bytes a node in the driver and in each worker).
WHOLE_NODES = 40_000_000


def power_iteration(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, t: np.ndarray, alpha: float, tol: float, max_iter: int, redistribute: bool = True) -> np.ndarray:
    sums = np.bincount(src, w, n)
    inverse = np.divide(1.0, sums, out=np.zeros(n), where=sums > 0)
    p, r = w * inverse[src], t / t.sum()
    for _ in range(max_iter):
        new = alpha * np.bincount(dst, p * r[src], n) + (1 - alpha) * t
        if redistribute:
            new += alpha * r[sums <= 0].sum() * t
        new /= new.sum()
        close = np.abs(new - r).sum() < tol
        r = new
        if close:
            break
    return r


def by_arrays(edges: DataFrame, nodes: DataFrame, alpha: float, tol: float, max_iter: int, redistribute: bool = True) -> DataFrame:
    kind = nodes.schema["node"].dataType.simpleString()

    def run(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("node")
        ids = v["node"].to_numpy()
        if not len(ids):
            return pd.DataFrame({"graph": [], "node": [], "rank": []})
        src, dst = np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy())
        known = (src < len(ids)) & (dst < len(ids))
        src, dst, w = src[known], dst[known], e["w"].to_numpy(float)[known]
        same = (ids[src] == e["src"].to_numpy()[known]) & (ids[dst] == e["dst"].to_numpy()[known])
        r = power_iteration(len(ids), src[same], dst[same], w[same], v["t"].to_numpy(float), alpha, tol, max_iter, redistribute)
        return pd.DataFrame({"graph": v["graph"].to_numpy(), "node": ids, "rank": r})

    return edges.groupBy("graph").cogroup(nodes.groupBy("graph")).applyInPandas(run, f"graph string, node {kind}, rank double")


def iterate(index: Index, t: np.ndarray, sums: np.ndarray, flow: Callable[[np.ndarray], np.ndarray], alpha: float, tol: float, max_iter: int, redistribute: bool = True) -> np.ndarray:
    """As power_iteration, on the stacked vectors of several graphs, each of which stops by itself.  ``flow`` gives what
    flows into each place from ranks over ``sums``, a place's outgoing weight."""
    inverse = np.divide(1.0, sums, out=np.zeros(index.n), where=sums > 0)
    r, going = t.copy(), list(index.spans.values())
    for span in going:
        r[span] /= t[span].sum()
    for _ in range(max_iter):
        if not going:
            break
        moved = flow(r * inverse)
        for span in list(going):
            old, hangs = r[span], sums[span] <= 0
            new = alpha * moved[span] + (1 - alpha) * t[span]
            if redistribute:
                new += alpha * old[hangs].sum() * t[span]
            new /= new.sum()
            if np.abs(new - old).sum() < tol:
                going.remove(span)
            r[span] = new
    return r


def out_sums(edges: DataFrame) -> DataFrame:
    """(graph, node, s): the weight that leaves each node."""
    return edges.groupBy("graph", F.col("src").alias("node")).agg(F.sum("w").alias("s"))


def by_blocks(edges: DataFrame, nodes: DataFrame, alpha: float, tol: float, max_iter: int, redistribute: bool = True) -> DataFrame:
    """The same, edges dealt over the tasks by blocks of their ends, vectors whole."""
    index, t = Index.of(nodes.select("graph", F.col("node").alias("id"), "t"), "t")
    flows = Blocks.build(edges, index, index)
    if flows.entries < edges.count():  # as the others, take no edge of unknown nodes
        ends = nodes.select("graph", "node")
        for end in ("src", "dst"):
            edges = edges.join(ends.withColumnRenamed("node", end), ["graph", end], "left_semi")
    sums = index.vector(out_sums(edges).select("graph", F.col("node").alias("id"), "s"), "s")
    return index.table(nodes, iterate(index, t, sums, flows.apply, alpha, tol, max_iter, redistribute))


def by_joins(edges: DataFrame, nodes: DataFrame, alpha: float, tol: float, max_iter: int, redistribute: bool = True, every: int = 5) -> DataFrame:
    """The same by joins; closeness is looked at every few steps, so a few more may be taken.  What there is one row of for
    a graph is broadcast, as joins by graph would put a graph into one task."""
    out = edges.groupBy("graph", "src").agg(F.sum("w").alias("s")).where("s > 0")
    p = cut(edges.join(out, ["graph", "src"]).select("graph", "src", "dst", (F.col("w") / F.col("s")).alias("p")))
    base = cut(nodes.join(out.select("graph", F.col("src").alias("node"), F.lit(True).alias("flows")), ["graph", "node"], "left").select("graph", "node", "t", F.col("flows").isNull().alias("hangs")))
    total = base.groupBy("graph").agg(F.sum("t").alias("total"))
    rank = base.join(F.broadcast(total), "graph").select("graph", "node", (F.col("t") / F.col("total")).alias("rank"))
    for step in range(1, max_iter + 1):
        flow = p.join(rank.select("graph", F.col("node").alias("src"), "rank"), ["graph", "src"]).groupBy("graph", F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("flow"))
        hanging = base.where("hangs").join(rank, ["graph", "node"]).groupBy("graph").agg(F.sum("rank").alias("hang"))
        new = base.join(flow, ["graph", "node"], "left").join(F.broadcast(hanging), "graph", "left")
        more = F.coalesce("hang", F.lit(0.0)) if redistribute else F.lit(0.0)
        new = cut(new.select("graph", "node", (alpha * F.coalesce("flow", F.lit(0.0)) + (1 - alpha + alpha * more) * F.col("t")).alias("rank")))
        new = new.join(F.broadcast(new.groupBy("graph").agg(F.sum("rank").alias("all"))), "graph").select("graph", "node", (F.col("rank") / F.col("all")).alias("rank"))
        if step % every == 0 or step == max_iter:
            far = new.join(rank.withColumnRenamed("rank", "old"), ["graph", "node"]).groupBy("graph").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).agg(F.max("d")).first()[0]
            rank = new
            if far is None or far < tol:
                break
        rank = new
    return rank


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.85, tol: float = 1e-8, max_iter: int = 200, redistribute: bool = True, array_edges: int = ARRAY_EDGES, whole_nodes: int = WHOLE_NODES) -> DataFrame:
    """(graph, node, rank); arrays for small graphs, blocks of edges beyond, joins where nodes are too many for whole vectors
    (or aren't integers).  ``edges`` and ``nodes`` are read several times."""
    largest = edges.groupBy("graph").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= array_edges:
        way = by_arrays
    else:
        way = by_blocks if isinstance(nodes.schema["node"].dataType, T.IntegralType) and nodes.count() <= whole_nodes else by_joins
    return way(edges, nodes, alpha, tol, max_iter, redistribute)


def fixed_point(move: Callable[[np.ndarray], np.ndarray], u: np.ndarray, alpha: float, tol: float = 1e-12, max_iter: int = 2000) -> np.ndarray:
    """Solves (I - alpha A) x = u, where ``move`` multiplies by A."""
    x = u
    for _ in range(max_iter):
        new = u + alpha * move(x)
        if np.abs(new - x).sum() <= tol * max(np.abs(new).sum(), 1e-300):
            return new
        x = new
    return x


def neumann(move: Callable[[np.ndarray], np.ndarray], u: np.ndarray, alpha: float, steps: int) -> np.ndarray:
    """The sum of the first ``steps`` powers, applied to u."""
    x, term = u.copy(), u
    for _ in range(steps - 1):
        term = alpha * move(term)
        x = x + term
    return x
