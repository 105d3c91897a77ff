"""Sparse matrices dealt over the tasks by blocks of rows, and products with vectors that are kept whole.

A matrix is a table of chunks of at most CHUNK entries, each inside one block of rows, as arrays of places and weights.  A
product broadcasts the vector, each chunk gives its part of a block, and the driver adds these up, so that nothing is shuffled
and memory grows with the vectors (8 bytes a place in the driver and in each worker), not with the entries.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.session import cut

#: Entries of a chunk, chunks that a task is dealt on average, and entries that are held before they are dealt.
CHUNK, EACH, HELD = 1 << 18, 8, 1 << 20
PIECE = "part int, first long, size long, col binary, row binary, w binary, tag binary"


class Index:
    """Places of (graph, id): those of a graph are together, in order of id."""

    def __init__(self, ids: dict[str, np.ndarray]) -> None:
        self.ids, self.spans, self.n = ids, {}, 0
        for graph, each in ids.items():
            self.spans[graph], self.n = slice(self.n, self.n + len(each)), self.n + len(each)

    @staticmethod
    def of(df: DataFrame, value: str | None = None) -> tuple[Index, np.ndarray | None]:
        """The index of a table's (graph, id), which must be distinct, and a value by place."""
        ids, values = {}, []
        for graph, each in sorted(_by_graph(df.toArrow())):
            found = each["id"].to_numpy()
            order = np.argsort(found, kind="stable")
            ids[graph] = found[order]
            if value:
                values.append(each[value].to_numpy().astype(float)[order])
        return Index(ids), np.concatenate(values or [np.zeros(0)]) if value else None

    def places(self, graph: str, ids: np.ndarray) -> np.ndarray:
        """-1 where unknown"""
        known = self.ids.get(graph)
        if known is None or not len(known):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return np.where(known[at] == ids, at + self.spans[graph].start, -1)

    def vector(self, df: DataFrame, value: str) -> np.ndarray:
        """A value of (graph, id) by place, 0 where there is none."""
        out = np.zeros(self.n)
        for graph, each in _by_graph(df.toArrow()):
            at = self.places(graph, each["id"].to_numpy())
            out[at[at >= 0]] = each[value].to_numpy().astype(float)[at >= 0]
        return out

    def table(self, nodes: DataFrame, x: np.ndarray, value: str = "rank") -> DataFrame:
        """(graph, node) with what a vector holds at their places."""
        shared = nodes.sparkSession.sparkContext.broadcast((self, x))
        kind = nodes.schema["node"].dataType.simpleString()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, x = shared.value
            for batch in batches:
                for graph, each in _by_graph(pa.Table.from_batches([batch])):
                    got = pa.array(x[index.places(graph, each["node"].to_numpy())])
                    yield from each.append_column(value, got).combine_chunks().to_batches()

        out = cut(nodes.select("graph", "node").mapInArrow(run, f"graph string, node {kind}, {value} double"))
        shared.destroy()
        return out


def _by_graph(table: pa.Table) -> list[tuple[str, pa.Table]]:
    graphs = pc.unique(table["graph"]).to_pylist()
    return [(g, table.filter(pc.equal(table["graph"], g)) if len(graphs) > 1 else table) for g in graphs]


class Blocks:
    """A matrix; ``tag`` is the place of an entry's factor, where products are given factors."""

    def __init__(self, chunks: DataFrame, rows: int, entries: int) -> None:
        self.chunks, self.rows, self.entries = chunks, rows, entries

    @staticmethod
    def build(entries: DataFrame, cols: Index, rows: Index, src: str = "src", dst: str = "dst", tags: np.ndarray | None = None) -> Blocks:
        """Of (graph, src, dst, w[, tag]): src is a column, dst a row, ``tags`` the sorted tags.  Entries of unknown places are
        left out."""
        spark = entries.sparkSession
        many = max(1, -(-entries.count() // CHUNK))
        width = max(1, -(-rows.n // many))
        shared = spark.sparkContext.broadcast((cols, rows, tags))
        tasks = max(min(many, spark.sparkContext.defaultParallelism), -(-many // EACH))
        names = ["graph", src, dst, "w"] + (["tag"] if tags is not None else [])

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cols, rows, tags = shared.value
            held, n = [], 0
            for batch in batches:
                for graph, each in _by_graph(pa.Table.from_batches([batch])):
                    c, r = cols.places(graph, each[src].to_numpy()), rows.places(graph, each[dst].to_numpy())
                    tag = np.zeros(0, np.int32) if tags is None else np.searchsorted(tags, each["tag"].to_numpy()).astype(np.int32)
                    known = (c >= 0) & (r >= 0)
                    held.append((c[known].astype(np.int32), r[known].astype(np.int32), each["w"].to_numpy().astype(float)[known], tag[known] if tags is not None else tag))
                    n += len(held[-1][0])
                if n >= HELD:
                    yield from pieces(held)
                    held, n = [], 0
            if n:
                yield from pieces(held)

        def pieces(held: list) -> Iterator[pa.RecordBatch]:
            c, r, w, tag = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(r, kind="stable")
            c, r, w, tag = c[order], r[order], w[order], tag[order] if len(tag) else tag
            edges = np.flatnonzero(np.diff(r // width, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield piece(int(r[a]) // width, c[a:b], r[a:b], w[a:b], tag[a:b])

        def piece(part: int, c: np.ndarray, r: np.ndarray, w: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
            values = [[part], [part * width], [len(c)], *([x.tobytes()] for x in (c, r, w, tag))]
            kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])

        def whole(part: int, held: list) -> pa.RecordBatch:
            join = lambda i, kind: np.frombuffer(b"".join(x[i] for x in held), kind)
            return piece(part, join(0, np.int32), join(1, np.int32), join(2, float), join(3, np.int32))

        def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, sizes = defaultdict(list), defaultdict(int)
            for batch in batches:
                for x in batch.to_pylist():
                    part = x["part"]
                    if sizes[part] and sizes[part] + x["size"] > CHUNK:
                        yield whole(part, held.pop(part))
                        sizes[part] = 0
                    held[part].append((x["col"], x["row"], x["w"], x["tag"]))
                    sizes[part] += x["size"]
            for part, each in held.items():
                yield whole(part, each)

        chunks = cut(entries.select(*names).mapInArrow(deal, PIECE).repartition(tasks, "part").mapInArrow(gather, PIECE))
        shared.destroy()
        return Blocks(chunks, rows.n, chunks.agg(F.sum("size")).first()[0] or 0)

    def apply(self, x: np.ndarray, factors: np.ndarray | None = None) -> np.ndarray:
        """The product with a vector, or with each row of an array; entries count by the factor of their tag, if factors are
        given."""
        shared = self.chunks.sparkSession.sparkContext.broadcast((np.atleast_2d(x), factors))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, factors = shared.value
            for batch in batches:
                at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    col, row, w = (np.frombuffer(at[c][i].as_buffer(), kind) for c, kind in (("col", np.int32), ("row", np.int32), ("w", float)))
                    first = at["first"][i].as_py()
                    if factors is not None:
                        w = w * factors[np.frombuffer(at["tag"][i].as_buffer(), np.int32)]
                    part = np.stack([np.bincount(row - first, w * each[col]) for each in x])
                    yield pa.record_batch([pa.array([first], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["first", "part"])

        got = self.chunks.mapInArrow(run, "first long, part binary").toArrow()
        shared.destroy()
        out = np.zeros((len(np.atleast_2d(x)), self.rows))
        for first, part in zip(got["first"].to_pylist(), got["part"], strict=True):
            each = np.frombuffer(part.as_buffer(), float).reshape(len(out), -1)
            out[:, first:first + each.shape[1]] += each
        return out.reshape((*x.shape[:-1], self.rows))
