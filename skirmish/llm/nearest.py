"""Nearest neighbours by multi-index hashing (operator 3).

Rotations are learnt on at most ``SAMPLE`` vectors, those whose ids hash lowest, so that the signs of the rotated components
lose little; ``ROTATIONS`` of them, from different starts, give a code of some hundred bits.  A code is split into substrings
of 16 bits and each is indexed.  A code within Hamming radius r of a query's has a substring within r / (number of
substrings) of the query's own; probing every index with that radius therefore retrieves all of them.  These are confirmed
on the whole code and ranked by the inner product of the original vectors in double precision.

The largest inner product is a matter of angles once each vector gets one more component that brings all to one length.
The radius is set on the sample, so that ``INSIDE`` of the neighbours sought lie within it; a block with fewer than k
codes within the radius is probed with growing radii.

Every row is indexed: rows and queries are cut into blocks, and each pair of blocks is one group of a cogroup; its size is
bounded by ``BLOCK`` and ``QUERIES``.  Of equal vectors only the k + 1 smallest ids can ever be among a query's k nearest, so
only these go on (a limit that each task applies before the shuffle), which removes any hot group.

Cases: vectors that are null, zero, hold null or non-finite components, or differ in length from most others take no part,
nor do null ids; with fewer candidates than k all are returned; ties go to the smaller id; empty tables give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.llm.common import mapped, ship, stored, table

SAMPLE = 8_000
ROTATIONS = 6
ROUNDS = 12
INSIDE = 0.985
PROBES = 300
BLOCK = 20_000
QUERIES = 4_000
BITS = 16
RESULT = "query_id long, vec_id long, score double"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, array) to (id, bytes of doubles, components, length); unfit ones go."""
    for batch in batches:
        # a null component reads as not finite
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float) + 0.0
        edge = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
        odd, full = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(flat), flat != 0))
        fit = (odd[edge[1:]] == odd[edge[:-1]]) & (full[edge[1:]] > full[edge[:-1]]) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(fit)
        ids = batch.column(0).take(pa.array(at))
        out = [flat[a:b] for a, b in zip(edge[at].tolist(), edge[at + 1].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes() for v in out], pa.binary()), pa.array([len(v) for v in out], pa.int32()), pa.array([float(np.sqrt((v * v).sum())) for v in out], pa.float64())], ["id", "v", "d", "length"])


def matrix(column: list[bytes] | pd.Series) -> np.ndarray:
    return np.array([np.frombuffer(x) for x in column])


class Coder:
    """Learnt rotations; queries and rows are lengthened so that the angle orders by inner product."""

    def __init__(self, rotations: np.ndarray, longest: float) -> None:
        self.rotations, self.longest = rotations, longest

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows of 16-bit substrings."""
        size = np.sqrt((x * x).sum(1, keepdims=True))
        x = x / size if query else x / self.longest
        more = np.zeros_like(size) if query else np.sqrt(np.maximum(0, 1 - (size / self.longest) ** 2))
        z = np.concatenate([x, more], 1)
        bits = np.concatenate([z @ r > 0 for r in self.rotations], 1)
        bits = bits[:, : bits.shape[1] // BITS * BITS]
        return np.packbits(bits, axis=1).view(np.uint16)


def learn(x: np.ndarray, longest: float, rotations: int = ROTATIONS) -> Coder:
    coder = Coder(np.empty((0, 0, 0)), longest)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    z = np.concatenate([x / longest, np.sqrt(np.maximum(0, 1 - (size / longest) ** 2))], 1)
    random = np.random.default_rng(0)
    found = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(random.standard_normal((z.shape[1], z.shape[1])))
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(z.T @ np.sign(z @ r))
            r = u @ w
        found.append(r)
    coder.rotations = np.array(found)
    return coder


def calibrate(coder: Coder, x: np.ndarray, rows: int, k: int) -> int:
    """The radius within which INSIDE of the nearest lie.  In a sample they are as rare as among all rows."""
    q, take = x[:PROBES], max(1, round(k * len(x) / max(rows, 1)))
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argpartition(-scores, min(take, len(x) - 1) - 1, axis=1)[:, :take] if len(x) > 1 else np.zeros((len(q), 1), int)
    a, b = coder.codes(q, True), coder.codes(x, False)
    far = np.concatenate([np.bitwise_count(b[n] ^ a[i]).sum(1) for i, n in enumerate(near)])
    return int(np.ceil(np.quantile(far, INSIDE))) + 1


class Index:
    """The substring indexes of one block."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.values, self.of = [], []
        for j in range(codes.shape[1]):
            values, of = np.unique(codes[:, j], return_inverse=True)
            self.values.append(values)
            self.of.append(of)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes lie within the radius: every index is probed, what it retrieves is confirmed."""
        m = len(self.values)
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            # by the pigeonhole the first radius % m + 1 substrings need the full share, the others one bit less
            share = radius // m - (j > radius % m)
            if share >= 0:
                hit |= (np.bitwise_count(self.values[j] ^ code[j]) <= share)[self.of[j]]
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, coder: Coder, radius: int, k: int) -> pd.DataFrame:
    """The k nearest of one block of rows to each of one block of queries."""
    if rows.empty or queries.empty:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    rows = rows.sort_values("id")
    same: dict[bytes, list[int]] = {}
    for v, i in zip(rows["v"], rows["id"], strict=True):
        same.setdefault(bytes(v), []).append(i)
    x, ids = matrix(list(same)), list(same.values())
    index, out = Index(coder.codes(x, False)), []
    many = np.array([len(i) for i in ids])
    asked = matrix(queries["query"])
    for i, q, code in zip(queries["query_id"].tolist(), asked, coder.codes(asked, True), strict=True):
        r = radius
        while True:
            c = index.within(code, r)
            if many[c].sum() > k or r >= 16 * index.codes.shape[1]:
                break
            r += 8
        score = (x[c] * q).sum(1)
        found = sorted((-s, j) for s, at in zip(score.tolist(), c.tolist(), strict=True) for j in ids[at] if j != i)[:k] if len(c) <= 4 * k else None
        if found is None:
            best = c[np.lexsort((c, -score))]
            score = np.sort(-score)
            cut = np.searchsorted(score, score[min(k, len(score) - 1)], side="right")
            found = sorted((s, j) for s, at in zip(score[:cut].tolist(), best[:cut].tolist(), strict=True) for j in ids[at] if j != i)[:k]
        out += [(i, j, -s) for s, j in found]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(df: DataFrame, chosen: Column, k: int = 20, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row that ``chosen`` holds for."""
    ship(df.sparkSession)
    fit = stored(mapped(df.select(F.col(key).cast("long").alias("id"), vector), _vectors, "id long, v binary, d int, length double"), "vectors")
    most = fit.groupBy("d").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy(F.desc("n"), "d").first()
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if most is None:
        return empty
    fit = fit.where(F.col("d") == most["d"]).select("id", "v")
    x = matrix([bytes(r["v"]) for r in fit.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    coder = learn(x, most["longest"])
    radius = calibrate(coder, x, most["n"], k)
    first = Window.partitionBy("v").orderBy("id")
    rows = fit.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    asked = df.where(F.coalesce(chosen, F.lit(False))).select(F.col(key).cast("long").alias("id")).distinct().join(fit, "id")
    blocks, asks = -(-most["n"] // BLOCK), -(-most["n"] // (20 * QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "v", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("b"), spread(asks).alias("a"))
    right = asked.select(F.col("id").alias("query_id"), F.col("v").alias("query"), F.pmod(F.xxhash64("id"), F.lit(asks)).cast("int").alias("qa"), spread(blocks).alias("qb"))
    found = left.groupBy("a", "b").cogroup(right.groupBy("qa", "qb")).applyInPandas(lambda rows, queries: search_block(rows, queries, coder, radius, k), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
