"""Quality classifier from weak labels (operator 9).

Heuristic labellers vote good (1), bad (-1) or nothing (0) on each document.  Expectation-maximisation over the counts of
all vote patterns (at most 3 to the number of labellers, however large the corpus) estimates each labeller's accuracies and
the posterior of each pattern.  The posteriors of at most ``ROWS`` documents, those whose ids hash lowest, then train a
linear scorer on hashed words and hashed levels of the same statistics; it scores every document.

Cases: null or empty texts have no words: all labellers abstain, and the score is that of the constant and the levels of
zero; repeated rows are scored alike and ties don't matter; a null id is scored but not learnt from; an empty table gives
no rows (and a model that is the constant alone); other columns pass through ``score``, which replaces ``quality_score`` and
``good``.  Memory: some 12 bytes for each byte of the longest text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import U, chunks, cleared, mapped, mix, schema_of, table, text_bytes, words

ROWS = 8_000
BITS = 18
STEPS = 80
#: Of each labeller: the statistic, and the bounds below which it votes good and from which it votes bad.
LABELLERS = (("symbols", 0.01, 0.05), ("upper", 0.2, 0.5), ("repeated", 0.15, 0.5), ("marked", 0.1, 0.3), ("same_lines", 0.1, 0.4), ("bare", 0.1, 0.3), ("few_words", 0.5, 0.8))
#: Words from which a labeller votes at all.
ENOUGH = 8
N = len(LABELLERS)

SYMBOL, UPPER, LETTER, MARK = (np.zeros(256, bool) for _ in range(4))
SYMBOL[list(b"#*$%&|<>")] = True
UPPER[65:91] = True
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
MARK[list(b"!#*$%&|<>")] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of texts: statistics (text by labeller), hash of each word, and words before each text."""
    starts, ends, h, before = words(data, offsets)
    n = np.diff(before)
    docs = len(n)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    chars, owner = np.maximum(per(np.ones(len(data), bool)) - 1, 1), np.repeat(np.arange(docs), n)
    out = np.zeros((docs, N))
    out[:, 0] = per(SYMBOL[data]) / chars
    out[:, 1] = per(UPPER[data]) / np.maximum(per(LETTER[data]), 1)
    if len(h) > 2:
        three = mix(h[:-2] + U(3) * mix(h[1:-1] + U(5) * h[2:]))
        at = np.flatnonzero(owner[:-2] == owner[2:])
        order = at[np.lexsort((three[at], owner[at]))]
        twin = (three[order][1:] == three[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        twice = order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])] if len(order) else order
        cover = np.zeros(len(h), bool)
        for j in range(3):
            cover[twice + j] = True
        out[:, 2] = np.bincount(owner, cover, docs) / np.maximum(n, 1)
    if len(h):
        marked = MARK[data[ends - 1]]
        out[:, 3] = np.bincount(owner, marked, docs) / np.maximum(n, 1)
        sizes = np.concatenate([[0], np.cumsum(LETTER[data])])
        out[:, 5] = np.bincount(owner, sizes[ends] == sizes[starts], docs) / np.maximum(n, 1)
        order = np.lexsort((h, owner))
        fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
        # the share of distinct words expected of a text shrinks with its length
        distinct = np.bincount(owner[order], fresh, docs)
        out[:, 6] = 1 - distinct / np.maximum(np.minimum(n, 2.5 * np.maximum(n, 1) ** 0.75), 1)
    # lines: a hash of each line's words in turn
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    if len(h):
        line = breaks[starts] + owner
        edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        powers = np.power(U(0x9E3779B97F4A7C15), np.arange(len(h), dtype=U) - np.repeat(edge, np.diff(np.concatenate([edge, [len(h)]]))).astype(U))
        value, of = np.add.reduceat(h * powers, edge), owner[edge]
        order = np.lexsort((value, of))
        again = np.concatenate([[False], (value[order][1:] == value[order][:-1]) & (of[order][1:] == of[order][:-1])])
        out[:, 4] = np.bincount(of[order], again, docs) / np.maximum(np.bincount(of, minlength=docs), 1)
    out[n == 0] = 0
    return out, h, before


def votes(stats: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    good, bad = np.array([x[1] for x in LABELLERS]), np.array([x[2] for x in LABELLERS])
    return np.where(n_words[:, None] < ENOUGH, 0, np.where(stats >= bad, -1, np.where(stats < good, 1, 0))).astype(np.int8)


def hashed(stats: np.ndarray, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row edges, buckets and values of the features: words by share, then levels of the statistics."""
    n, docs = np.diff(before), len(before) - 1
    level = np.clip((stats * 10).astype(np.int64), 0, 9)
    named = mix((np.arange(N) * 16 + 1)[None, :].astype(U) + level.astype(U) + U(0xABCDEF) * U(1 << 20))
    edge = np.concatenate([[0], np.cumsum(n + N)])
    bucket, value = np.empty(edge[-1], np.int64), np.empty(edge[-1])
    word_at = np.arange(len(h)) + np.repeat(np.arange(docs), n) * N
    bucket[word_at] = (h >> U(64 - BITS)).astype(np.int64)
    value[word_at] = np.repeat(1 / np.maximum(n, 1), n)
    level_at = (edge[1:, None] - N + np.arange(N)[None, :]).ravel()
    bucket[level_at] = (named >> U(64 - BITS)).astype(np.int64).ravel()
    value[level_at] = 1.0
    return edge, bucket, value


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "good" of each pattern, and the labellers' vote shares given the class (class, labeller, vote)."""
    if not len(patterns):
        return np.empty(0), np.full((2, N, 3), 1 / 3)
    kinds = patterns[:, :, None] == np.array([-1, 0, 1])
    post = np.clip(0.8 + 0.1 * patterns.sum(1), 0.05, 0.95)
    post[(patterns < 0).any(1)] = 0.2
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        share = np.einsum("cp,plv->clv", weight, kinds) + np.array([[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]])[:, None, :]
        share /= share.sum(2, keepdims=True)
        prior = np.log((weight.sum(1) + 1) / (weight.sum() + 2))
        # an abstention tells nothing
        told = np.log(share) * np.array([1, 0, 1])
        like = prior[:, None] + np.einsum("clv,plv->cp", told, kinds)
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -40, 40)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, share


class Model:
    def __init__(self, patterns: dict[bytes, float], share: np.ndarray, weights: np.ndarray, constant: float) -> None:
        self.patterns, self.share, self.weights, self.constant = patterns, share, weights, constant


def _code(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(N)).sum(1)


def learn(df: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Votes are counted over all documents; the driver gets one row per pattern and the features of ROWS documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3**N, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(text_bytes(batch.column(0))):
                stats, _, before = statistics(data, offsets)
                total += np.bincount(_code(votes(stats, np.diff(before))), minlength=3**N)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pattern", "n"])

    got = mapped(df.select(F.col(text).alias("_text")), count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    codes = got["pattern"].to_numpy(np.int64)
    patterns = codes[:, None] // 3 ** np.arange(N) % 3 - 1
    post, share = expectation_maximisation(patterns, got["n"].to_numpy(float))
    posterior = dict(zip(codes.tolist(), post.tolist(), strict=True))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(text_bytes(batch.column(0))):
                stats, h, before = statistics(data, offsets)
                p = [posterior.get(c, 0.5) for c in _code(votes(stats, np.diff(before))).tolist()]
                edge, bucket, value = hashed(stats, h, before)
                b, v = [], []
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    u, where = np.unique(bucket[i:j], return_inverse=True)
                    b.append(u.astype(np.int32))
                    v.append(np.bincount(where, value[i:j]).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float32())), pa.array(p, pa.float64())], ["b", "v", "p"])

    chosen = df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(ROWS)
    sample = df.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key).select("_text")
    got = mapped(sample, rows, "b array<int>, v array<float>, p double").toArrow()
    weights, constant = np.zeros(1 << BITS), 0.0
    if got.num_rows:
        got = got.combine_chunks()
        b, v = (got.column(c).chunk(0) for c in ("b", "v"))
        edge, p = b.offsets.to_numpy(), got.column("p").to_numpy()
        b, v = b.values.to_numpy(), v.values.to_numpy().astype(float)
        owner, squares = np.repeat(np.arange(len(p)), np.diff(edge)), np.full(1 << BITS, 1e-6)
        of_constant = 1e-6
        for _ in range(STEPS):  # gradient steps, each bucket's scaled by its past gradients
            z = np.bincount(owner, weights[b] * v, len(p)) + constant
            error = (p - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) / len(p)
            gradient = np.bincount(b, error[owner] * v, 1 << BITS) - 1e-7 * weights
            squares += gradient**2
            of_constant += error.sum() ** 2
            weights += 0.3 * gradient / np.sqrt(squares)
            constant += 0.3 * error.sum() / np.sqrt(of_constant)
    return Model(posterior, share, weights.astype(np.float32), constant)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with ``quality_score`` (0 to 1) and ``good`` (score of 0.5 or more), which replace columns of these names."""
    df = cleared(df, ("quality_score", "good"), text)
    names, where, schema = df.columns, df.columns.index(text), schema_of(df)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [np.empty(0)]
            for _, _, data, offsets in chunks(text_bytes(batch.column(where))):
                edge, bucket, value = hashed(*statistics(data, offsets))
                z = np.add.reduceat(m.weights[bucket] * value, edge[:-1]) + m.constant
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(p >= 0.5)], [*names, "quality_score", "good"])

    return mapped(df, run, f"{schema}, quality_score double, good boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs)).select("doc_id", F.col("quality_score").alias("score"), F.col("good").alias("kept"))
