"""Near-duplicates by bottom-k sketches (operator 10).

A document is the set of its distinct shingles (hashed to 64 bits).  One hash function orders all shingles; a document
retains the first ``K`` of its set (its sketch), a random sample of the set, whatever its shingles look like.

1. Documents of one set are one class, named by the smallest id; all else concerns classes.
2. Inverted lists.  A list's key is made of retained values: of all that fall into one of the first ``BINS`` ranges of the
   hash, if these are two or more.  Ranges depend on the power of two below the set's size (sets near the next power have
   both kinds), so two sets have the same ranges, some three values in each.  A key of sets of similarity 0.8 is equal with a
   chance of a third at least, so such a pair has no list in common once in 60,000 (sizes of 64 to 128) or two million pairs.
   Sets of fewer than ``SHORT`` values use all choices of some of their first values instead: of so many first values that
   two sets of the similarity asked for have a choice in common for certain (prefix filter; larger sets up to the size that
   can be similar do so too), and as many values a choice as give at most ``CHOICES`` lists (two at least).
3. In lists of up to ``HOT`` classes all are paired; in longer ones, each with the smallest id (stars), so a large group
   costs a few pairs per member.
4. Classes of long lists that hold several components of the confirmed links meet once more, by their full sets: a set's
   values are ranked by how many of these classes have them, rarest first, and two similar sets share one of the first
   few (prefix filter).  A list is one such value and two bands of sizes, so that the prefix is no longer than sizes of
   these bands ask for; values that one component alone has take places in a prefix but make no lists.  All of this is
   exact: no list is dropped and no link is lost.  Lists of up to ``SPLIT`` of other components on average are paired; the
   sets of longer ones are sent to cells of two bounded blocks, where each is compared with those of other components, so
   only links become rows.
5. Candidates are filtered by sizes and by the estimate from the union's sketch (with five standard deviations to spare)
   and confirmed on the full sets; components of the confirmed links.  Documents are dealt to blocks of ``CELL_ROWS`` or
   ``CELL_BYTES``; a pair is confirmed in the cell of its two blocks, to which each text is sent once, however many pairs
   it has there.

Sketches and texts are joined for candidates only (``common.asked_for``).  Hot keys: a list's or value's rows (ids
alone) are counted by a window, which spills, in one task; lists are joined as skewed joins, which Spark splits; a document of
many pairs is in many cells, each of bounded size.
The driver holds one filter of ids at a time and some twenty jobs' plans, whatever the input.

Cases: null or empty texts have no shingles and no links; fewer words than a shingle make one shingle of all; a null id
takes no part (component null); repeated rows are one document if their id is the same; an empty table gives no rows; other
columns, whatever their names, are not read.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.llm.common import NARROW, U, asked_for, chunks, mapped, mix, signed, stored, table, text_bytes, words
from skirmish.llm.components import components

K = 64
BINS = 40
SHORT = 64
HOT = 32
SPLIT = 16
#: Lists of a short set, about.
CHOICES = 170
#: Smallest size of each band, some 5 % wide.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(max(BANDS[-1] + 1, BANDS[-1] * 21 // 20))
#: Documents, and bytes of text, of a block; two of them meet in a cell, in one worker's memory.
CELL_ROWS = 2000
CELL_BYTES = 4 << 20
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SKETCH = "doc long, n long, bytes long, s1 long, s2 long, sketch binary, keys array<long>"


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with one as similar as asked for."""
    return -(-percent * n // 100)


def _combined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * U(0x9FB21C651E98DF25) + y)


def _levels(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The power of two below the size, and below the largest size that can be similar."""
    return tuple(np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) for x in (n, np.floor(n * 100 / percent)))


def _bin_keys(value: np.ndarray, owner: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (even) and their owners, from values sorted by owner; level is each value's."""
    wide = U(5 << 61) // (U(1) << (level - 2).astype(U))  # 2.5 values of a set of that power of two
    at = value // wide
    use = at < np.minimum(BINS, (1 << level) * 2 // 5).astype(U)
    value, owner, level, at = value[use], owner[use], level[use], at[use]
    if not len(value):
        return value, owner
    head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])]))
    many = np.diff(np.concatenate([head, [len(value)]]))
    key = mix(np.add.reduceat(mix(value ^ U(0xA0761D6478BD642F)), head) + at[head] + (level[head].astype(U) << U(32)))
    return key[many > 1] & ~U(1), owner[head][many > 1]


@lru_cache(4096)
def _values_of_key(n: int, percent: int, lists: int) -> frozenset[int]:
    """Values of a key, by the size of the larger of two similar sets; all that a set of n needs."""

    def most(x: int) -> int:
        least = least_overlap(x, percent)
        return max((k for k in range(2, least + 1) if comb(x - least + k, k) <= lists), default=min(2, least))

    return frozenset(map(most, range(n, n * 100 // percent + 1)))


@lru_cache(256)
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.uint8).reshape(-1, k)


def _keys_of(value: np.ndarray, chosen: np.ndarray, begin: int) -> np.ndarray:
    key = np.full(len(chosen), U(begin))
    for column in chosen.T:
        key = _combined(key, value[column])
    return key


def shingle_hashes(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of groups of texts: bytes of each, the distinct hashes of its shingles in order, and where each text's begin (and end)."""
    for a, b, data, offsets in chunks(texts):
        _, _, h, before = words(FOLD[data], offsets)
        count = np.diff(before)
        shingles = np.maximum(count - size + 1, (count > 0).astype(np.int64))
        first = np.repeat(before[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(shingles.sum())
        wide, value = np.repeat(np.minimum(count, size), shingles), np.full(len(first), U(0x51ED270B))
        for j in range(size):
            if len(h):
                value = np.where(wide > j, _combined(value, h[np.minimum(first + j, len(h) - 1)]), value)
        owner = np.repeat(np.arange(b - a), shingles)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])[: len(value)]
        value, owner = value[fresh], owner[fresh]
        yield np.diff(offsets) - 1, value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))])


def sketches(batches: Iterator[pa.RecordBatch], size: int, percent: int = 80) -> Iterator[pa.RecordBatch]:
    """(doc, text) to the set's size, a 128-bit name of the set, its sketch in order, and the keys of its lists."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for sizes, value, edge in shingle_hashes(text_bytes(batch.column(1)), size):
            n = np.diff(edge)
            owner = np.repeat(np.arange(len(n)), n)
            full, some = edge[:-1][n > 0], n > 0
            s1, s2 = np.zeros(len(n), U), np.zeros(len(n), U)
            if len(full):
                s1[some] = np.add.reduceat(mix(value ^ U(0xA0761D6478BD642F)), full)
                s2[some] = np.add.reduceat(mix(value ^ U(0xE7037ED1A0B428DB)), full)
            low, high = _levels(n, percent)
            keys, owners = [], []
            for level, use in ((low, n >= SHORT), (high, (n >= SHORT) & (high != low))):
                use = use[owner]
                k, o = _bin_keys(value[use], owner[use], level[owner[use]])
                keys.append(k)
                owners.append(o)
            for i in np.flatnonzero((n > 0) & (n * percent <= SHORT * 100)).tolist():
                m = int(n[i])
                if least_overlap(m + 1, percent) <= m:  # else no other set is similar
                    for many in _values_of_key(m, percent, CHOICES):
                        keys.append(_keys_of(value[edge[i] : edge[i + 1]], _choices(min(m, m - least_overlap(m, percent) + many), many), 0) | U(1))
                        owners.append(np.full(len(keys[-1]), i))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(owners, kind="stable")
            ends = np.cumsum(np.bincount(owners, minlength=len(n)))
            out[0].append(n)
            out[1].append(sizes)
            out[2].append(signed(s1))
            out[3].append(signed(s2))
            held = lambda m: m if m * percent <= SHORT * 100 else K
            out[4] += [value[x : min(x + held(y - x), y)].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            out[5] += np.split(signed(keys[order]), ends[:-1])
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x), pa.int64()) for x in out[:4]), pa.array(out[4], pa.binary()), pa.array(out[5], pa.list_(pa.int64()))], ["doc", "n", "bytes", "s1", "s2", "sketch", "keys"])


def estimate(x: bytes, y: bytes) -> float:
    """Share of the union's first values that both sets hold; exact if both sketches hold all of their sets."""
    a, b = np.frombuffer(x, U)[:K], np.frombuffer(y, U)[:K]
    both = np.sort(np.concatenate([a, b]))
    twin = both[1:] == both[:-1]
    union = len(both) - int(twin.sum())
    if union <= K or (len(a) < K and len(b) < K):
        return (len(both) - union) / max(union, 1)
    # the bound: the K-th distinct value; beyond it a sketch may lack values
    fresh = both[np.concatenate([[True], ~twin])]
    return float(np.count_nonzero(both[1:][twin] <= fresh[K - 1])) / K


def _likely(percent: int):  # noqa: ANN202
    """Pairs that can be as similar by sizes and estimate."""
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")), strict=True):
                keep.append(100 * min(n, m) >= percent * max(n, m) and estimate(x, y) >= t - 5 * (t * (1 - t) / K) ** 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def shingle_set(text: bytes, size: int) -> frozenset:
    w = text.translate(FOLD.tobytes()).split()
    return frozenset(zip(*(w[j:] for j in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sets of hashes in order."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0


def _linked(x: bytes, y: bytes, size: int, percent: int) -> bool:
    x, y = shingle_set(x, size), shingle_set(y, size)
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0


def _confirm(size: int, percent: int):  # noqa: ANN202
    """(cell, a, b, text), of each cell first its texts (a is the id, b null) and then its pairs, to the pairs that are linked.

    Sets of hashes tell which pairs to compare word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            out: list[tuple[int, int]] = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if cells[i] != cell:
                    cell, held = cells[i], {}
                part = batch.slice(i, j - i)
                m = part.column("b").null_count
                texts, at = text_bytes(part.column("text").slice(0, m)), 0
                ids = part.column("a").to_pylist()
                for _, value, edge in shingle_hashes(texts, size):
                    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                        held.setdefault(ids[at], {})[texts[at]] = value[x:y].copy()
                        at += 1
                for a, b in zip(ids[m:], part.column("b").slice(m).to_pylist(), strict=True):
                    if any(_similar(x, y, percent) and _linked(t, u, size, percent) for t, x in held[a].items() for u, y in held[b].items()):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


@lru_cache(4096)
def _prefixes(n: int, percent: int) -> tuple[tuple[int, int], ...]:
    """Of a set of n, for each band that similar sets can be in: a name of both bands, values that needn't be shared."""
    least, most = least_overlap(n, percent), n * 100 // percent
    own, out = bisect_right(BANDS, n) - 1, []
    for band in range(bisect_right(BANDS, least) - 1, bisect_right(BANDS, most)):
        overlap = -(-percent * (n + max(BANDS[band], least)) // (100 + percent))
        out.append((min(own, band) << 16 | max(own, band), n - overlap))
    return tuple(out)


def _prefix_lists(percent: int):  # noqa: ANN202
    """(doc, one, row, n, ranked) to (key, value, doc, one, row, n); of the set's n values, those not ranked come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, many = [np.empty(0, U)], [np.empty(0, U)], []
            for n, ranked in zip(batch.column("n").to_pylist(), batch.column("ranked"), strict=True):
                v, before = ranked.values.to_numpy().view(U), sum(map(len, keys))
                for name, spare in _prefixes(n, percent):
                    if (end := min(spare + 1 - (n - len(v)), len(v))) > 0:
                        keys.append(_combined(np.full(end, U(name)), v[:end]))
                        values.append(v[:end])
                many.append(sum(map(len, keys)) - before)
            others = [pa.array(np.repeat(batch.column(c).to_numpy(), many)) for c in ("doc", "one", "row", "n")]
            yield pa.RecordBatch.from_arrays([*(pa.array(signed(np.concatenate(x))) for x in (keys, values)), *others], ["key", "value", "doc", "one", "row", "n"])

    return run


def linked_across(doc: np.ndarray, one: np.ndarray, second: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of one cell whose components differ and whose sets are similar; where some are of a second block, of two blocks only."""
    order = np.argsort(second, kind="stable")
    doc, one, sets, half = doc[order], one[order], [sets[i] for i in order], int(np.count_nonzero(~second))
    n = np.array([len(x) for x in sets])
    edge = np.concatenate([[0], np.cumsum(n)])
    kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(kinds), np.int64)
    names, count = np.unique(one, return_counts=True)
    for i in np.flatnonzero(one != names[np.argmax(count)]).tolist():  # pairs of others than the largest component, with all
        x, y = (0, len(doc)) if half in (0, len(doc)) else (half, len(doc)) if i < half else (0, half)
        mine = ids[edge[i] : edge[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[ids[edge[x] : edge[y]]], edge[x:y] - edge[x])
        mark[mine] = 0
        for j in (x + np.flatnonzero((one[x:y] != one[i]) & (100 * both >= percent * (n[i] + n[x:y] - both)))).tolist():
            yield int(min(doc[i], doc[j])), int(max(doc[i], doc[j]))


def _across(percent: int):  # noqa: ANN202
    """(key, lo, hi, second, doc, one, set), cell by cell, to the pairs (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def made() -> pa.RecordBatch:
            pairs = set()
            if len(held) > 1:
                doc, one, second = (np.array([h[k] for h in held], kind) for k, kind in enumerate((np.int64, np.int64, bool)))
                pairs = set(linked_across(doc, one, second, [np.frombuffer(h[3], U) for h in held], percent))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for *here, second, doc, one, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != cell:
                    yield made()
                    cell, held = here, []
                held.append((doc, one, second, values))
        yield made()

    return run


def _sets(size: int):  # noqa: ANN202
    """(doc, one, text) to (doc, one, row, n, set); ``row`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, sets = [], [], []
            for _, value, edge in shingle_hashes(text_bytes(batch.column(2)), size):
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    row.append(int(signed(np.bitwise_xor.reduce(mix(value[x:y] ^ U(0xA0761D6478BD642F)), keepdims=True))[0]) if y > x else 0)
                    n.append(y - x)
                    sets.append(value[x:y].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(row, pa.int64()), pa.array(n, pa.int64()), pa.array(sets, pa.binary())], ["doc", "one", "row", "n", "set"])

    return run


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, one, row, n, set) to one row per value of the set."""
    for batch in batches:
        n = batch.column("n").to_numpy()
        value = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in batch.column("set").to_pylist())])
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("doc", "one", "row", "n")), pa.array(value)], ["doc", "one", "row", "n", "value"])


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: key, n_shingles, component_id, kept."""
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = stored(mapped(docs, lambda b: sketches(b, shingle, percent), SKETCH), "sketches")
    real = rows.where("n > 0 AND doc IS NOT NULL")
    classes = stored(real.groupBy("s1", "s2").agg(F.min("doc").alias("doc"), F.max("bytes").alias("bytes"), *(F.first(c).alias(c) for c in ("n", "sketch", "keys"))), "classes")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of (a, b) those that are linked."""
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "pairs", NARROW)
        asked, filter_ = asked_for(pairs.select("a").union(pairs.select("b")), 2 * pairs.count())
        few = asked(classes.select("doc", "n", "sketch"), "doc")
        side = lambda c: few.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"x{c}"))
        pairs = stored(mapped(pairs.join(side("b"), "b").join(side("a"), "a"), _likely(percent), "a long, b long").distinct(), "likely", NARROW)
        filter_.destroy()
        asked, filter_ = asked_for(pairs.select("a").union(pairs.select("b")), 2 * pairs.count())
        count, size = asked(classes.select("doc", "bytes"), "doc").agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        blocks = max(1, -(-count // CELL_ROWS), -(-size // CELL_BYTES))
        # a document goes with its smallest partner, so that most pairs of a group are in one cell; large groups have parts
        group = pairs.union(pairs.select("a", "a")).toDF("m", "doc").groupBy("doc").agg(F.min("m").alias("m")).join(asked(classes.select("doc", "bytes"), "doc"), "doc")
        parts = group.groupBy("m").agg(F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("bytes") / CELL_BYTES)).alias("parts"))
        block = F.pmod(F.xxhash64("m", F.pmod(F.xxhash64("doc"), F.col("parts"))), F.lit(blocks))
        placed = stored(group.join(parts, "m").select("doc", block.alias("block")).distinct(), "placed", NARROW)
        for c in ("a", "b"):
            pairs = pairs.join(placed.select(F.col("doc").alias(c), F.col("block").alias(f"b{c}")), c)
        dealt = pairs.select((F.least("ba", "bb") * blocks + F.greatest("ba", "bb")).alias("cell"), "a", "b")
        places = dealt.select("cell", F.col("a").alias("doc")).union(dealt.select("cell", F.col("b").alias("doc"))).distinct()
        texts = places.join(asked(docs, "doc"), "doc").select("cell", F.col("doc").alias("a"), F.lit(None).cast("long").alias("b"), "text")
        both = texts.union(dealt.withColumn("text", F.lit(None).cast("string"))).repartition("cell").sortWithinPartitions("cell", "b")
        out = stored(mapped(both, _confirm(shingle, percent), "a long, b long").distinct(), "confirmed")
        filter_.destroy()
        return out

    def paired(lists: DataFrame, where: str) -> DataFrame:
        """Pairs (a, b) of the lists (key, doc and another column)."""
        other = next(c for c in lists.columns if c not in ("key", "doc"))
        one, two = (lists.withColumnsRenamed({"doc": d, other: o}) for d, o in (("a", "oa"), ("b", "ob")))
        return one.join(two, "key").where(f"a < b AND {where}").select("a", "b")

    each = classes.select(F.explode("keys").alias("key"), "doc", "n")
    alike = Window.partitionBy("key")
    met = stored(each.select("key", "doc", "n", F.count("*").over(alike).alias("many"), F.min("doc").over(alike).alias("head")).where("many > 1"), "lists")
    short = paired(met.where(F.col("many") <= HOT).select("key", "doc", "n"), f"100 * least(oa, ob) >= {percent} * greatest(oa, ob)")
    first = confirmed(short.union(met.where((F.col("many") > HOT) & (F.col("doc") != F.col("head"))).select(F.col("head").alias("a"), F.col("doc").alias("b"))))

    named = components(first).withColumnsRenamed({"node": "doc", "component": "one"})
    long = met.where(F.col("many") > HOT).select("key", "doc").join(named, "doc", "left").select("key", "doc", F.coalesce("one", "doc").alias("one"))
    apart = long.groupBy("key").agg(F.min("one").alias("x"), F.max("one").alias("y")).where("x < y").select("key")
    left = stored(long.join(apart, "key").select("doc", "one").distinct(), "left", NARROW)
    asked, filter_ = asked_for(left.select("doc"), left.count())
    texts = asked(docs, "doc").join(left, "doc").select("doc", "one", "text")
    sets = stored(mapped(texts, _sets(shingle), "doc long, one long, row long, n long, set binary").dropDuplicates(["doc", "row"]), "sets")
    filter_.destroy()
    values = mapped(sets, _values, "doc long, one long, row long, n long, value long")
    # values that one component alone has needn't be ranked
    alike = Window.partitionBy("value")
    often = values.select("*", F.count("*").over(alike).alias("many"), F.min("one").over(alike).alias("x"), F.max("one").over(alike).alias("y")).where("x < y")
    ranked = often.groupBy("doc", "one", "row", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("many", "value"))), lambda x: x["value"]).alias("ranked"))
    of = stored(mapped(ranked, _prefix_lists(percent), "key long, value long, doc long, one long, row long, n long"), "prefixes")
    name = [F.bit_xor(F.xxhash64("doc", "row", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    apart = of.groupBy("key", "one").agg(F.count("*").alias("c"), *name)
    apart = apart.groupBy("key").agg(F.sum("c").alias("many"), F.sum(F.col("c") * F.col("c")).alias("own"), F.count("*").alias("ones"), *(F.bit_xor(h).alias(h) for h in ("h1", "h2")))
    # lists of the same sets give the same pairs
    once = apart.where("ones > 1").groupBy("h1", "h2", "many", "own").agg(F.min("key").alias("key"))
    across = (F.col("many") * F.col("many") - F.col("own")) / F.col("many")
    sizes = stored(once.select("key", across.alias("across")), "sizes", NARROW)
    few = paired(of.select("key", "doc", "one").join(sizes.where(F.col("across") <= SPLIT).select("key"), "key"), "oa <> ob")
    # long lists of one value are one group, whatever the bands
    hot = stored(of.join(sizes.where(F.col("across") > SPLIT).select("key"), "key").select("value", "doc", "one", "row", "n").distinct(), "hot", NARROW)
    each = hot.groupBy("value").agg(F.count("*").alias("many"), F.sum("n").alias("all"), *name).groupBy("h1", "h2", "many").agg(F.min("value").alias("value"), F.max("all").alias("all"))
    blocks = F.greatest(F.ceil(F.col("many") / CELL_ROWS), F.ceil(8 * F.col("all") / CELL_BYTES))
    dealt = hot.join(each.select("value", blocks.alias("blocks")), "value").withColumnRenamed("value", "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).alias("second"), "doc", "one", "row")
    cells = dealt.join(sets.select("doc", "row", "set"), ["doc", "row"]).select("key", "lo", "hi", "second", "doc", "one", "set")
    cells = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    candidates = few.union(mapped(cells, _across(percent), "a long, b long"))
    links = first.union(confirmed(candidates))
    of = rows.join(classes.select("s1", "s2", F.col("doc").alias("class")), ["s1", "s2"], "left").select("doc", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
    # ids on rows of different sets tie these sets together
    twice = of.where("doc IS NOT NULL AND class IS NOT NULL").groupBy("doc").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    tied = of.join(twice, "doc").where("class > a").select("a", F.col("class").alias("b"))
    ends = components(links.union(tied))
    out = of.join(ends.withColumnsRenamed({"node": "class", "component": "end"}), "class", "left")
    component = F.when(F.col("doc").isNotNull(), F.least(F.coalesce("end", "class", "doc"), "doc"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS n, doc_id AS m FROM s UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n WHERE r.m < u.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.m)::BIGINT AS component_id, min(r.m) = s.doc_id AS kept FROM s JOIN r ON r.n = s.doc_id GROUP BY s.doc_id, s.s
"""
