"""Exact substring de-duplication by super-k-mers (operator 5).

A window is 13 consecutive words.  Its minimiser is the least hash of the word triples in it; consecutive windows of one
document that share it travel as one string (a super-k-mer) to the minimiser's bucket, so a word is sent about three times
rather than 13.  Strings travel in compressed bundles: a task holds some ``HELD`` bytes of them, deals them to bins (ranges
of buckets, ``BINS`` per shuffle partition) and sends at most ``BUNDLE`` as one row.  On arrival bundles are opened and the
strings sorted by bucket, which spills if need be.  In a bucket all windows are sorted by hash, groups of equal windows are
confirmed byte by byte, and each window that also starts in a document with a smaller id is reported.

Hot buckets.  Triples that would be the minimiser of more than one in ``bins`` windows are ordered last, so the windows
around them spread over the buckets of their other triples: one document in ``PART`` tells which these are, at most
``POPULAR``.  This list only decides where a window is counted, never whether.  A passage in very many documents is made of
equal strings: of those that a task sees twice within ``CHUNK`` bytes it remembers some ``KNOWN`` and sends only the one of
the smallest document (for the others all windows are already known to be repeated), and in a bucket, where rows come sorted
by string and document, equal strings after the first are settled while they stream by.  So a task holds at most the
different strings of one bucket, at some 12 times their bytes.

Cases: null or empty texts have no words; texts of fewer than 13 words lose none; a null id is larger than all others; of
repeated rows with one id none counts as smaller than another; an empty table gives no rows; other columns pass through
``deduplicate``, whose ``n_words``, ``n_removed`` and ``kept_text`` replace columns of these names.  A very long text takes
some 12 times its bytes.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import CHUNK, U, chunks, cleared, mapped, mix, packed, schema_of, sliding_min, stored, table, text_bytes, words

WINDOW = 13
SEED = 3
#: Bins per shuffle partition, most strings in a bundle, and bytes of strings that a task holds before it sends them.
BINS = 4
BUNDLE = 600
HELD = 12 << 20
#: One document in so many tells which triples are popular; at most so many triples, and remembered bytes of strings.
PART = 64
POPULAR = 1 << 16
KNOWN = 2 << 20
LAST = (1 << 63) - 1
SENT = "bin int, many int, numbers binary, strings binary"
OPENED = "bucket int, doc long, row long, start int, n int, blob binary"
FOUND = "doc long, row long, start int, n int"


def _runs(doc: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch with one document, consecutive positions and equal ``same``."""
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    for x in same:
        cut |= x[1:] != x[:-1]
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return first, np.concatenate([first[1:] - 1, [len(doc) - 1]])


#: Columns of numbers in a bundle.
NUMBERS = (("bucket", np.int32), ("doc", np.int64), ("row", np.int64), ("start", np.int32), ("n", np.int32))


def bundles(bins: int, spread: np.ndarray, columns: list[np.ndarray], blobs: list[bytes] | None) -> pa.RecordBatch:
    """One row per bin and at most BUNDLE strings: differences of the numbers byte by byte, and the strings, compressed."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    to = ((spread >> U(32)) % U(bins)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    to = to[order]
    head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    ends = np.concatenate([head[1:], [len(to)]])
    edges = [(i, min(i + BUNDLE, e)) for h, e in zip(head.tolist(), ends.tolist(), strict=True) for i in range(h, e, BUNDLE)]
    columns, rows = [c[order] for c in columns], order.tolist()
    numbers = [squeeze(b"".join(np.diff(c[i:j], prepend=c.dtype.type(0)).view(np.uint8).reshape(j - i, -1).T.tobytes() for c in columns)) for i, j in edges]
    strings = [squeeze(b"\n".join([blobs[r] for r in rows[i:j]])) if blobs is not None else None for i, j in edges]
    return pa.RecordBatch.from_arrays([pa.array(to[[i for i, _ in edges]]), pa.array([j - i for i, j in edges], pa.int32()), pa.array(numbers, pa.binary()), pa.array(strings, pa.binary())], ["bin", "many", "numbers", "strings"])


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles to super-k-mers and windows known to be repeated."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for many, numbers, strings in zip(*(batch.column(c).to_pylist() for c in ("many", "numbers", "strings")), strict=True):
            numbers, at, out = expand(numbers), 0, []
            for _, kind in NUMBERS:
                wide = np.dtype(kind).itemsize
                apart = np.frombuffer(numbers, np.uint8, many * wide, at).reshape(wide, many)
                out.append(pa.array(np.cumsum(np.ascontiguousarray(apart.T).view(kind).ravel(), dtype=kind)))
                at += many * wide
            blobs = pa.nulls(many, pa.binary()) if strings is None else pa.array(expand(strings).split(b"\n"), pa.binary())
            yield pa.RecordBatch.from_arrays([*out, blobs], [*(name for name, _ in NUMBERS), "blob"])


def _minimisers(h: np.ndarray, owner: np.ndarray, window: int, popular: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First windows of all windows of one text (word places), their minimisers, and first and last index of each run."""
    triples = mix(h[:-2] * U(3) + h[1:-1] * U(0x9E3779B97F4A7C15) + h[2:] * U(0xC2B2AE3D27D4EB4F)) >> U(1)
    if len(popular):
        triples = triples | np.isin(triples, popular).astype(U) << U(63)
    least = sliding_min(triples, window - SEED + 1)
    at = np.flatnonzero(owner[: len(owner) - window + 1] == owner[window - 1 :])
    return at, least, *_runs(owner[at], at, least[at])


def popular_triples(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """(doc, row, text) to minimisers and the number of their windows, a chunk at a time."""
    for batch in batches:
        for _, _, data, offsets in chunks([b" ".join(t.split()) for t in text_bytes(batch.column(2))]):
            _, _, h, before = words(data, offsets)
            if len(h) >= window:
                at, least, _, _ = _minimisers(h, np.repeat(np.arange(len(before) - 1), np.diff(before)), window, np.empty(0, U))
                found, many = np.unique(least[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(many, pa.int64())], ["triple", "n"])


def super_kmers(batches: Iterator[pa.RecordBatch], bins: int, window: int = WINDOW, popular: np.ndarray = np.empty(0, U)) -> Iterator[pa.RecordBatch]:  # noqa: B008
    """(doc, row, text) to bundles of super-k-mers and of windows already known to be repeated (no strings)."""
    held: list[tuple] = []
    strings: list[bytes] = []
    known: dict[bytes, int] = {}  # strings seen again and again, and the smallest document that has sent them
    size, remembered = 0, 0

    def send() -> pa.RecordBatch:
        nonlocal size
        spread, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
        out = bundles(bins, spread, columns, strings)
        held.clear()
        strings.clear()
        size = 0
        return out

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        rows = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in chunks([b" ".join(t.split()) for t in text_bytes(batch.column(2))]):
            starts, ends, h, before = words(data, offsets)
            if len(starts) < window:
                continue
            owner = np.repeat(np.arange(b - a), np.diff(before))
            at, least, first, last = _minimisers(h, owner, window, popular)
            if not len(at):
                continue
            text = data.tobytes()
            lo, hi = at[first], at[last] + window - 1
            blobs = [text[s:e] for s, e in zip(starts[lo].tolist(), ends[hi].tolist(), strict=True)]
            docs = ids[a + owner[lo]]
            group: dict[bytes, int] = {}
            of = np.fromiter((group.setdefault(x, len(group)) for x in blobs), np.int64, len(blobs))
            smallest = np.full(len(group), LAST)
            np.minimum.at(smallest, of, docs)
            before_now = np.fromiter((known.get(x, LAST) for x in group), np.int64, len(group)) if known else np.full(len(group), LAST)
            sent = (docs == smallest[of]) & (docs <= before_now[of])
            for x, many, d in zip(group, np.bincount(of).tolist(), smallest.tolist(), strict=True):
                if many > 1 or x in known:
                    if x not in known:
                        remembered += len(x) + 100
                    known[x] = min(d, known.get(x, LAST))
            if remembered > KNOWN:
                known, remembered = {}, 0
            place, count = (lo - before[owner[lo]]).astype(np.int32), (last - first + 1).astype(np.int32)
            pick = np.flatnonzero(sent)
            if len(pick):
                key = mix(least[lo[pick]])
                held.append((key, key.astype(np.uint32).view(np.int32), docs[pick], rows[a + owner[lo[pick]]], place[pick], np.zeros(len(pick), np.int32)))
                strings += [blobs[i] for i in pick.tolist()]
                size += sum(map(len, strings[-len(pick) :]))
            if len(rest := np.flatnonzero(~sent)):
                f, g = _runs(owner[lo[rest]] + np.cumsum(np.concatenate([[0], lo[rest[1:]] != lo[rest[:-1]] + count[rest[:-1]]])), np.arange(len(rest)))
                r, total = rest[f], (lo[rest[g]] + count[rest[g]] - lo[rest[f]]).astype(np.int32)
                spread = mix(rows[a + owner[lo[r]]].view(np.uint64) + place[r].astype(U))
                yield bundles(bins, spread, [spread.astype(np.uint32).view(np.int32), docs[r], rows[a + owner[lo[r]]], place[r], total], None)
            if size > HELD:
                yield send()
    if held:
        yield send()


def _count(docs: list[int], rows: list[int], starts: list[int], blobs: list[bytes], window: int) -> pa.RecordBatch:
    """The windows, in whole buckets, that also start in a smaller document."""
    data, offsets = packed(blobs)
    s, e, h, before = words(data, offsets)
    owner = np.repeat(np.arange(len(blobs), dtype=np.int32), np.diff(before))
    at = np.flatnonzero(owner[: len(owner) - window + 1] == owner[window - 1 :])
    code = np.zeros(len(h) - window + 1, U)
    for j in range(window):
        code = code * U(0xD1342543DE82EF95) + h[j : len(h) - window + 1 + j]
    code, doc = code[at], np.array(docs)[owner[at]]
    del h
    order = np.argsort(code, kind="stable")
    code = code[order]
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    group = np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(order)]])))
    least = np.minimum.reduceat(doc[order], head)
    holder = np.full(len(head), -1)
    mine = np.flatnonzero(doc[order] == least[group])
    holder[group[mine[::-1]]] = order[mine[::-1]]
    repeated = np.flatnonzero(doc[order] > least[group])
    flagged = order[repeated]
    text = data.tobytes()
    s, e = s[at], e[at + window - 1]
    other = holder[group[repeated]]
    if any(text[a:b] != text[c:d] for a, b, c, d in zip(s[flagged].tolist(), e[flagged].tolist(), s[other].tolist(), e[other].tolist(), strict=True)):
        # two different windows share 64 bits: count these buckets by the strings themselves
        seen: dict[bytes, int] = {}
        keys = [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        for k, d in zip(keys, doc.tolist(), strict=True):
            seen[k] = min(d, seen.get(k, LAST))
        flagged = np.array([i for i, (k, d) in enumerate(zip(keys, doc.tolist(), strict=True)) if seen[k] < d], np.int64)
    flagged = np.sort(flagged)
    own, place = owner[at[flagged]], at[flagged] - before[owner[at[flagged]]]
    first, last = _runs(own, place)
    own = own[first]
    return pa.RecordBatch.from_arrays([pa.array(np.array(docs)[own]), pa.array(np.array(rows)[own]), pa.array((np.array(starts)[own] + place[first]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["doc", "row", "start", "n"])


def repeated_windows(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, blob and document to the repeated windows."""
    names = ["doc", "row", "start", "n"]
    docs: list[int] = []
    rows: list[int] = []
    starts: list[int] = []
    blobs: list[bytes] = []
    size, bucket, last, last_doc = 0, None, None, 0
    for batch in batches:
        known = batch.filter(batch.column("blob").is_null())
        if known.num_rows:
            yield known.select(names)
        sent = batch.filter(batch.column("blob").is_valid())
        more: list[tuple[int, int, int, int]] = []
        for b, d, r, at, blob in zip(*(sent.column(c).to_pylist() for c in ("bucket", "doc", "row", "start", "blob")), strict=True):
            if b != bucket:
                if size > CHUNK:
                    yield _count(docs, rows, starts, blobs, window)
                    docs, rows, starts, blobs, size = [], [], [], [], 0
                bucket, last = b, None
            if blob == last and d > last_doc:
                more.append((d, r, at, blob.count(b" ") + 2 - window))
                continue
            if blob != last:
                last, last_doc = blob, d
            docs.append(d)
            rows.append(r)
            starts.append(at)
            blobs.append(blob)
            size += len(blob)
        if more:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*more, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names)
    if blobs:
        yield _count(docs, rows, starts, blobs, window)


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """df with ``n_words``, ``n_removed`` and ``kept_text`` (the kept words joined by one space) added."""
    df = cleared(df, ("n_words", "n_removed", "kept_text"), text, key)
    doc, row = F.coalesce(F.col(key).cast("long"), F.lit(LAST)), F.xxhash64(F.col(key), F.col(text))
    bins = BINS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(doc.alias("doc"), row.alias("row"), F.col(text).alias("text"))
    seen = stored(mapped(texts.where(F.pmod(F.xxhash64("doc"), F.lit(PART)) == 0), lambda b: popular_triples(b, window), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")), "triples")
    share = (seen.agg(F.sum("n")).first()[0] or 0) / bins
    top = np.sort(seen.where(F.col("n") > max(share, window)).orderBy(F.desc("n"), "triple").limit(POPULAR).select("triple").toArrow().column(0).to_numpy()).view(np.uint64)
    sent = mapped(texts, lambda b: super_kmers(b, bins, window, top), SENT)
    found = mapped(mapped(sent.repartition("bin"), opened, OPENED).sortWithinPartitions("bucket", "blob", "doc"), lambda b: repeated_windows(b, window), FOUND)
    spans = found.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("__spans")).withColumnsRenamed({"doc": "__doc", "row": "__row"})
    joined = df.withColumns({"__doc": doc, "__row": row}).join(spans, ["__doc", "__row"], "left").drop("__doc", "__row")
    names, where = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for t, spans in zip(text_bytes(batch.column(where)), batch.column(len(names)).to_pylist(), strict=True):
                tokens = t.split()
                total.append(len(tokens))
                if spans:
                    gone = np.zeros(len(tokens), bool)
                    for x in spans:
                        gone[x["start"] : x["start"] + x["n"] + window - 1] = True
                    tokens = [w for w, g in zip(tokens, gone.tolist(), strict=True) if not g]
                removed.append(total[-1] - len(tokens))
                kept.append(b" ".join(tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept_text"])

    return mapped(joined, run, f"{schema_of(df)}, n_words long, n_removed long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT win.doc_id, list(DISTINCT i + j) AS gone FROM win JOIN least USING (s), range(0, 13) r(j) WHERE m < win.doc_id GROUP BY win.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN hit USING (doc_id)
"""
