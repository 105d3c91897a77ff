"""Shared pieces: the shared folder, shipping the package, and byte-level tokenising with numpy.

Words are the maximal runs of bytes other than ``\\x20 \\x09-\\x0D``; in UTF-8 these bytes never occur inside another
character, so splitting bytes equals splitting text.  ``bytes.split()`` splits on exactly this set.
"""
from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of text that are worked on at once (a longer text is alone), at some 12 times as much memory; what needs 60 times as
#: much goes over ``SEGMENT`` bytes at a time, however long a text is.
CHUNK = 512 << 10
SEGMENT = 256 << 10
#: Bytes of one Arrow batch.
BATCH = 4 << 20
U = np.uint64


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors unless they find it by PYTHONPATH or their working folder; bounds Arrow batches."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if ROOT in paths or os.path.abspath(os.getcwd()) == ROOT or getattr(sc, "_skirmish_shipped", False):
        return
    name = os.path.join(tempfile.mkdtemp(), "skirmish.zip")
    with zipfile.ZipFile(name, "w") as z:
        for top, _, files in os.walk(os.path.join(ROOT, "skirmish")):
            for f in files:
                if f.endswith(".py"):
                    z.write(full := os.path.join(top, f), os.path.relpath(full, ROOT))
    sc.addPyFile(name)
    sc._skirmish_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``, else,
    in local mode only, one of our own."""
    if set_ := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return set_.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(spark, "_skirmish_dir", None):
        spark._skirmish_dir = "file://" + tempfile.mkdtemp(prefix="skirmish-")
    return spark._skirmish_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/skirmish/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(hadoop)
    return path


#: Shuffle partitions in one file, for tables of a few ids a row: these are a hundredth of the texts that partitions are for.
NARROW = 8


def stored(df: DataFrame, name: str, together: int = 1) -> DataFrame:
    """Writes df as a table into the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    if together > 1:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // together))
    df.write.parquet(path := fresh_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- work in Python workers
def _rest() -> None:
    """Gives back what the allocators keep, as an idle worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


_remembered: dict = {}


def remembered(mark: object, make: Callable[[], object]) -> object:
    """What this worker made under the mark, until it makes something else or runs tasks that remember nothing."""
    if mark not in _remembered:
        _remembered.clear()
        _remembered[mark] = make()
    return _remembered[mark]


def forget() -> None:
    if _remembered:
        _remembered.clear()
        _rest()


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, remembers: bool = False) -> DataFrame:
    """``mapInArrow`` in batches of bounded size by workers that give memory back when a task ends.

    Workers outlive a query: unless the work itself remembers something between tasks, it drops what others left."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        try:
            yield from work(batches)
        finally:
            _rest()

    return df.mapInArrow(run, schema)


def schema_of(df: DataFrame, *without: str) -> str:
    """The columns of df as DDL, except those named."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def cleared(df: DataFrame, made: tuple[str, ...], *needed: str) -> DataFrame:
    """df without columns that carry the name of one that is about to be made, which replaces it; those needed must not."""
    names = {c.lower() for c in made}
    if clash := [c for c in needed if c.lower() in names]:
        raise ValueError(f"the input column {clash[0]} has the name of a result")
    return df.select(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in names))


# ---------------------------------------------------------------- texts as bytes
def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups of whole texts of about ``limit`` bytes: first row, end row, bytes, offsets.  A blank follows each text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield (first, i, *packed(texts[first:i]))
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield (first, len(texts), *packed(texts[first:]))


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def _power_pair(n: int) -> list[np.ndarray]:
    return [_powers(b, n) for b in (_BASE, pow(_BASE, -1, 1 << 64))]


_small: list[np.ndarray] = []


def _segment(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words, by differences of one running polynomial; ends with a blank."""
    edge = np.diff(np.concatenate([[False], ~BLANK[data]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, U)
    if not _small:
        _small[:] = _power_pair(SEGMENT + 1)
    up, down = _small if len(data) <= SEGMENT else _power_pair(len(data) + 1)
    running = np.concatenate([[U(0)], np.cumsum((data.astype(U) + U(1)) * up[: len(data)])])
    return starts, ends, mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, and the number of words before each text (and in all); segments end at blanks."""
    parts, at = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U))], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        if end < len(data):
            tail = np.flatnonzero(BLANK[data[at:end]])
            while not len(tail):  # one word fills the segment
                end = min(end + SEGMENT, len(data))
                tail = np.flatnonzero(BLANK[data[at:end]])
            end = at + int(tail[-1]) + 1
        starts, ends, h = _segment(data[at:end])
        parts.append((starts + at, ends + at, h))
        at = end
    starts, ends, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return starts, ends, h, np.searchsorted(starts, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


# ---------------------------------------------------------------- ids that are asked for
#: Bits of the largest filter (16 MB).
FILTER_BITS = 27


def asked_for(asked: DataFrame, most: int) -> tuple[Callable[[DataFrame, str], DataFrame], Broadcast]:
    """A filter of tables by a key (a long): it drops most rows whose key isn't in the one column of ``asked`` (``most`` rows);
    and what it holds on the driver and the executors, to be destroyed when the filter's tables have been stored.

    The filter is a bitmap of hashed ids of at most 2 ** FILTER_BITS bits, whatever the number of ids; beyond some tens of
    millions of ids it lets more and more other rows through, which the join that follows drops."""
    ids = asked.toDF("_id").where("_id IS NOT NULL")
    bits = min(FILTER_BITS, max(10, (8 * most).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    got = ids.select(place("_id").alias("p")).select((F.col("p") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, int(p % 64)) AS b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[got.column("w").to_numpy()] = got.column("b").to_numpy()
    shared = asked.sparkSession.sparkContext.broadcast(words.tobytes())

    @F.pandas_udf("boolean")
    def held(p: pd.Series) -> pd.Series:
        table, at = np.frombuffer(shared.value, np.uint64), p.to_numpy(np.int64)
        return pd.Series((table[at >> 6] >> (at & 63).astype(U) & U(1)).astype(bool))

    return lambda df, key: df.where(F.col(key).isNotNull()).where(held(place(key))), shared
