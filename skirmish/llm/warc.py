"""WARC archives with an index that is written first (operator 8).

``write`` gives each task an archive of its own in a shared folder, one gzip member per record, and an index row per record:
archive, offset, length, URL, digest.  ``read`` takes any selection of index rows, sorts them by archive and offset, joins
neighbouring byte ranges and fetches each joined range with one call.  Archives are reached by Arrow's file systems (local,
HDFS, S3, GCS), tables by Spark.

Of records with equal payloads (by SHA-1 and length), empty ones too, that with the largest id is a response and the others
are revisits that name it.  Only ids and hashes are shuffled to tell groups (sizes counted with partial counts, the groups'
largest ids joined as a skewed join, which Spark splits); payloads go to the archives from where they are read, or, when more
than ``NAMED`` groups have two or more pages, after a join by id.  An archive's name holds the attempt, so a task that runs again never touches what an earlier one wrote, and
the index, stored before it is used, only names archives of tasks that ended.

Cases: a null payload is empty; repeated rows with the largest id are all responses; a null id is a response, unless the
same payload has an id elsewhere; empty tables make no archive and an empty index; a null URL is written as an empty one;
other columns, whatever their names, are not read.  A very long payload is held whole, at some four times its bytes.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import fresh_path, mapped, stored, table

#: Bytes of one fetch at most, unless a single record is longer; gaps up to GAP bytes are read over.
FETCH = 8 << 20
GAP = 64 << 10
#: Bytes of an archive that one task reads back.
PART = 16 << 20
#: Groups of equal payloads that are broadcast (20 bytes and an id each, some 20 MB); more are joined.
NAMED = 200_000
LEVEL = 4
INDEX = "id long, url string, archive string, offset long, length long, payload_digest string, record_type string, refers_to long"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _target(url: str) -> str:
    """A URL fit for a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(kind: str, page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member.  A revisit has an empty block and keeps the payload's length in a header of its own."""
    block = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        lines[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    c = zlib.compressobj(LEVEL, wbits=31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + c.compress(block) + c.compress(b"\r\n\r\n") + c.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a gzip member."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header")
    return headers, rest[:n]


def _file_system(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the archives and the index; gives the index, which lies as a table in ``folder``/index."""
    spark = df.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    pages = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    marked = pages.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("bytes", F.length("payload"))
    names = marked.select("id", "sha1", "bytes")
    groups = stored(names.groupBy("sha1", "bytes").agg(F.max("id").alias("largest"), F.count("*").alias("many")).where("many > 1").drop("many"), "groups")
    if groups.count() <= NAMED:
        ready = marked.join(F.broadcast(groups), ["sha1", "bytes"], "left")
    else:
        # ids of pages that aren't the response, and the payload's hash, as an id may be on several rows
        later = names.join(groups, ["sha1", "bytes"]).where("NOT id <=> largest").select("sha1", "bytes", "id", "largest").distinct().toDF("s", "b", "i", "largest")
        ready = marked.join(later, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha1") == F.col("s")) & (F.col("bytes") == F.col("b")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _file_system(folder)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    fs.create_dir(f"{at}/archives", recursive=True)
                    out = fs.open_output_stream(f"{at}/archives/{name}", compression=None)
                rows = []
                ids, urls, sha1s, largest = (batch.column(c).to_pylist() for c in ("id", "url", "sha1", "largest"))
                for i, u, body, sha1, most in zip(ids, urls, batch.column("payload"), sha1s, largest, strict=True):
                    kind = "response" if most is None or i == most else "revisit"
                    digest = base32(sha1)
                    member = record(kind, i, u, body.as_py(), digest, most)
                    out.write(member)
                    rows.append((i, u, name, offset, len(member), digest, kind, most if kind == "revisit" else None))
                    offset += len(member)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "url", "archive", "offset", "length", "payload_digest", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    mapped(ready.select("id", "url", "payload", "sha1", "largest"), run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int, list[int]]]:
    """Start, end and members of joined byte ranges of sorted records."""
    start, end, members = 0, 0, []
    for i, (o, n) in enumerate(zip(offsets, lengths, strict=True)):
        if members and (o - end > GAP or max(end, o + n) - start > FETCH):
            yield start, end, members
            members = []
        if not members:
            start = o
        end = o + n if not members else max(end, o + n)
        members.append(i)
    if members:
        yield start, end, members


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of a selection of index rows: id, url, payload_bytes, payload_digest, record_type, refers_to[, payload].

    A response's payload is held against its digest; the payload of a revisit is null here, as its response has it."""
    schema = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _file_system(folder)
        for batch in batches:
            archives, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            first = 0
            while first < len(archives):
                last = first
                while last < len(archives) and archives[last] == archives[first]:
                    last += 1
                with fs.open_input_file(f"{at}/archives/{archives[first]}") as f:
                    for start, end, members in ranges(offsets[first:last], lengths[first:last]):
                        data = f.read_at(end - start, start)
                        rows = []
                        for i in members:
                            o = offsets[first + i] - start
                            h, block = parse(data[o : o + lengths[first + i]])
                            digest, kind = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"]
                            if kind == "response" and base32(hashlib.sha1(block).digest()) != digest:
                                raise ValueError(f"the payload at {archives[first]}:{offsets[first + i]} differs from its digest")
                            to = h.get("x-refers-to-page-id")
                            page = h["x-page-id"]
                            rows.append((int(page) if page else None, h["warc-target-uri"], int(h["x-payload-length"]), digest, kind, int(to) if to else None, *([block if kind == "response" else None] * payloads)))
                        cols = list(zip(*rows, strict=True))
                        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                        names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names[: len(cols)])
                first = last

    chosen = index.select("archive", "offset", "length", F.floor(F.col("offset") / PART).alias("part"))
    # tasks by the bytes to fetch: the index rows themselves are small and would be put into one task
    size = chosen.agg(F.sum("length")).first()[0] or 0
    return mapped(chosen.repartition(size // PART + 1, "archive", "part").sortWithinPartitions("archive", "offset"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    out = read(write(table(spark, sf_dir, "pages"), folder), folder, payloads=False)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
bits AS (SELECT page_id, n, x, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(x, 1 + 5 * i // 4, 2) || CASE WHEN 5 * i // 4 + 2 > 40 THEN '0' ELSE '' END)::INTEGER >> (3 - (5 * i) % 4) & 31), 1)) AS c FROM h),
g AS (SELECT x, n, max(page_id) AS m FROM h GROUP BY x, n)
SELECT page_id, bits.n::BIGINT AS payload_bytes, array_to_string(c, '') AS payload_digest,
  CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM bits LEFT JOIN g ON bits.x = g.x AND bits.n = g.n
"""
