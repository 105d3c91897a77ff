"""Byte-level BPE by sentencepiece (operator 1).

A rank file (token bytes, rank) becomes a sentencepiece BPE model without training: each token's bytes are mapped to
printable characters, the piece's score is its negative rank, and normalisation is the identity.  Merging the best-scored
neighbours is then the same as merging those of the lowest rank.  A text is cut by the pattern into pre-tokens; each is
encoded alone; ids are decoded by the inverse mapping.

Cases: a null or empty text has no tokens; rows are independent, so ties, repeated rows and empty tables need no care;
other columns are not read.  Memory: one batch of texts and a bounded cache of pieces.
"""
from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import mapped, ship, table

#: Most pieces that a worker remembers.
CACHE = 200_000


def _byte_letters() -> list[str]:
    """A printable character for each byte: Latin-1's visible ones stand for themselves, the rest lie from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    at = {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [at[b] for b in range(256)]


LETTERS = _byte_letters()
_TO_LETTERS = dict(enumerate(LETTERS))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: an integer, a float or something with a length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model whose ids are the ranks; one unknown piece follows the last."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, _field(1, "".join(map(LETTERS.__getitem__, t)).encode()) + _field(2, float(-r)) + _field(3, 1)) for r, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    absent = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(k, absent) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes with one vocabulary.

    The pattern never joins a character with a blank that follows it, except inside a run of white space of which the
    blank is neither the first nor the last; so other texts may be cut before each blank and the pieces looked up.
    """

    #: White space before a blank, or white space that isn't ASCII: such texts are matched whole.
    tricky = re.compile("[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000 ] |[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search

    def __init__(self, ranks: dict[bytes, int], pattern: str, cut: bool = True) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(pattern).findall
        self.ranks, self.cut = ranks, cut
        self.as_bytes = {str(r): t for t, r in ranks.items()}
        self.known: dict[str, str] = {}

    def fresh(self, texts: list[str]) -> list[str]:
        """The decimal ids of texts, each id after a blank, without the cache: each pre-token of a text encoded alone."""
        parts = list(map(self.split, texts))
        tokens = list({t for some in parts for t in some})
        raw = [t.encode() for t in tokens]
        coded = self.processor.encode([b.decode("latin-1").translate(_TO_LETTERS) for b in raw], num_threads=1)
        ids = {}
        for t, one, got in zip(tokens, map(self.ranks.get, raw), coded, strict=True):
            ids[t] = f" {one}" if one is not None else "".join([f" {i}" for i in got])
        return ["".join(map(ids.__getitem__, some)) for some in parts]

    def encode(self, texts: list[str]) -> Iterator[str]:
        """Decimal ids of each text, joined by one space."""
        for i in range(0, len(texts), 256):
            split = [[t] if not self.cut or self.tricky(t) else t.replace(" ", "\0 ").split("\0") if "\0" not in t else [t] for t in texts[i : i + 256]]
            found = [list(map(self.known.get, pieces)) for pieces in split]
            new = list({p for pieces, got in zip(split, found, strict=True) if None in got for p, x in zip(pieces, got, strict=True) if x is None})
            extra = dict(zip(new, self.fresh(new), strict=True)) if new else {}
            for pieces, got in zip(split, found, strict=True):
                yield "".join([extra[p] if x is None else x for p, x in zip(pieces, got, strict=True)] if None in got else got)[1:]
            if len(self.known) < CACHE:
                self.known.update((p, x) for p, x in extra.items() if len(p) < 40)

    def decode(self, ids: str) -> bytes:
        """The bytes of decimal ids joined by one space."""
        return b"".join(map(self.as_bytes.__getitem__, ids.split()))


#: The pattern for which cutting before blanks is known to be right.
CUTTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, kept for the life of the worker."""
    if (path, pattern) not in _codecs:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _codecs[path, pattern] = Codec(ranks, pattern, cut=pattern == CUTTABLE)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Adds to the columns kept: ``ids`` (array, if asked for), ``n_tokens``, ``ids_sha256`` of the decimal ids joined by
    one space, and ``decoded_sha256`` of the bytes that the ids decode to."""
    kept = df.select(*keep, F.col(text).alias("_text"))
    out = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep] + ["ids array<int>"] * ids + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            lists, counts, of_ids, of_bytes = [], [], [], []
            for got in c.encode([x or "" for x in batch.column("_text").to_pylist()]):
                counts.append(got.count(" ") + bool(got))
                of_ids.append(hashlib.sha256(got.encode()).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(got)).hexdigest())
                if ids:
                    lists.append(np.array(got.split(), np.int32))
            made = [pa.array(lists, pa.list_(pa.int32()))] * ids + [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            names = ["ids"] * ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + made, [*keep, *names])

    return mapped(kept, run, out)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that a column of ids decodes to; null ids give null."""
    ship(df.sparkSession)

    @F.pandas_udf("binary")
    def run(column):  # noqa: ANN001, ANN202
        c = codec(path, pattern)
        return column.map(lambda x: None if x is None else c.decode(" ".join(map(str, x))))

    return df.withColumn(to, run(ids))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
