"""Hierarchical multi-length packing (operator 6).

Documents are tokenised and cut into full windows; what is left of a document is routed to the tier of the smallest
context size that holds it.  Each tier is packed, longest windows first: the longest waiting piece opens a window, the
gap is filled with the longest pieces of this or shorter tiers that fit, and what then is left with the start of one more
piece.  A window of any tier is full, so it has no padding; only when a task ends, what waits is cut into windows of
descending powers of two.  Windows are dealt to step groups of equal token counts, tier by tier.

Every task packs the rows it has read, holding at most ``POOL`` waiting pieces, so there is no shuffle and no collecting.
Cases: a null or empty text is the end token alone; repeated rows are packed each; an empty table gives no rows; other
columns are not read.  The result is the same for the same input splits.
"""
from __future__ import annotations

import bisect
import codecs
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.byte_bpe import LETTERS
from skirmish.llm.common import BLANK, CHUNK, chunks, mapped, remembered, table, text_bytes

WINDOW = 4096
TIERS = (512, 1024, 2048, WINDOW)
#: Most pieces that wait in a task; half of the tokens are packed when there are more.
POOL = 4096
#: Tokens in a step group.
STEP = 8 * WINDOW
#: Most parts of words that a worker remembers.
CACHE = 200_000

BLANKS, MARKS = b" \t\n\x0b\x0c\r", b".,!*$%&#|;:?"
#: By byte: 0 white space, 1 ASCII letters, 2 marks, 3 all else.
KINDS = bytes(0 if c in BLANKS else 2 if c in MARKS else 1 if bytes([c]).isalpha() else 3 for c in range(256))
#: By 4 * the kind before + the kind of a byte: 1 starts a word, 2 starts a tail of marks, 4 is in no word of letters and a tail.
STEPS = bytes((k % 4 > 0) * (k < 4) | 2 * (k == 6) | 4 * (k % 4 == 3 or k in (2, 9)) for k in range(16)).ljust(256, b"\0")
LOWER = bytes(range(256)).lower()
#: The vocabulary's character for each byte.
ALPHABET = "".join(LETTERS)


class Words:
    """Token ids of whole texts by a vocabulary that drops white space: a text's ids are those of its parts in turn.

    A word of Latin-1 letters and a tail of marks is two parts, as the vocabulary's own pattern makes of it: the letters in
    lower case, which is all that its normalizer makes of them, and the tail.  Any other word is one part.  Arrow finds the
    distinct parts and puts their ids together.  New ones of letters go to the merges of the tokenizer's model, as bytes in
    the vocabulary's alphabet; whatever else is new goes to the tokenizer itself.
    """

    letters = re.compile(b"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        if hasattr(self.merges, "_resize_cache"):
            self.merges._resize_cache(0)  # no part is asked for twice while it is remembered here
        self.known: dict[bytes, bytes] = {}

    def _direct(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merged(self, runs: list[bytes]) -> Iterator[bytes]:
        """Ids of each run of lower-case letters."""
        merge = self.merges.tokenize
        for run in codecs.charmap_decode(b"\n".join(runs), "strict", ALPHABET)[0].split(ALPHABET[10]):
            ids = [t.id for t in merge(run)]
            yield struct.pack(f"<{len(ids)}I", *ids)

    def _fresh(self, new: list[bytes]) -> list[bytes]:
        of_letters = [w.isalpha() or self.letters(w) for w in new]
        merged = self._merged([w for w, plain in zip(new, of_letters, strict=True) if plain])
        return [next(merged) if plain else self._direct(w.decode()) for w, plain in zip(new, of_letters, strict=True)]

    def _looked_up(self, parts: list[bytes]) -> list[bytes]:
        got = list(map(self.known.get, parts))
        if new := [w for w, ids in zip(parts, got, strict=True) if ids is None]:
            fresh = self._fresh(new)
            if len(self.known) < CACHE:
                self.known.update(zip(new, fresh, strict=True))
            rest = iter(fresh)
            got = [next(rest) if ids is None else ids for ids in got]
        return got

    def _ids(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, memoryview]:
        """Where parts start in bytes that end with white space, where the ids of each start and the last end, and all ids."""
        starts, offsets, kept = parts_of(data)
        if not len(starts):
            return starts, offsets, memoryview(b"")
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        ids = pa.array(self._looked_up(found.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(found.indices)
        _, ends, values = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(starts) + 1]
        return starts, ends, memoryview(values or b"")[: ends[-1]]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for first, last, data, offsets in chunks(texts):
            if last - first == 1:
                yield b"".join(self._ids(some)[2] for some in segments(data))
            else:
                starts, ends, ids = self._ids(data)
                at = ends[np.searchsorted(starts, offsets)].tolist()
                yield from (bytes(ids[a:b]) for a, b in itertools.pairwise(at))


def segments(data: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of some ``CHUNK`` bytes that end with white space, as the bytes do."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while not BLANK[data[end - 1]]:
            gap = np.flatnonzero(BLANK[data[end : end + CHUNK]])
            end += int(gap[0]) + 1 if len(gap) else CHUNK
        yield data[at:end]
        at = end


def parts_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Where parts of words start in bytes that end with white space, and these parts: offsets and bytes."""
    raw = data.tobytes()
    kinds, low = (np.frombuffer(bytearray(raw.translate(by)), np.uint8) for by in (KINDS, LOWER))
    lead = np.flatnonzero(data == 0xC3)  # Latin-1 letters beyond ASCII, if neither sign of arithmetic follows
    second = data[lead + 1]
    letter = (second >= 0x80) & (second != 0x97) & (second != 0xB7)
    lead, second = lead[letter], second[letter]
    kinds[lead] = kinds[lead + 1] = 1
    low[lead[second < 0x9F] + 1] += 0x20
    pairs = kinds.copy()
    pairs[1:] |= kinds[:-1] << 2
    steps = np.frombuffer(bytearray(pairs.tobytes().translate(STEPS)), np.uint8)
    if len(other := np.flatnonzero(steps & 4)):
        words = np.flatnonzero(steps & 1)
        whole = np.zeros(len(words), bool)
        whole[np.searchsorted(words, other, "right") - 1] = True
        inside = np.concatenate([np.zeros(words[0], bool), np.repeat(whole, np.diff(words, append=len(data)))])
        np.bitwise_and(steps, 1, out=steps, where=inside)
        np.copyto(low, data, where=inside)
    starts = np.flatnonzero(steps & 3)
    before = np.cumsum(kinds != 0, dtype=np.int32)
    offsets = np.append(before[starts] - np.int32(1), before[-1:])
    return starts, offsets, low.tobytes().translate(None, BLANKS)


def words_of(path: str) -> Words:
    return remembered(("packing", path), lambda: Words(path))


class Packer:
    """Packs the pieces of one task; ``out`` gets (key, start, ids, tokens of the document, sequence, offset, tier, group)."""

    def __init__(self, base: int) -> None:
        self.base, self.made, self.out = base, 0, []
        self.waiting: list[tuple[int, int, object, int, bytes, int]] = []  # ascending by length
        self.serial, self.total = 0, 0
        self.filled: dict[int, int] = {}

    def add(self, key: object, ids: bytes) -> None:
        n = len(ids) // 4
        full = n - n % WINDOW
        for at in range(0, full, WINDOW):
            self._emit(WINDOW, [(key, at, ids[4 * at : 4 * (at + WINDOW)], n)])
        if full < n:
            self._wait(key, full, ids[4 * full :], n)
        if len(self.waiting) > POOL:
            self._pack(POOL // 2)

    def _wait(self, key: object, start: int, ids: bytes, n: int) -> None:
        self.serial += 1
        self.total += len(ids) // 4
        bisect.insort(self.waiting, (len(ids) // 4, self.serial, key, start, ids, n))

    def _emit(self, tier: int, pieces: list[tuple]) -> None:
        tokens = self.filled.get(tier, 0)
        self.filled[tier] = tokens + tier
        sequence, at = self.base + self.made, 0
        self.made += 1
        for key, start, ids, n in pieces:
            self.out.append((key, start, ids, n, sequence, at, tier, tokens // STEP))
            at += len(ids) // 4

    def _window(self, tier: int) -> None:
        """One full window of a tier from the waiting pieces, whose tokens must suffice."""
        gap, pieces = tier, []
        while gap:
            i = bisect.bisect_right(self.waiting, gap, key=lambda x: x[0]) - 1
            size, _, key, start, ids, n = self.waiting.pop(max(i, 0))
            self.total -= size
            if size > gap:  # only the start of the shortest one fits
                self._wait(key, start + gap, ids[4 * gap :], n)
                size, ids = gap, ids[: 4 * gap]
            pieces.append((key, start, ids, n))
            gap -= size
        self._emit(tier, pieces)

    def _pack(self, leave: int) -> None:
        while len(self.waiting) > leave:
            longest = self.waiting[-1][0]
            tier = next(t for t in TIERS if longest <= t)
            if self.total < tier:
                break
            self._window(tier)

    def close(self) -> None:
        self._pack(0)
        left, size = self.total, WINDOW
        while left:
            if left >= size:
                self._window(size)
                left -= size
            else:
                size //= 2


def pack(df: DataFrame, path: str, end_id: int = 2, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group[, ids]."""
    kept = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    end = struct.pack("<I", end_id)
    kind = kept.schema["_key"].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids
    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        w, p, types = words_of(path), Packer(task << 32), None

        def rows() -> pa.RecordBatch:
            got, p.out = p.out, []
            cols = list(zip(*got, strict=True)) if got else [()] * 8
            made = [pa.array(cols[0], types), pa.array(cols[1], pa.int64()), pa.array([len(x) // 4 for x in cols[2]], pa.int64()), pa.array([zlib.crc32(x) for x in cols[2]], pa.int64()), *(pa.array(cols[i], pa.int64()) for i in (3, 4, 5)), pa.array(cols[6], pa.int32()), pa.array([(task << 32) + x for x in cols[7]], pa.int64())]
            if with_ids:
                made.append(pa.array([np.frombuffer(x, "<i4") for x in cols[2]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(made, names)

        for batch in batches:
            keys, types = batch.column(0), batch.column(0).type
            for i, ids in enumerate(w.encode(text_bytes(batch.column(1)))):
                p.add(keys[i].as_py(), ids + end)
            yield rows()
        if types is not None:
            p.close()
            yield rows()

    return mapped(kept, run, schema, remembers=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
