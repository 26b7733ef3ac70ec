"""Packing: documents in the order of a space-filling curve, cut into sequences of one length.

A document's vector counts its hashed token ids. Fixed random directions project it to a few dimensions, and the
place along a Hilbert curve through them is its key. Rows are range-partitioned and sorted by ``(key, id)``, so
neighbours on the curve are packed next to each other, and a key that many copies share still spreads. The number of
ranges follows from the bytes that were written, and long documents, which lie close together on the curve, come in
chunks of ``CHUNK`` ids, so that ranges of rows are ranges of bytes, too. Each partition
fills sequences one after the other and cuts documents where a sequence is full. Only the last sequence of a partition
can stay short: it is split into sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is the closing id alone; null ids and repeated rows are packed like any other;
an empty table gives no rows. Other columns are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import ranges_of
from lodestar.llm.tokens import text_ids
from lodestar.session import written

LENGTH, CHUNK = 4096, 1024
CLOSING_ID = 2

#: Hashed counts, dimensions of the curve, bits of each. They choose the order only.
BUCKETS, DIMENSIONS, DEPTH = 256, 4, 12

#: Bytes of text turned into ids at once, but for a longer text.
TEXT_BYTES = 1 << 24

#: Bytes of stored ids in one range of the curve.
RANGE_BYTES = 1 << 24

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


#: A document's ids in chunks that all have its place on the curve, and the checksum and number of all of its ids.
CHUNKS = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)


def hilbert_keys(points: np.ndarray, depth: int) -> np.ndarray:
    """Place of each grid point (rows of unsigned coordinates below 2**depth) along the Hilbert curve.

    Walks down the bits: at every level the cell's quadrant, seen in the turned frame, is its Gray code rank.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(depth - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            inside = (x[i] >> level) & 1
            swapped = np.where(inside == 1, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside == 1, low, swapped)
            x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(depth - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


@lru_cache(maxsize=2)
def _directions(seed: int = 7) -> np.ndarray:
    """Random directions at right angles to the mean, so that what all documents share does not count."""
    found = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))
    return found - found.mean(axis=0)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each list of token ids."""
    vectors = np.zeros((len(ids), BUCKETS))
    for row, own in zip(vectors, ids, strict=True):
        row[:] = np.sqrt(np.bincount((own.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    scaled = (vectors @ _directions() / 6 + 0.5) * (1 << DEPTH)
    return hilbert_keys(np.clip(scaled, 0, (1 << DEPTH) - 1).astype(np.int64), DEPTH)


def _tokenized(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    reader = text_ids(path)
    closing = np.array([CLOSING_ID], reader.dtype)
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // TEXT_BYTES
        for at, end in pairwise([0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]):
            part = batch.slice(at, end - at)
            ids = [np.concatenate((own, closing)) for own in reader.of(part.column(1))]
            keys = curve_keys(ids).tolist()
            rows = []
            for doc, key, own in zip(part.column(0).to_pylist(), keys, ids, strict=True):
                mark = zlib.crc32(own.tobytes())
                rows += [(doc, key, mark, start, len(own), own[start : start + CHUNK].tobytes()) for start in range(0, len(own), CHUNK)]
            if rows:
                yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=CHUNKS)


class _Filler:
    """Fills sequences with what is added to it and keeps the rows of the pieces."""

    def __init__(self, first_sequence: int):
        self.sequence, self.rows, self.open = first_sequence, [], []
        self.ahead: tuple | None = None
        self.used = 0

    def _close(self, pieces: list[tuple], length: int) -> list[tuple]:
        """Put the first ``length`` tokens of the pieces into one sequence; what is left comes back."""
        at, left = 0, list(pieces)
        while at < length:
            doc, start, ids, total = left.pop(0)
            take = min(len(ids), length - at)
            crc = zlib.crc32(ids[:take].astype("<u4").tobytes())
            self.rows.append((doc, start, take, crc, total, self.sequence, at))
            if take < len(ids):
                left.insert(0, (doc, start + take, ids[take:], total))
            at += take
        self.sequence += 1
        return left

    def add(self, doc: int | None, mark: int, start: int, total: int, ids: np.ndarray) -> None:
        """Add a chunk; what goes on where the last piece ends is one piece with it."""
        at, goes_on = 0, self.open and (doc, mark, start) == self.ahead
        self.ahead = (doc, mark, start + len(ids))
        while at < len(ids):
            take = min(len(ids) - at, LENGTH - self.used)
            own = ids[at : at + take]
            if goes_on:
                _, first, before, _ = self.open.pop()
                self.open.append((doc, first, np.concatenate((before, own)), total))
            else:
                self.open.append((doc, start + at, own, total))
            goes_on = False
            self.used += take
            at += take
            if self.used == LENGTH:
                self.open, self.used = self._close(self.open, LENGTH), 0

    def finish(self) -> None:
        """Split the last, short sequence into powers of two, the longest first."""
        while self.used:
            part = 1 << (self.used.bit_length() - 1)
            self.open, self.used = self._close(self.open, part), self.used - part

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(PIECES), schema=PIECES)


def _filled(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[pa.RecordBatch]:
    filler = _Filler(TaskContext.get().partitionId() << 40)
    for batch in batches:
        for *chunk, ids in zip(*[c.to_pylist() for c in batch.columns[:-1]], batch.columns[-1], strict=True):
            filler.add(*chunk, np.frombuffer(ids.as_buffer(), dtype))
        yield filler.taken()
    filler.finish()
    yield filler.taken()


def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all documents. ``tokenizer``
    is the path of a tokenizer file that the executors can read."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, key long, mark long, start long, doc_tokens long, ids binary"
    # Written before it is sorted: range partitioning reads its input twice.
    tokens = written(rows.mapInArrow(lambda batches: _tokenized(batches, tokenizer), schema), "tokens")
    order = ["key", "doc_id", "mark", "start"]
    sorted_rows = tokens.repartitionByRange(ranges_of(tokens, RANGE_BYTES), *order).sortWithinPartitions(*order).select("doc_id", "mark", "start", "doc_tokens", "ids")
    dtype = text_ids(tokenizer).dtype
    return sorted_rows.mapInArrow(lambda batches: _filled(batches, dtype), T.StructType([T.StructField(f.name, T.LongType()) for f in PIECES]))
