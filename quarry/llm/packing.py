"""Packing documents into sequences along a space-filling curve.

1. Each text is encoded once. Its ids, hashed with signs into a vector of ``WIDTH`` numbers of length one, are projected
   to ``DIMS`` dimensions by a fixed random matrix; the point's place on a Hilbert curve is the document's key. Ids and
   keys are written to the shared folder, so that neither the sampling for the ranges nor a lost executor repeats
   the encoding.
2. The table is range-partitioned and sorted by (key, id): neighbours in a partition are neighbours on the curve. Equal
   keys (copies) are parted by id, so a hot group of them is spread over ranges.
3. Each partition is one stream of ids that is cut every ``LENGTH`` ids. What is left at its end is cut into pieces of
   the powers of two that sum up to it; such sequences need no padding. Only the pieces of one open sequence are held.

A sequence's id holds the partition in its upper bits, so ids are unique without any exchange.

Defined results: null and empty texts are one end-of-text id. Rows without an id are packed like others. Repeated rows
are separate documents. Empty table: no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import Vocabulary, default_path, encoder, runs
from quarry.llm.common import Tables, tidy

LENGTH, END = 4096, 2
#: About so many bytes of written ids go into a range, where the session's number of shuffle partitions would make them larger.
RANGE_BYTES = 64 << 20
WIDTH, DIMS, BITS, SEED = 256, 3, 16, 7


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each point (rows of coordinates below 2**bits), by transposing Gray codes."""
    x = points.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        flip = np.where((x[-1] & q) != 0, flip ^ (q - one), flip)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(level)) & one)
    return out.astype(np.int64)


class Curve:
    """Places on the curve for texts' ids."""

    def __init__(self, vocabulary: int):
        rng = np.random.default_rng(SEED)
        self.bucket = rng.integers(0, WIDTH, vocabulary)
        self.sign = rng.choice([-1.0, 1.0], vocabulary)
        self.matrix = rng.standard_normal((WIDTH, DIMS))

    def vector(self, ids: np.ndarray) -> np.ndarray:
        v = np.bincount(self.bucket[ids], weights=self.sign[ids], minlength=WIDTH)
        norm = np.linalg.norm(v)
        return v / norm if norm else v

    def keys(self, vectors: list[np.ndarray]) -> np.ndarray:
        if not vectors:
            return np.zeros(0, np.int64)
        spread = 1 / (1 + np.exp(-1.7 * (np.array(vectors) @ self.matrix)))  # about the normal distribution function
        return hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, library=True)
        width = np.dtype("<u2" if e.v.size <= 1 << 16 else "<u4")
        curve = Curve(e.v.size)
        for keys, texts in runs(batches):
            vectors, held = [], []
            for ids in e.encode(texts):
                vectors.append(curve.vector(ids))
                held.append(np.append(ids, end).astype(width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(curve.keys(vectors)), pa.array(held, pa.binary())], schema=schema)

    return docs.mapInArrow(tidy(work), "doc_id bigint, place bigint, ids binary")


def cut(docs: Iterator[tuple[int | None, bytes]], first: int, length: int = LENGTH) -> Iterator[tuple]:
    """Pieces of the documents (id, ids as 32-bit numbers) in one stream; sequences are numbered from first."""
    open_pieces: list[tuple] = []
    filled, sequence = 0, first
    for doc, raw in docs:
        total, start = len(raw) // 4, 0
        while start < total:
            n = min(total - start, length - filled)
            open_pieces.append((doc, start, raw[4 * start : 4 * (start + n)], total, filled))
            filled, start = filled + n, start + n
            if filled == length:
                for d, s, part, whole, at in open_pieces:
                    yield d, s, len(part) // 4, zlib.crc32(part), whole, sequence, at
                open_pieces, filled, sequence = [], 0, sequence + 1
    room, at = 0, 0
    rest = filled
    for d, s, part, whole, _ in open_pieces:
        while part:
            if not room:  # the next sequence: the largest power of two that is left
                room, at = 1 << (rest.bit_length() - 1), 0
                rest -= room
            n = min(room, len(part) // 4)
            yield d, s, n, zlib.crc32(part[: 4 * n]), whole, sequence, at
            part, s, at, room = part[4 * n :], s + n, at + n, room - n
            sequence += not room


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of all docs (columns doc_id and text)."""
    path = path or default_path()
    spark = docs.sparkSession
    width = np.dtype("<u2" if Vocabulary(path).size <= 1 << 16 else "<u4")
    tables = Tables(spark, "packing")
    held = tables.keep(encoded(docs, path), "ids")
    ranges = -(-tables.size("ids") // RANGE_BYTES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40

        def rows():
            for b in batches:
                for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield doc, np.frombuffer(raw.as_buffer(), width).astype("<u4").tobytes()

        out: list[tuple] = []
        for piece in cut(rows(), first, length):
            out.append(piece)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=PIECE)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=PIECE)

    order = (F.col("place"), F.col("doc_id"))
    few = ranges <= int(spark.conf.get("spark.sql.shuffle.partitions"))  # then Spark joins small ranges
    ranged = (held.repartitionByRange(*order) if few else held.repartitionByRange(ranges, *order)).sortWithinPartitions("place", "doc_id")
    return ranged.select("doc_id", "ids").mapInArrow(tidy(work), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
