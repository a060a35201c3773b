"""Embedding near-deduplication: all vectors compared with each other, or where a caller asks for it, by projection passes.

1. Equal vectors are one class, represented by its smallest id; only representatives are compared.
2. All representatives of one length are compared with each other, as pairs of blocks: no pair within the limit is lost, at
   any size and however the vectors lie. 32-bit products tell all pairs but those whose product is as near to the limit as
   these products may err; these are told by 64-bit ones. Of the pairs of a unit goes out a spanning forest.
3. The links are united: connected components. Within each component all pairs are compared once more, in the same way,
   and links are counted there.

The work grows with the square of the number of distinct vectors, and a vector travels ``SHARES`` times, or once for every
``COMPONENTS`` numbers there are where that is more. Callers who would rather lose some links than wait give ``window``:

* In each pass a vector's code is the signs of its products with random directions, and all vectors of one code (a
  bucket) are compared with each other. Two vectors at the limit share a bucket in one of the passes with probability
  ``RECALL``, however full the buckets are. Large buckets are dealt to tasks as pairs of blocks (see dealing.large_groups).
* How many signs a code has follows from the number of vectors and the measured fill: from up to ``SAMPLE`` vectors the share
  of pairs that agree in the first k signs is counted, and the k with the least work is taken (more signs: fewer pairs, more
  passes). Where vectors crowd so much that no code parts them, or are few, k is 0, which compares all with all. So which
  links are lost depends on the size of the table; the query never gives ``window``.

Vectors travel as 32-bit numbers where these hold them exactly, else as 64-bit ones.
Within a component each vector meets each other one, so for a component of k vectors the work grows with k squared, and
a vector travels k / ``BLOCK`` times. No projection prunes that: in many dimensions vectors of one component lie too near
together for the bound (0.45 along any direction, at 0.9) to part them.

Defined results: vectors that are null, zero, or hold null, NaN or infinite components, link with nothing and are their own
component; vectors of different lengths don't link. Rows without an id are kept where no vector equals theirs.
Repeated rows are vectors that link with each other. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Tables, tidy
from quarry.llm.dealing import LEAST, SHARES, dealt, large_groups
from quarry.llm.graph import components
from quarry.llm.simhash import forest

LIMIT, WINDOW, HASHES, RECALL, BLOCK, SEED = 0.9, 64, 48, 0.98, 2048, 23
#: Numbers in a block of whole vectors, and rows and columns of products held at a time.
COMPONENTS, ROWS, COLUMNS = 1 << 22, 256, 2048
#: Vectors that the fill of the codes is measured with, and drawings of the directions for it.
SAMPLE, DRAWINGS = 4096, 4
#: Seconds for a row in a pass, for a pair, and for each component of a pair: only their proportions matter.
ROW_COST, PAIR_COST, COMPONENT_COST = 12e-6, 2e-9, 2e-10


def passes(bits: int, limit: float = LIMIT, recall: float = RECALL) -> int:
    """So many that a pair at the limit has one code of so many bits in one pass at least with probability recall."""
    together = (1 - math.acos(limit) / math.pi) ** bits
    return 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def fill(sample: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The share of the sample's pairs whose codes agree in the first 0, 1, ... signs."""
    n, d = sample.shape
    share = np.zeros(hashes + 1)
    for k in range(DRAWINGS):
        signs = sample @ np.random.default_rng((SEED, d, k, 1)).standard_normal((d, hashes)) > 0
        code = np.zeros(n, np.int64)
        for bits in range(hashes + 1):
            if bits:
                code = code * 2 + signs[:, bits - 1]
            sizes = np.unique(code, return_counts=True)[1].astype(float)
            share[bits] += (sizes * (sizes - 1)).sum() / max(1, n * (n - 1)) / DRAWINGS
    return share


def bits_for(vectors: int, sample: np.ndarray, limit: float = LIMIT, window: int = WINDOW) -> int:
    """The length of code with the least work; none longer than leaves a vector ``window`` others to be compared with."""
    best, least = 0, math.inf
    for bits, share in enumerate(fill(sample)):
        cost = passes(bits, limit) * vectors * (ROW_COST * (bits > 0) + share * vectors / 2 * (PAIR_COST + COMPONENT_COST * sample.shape[1]))
        if cost < least:
            best, least = bits, cost
        if share * vectors <= window:
            break
    return best


def packed(x: np.ndarray) -> bytes:
    """The vector's bytes, after a letter for their kind."""
    narrow = x.astype(np.float32) if np.abs(x).max() < 3e38 else x
    return b"f" + narrow.tobytes() if (narrow == x).all() and narrow.dtype == np.float32 else b"d" + x.tobytes()


def unpacked(raws: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(r, np.float32 if r[:1] == b"f" else np.float64, offset=1) for r in raws], np.float64)


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, hash and raw bytes (both null for vectors that can't link) of vectors (vec_id, embedding as array<double>)."""
    schema = pa.schema([("vec_id", pa.int64()), ("hash", pa.binary()), ("dims", pa.int32()), ("raw", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for v in b.column(1):
                x = None
                if v.is_valid and not v.values.null_count and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if not np.isfinite(x).all() or not np.isfinite(n := np.linalg.norm(x)) or n == 0:
                        x = None
                raw = None if x is None else packed(x)
                rows.append((raw and hashlib.md5(raw, usedforsecurity=False).digest(), 0 if x is None else len(x), raw))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return vectors.mapInArrow(tidy(work), "vec_id bigint, hash binary, dims int, raw binary")


def coded(classes: DataFrame, bits: dict[int, int], limit: float = LIMIT, raw: bool = True) -> DataFrame:
    """(bucket, rep, raw) for each class and pass; bits: the length of the codes for each number of dimensions."""
    fields = [("bucket", pa.binary()), ("rep", pa.int64()), ("raw", pa.binary())][: 3 if raw else 2]
    schema = pa.schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            raws = b.column(2).to_pylist()
            lengths = np.array(b.column(1).to_pylist(), np.int64)
            for d in np.unique(lengths).tolist():
                size = bits[d]
                if d not in planes:
                    planes[d] = np.random.default_rng((SEED, d)).standard_normal((passes(size, limit), d, size))
                weight = np.int64(1) << np.arange(size, dtype=np.int64)
                at = np.flatnonzero(lengths == d)
                x = unpacked([raws[i] for i in at])
                own = [c.take(pa.array(at)) for c in ([b.column(0), b.column(2)] if raw else [b.column(0)])]
                for p, plane in enumerate(planes[d]):
                    code = (x @ plane > 0) @ weight if size else np.zeros(len(at), np.int64)
                    names = np.column_stack([np.full(len(at), d << 32 | p, np.int64), code])
                    yield pa.RecordBatch.from_arrays([pa.array([n.tobytes() for n in names], pa.binary()), *own], schema=schema)

    return classes.select("rep", "dims", "raw").mapInArrow(tidy(work), "bucket binary, rep bigint" + ", raw binary" * raw)


def near_pairs(x: np.ndarray, side: np.ndarray, same: bool, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A unit's pairs within the limit, each once. x: vectors of length 1, whose 32-bit products err by less than slack."""
    slack = (x.shape[1] + 8) * 2.0**-22
    own, other = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side != 0))
    left = x[own].astype(np.float32)
    right = left if same else x[other].astype(np.float32)
    step = max(1, (1 << 20) // x.shape[1])
    for s in range(0, len(own), ROWS):
        for t in range(s if same else 0, len(other), COLUMNS):
            product = left[s : s + ROWS] @ right[t : t + COLUMNS].T
            at = np.flatnonzero(product > limit - slack)
            a, b = own[at // product.shape[1] + s], other[at % product.shape[1] + t]
            within = product.ravel()[at] >= limit + slack
            if same:
                within &= b > a
                unsure = np.flatnonzero(~within & (b > a))
            else:
                unsure = np.flatnonzero(~within)
            for u in np.split(unsure, range(step, len(unsure), step)):
                within[u] = np.einsum("ij,ij->i", x[a[u]], x[b[u]]) >= limit
            if within.any():
                yield a[within], b[within]


def unit_links(rep: np.ndarray, side: np.ndarray, same: bool, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a unit's pairs within the limit."""
    n = len(rep)
    label = np.arange(n)
    held: list[tuple] = []
    many = 0
    for a, b in near_pairs(x, side, same, limit):
        held.append((a, b))
        many += len(a)
        if many > 1 << 20:
            label, held, many = forest(n, *map(np.concatenate, zip(*held, strict=True)), label), [], 0
    if held:
        label = forest(n, *map(np.concatenate, zip(*held, strict=True)), label)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, rep)
    root = least[label]
    out = root != rep
    return rep[out], root[out]


def searched(rows: DataFrame, key: str, large: DataFrame, many: int, limit: float) -> DataFrame:
    """Links found among all members of each group of rows (key, rep, raw); large groups by blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def done():
            side, same, rep, raw = zip(*held, strict=True)
            a, b = unit_links(np.array(rep, np.int64), np.array(side), same[0], units(unpacked(raw)), limit)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            for c, u, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (c, u):
                    if len(held) > 1:
                        yield done()
                    held, now = [], (c, u)
                held.append(tuple(row))
        if len(held) > 1:
            yield done()

    ordered = dealt(rows, key, large, many).repartition("unit").sortWithinPartitions(key, "unit")
    return ordered.select(key, "unit", "side", "same", "rep", "raw").mapInArrow(tidy(work), "a bigint, b bigint")


def whole_search(tables: Tables, known: DataFrame, limit: float = LIMIT, numbers: int = COMPONENTS) -> DataFrame:
    """Links found among all vectors of one length, whatever their number: it sets only how many blocks they are dealt as."""
    k, most = F.col("k"), F.greatest(F.lit(1), F.floor(F.lit(numbers) / F.col("dims")))
    blocks = F.greatest(F.ceil(k / most), F.least(F.lit(SHARES), F.ceil(k / LEAST))).cast("int")
    counts = known.groupBy("dims").agg(F.count(F.lit(1)).alias("k"))
    large = tables.keep(counts.select("dims", blocks.alias("blocks")).where("blocks > 1"), "large-lengths")
    return searched(known.select("dims", "rep", "raw"), "dims", large, large.count(), limit)


def bucket_search(tables: Tables, known: DataFrame, bits: dict[int, int], limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """Links found among all members of each bucket in each pass."""
    large, many = large_groups(tables, coded(known, bits, limit, False), "bucket", block, "large-buckets")
    return searched(coded(known, bits, limit), "bucket", large, many, limit)


def measured_bits(known: DataFrame, limit: float = LIMIT, window: int = WINDOW) -> dict[int, int]:
    """The length of the codes for each number of dimensions there is."""
    out = {}
    for dims, n in known.groupBy("dims").count().collect():
        sample = known.where(F.col("dims") == dims).orderBy("hash").limit(SAMPLE).select("raw").collect()
        out[dims] = bits_for(n, units(unpacked([bytes(r["raw"]) for r in sample])), limit, window)
    return out


def counted(tables: Tables, members: DataFrame, limit: float, block: int) -> DataFrame:
    """(rep, n): how many vectors the representative's links within its component reach. members: component, rep, size, raw."""
    large, many = large_groups(tables, members, "component", block, "large")
    rows = dealt(members.select("component", "rep", "size", "raw"), "component", large, many)
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64())])

    def one(rep: np.ndarray, side: np.ndarray, same: bool, size: np.ndarray, raw: list) -> pa.RecordBatch:
        n = np.zeros(len(rep), np.int64)
        for a, b in near_pairs(units(unpacked(raw)), side, same, limit):
            np.add.at(n, a, size[b])
            np.add.at(n, b, size[a])
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def done():
            rep, side, same, size, raw = zip(*held, strict=True)
            return one(np.array(rep, np.int64), np.array(side), same[0], np.array(size, np.int64), raw)

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for c, u, side, same, rep, size, raw in zip(*columns, strict=True):
                if now != (c, u):
                    if held:
                        yield done()
                    held, now = [], (c, u)
                held.append((rep, side, same, size, raw))
        if held:
            yield done()

    ordered = rows.repartition("unit").sortWithinPartitions("component", "unit")
    return ordered.select("component", "unit", "side", "same", "rep", "size", "raw").mapInArrow(tidy(work), "rep bigint, n bigint").groupBy("rep").agg(F.sum("n").alias("n"))


def near_groups(vectors: DataFrame, limit: float = LIMIT, window: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for vectors (vec_id, embedding).

    Without window every link is found, at any size. With it links are searched in passes, by codes none longer than leaves
    a vector that many others to be compared with, and a link is found with probability ``RECALL`` or more.
    """
    tables = Tables(vectors.sparkSession, "embeddings")
    rows = tables.keep(prepared(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))), "vectors")
    valid = rows.where("hash is not null")
    classes = tables.keep(valid.groupBy("hash").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("dims").alias("dims"), F.first("raw").alias("raw")), "classes")
    known = classes.where("rep is not null")
    found = whole_search(tables, known, limit) if window is None else bucket_search(tables, known, measured_bits(known, limit, window), limit, block)
    joined = tables.keep(components(tables, found), "components")
    members = tables.keep(joined.join(known, joined["node"] == known["rep"]).select("component", "rep", "size", "raw"), "members")
    links = counted(tables, members, limit, block)
    told = (
        classes.select("hash", "rep", "size")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .select("hash", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = valid.join(told, "hash").select("vec_id", "n_links", "component_id")
    alone = rows.where("hash is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
