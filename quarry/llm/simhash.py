"""SimHash near-deduplication through a Gray-order hierarchical index.

* Fingerprints: a text's words (A-Z lower-cased), shingles of ``shingle`` words with repeats, XXH64 (seed 42) of each;
  a bit is set if it is set in over half of the hashes. Further lanes of 64 bits come from mixing the same hashes.
* Equal fingerprints are one class, represented by its smallest id: copies are gathered before anything else.
* Upper nodes of the index are masked bit patterns that fingerprints share. With ``exact_masks`` the bits are parted
  into bands, and a mask leaves out as many bands as bits may differ: two fingerprints that near always share a
  node, so no link is lost, and a node has at most two to the power of the bits left out members.
* In a node, members are sorted by Gray rank. Groups of ``FANOUT`` neighbours have a pattern: the bits they agree on,
  and their values; groups of groups likewise. Two groups are compared only if the differences accumulated in the bits
  that both agree on are within the distance.
* Of the links in a node goes out a spanning forest (at most one link for each member), never all pairs. Nodes with
  over ``block`` members are dealt to tasks as pairs of blocks.
* Connected components of the links, over written tables, give the groups.

Defined results: null text is empty; texts without words have fingerprint zero, linked like any other; fewer words than
a shingle has are one shingle. Rows without an id belong to no group, unless they share a fingerprint with a row that
has one. Repeated rows share their group. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh, Tables, tidy
from quarry.llm.graph import components

FANOUT, SMALL = 16, 32
#: Members of a node that one task compares with each other at most (times two).
BLOCK = 16_384
_ONES = np.uint64(0x0101010101010101)


def hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, max(1, len(words) - shingle + 1))


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Other 64 bits for the same shingles; lane 0 is the hashes themselves."""
    if not lane:
        return h
    x = h + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The number whose bits are those set in over half of h."""
    n = len(h)
    if n < 1500:
        count = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        rows = np.zeros(-(-n // 255) * 255, np.uint64)
        rows[:n] = h
        count = np.empty(64, np.int64)
        for k in range(8):  # eight bits are counted at once, in the bytes of a number
            sums = ((rows >> np.uint64(k)) & _ONES).reshape(-1, 255).sum(1, dtype=np.uint64)
            count[k::8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def lanes_of(text: str | None, shingle: int, lanes: int) -> list[int]:
    h = hashes(text, shingle)
    return [majority(mixed(h, k)) if len(h) else 0 for k in range(lanes)]


def names(lanes: int) -> list[str]:
    return [f"f{k}" for k in range(lanes)]


def fingerprints(docs: DataFrame, shingle: int, lanes: int = 1) -> DataFrame:
    """doc_id and f0, f1, ... (64 bits each, as signed numbers) of docs (columns doc_id and text)."""
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names(lanes))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([lanes_of(t.as_py(), shingle, lanes) for t in b.column(1)], np.uint64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, k].view(np.int64) if lanes == 1 else found[:, k].copy().view(np.int64)) for k in range(lanes))], schema=schema)

    return docs.mapInArrow(tidy(work), ", ".join(["doc_id bigint", *(f"{n} bigint" for n in names(lanes))]))


def exact_masks(bits: int, distance: int, bands: int = 8) -> list[int]:
    """Masks that leave out ``distance`` of the bands: fingerprints that differ in so many bits agree under one of them."""
    width = bits // bands
    full = (1 << bits) - 1
    return [full & ~sum(((1 << width) - 1) << (width * k) for k in out) for out in combinations(range(bands), distance)]


def gray_rank(f: np.ndarray) -> np.ndarray:
    """The place of each 64-bit number in the order of Gray codes."""
    out = f.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def near_pairs(f: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of f (n x lanes, sorted by Gray rank) that differ in at most ``distance`` bits, by the hierarchy."""
    n, lanes = f.shape
    levels = []  # from the leaves up: the bits that all members of a group agree on, and their values
    both, any_ = f, f
    while True:
        short = -len(both) % FANOUT
        if short:
            both = np.concatenate([both, np.repeat(both[-1:], short, 0)])
            any_ = np.concatenate([any_, np.repeat(any_[-1:], short, 0)])
        both = np.bitwise_and.reduce(both.reshape(-1, FANOUT, lanes), axis=1)
        any_ = np.bitwise_or.reduce(any_.reshape(-1, FANOUT, lanes), axis=1)
        levels.append((~(both ^ any_), both))
        if len(both) <= FANOUT:
            break
    top = len(levels[-1][0])
    a, b = np.triu_indices(top)
    stack = [(len(levels) - 1, a, b)]
    child = np.arange(FANOUT)
    while stack:
        level, a, b = stack.pop()
        if len(a) > 4096:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        same, value = levels[level]
        apart = np.bitwise_count((value[a] ^ value[b]) & same[a] & same[b]).sum(1, dtype=np.int64)
        a, b = a[apart <= distance], b[apart <= distance]
        if not len(a):
            continue
        x = np.repeat((a[:, None] * FANOUT + child)[:, :, None], FANOUT, 2).ravel()
        y = np.repeat((b[:, None] * FANOUT + child)[:, None, :], FANOUT, 1).ravel()
        end = n if level == 0 else len(levels[level - 1][0])
        fit = (x < end) & (y < end) & ((x < y) if level == 0 else (x <= y))
        x, y = x[fit], y[fit]
        if level:
            stack.append((level - 1, x, y))
        else:
            near = np.bitwise_count(f[x] ^ f[y]).sum(1, dtype=np.int64) <= distance
            yield x[near], y[near]


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n members the smallest member that the pairs connect it with."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, light ones first, that connect what all the pairs connect (fewer than two for each member), and the new labels."""
    order = np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    first, second = [], []
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            break
        best = np.full(len(label), len(a))
        place = np.arange(len(a))
        np.minimum.at(best, la, place)
        np.minimum.at(best, lb, place)
        took = np.unique(best[best < len(a)])
        first.append(a[took])
        second.append(b[took])
        label = forest(len(label), a[took], b[took], label)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second]), label


def links_of_nodes(node: np.ndarray, rep: np.ndarray, f: np.ndarray, distance: int, fits: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (pairs of representatives that are near) of rows sorted by node and Gray rank; whole nodes only.

    fits: what two rows (arrays of their places) must fulfil besides.
    """
    n = len(node)
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    sizes = np.diff(np.append(starts, n))
    label = np.arange(n)
    small = np.repeat(sizes <= SMALL, sizes)
    none = np.zeros(0, np.int64)
    first, second, weight = [none], [none], [none]
    for lag in range(1, int(min(SMALL, sizes.max(initial=1)))):
        i = np.flatnonzero((node[lag:] == node[:-lag]) & small[lag:])
        if not len(i):
            break
        apart = np.bitwise_count(f[i] ^ f[i + lag]).sum(1, dtype=np.int64)
        near = apart <= distance
        if fits:
            near &= fits(i, i + lag)
        first.append(i[near])
        second.append(i[near] + lag)
        weight.append(apart[near])
    x, y, label = spanning(label, np.concatenate(first), np.concatenate(second), np.concatenate(weight))
    first, second = [x], [y]
    for s, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = np.arange(size)
        for x, y in near_pairs(f[s : s + size], distance):
            if fits:
                fit = fits(x + s, y + s)
                x, y = x[fit], y[fit]
            apart = np.bitwise_count(f[x + s] ^ f[y + s]).sum(1, dtype=np.int64)
            x, y, own = spanning(own, x, y, apart)
            first.append(x + s)
            second.append(y + s)
    a, b = rep[np.concatenate(first)], rep[np.concatenate(second)]
    return a, b


def _bit_columns(mask: int, lanes: int) -> list[int]:
    """The mask's 64 bits for each lane, as signed numbers."""
    parts = [mask >> (64 * k) & (2**64 - 1) for k in range(lanes)]
    return [p - 2**64 if p >= 2**63 else p for p in parts]


def node_rows(classes: DataFrame, masks: list[int], lanes: int) -> DataFrame:
    """A row (node, rep, gray, f...) for each class and mask."""
    fs = names(lanes)
    keys = [F.xxhash64(F.lit(j), *(F.col(c).bitwiseAND(F.lit(m).cast("bigint")) for c, m in zip(fs, _bit_columns(mask, lanes), strict=True))) for j, mask in enumerate(masks)]
    step = classes
    gray = "gray"
    column = F.col("f0")
    for k in (1, 2, 4, 8, 16, 32):  # a step at a time: nested in one expression it would double six times
        step = step.withColumn(gray, column.bitwiseXOR(F.shiftrightunsigned(column, k)))
        column = F.col(gray)
    return step.select(F.explode(F.array(*keys)).alias("node"), "rep", gray, *fs)


def split_nodes(tables: Tables, rows: DataFrame, block: int) -> DataFrame:
    """Nodes with over ``block`` members become pairs of blocks, each a node of its own."""
    sizes = tables.keep(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("node", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-nodes")
    many = sizes.count()
    if not many:
        return rows
    sizes = F.broadcast(sizes) if many <= 10_000 else sizes
    whole = rows.join(sizes, "node", "left")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64(F.col("node"), F.least(own, j.cast("bigint")), F.greatest(own, j.cast("bigint"))))
    return whole.select(F.explode(F.when(F.col("blocks").isNull(), F.array("node")).otherwise(pairs)).alias("node"), *[c for c in rows.columns if c != "node"])


def search(rows: DataFrame, lanes: int, distance: int, links: Callable = links_of_nodes, more: tuple[str, ...] = ()) -> DataFrame:
    """Spanning links (a, b) between the representatives in each node. links gets the columns named in more as well."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(table: np.ndarray) -> pa.RecordBatch:
            a, b = links(table[:, 0], table[:, 1], table[:, 2 : 2 + lanes].view(np.uint64), distance, *table[:, 2 + lanes :].T)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        size = 0
        for batch in batches:
            held.append(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2 + lanes + len(more))]))
            size += len(held[-1])
            if size < 50_000:
                continue
            table = np.concatenate(held)
            end = int(np.searchsorted(table[:, 0], table[-1, 0]))  # the last node may go on
            if end:
                yield found(table[:end])
            held = [table[end:]]
            size = len(held[0])
        if size:
            yield found(np.concatenate(held))

    fs = names(lanes)
    ordered = rows.repartition("node").sortWithinPartitions("node", "gray", *fs)
    return ordered.select("node", "rep", *fs, *more).mapInArrow(tidy(work), "a bigint, b bigint")


def groups(docs: DataFrame, shingle: int = 5, lanes: int = 1, distance: int = 2) -> DataFrame:
    """doc_id, the fingerprint (f0, f1, ...) and component_id of each row of docs (columns doc_id and text)."""
    tables = Tables(docs.sparkSession, "simhash")
    fs = names(lanes)
    prints = tables.keep(fingerprints(docs, shingle, lanes), "fingerprints")
    classes = tables.keep(prints.groupBy(*fs).agg(F.min("doc_id").alias("rep")), "classes")
    known = classes.where("rep is not null")
    links = search(node_rows(known.select("rep", *fs), exact_masks(64 * lanes, distance), lanes), lanes, distance)
    joined = components(tables, links)
    named = classes.join(joined, classes["rep"] == joined["node"], "left").select(*fs, F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, fs)


def hex_fingerprint(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies (that of the smallest id; rows without an id stay), with the columns of docs.

    Near are texts whose sets of shingles have a Jaccard similarity of at least 0.8, exactly: see jaccard.groups.
    """
    from quarry.llm import jaccard  # which needs hashes() from here

    narrow = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    (name,) = fresh(docs, "gone")
    found = jaccard.groups(narrow, shingle, similarity)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{key}`") == F.col(name), "left_anti")
