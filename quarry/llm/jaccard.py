"""Near copies by the exact Jaccard similarity of texts' shingle sets; SimHash's Gray-order index finds the candidates.

* A text's set: the distinct XXH64 values of its shingles (see simhash.hashes). Equal sets are one node, with a
  fingerprint of ``LANES`` times 64 bits.
* Fingerprints alone can't promise to lose no link at a similarity of 0.8 (some 39 of 256 bits differ), so the index's
  upper nodes are not masked bits here but shared shingles: two sets of similarity s have one in common among the first
  n - ceil(s n) + 1 elements of each, in any order that is the same for all sets. The order is by hash, with elements
  last that are in over ``hot_over`` prefixes (in a line that many texts have, say): it decides the work, never the
  result. Elements with the same members are one node of the index; nodes of many members are dealt as pairs of blocks.
* Within a node, members are sorted by Gray rank, and the hierarchy prunes groups whose accumulated differences exceed
  ``DISTANCE`` (as far from the mean at 0.8 as six standard deviations: about one link in a billion is lost there).
  Sets of at most ``REPEATS`` elements have too coarse fingerprints for that and go by size alone.
* Connected candidates are a family. Its sets are brought together (by blocks) and its pairs within the distance tested
  exactly, nearest first, but for those that are connected by then.
* Texts that repeat themselves have few distinct shingles, of which one word changes a large share. So pairs also count
  whose sets differ in no more elements than one word has shingles, if their similarity with repeats is high enough.

Defined results: null text is empty; texts without words are copies of each other. Rows without an id are in no group.
Repeated rows share their group. Empty table: empty result.
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
from quarry.llm.dealing import dealt, large_groups
from quarry.llm.graph import components
from quarry.llm.simhash import BLOCK, gray_rank, hashes, links_of_nodes, majority, mixed, names, search, spanning, split_nodes

#: Sets up to this size carry their elements' repeats.
REPEATS = 64
#: Fingerprints, and the bits in which those of a link may differ.
LANES, DISTANCE = 4, 72
#: At most so many elements are put last.
MOST_HOT = 2_000_000
#: Prefix elements of texts that are counted together, and the count from which one is told.
RUN, TOLD = 1_000_000, 3
#: Elements of a family's block up to which they are numbered anew: faster, at three numbers for each.
NUMBERED = 4_000_000


def shingle_set(text: str | None, shingle: int) -> tuple[int, np.ndarray, np.ndarray | None]:
    """The node's number, the sorted set, and how often each element occurs (small sets)."""
    values, counts = np.unique(hashes(text, shingle), return_counts=True)
    counts = counts if len(values) <= REPEATS else None
    name = hashlib.md5(values.tobytes() + (b"" if counts is None else counts.tobytes()), usedforsecurity=False).digest()
    return int.from_bytes(name[:8], "little", signed=True), values, counts


def prefix_size(n: int, similarity: float, shingle: int) -> int:
    return min(n, max(n - math.ceil(similarity * n - 1e-9) + 1, shingle + 1))


def prefix(values: np.ndarray, similarity: float, shingle: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first elements in the common order, and which of them are hot."""
    size = prefix_size(len(values), similarity, shingle)
    if not len(hot):
        return values[:size], np.zeros(size, bool)
    last = hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values
    rest = values[~last]
    return np.concatenate([rest, values[last]])[:size], np.arange(size) >= len(rest)


def fits(a: np.ndarray, b: np.ndarray, similarity: float, shingle: int) -> np.ndarray:
    """Whether sets of these sizes can be near."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    return (small >= large * similarity - 1e-9) | (large - small <= shingle)


def near(x: tuple[np.ndarray, np.ndarray | None], y: tuple[np.ndarray, np.ndarray | None], similarity: float, shingle: int) -> bool:
    """Whether two sets (with the repeats of small ones) are near."""
    (a, m), (b, n) = x, y
    both = np.intersect1d(a, b, assume_unique=True)
    union = len(a) + len(b) - len(both)
    if len(both) >= similarity * union - 1e-9:
        return True
    if m is None or n is None or union - len(both) > shingle:
        return False
    least = np.minimum(m[np.searchsorted(a, both)], n[np.searchsorted(b, both)]).sum()
    return bool(least >= similarity * (m.sum() + n.sum() - least) - 1e-9)


def prints(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Rows (doc_id, node, n, gray, f0, ...) for texts, and rows (token, times) for elements that several prefixes hold."""
    fs = names(LANES)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "node", "n", "gray", *fs, "token", "times")])

    def often(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, times = np.unique(np.concatenate(held), return_counts=True)
        token, times = token[times >= TOLD], times[times >= TOLD]
        blank = pa.nulls(len(token), pa.int64())
        yield pa.RecordBatch.from_arrays([blank] * (4 + LANES) + [pa.array(token.view(np.int64)), pa.array(times)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            made = [shingle_set(t.as_py(), shingle)[:2] for t in b.column(1)]
            f = np.array([[majority(mixed(v, k)) if len(v) else 0 for k in range(LANES)] for _, v in made], np.uint64).reshape(-1, LANES)
            columns = [np.array([m[0] for m in made], np.int64), np.array([len(m[1]) for m in made], np.int64), gray_rank(f[:, 0].copy()).view(np.int64)]
            blank = pa.nulls(len(made), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns), *(pa.array(f[:, k].copy().view(np.int64)) for k in range(LANES)), blank, blank], schema=schema)
            # twice the prefix: what is put last makes room for others
            held += [v[: 2 * prefix_size(len(v), similarity, shingle)] for _, v in made]
            size += sum(map(len, held[-len(made) :])) if made else 0
            if size >= RUN:
                yield from often(held)
                held, size = [], 0
        if held:
            yield from often(held)

    return docs.select("doc_id", "text").mapInArrow(tidy(work), ", ".join(f"{f.name} bigint" for f in schema))


def tokens(docs: DataFrame, similarity: float, shingle: int, hot: np.ndarray) -> DataFrame:
    """A row (token, node) for each element of each text's prefix; the token's lowest bit says whether it is hot."""
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(t.as_py(), shingle)[:2] for t in b.column(0)]
            firsts = [prefix(values, similarity, shingle, shared.value) for _, values in made]
            node = np.repeat(np.array([m[0] for m in made], np.int64), [len(f) for f, _ in firsts])
            token = np.concatenate([np.zeros(0, np.uint64), *(f & ~np.uint64(1) | h for f, h in firsts)])
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node)], schema=schema)

    return docs.select("text").mapInArrow(tidy(work), "token bigint, node bigint")


def index_nodes(rows: DataFrame) -> DataFrame:
    """(key, node) for the elements (token, node) of several sets. Elements with the same sets have one key.

    Hot elements are spread over tasks, as nobody needs all their sets at once: their key is the element.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def found(table: np.ndarray, going_on: int | None) -> pa.RecordBatch:
        table = table[np.concatenate([[True], (table[1:] != table[:-1]).any(1)])]  # equal texts are one node
        starts = np.flatnonzero(np.concatenate([[True], table[1:, 0] != table[:-1, 0]]))
        sizes = np.diff(np.append(starts, len(table)))
        token = table[starts, 0]
        large = (token & 1 == 1) | (token == going_on if going_on is not None else False)
        key = np.where(large, token, np.add.reduceat(mixed(table[:, 1].view(np.uint64), 1), starts).view(np.int64))
        kept = np.repeat(large | (sizes > 1), sizes)
        out = np.unique(np.column_stack([np.repeat(key, sizes), table[:, 1]])[kept], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, going_on = 0, None
        for b in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
            size += len(held[-1])
            if size < 100_000:
                continue
            table = np.concatenate(held)
            end = int(np.searchsorted(table[:, 0], table[-1, 0]))  # the last token may go on
            if end:
                yield found(table[:end], going_on)
            else:  # a token with very many sets
                going_on, end = int(table[-1, 0]), len(table)
                yield found(table, going_on)
            held, size = [table[end:].copy()], len(table) - end
        if size:
            yield found(np.concatenate(held), going_on)

    spread = F.when(F.col("token").bitwiseAND(F.lit(1)) == 1, F.xxhash64("token", "node")).otherwise(F.col("token"))
    return rows.repartition(spread).sortWithinPartitions("token", "node").mapInArrow(tidy(work), "key bigint, node bigint").distinct()


def candidates(similarity: float, shingle: int):
    """Spanning candidate links of the index's nodes, for simhash.search."""

    def links(node: np.ndarray, rep: np.ndarray, f: np.ndarray, distance: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        large = np.flatnonzero(n > REPEATS)
        of = n[large]
        a, b = links_of_nodes(node[large], rep[large], f[large], distance, lambda x, y: fits(of[x], of[y], similarity, shingle))
        small = np.flatnonzero(n <= max(REPEATS / similarity, REPEATS + shingle))  # sorted by size, neighbours that fit connect all that fit
        small = small[np.lexsort((n[small], node[small]))]
        x, y = small[:-1], small[1:]
        linked = (node[x] == node[y]) & fits(n[x], n[y], similarity, shingle)
        return np.concatenate([a, rep[x[linked]]]), np.concatenate([b, rep[y[linked]]])

    return links


class Overlap:
    """How many elements pairs of a block's sets share."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        self.start = np.cumsum(self.size) - self.size
        self.flat = None
        if self.size.sum() <= NUMBERED:
            every, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
            self.mark = np.zeros(len(every), bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        if self.flat is None:
            for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                out[k] = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
            return out
        order = np.argsort(a, kind="stable")
        bounds = np.flatnonzero(np.diff(a[order], prepend=-1, append=-1))
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            x, ys = a[order[s]], b[order[s:e]]
            own = self.flat[self.start[x] : self.start[x] + self.size[x]]
            self.mark[own] = True
            sizes = self.size[ys]
            first = np.cumsum(sizes) - sizes
            at = np.repeat(self.start[ys] - first, sizes) + np.arange(sizes.sum())
            out[order[s:e]] = np.add.reduceat(self.mark[self.flat[at]], first, dtype=np.int64)
            self.mark[own] = False
        return out


def unit_links(node: np.ndarray, side: np.ndarray, same: bool, f: np.ndarray, sets: list[np.ndarray], repeats: list[np.ndarray | None], similarity: float, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the near pairs among a family's block, or between two blocks."""
    k = len(node)
    overlap = Overlap(sets)
    n = overlap.size
    first, second, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, k, 128):
        apart = np.bitwise_count(f[s : s + 128, None] ^ f[None]).sum(2, dtype=np.int64)
        own = n[s : s + 128, None]
        ok = fits(own, n[None], similarity, shingle) & ((apart <= DISTANCE) | (np.minimum(own, n[None]) <= REPEATS))
        if not same:
            ok &= side[s : s + 128, None] != side[None]
        a, b = np.nonzero(ok)
        a, b, apart = (x[b > a + s] for x in (a + s, b, apart[a, b]))
        first.append(a)
        second.append(b)
        weight.append(apart)
    a, b, weight = np.concatenate(first), np.concatenate(second), np.concatenate(weight)
    order = np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    label = np.arange(k)
    found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    step = 4 * k
    while len(a):  # nearest first; what is connected by then needs no test
        x, y = a[:step], b[:step]
        both = overlap(x, y)
        union = n[x] + n[y] - both
        ok = both >= similarity * union - 1e-9
        for i in np.flatnonzero(~ok & (union - both <= shingle)).tolist():
            ok[i] = near((sets[x[i]], repeats[x[i]]), (sets[y[i]], repeats[y[i]]), similarity, shingle)
        x, y, label = spanning(label, x[ok], y[ok], np.zeros(int(ok.sum())))
        found.append(np.column_stack([x, y]))
        rest = label[a[step:]] != label[b[step:]]
        a, b = a[step:][rest], b[step:][rest]
    links = np.concatenate(found)
    return node[links[:, 0]], node[links[:, 1]]


def verified(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) of the units of rows (family, unit, side, same, rep, f0, ..., s, m)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    fs = names(LANES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def done():
            side, same, rep, *f, s, m = zip(*held, strict=True)
            sets = [np.frombuffer(x, np.uint64) for x in s]
            repeats = [None if x is None else np.frombuffer(x, np.int64) for x in m]
            a, b = unit_links(np.array(rep, np.int64), np.array(side), same[0], np.array(f, np.int64).T.copy().view(np.uint64), sets, repeats, similarity, shingle)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            for c, u, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (c, u):
                    if len(held) > 1:
                        yield done()
                    held, now = [], (c, u)
                held.append(tuple(row))
        if len(held) > 1:
            yield done()

    ordered = rows.repartition("unit").sortWithinPartitions("family", "unit")
    return ordered.select("family", "unit", "side", "same", "rep", *fs, "s", "m").mapInArrow(tidy(work), "a bigint, b bigint")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """rep (the node), its set s, and m, the elements' repeats, of docs (doc_id, text)."""
    schema = pa.schema([("rep", pa.int64()), ("s", pa.binary()), ("m", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([None if r[2] is None else r[2].tobytes() for r in rows], pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(work), "rep bigint, s binary, m binary")


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = 256, hot_over: int = 64) -> DataFrame:
    """doc_id and component_id (the group's smallest id) of the rows of docs (doc_id, text) that have an id."""
    tables = Tables(docs.sparkSession, "jaccard")
    fs = names(LANES)
    docs = docs.where("doc_id is not null")
    told = tables.keep(prints(docs, similarity, shingle), "prints")
    often = tables.keep(told.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") > hot_over), "often")
    total = often.agg(F.sum("times")).first()[0] or 0  # no more than MOST_HOT elements are in over total / MOST_HOT prefixes
    hot = [r["token"] for r in often.where(F.col("times") > total // MOST_HOT).select("token").toLocalIterator()]
    known = told.where("node is not null")
    nodes = tables.keep(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "gray", *fs))), "nodes")

    shared = index_nodes(tokens(docs, similarity, shingle, np.sort(np.array(hot, np.int64).view(np.uint64))))
    index = shared.join(nodes.drop("doc_id"), "node").select(F.col("key").alias("node"), F.col("node").alias("rep"), "n", "gray", *fs)
    index = split_nodes(tables, tables.keep(index, "index"), min(BLOCK, 64 * block))
    links = tables.keep(search(index, LANES, DISTANCE, candidates(similarity, shingle), ("n",)), "candidates")
    families = components(tables, links).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    members = nodes.join(families, nodes["node"] == families["rep"])
    members = tables.keep(members.select("rep", "family", "doc_id", *fs), "members")

    one = docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = tables.keep(members.select("rep", "family", *fs).join(sets_of(one, shingle).dropDuplicates(["rep"]), "rep"), "sets")
    large, many = large_groups(tables, members.select("family", "rep"), "family", block, "large-families")
    links = tables.keep(verified(dealt(sets, "family", large, many), similarity, shingle), "links")
    tables.drop("index", "candidates", "members", "sets")

    found = known.select("doc_id", "node").join(components(tables, links), "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))
    found = tables.keep(found, "found")
    return found.join(found.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "component_id")
