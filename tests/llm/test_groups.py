"""Exact copies, SimHash, embeddings, WARC: against brute force, over whole test tables, odd rows and planted cases."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import embeddings, exact, graph, jaccard, registry, simhash, warc
from quarry.llm.common import Tables, need
from tests.conftest import SMALL


def plain_components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(ready):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    links = ready.createDataFrame([*pairs, (7, 7), (None, 3), *pairs[:5]], "a bigint, b bigint")
    want = plain_components(pairs, {n for a, b in pairs if a != b for n in (a, b)})
    assert {r["node"]: r["component"] for r in graph.components(Tables(ready, "t"), links).collect()} == want
    assert graph.components(Tables(ready, "t"), links.limit(0)).count() == 0


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    keep = {k: min(v)[2] for k, v in groups.items()}
    return sorted(((i, keep[n := re.sub(r"[\x20\x09-\x0D]", "", t or "")], len(groups[n]), i == keep[n], hashlib.sha256(n.encode()).hexdigest()) for i, t in rows), key=repr)


@pytest.mark.parametrize("bits", [128, 4])
def test_op7(ready, odd, none, bits):
    """With a hash of 4 bits nearly all groups clash, and the comparison of the texts must tell them apart."""
    docs = ready.read.parquet(f"{SMALL}/documents.parquet")
    for d in (docs, odd):
        rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
        found = exact.decide(d, hash_bits=bits).select("doc_id", *exact.RESULT)
        assert sorted(map(tuple, found.collect()), key=repr) == plain_exact(rows)
    assert exact.decide(none).count() == 0
    assert exact.drop_copies(odd).columns == odd.columns


def test_op7_oracle(ready):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    mine = registry.op7_exact_dedup(ready, SMALL)
    theirs = c.sql(registry.oracle_sql()["op7_exact_dedup"])
    assert mine.columns == theirs.columns
    assert sorted(map(tuple, mine.collect())) == sorted(theirs.fetchall())
    assert "Python" not in mine._jdf.queryExecution().executedPlan().toString()


def plain_print(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    bits = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(parts))


def plain_simhash(rows):
    prints = [plain_print(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = plain_components(pairs, range(len(rows)))
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, float("inf")), rows[k][0])
    return sorted((i, f"{p:016x}", least[root[k]]) for k, ((i, _), p) in enumerate(zip(rows, prints)))


def test_op5(ready, odd, none):
    rows = [tuple(r) for r in ready.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registry.op5_simhash_near_dedup(ready, SMALL).collect())) == plain_simhash(rows)
    known = odd.where("doc_id is not null").select("doc_id", "text")
    found = simhash.groups(known, 3).select("doc_id", simhash.hex_fingerprint("f0").alias("f"), "component_id")
    assert sorted(map(tuple, found.collect())) == plain_simhash([tuple(r) for r in known.collect()])
    whole = simhash.groups(odd.select("doc_id", "text"), 3)
    assert whole.count() == odd.count()
    assert simhash.groups(none.select("doc_id", "text"), 3).count() == 0


def test_no_link_is_lost_among_planted_fingerprints(ready):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    prints = np.unique([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (0, 1, 2, 2, 3, 4)])
    hot = np.unique(np.uint64(5 << 40) | rng.integers(0, 1 << 16, 3000, dtype=np.uint64))  # one node of the index holds them all
    prints = np.concatenate([prints, hot])
    rows = ready.createDataFrame([(k, int(p.view(np.int64))) for k, p in enumerate(prints)], "rep bigint, f0 bigint")
    links = simhash.search(simhash.node_rows(rows, simhash.exact_masks(64, 2), 1), 1, 2)
    found = {r["node"]: r["component"] for r in graph.components(Tables(ready, "t"), links).collect()}
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None]) <= 2, 1))
    want = plain_components(zip(a.tolist(), b.tolist()), range(len(prints)))
    assert {k: found.get(k, k) for k in range(len(prints))} == want


@pytest.mark.parametrize("distance", [0, 2, 6])
def test_the_hierarchy_finds_all_pairs(distance):
    rng = np.random.default_rng(3)
    f = rng.integers(0, 2**63, (5, 2), dtype=np.uint64)[rng.integers(0, 5, 700)]
    f ^= (np.uint64(1) << rng.integers(0, 60, f.shape, dtype=np.uint64)) * rng.integers(0, 2, f.shape, dtype=np.uint64)
    f = f[np.argsort(simhash.gray_rank(f[:, 0].copy()), kind="stable")]
    found = {(int(x), int(y)) for xs, ys in simhash.near_pairs(f, distance) for x, y in zip(xs, ys)}
    apart = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    assert found == {(int(x), int(y)) for x, y in zip(*np.nonzero(np.triu(apart <= distance, 1)))}


def test_large_nodes_are_split_without_loss(ready):
    rng = np.random.default_rng(9)
    prints = np.unique(np.uint64(7 << 50) | rng.integers(0, 1 << 12, 900, dtype=np.uint64))
    rows = simhash.node_rows(ready.createDataFrame([(k, int(p)) for k, p in enumerate(prints)], "rep bigint, f0 bigint"), [((1 << 40) - 1) << 24], 1)
    whole = graph.components(Tables(ready, "t"), simhash.search(rows, 1, 1))
    parts = graph.components(Tables(ready, "t"), simhash.search(simhash.split_nodes(Tables(ready, "t"), rows, 50), 1, 1))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_near_copies_go_and_clean_texts_stay(ready, odd):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    docs, near, clean = [], [], []
    for k in range(60):
        text = [rng.choice(words) for _ in range(400)]
        docs.append((k, " ".join(text)))
        for n, edits in ((100 + k, 5), (200 + k, 120)):  # similarity about 0.9, and about 0.2
            other = list(text)
            for at in rng.sample(range(400), edits):
                other[at] = rng.choice(words)
            docs.append((n, " ".join(other)))
            (near if edits == 5 else clean).append(n)
    kept = {r["doc_id"] for r in simhash.keep_one(ready.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert len(kept & set(near)) <= 3
    assert set(range(60)) <= kept and set(clean) <= kept
    out = simhash.keep_one(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} == {None, 1, 4, 7, 9, 10, 11, 12}


def plain_near_copies(rows, similarity=0.8):
    sets = [frozenset(simhash.hashes(t, 5).tolist()) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    root = plain_components(pairs, range(len(rows)))
    return {rows[k][0]: rows[r][0] for k, r in root.items()}


def near_copies(ready, rows, **more):
    return {r["doc_id"]: r["component_id"] for r in jaccard.groups(ready.createDataFrame(rows, "doc_id bigint, text string").repartition(3), **more).collect()}


def made_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


@pytest.mark.parametrize("more", [{}, {"block": 7, "hot_over": 3}])
def test_near_copies_in_a_family_with_shared_boilerplate(ready, more):
    """Pairs of 0.82 in a family of 0.65: links that fail must not take the true ones along."""
    rng = random.Random(21)
    shared = made_words(rng, 300)
    rows = []
    for k in range(60):
        own = made_words(rng, 75)
        other = own[:40] + made_words(rng, 35)
        rows += [(2 * k, " ".join(shared + own)), (2 * k + 1, " ".join(shared + other))]
    want = plain_near_copies(rows)
    assert sum(want[2 * k] == want[2 * k + 1] for k in range(60)) == 60 and len(set(want.values())) == 60
    assert near_copies(ready, rows, **more) == want


def test_a_repeated_line_makes_no_near_copies(ready):
    """14 words repeated 10 to 40 times outweigh 50 to 200 own shingles in hashes with repeats, not in sets."""
    rng = random.Random(22)
    rows = []
    for k in range(40):
        line = made_words(rng, 14) * rng.randrange(10, 41)
        rows += [(2 * k + j, " ".join(line + made_words(rng, rng.randrange(50, 201)))) for j in (0, 1)]
    assert near_copies(ready, rows) == {k: k for k in range(80)}
    kept = simhash.keep_one(ready.createDataFrame(rows, "doc_id bigint, text string"))
    assert kept.count() == 80


def test_short_near_copies_are_found(ready):
    """4 of 5, 5 of 6, 6 of 7 and 12 of 15 shingles, and texts just below the similarity."""
    rng = random.Random(23)
    rows = []
    for k in range(60):
        for n, more in ((8, 1), (9, 1), (10, 1), (16, 3), (7, 1), (15, 3)):  # the last two: 3 of 4 and 11 of 14
            text = made_words(rng, n + more)
            rows += [(len(rows), " ".join(text[:n])), (len(rows) + 1, " ".join(text))]
    want = plain_near_copies(rows)
    found = near_copies(ready, rows)
    far = [k for k in range(0, len(rows), 2) if want[k] != want[k + 1]]
    assert len(far) == 120 and all(found[k] == want[k] and found[k + 1] == want[k + 1] for k in range(0, len(rows), 2) if k not in far)
    assert all(found[k] == k and found[k + 1] == k + 1 for k in far)


def test_near_copies_of_a_whole_table(ready):
    """As by brute force over sets, but for the pairs of repetitive texts that one word tells apart."""
    rows = [tuple(r) for r in ready.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: jaccard.shingle_set(t, 5)[1:] for i, t in rows}
    ids = sorted(sets)
    root = plain_components([(a, b) for a in ids for b in ids if a < b and jaccard.near(sets[a], sets[b], 0.8, 5)], ids)
    assert near_copies(ready, rows, hot_over=2, block=20) == root


def plain_vectors(rows, limit):
    x = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    near = [(a, b) for a in x for b in x if b < a and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= limit]
    root = plain_components(near, range(len(rows)))
    links = [sum(k in p for p in near) for k in range(len(rows))]
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, float("inf")), rows[k][0])
    return sorted((i, links[k], least[root[k]], i == least[root[k]]) for k, (i, _) in enumerate(rows))


def planted_vectors():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(30):
        v = rng.standard_normal(16)
        rows += [v, v, v + 0.15 * rng.standard_normal(16), v + 0.5 * rng.standard_normal(16)]
    rows += list(rng.standard_normal(16) + 0.05 * rng.standard_normal((90, 16)))  # one large group
    out = [[float(x) for x in v] for v in rows]
    out += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8, [1.0] * 16]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [2048, 7])
def test_op4(ready, block):
    rows = planted_vectors()
    df = ready.createDataFrame([(i, v, None, 1) for i, v in rows], "vec_id bigint, embedding array<double>, label int, rep int").repartition(3)
    found = embeddings.near_groups(df, block=block, window=20)
    assert sorted(map(tuple, found.collect())) == plain_vectors(rows, 0.9)
    assert embeddings.near_groups(df.limit(0)).count() == 0


def test_op4_recall(ready):
    """Far more vectors than a window holds: at least 0.9 of all links, none that isn't one."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 32))
    x = np.concatenate([x, x[:700] + 0.35 * rng.standard_normal((700, 32))])  # cosines about the limit
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    df = ready.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = np.array([r["n_links"] for r in embeddings.near_groups(df, window=16).orderBy("vec_id").collect()])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum() > 500


def test_op4_recall_in_a_hot_cone(ready):
    """A third of the rows crowd round one direction (mutual cosine 0.7) and fill few codes: pairs there are found as well."""
    rng = np.random.default_rng(31)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((6000, 64)))
    mean = unit(rng.standard_normal((1, 64)))
    x[:2000] = unit(0.7**0.5 * mean + 0.3**0.5 * x[:2000])
    away = rng.standard_normal((200, 64))
    away = unit(away - (away * x[:200]).sum(1, keepdims=True) * x[:200])
    x[200:400] = 0.902 * x[:200] + (1 - 0.902**2) ** 0.5 * away  # pairs just within the limit
    df = ready.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    known = embeddings.prepared(df).select(F.col("vec_id").alias("rep"), "hash", "dims", "raw")
    links = embeddings.bucket_search(Tables(ready, "t"), known, {64: 6}, block=300)
    found = {r["node"]: r["component"] for r in graph.components(Tables(ready, "t"), links).collect()}
    assert sum(found.get(k, -1) == found.get(k + 200, -2) for k in range(200)) >= 190
    whole = {r["vec_id"]: r["component_id"] for r in embeddings.near_groups(df, window=4).collect()}
    assert sum(whole[k] == whole[k + 200] for k in range(200)) >= 190


def test_op4_codes_follow_the_measured_fill():
    rng = np.random.default_rng(32)
    even = rng.standard_normal((2000, 64))
    assert embeddings.bits_for(1_000_000, even) > 8
    assert embeddings.bits_for(1_000_000, even * 0.01 + rng.standard_normal((1, 64))) == 0  # no code parts them
    assert embeddings.passes(0) == 1


def test_op4_loses_no_link_at_sizes_where_codes_would_part_vectors(ready):
    """As many isolated pairs just within the limit are found among 6,000 vectors as there are."""
    rng = np.random.default_rng(33)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((6000, 256)))
    away = rng.standard_normal((1000, 256))
    away = unit(away - (away * x[:1000]).sum(1, keepdims=True) * x[:1000])
    x[1000:2000] = 0.901 * x[:1000] + (1 - 0.901**2) ** 0.5 * away
    assert embeddings.bits_for(len(x), x[:4096]) > 0
    df = ready.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = embeddings.near_groups(df).orderBy("vec_id").collect()
    near = x @ x.T >= 0.9
    assert [r["n_links"] for r in found] == (near.sum(1) - 1).tolist()
    assert [r["component_id"] for r in found] == near.argmax(1).tolist()


def test_op4_whole_search_by_small_blocks(ready):
    """Vectors of two lengths, dealt as many blocks: the same components as of all pairs."""
    rng = np.random.default_rng(34)
    x = [v for d in (16, 24) for v in np.repeat(rng.standard_normal((60, d)), 4, 0) + 0.3 * rng.standard_normal((240, d))]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    df = ready.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    known = embeddings.prepared(df).select(F.col("vec_id").alias("rep"), "hash", "dims", "raw")
    links = embeddings.whole_search(Tables(ready, "t"), known, numbers=300)
    found = {r["node"]: r["component"] for r in graph.components(Tables(ready, "t"), links).collect()}
    assert [found.get(k, k) for k in range(len(x))] == [c for _, _, c, _ in plain_vectors(rows, 0.9)]


def test_op4_pairs_next_to_the_limit_are_told_by_64_bit_products():
    x = np.array([[1.0, 0.0], *([c, (1 - c * c) ** 0.5] for c in (0.9 + 1e-9, 0.9 - 1e-9, 0.9 + 1e-3, 0.9 - 1e-3))])
    told = lambda side, same: sorted((int(i), int(j)) for a, b in embeddings.near_pairs(x, side, same, 0.9) for i, j in zip(a, b, strict=True) if not i)
    assert told(np.zeros(5, int), True) == told(np.array([0, 1, 1, 1, 1]), False) == [(0, 1), (0, 3)]


def test_op4_query(ready):
    rows = [(r["vec_id"], r["embedding"]) for r in ready.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, registry.op4_embedding_near_dedup(ready, SMALL).collect())) == plain_vectors(rows, 0.9)


def plain_warc(rows, least=0):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        again = i is not None and len(raw) >= least and first[h or ""] != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chunk", "least"), [(64, 0), (10, 6), (1 << 20, 10**9)])
def test_op2(ready, tmp_path, chunk, least):
    texts = [None, "", "a", "é" * 40, "x" * 1000, "x" * 1000, "line\r\n\r\nWARC/1.1\r\n" * 9, "tail\n", "tail\n", None, "\x1f\x00" * 30]
    rows = [*((k + 3, t) for k, t in enumerate(texts)), (None, "x" * 1000), (None, None), (5, "a"), (5, "other")]
    pages = ready.createDataFrame([(i, None if k % 2 else f"http://e/{k}\n", h, 1) for k, (i, h) in enumerate(rows)], "page_id bigint, url string, html string, size int").repartition(3)
    path = f"file://{tmp_path}/archive"
    warc.write(need(pages, page_id="bigint", url="string", html="string"), path, chunk, least)
    assert sorted(map(tuple, warc.read(ready, path).collect()), key=repr) == plain_warc(rows, least)


def test_warc_files_are_plain_gzip(ready, tmp_path):
    import gzip

    pages = ready.createDataFrame([(1, "http://e/", "<p>é</p>" * 50)], "page_id bigint, url string, html string")
    warc.write(pages, f"file://{tmp_path}/a", chunk=100)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(tmp_path.glob("a/*/part-*")))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Type: continuation\r\n" in text
    lengths = [int(n) for n in re.findall(rb"Content-Length: (\d+)\r\n\r\n", text)]
    assert len(lengths) > 3


def test_a_changed_archive_is_an_error(ready, tmp_path):
    good = b"".join(m for _, m in warc.records(1, "u", b"hello", None, "r", 100))
    headers, block = warc.opened(good)
    bad = warc.member([(k, v) for k, v in headers.items() if k != "content-length"], block.replace(b"hello", b"hullo"))
    import pyarrow as pa

    with pytest.raises(ValueError, match="not what its header says"):
        list(warc.whole(iter([pa.RecordBatch.from_arrays([pa.array([bad])], names=["m"])])))


def test_op2_query(ready):
    rows = [(r["page_id"], r["html"]) for r in ready.read.parquet(f"{SMALL}/pages.parquet").collect()]
    assert sorted(map(tuple, registry.op2_warc_round_trip(ready, SMALL).collect()), key=repr) == plain_warc(rows)


def test_empty_archive(ready, tmp_path):
    none = ready.createDataFrame([], "page_id bigint, url string, html string")
    warc.write(none, f"file://{tmp_path}/none")
    assert warc.read(ready, f"file://{tmp_path}/none").count() == 0
