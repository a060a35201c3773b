"""Surrogates in all scripts and their collision check, chunked writing, samples without caps, false-discovery rule."""

import gzip
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import embeddings, langid, pii, secrets, toxicity, warc
from quarry.llm.common import Tables
from quarry.llm.dealing import dealt, large_groups
from tests.conftest import SMALL


def test_addresses_and_names_in_any_script():
    text = "мария@пример.рф, é@ä.de; Mr 田中 met Dr Smith and Mme Émilie Dupont"
    made, found = pii.replaced(text)
    assert [k for *_, k in found] == ["email", "email", "name", "name", "name"]
    for s, e, _ in found:
        assert text[s:e] not in made
    m = re.fullmatch(r"([\u0430-\u047f]{5})@([\u0430-\u047f]{6})\.рф, (\S)@(\S)\.de; Mr ([一-鿿]{2}) met Dr ([A-Z][a-z]+) and Mme ([A-Z][a-z]+a) ([A-Z][a-z]+)", made)
    assert m and m[3].isalpha() and m[3] != "é" and m[4] != "ä"


def test_account_numbers_and_ip6():
    text = "IBAN DE89 3704 0044 0532 0130 00 from 2001:db8::1, not GB00 1234 5678 9012 or std::string a::b 12:30:45"
    made, found = pii.replaced(text)
    assert [k for *_, k in found][:2] == ["iban", "ip6"] and "3704" not in made and "2001:db8" not in made
    assert "std::string a::b 12:30:45" in made
    assert pii.right_iban(re.search(r"DE[\d ]+", made)[0].strip()) and pii.right_ip6(re.search(r"from (\S+),", made)[1])


def test_no_value_stays_itself_and_none_meet():
    for size in (2, 3, 10, 97, 1000):
        found = [pii.permuted(k, size, b"k", "t") for k in range(size)]
        assert sorted(found) == list(range(size)) and all(a != b for a, b in enumerate(found))
    letters = [f"{a}{b}" for a in "абвгд" for b in "éèê"]
    assert len({pii.like_any(x, b"k", "t") for x in letters}) == 15


def plain_surrogate_names(words, key, more):
    """Attempts until all differ, one after another."""
    again = {}
    while True:
        made = {w: pii.name_part(*w, key, again.get(w, 0), more).casefold() for w in words}
        real = {(g, w) for w, _, g in words}
        bad = [w for w in words if (w[2], made[w]) in real]
        groups = {}
        for w in sorted(words):
            groups.setdefault((w[2], made[w]), []).append(w)
        bad += [w for g in groups.values() for w in g[1:]]
        if not bad:
            return again, made
        for w in set(bad):
            again[w] = again.get(w, 0) + 1


def test_clashes_are_resolved_until_none_is_left(ready):
    more = 1 - pii.FAMILY  # one syllable, 85 surrogates for 50 names: many meet
    rng = random.Random(3)
    family = ["".join(rng.choice("abcdefgh") for _ in range(4)).capitalize() for _ in range(50)]
    docs = ready.createDataFrame([(k, f"Mr {n} and Mrs {n}") for k, n in enumerate(family)] + [(None, None), (99, "")], "doc_id bigint, text string")
    again = pii.clashes(docs, more=more)
    words = {(n.casefold(), "", False) for n in family}
    want, made = plain_surrogate_names(words, pii.KEY, more)
    assert {k: v for k, v in again.items() if k != pii.MORE} == want and len(want) > 5
    assert len(set(made.values())) == len(words)
    texts = [pii.replaced(f"Mr {n}", pii.KEY, again)[0] for n in family]
    assert len({t.casefold() for t in texts}) == len({n.casefold() for n in family})


def test_syllables_grow_with_the_names(ready):
    docs = ready.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Mr "), F.translate(F.concat(F.lit("A"), F.col("id").cast("string")), "0123456789", "bcdfghjklm")).alias("text"))
    assert pii.clashes(docs)[pii.MORE] == 0
    assert pii.clashes(docs.limit(0)) == {pii.MORE: 0}


def test_surrogates_against_one_text_after_another(ready):
    docs = ready.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    again = pii.clashes(docs)
    found = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.surrogates(docs).collect()}
    for r in docs.collect():
        made, spans = pii.replaced(r["text"], pii.KEY, again) if r["text"] else (r["text"], [])
        assert found[r["doc_id"]] == (made, len(spans))


def test_odd_rows_of_surrogates(ready, odd):
    found = [(r["doc_id"], r["text"], r["n_entities"]) for r in pii.surrogates(odd).collect()]
    assert len(found) == odd.count()
    assert {t for i, t, _ in found if i == 5} == {""} and all(n == 0 for i, _, n in found if i in (4, 5, 6, 11))


def test_archives_hold_every_byte(ready, tmp_path):
    """The text sink must pass raw gzip members through: all 256 values of a byte, and payloads in many chunks."""
    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(n)) for n in (1, 5000, 40_000, 63, 64, 65)]
    pages = ready.createDataFrame([(k, "u", t) for k, t in enumerate([*texts, texts[2]])], "page_id bigint, url string, html string").repartition(2)
    warc.write(pages, f"file://{tmp_path}/a", chunk=64)
    raw = b"".join(p.read_bytes() for p in tmp_path.glob("a/*/part-*"))
    assert set(raw) == set(range(256))
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("a/*/part-*"))
    assert plain.count(b"WARC-Type: response\r\n") == 6 and plain.count(b"WARC-Type: revisit\r\n") == 1
    assert plain.count(b"X-Running-Digest: ") == sum(-(-len(t.encode()) // 64) for t in texts if len(t.encode()) > 64)
    got = {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in warc.read(ready, f"file://{tmp_path}/a").collect()}
    assert got == {**{k: (len(t.encode()), None) for k, t in enumerate(texts)}, 6: (len(texts[2].encode()), 2)}


def test_a_changed_segment_is_an_error():
    members = [m for _, m in warc.records(1, "u", b"x" * 250, None, "r", 100)]
    headers, block = warc.opened(members[1])
    members[1] = warc.member([(k, v) for k, v in headers.items() if k != "content-length"], block.replace(b"x", b"y", 1))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["r"] * 3), pa.array([1, 2, 3]), pa.array(members)], names=["record", "number", "member"])
    with pytest.raises(ValueError, match="segment 2"):
        list(warc.joined(iter([batch])))


def test_no_language_is_left_out(ready):
    rng = random.Random(5)
    rows = []
    for k in range(230):
        own = "".join(chr(0x4E00 + 20 * k + j) for j in range(20))
        rows += [(len(rows) + j, "".join(rng.choice(own) for _ in range(60)), f"l{k:03d}") for j in range(9)]
    docs = ready.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.learn(docs.unionByName(docs.where("doc_id = 0")))
    assert set(model.languages) == {name for i, _, name in rows if zlib.crc32(str(i).encode()) % 3 != 1} and len(model.languages) > 220
    found = langid.predict(docs, model).join(docs, "doc_id").where("lang = lang_pred").count()
    assert found > 0.9 * len(rows)


def test_terms_chosen_by_spark_are_those_chosen_at_hand(ready):
    docs = ready.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = ready.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    rows, positive, negative = toxicity.sample(docs, labels)
    rows = Tables(ready, "t").keep(rows, "sample")
    held = sorted((r["doc_id"], r["text"], r["y"]) for r in rows.collect())
    want = toxicity.fit([toxicity.terms_of(t) for _, t, _ in held], np.array([y for *_, y in held], float), positive, negative)
    found = toxicity.learn(docs, labels)
    assert (found.terms == want.terms).all() and np.allclose(found.weight, want.weight) and abs(found.constant - want.constant) < 1e-9


def test_vectors_travel_exactly():
    rng = np.random.default_rng(1)
    for x in (rng.standard_normal(5), rng.standard_normal(5).astype(np.float32).astype(float), np.array([1e200, 1.0]), np.array([1e-60, 1.0])):
        assert (embeddings.unpacked([embeddings.packed(x)])[0] == x).all()
    assert len(embeddings.packed(np.ones(8))) == 33 and len(embeddings.packed(np.full(8, 0.1))) == 65


def test_blocks_meet_once(ready):
    rows = ready.range(1000).select(F.lit(7).alias("g"), F.col("id").alias("rep")).unionByName(ready.range(600).select((F.col("id") % 200 + 8).cast("int").alias("g"), F.col("id").alias("rep")))
    large, many = large_groups(Tables(ready, "t"), rows, "g", 256, "large")
    assert [tuple(r) for r in large.collect()] == [(7, 8)] and many == 1
    units = {}
    for r in dealt(rows, "g", large, many).where("g = 7").collect():
        units.setdefault(r["unit"], []).append((r["rep"], r["side"], r["same"]))
    met = {}
    for members in units.values():
        for k, (a, s, same) in enumerate(members):
            for b, t, _ in members[:k]:
                if same or s != t:
                    met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    assert len(met) == 1000 * 999 // 2 and set(met.values()) == {1}
    assert max(map(len, units.values())) < 400


def test_vectors_without_an_id_and_repeated_ids(ready):
    """A vector without an id links with none that has one; repeated ids count as vectors of their own."""
    v = [1.0, 2.0, 3.0]
    df = ready.createDataFrame([(1, v), (1, v), (2, [1.0, 2.0, 3.1]), (None, [9.0, -1.0, 0.0]), (None, None), (3, None)], "vec_id bigint, embedding array<double>")
    found = sorted(map(tuple, embeddings.near_groups(df).collect()), key=repr)
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True), (None, 0, None, True), (3, 0, 3, True)], key=repr)


def test_discoveries():
    assert secrets.discoveries([], 0.1) == 0
    assert secrets.discoveries([0.5, 0.01, 0.04], 0.06) == 2  # 0.01 <= 0.02, 0.04 <= 0.04
    assert secrets.discoveries([0.5, 0.03, 0.039], 0.06) == 2  # the first alone would fail
    rng = random.Random(2)
    p = [rng.random() for _ in range(2000)]
    assert secrets.discoveries(p, 0.001) <= 3


def test_battery_over_drawn_strings():
    """Drawn strings are rarely called uneven; strings with a pattern nearly always."""
    rng = random.Random(9)
    letters = secrets.ALPHABETS["base62"]
    place = {c: k for k, c in enumerate(letters)}
    tested = lambda s: 3 * min(secrets.battery([place[c] for c in s], 62))
    drawn = [tested("".join(rng.choice(letters) for _ in range(40))) for _ in range(500)]
    assert sum(p <= 0.001 for p in drawn) <= 5
    assert all(tested(x * 8) <= 0.001 for x in ("abcde", "Zz0Zz", "01234"))
