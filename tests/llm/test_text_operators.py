"""BPE, packing, secrets, personal data: against libraries and plain versions, over whole test tables and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, packing, pii, registry, secrets
from quarry.llm.common import need
from tests.conftest import SMALL

LIBRARY = Tokenizer.from_file(bpe.default_path())
LIBRARY.no_truncation()
LIBRARY.no_padding()


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoders():
    return bpe.Encoder(bpe.default_path()), bpe.Encoder(bpe.default_path(), library=True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text_encodes_as_the_library_does(texts):
    for e in (bpe.encoder(bpe.default_path()), bpe.encoder(bpe.default_path(), True)):
        found = [x.tolist() for x in e.encode(texts)]
        assert found == [library_ids(t) for t in texts]
        assert [e.decode(x) for x in found] == [LIBRARY.decode(x, skip_special_tokens=False) for x in found]


def test_each_plain_letter(encoders):
    texts = [f"a{chr(k)}B {chr(k)}{chr(k)}" for k in range(0x250)]
    for e in encoders:
        assert [x.tolist() for x in e.encode(texts)] == [library_ids(t) for t in texts]


@pytest.mark.parametrize("text", ["'s 'll it's ''t", "aaaaaaaaaaa", "ΑΣ ς", "İ", "Å Å", "<|endoftext|>x<|startoftext|>", "<|endoftext", "\x1c\x1d\x85  ", "a" * 3000])
def test_odd_text(encoders, text):
    for e in encoders:
        assert e.encode([text])[0].tolist() == library_ids(text)


def test_memory_is_bounded():
    e = bpe.Encoder(bpe.default_path(), memory=50)
    words = " ".join(f"w{k}q" for k in range(500))
    assert e.encode([words])[0].tolist() == library_ids(words)
    assert len(e.known) <= 50
    assert e.encode([words])[0].tolist() == library_ids(words)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(ready, odd, none):
    for docs, found in ((ready.read.parquet(f"{SMALL}/documents.parquet"), registry.op1_bpe_round_trip(ready, SMALL)), (odd, bpe.round_trip(need(odd, doc_id="bigint", text="string")))):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library_ids(r["text"])
            want.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False))))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(need(none, doc_id="bigint", text="string")).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    place = packing.hilbert(grid, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def check_pieces(docs, found):
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        ids.setdefault(r["doc_id"], []).append(np.array([*library_ids(r["text"]), 2], "<u4"))
    pieces = found.collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for doc, whole in ids.items():
        if len(whole) > 1:
            assert sum(p["length"] for p in by_doc[doc]) == sum(map(len, whole))
            continue
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(whole[0]))
            assert p["ids_crc32"] == zlib.crc32(whole[0][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(whole[0])
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two


def test_op9(ready, odd, none):
    check_pieces(ready.read.parquet(f"{SMALL}/documents.parquet"), registry.op9_hilbert_packing(ready, SMALL))
    check_pieces(odd, packing.pack(need(odd, doc_id="bigint", text="string")))
    assert packing.pack(need(none, doc_id="bigint", text="string")).count() == 0


def test_neighbours_on_the_curve_are_alike():
    curve = packing.Curve(1000)
    rng = np.random.default_rng(1)
    centres = [rng.integers(0, 1000, 40) for _ in range(20)]
    docs = [(k, np.concatenate([c, rng.integers(0, 1000, 2)])) for _ in range(10) for k, c in enumerate(centres)]
    order = np.argsort(curve.keys([curve.vector(d) for _, d in docs]))
    same = np.mean([docs[a][0] == docs[b][0] for a, b in zip(order, order[1:])])
    assert same > 0.5  # 0.05 by chance


def plain_base(text):
    """The contract's patterns, one after another."""
    out = []
    for kind, pattern, good in (
        ("assign", r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text) if good(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out)), [sum(x[3] == k for x in out) for k in ("assign", "access", "hex")]


def test_op10(ready, odd, none):
    for docs, found in ((ready.read.parquet(f"{SMALL}/documents.parquet"), registry.op10_secret_scan(ready, SMALL)), (odd, secrets.scan(need(odd, doc_id="bigint", text="string")))):
        want = []
        for r in docs.select("doc_id", "text").collect():
            base, counts = plain_base(r["text"] or "")
            want.append((r["doc_id"], *counts, digest(base)))
        assert sorted((tuple(r)[:5] for r in found.collect()), key=repr) == sorted(want, key=repr)
    assert secrets.scan(need(none, doc_id="bigint", text="string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "=", ":", " ", '"', "abcdefgh", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJKL", "é", "\n", "K", "ſecret"]), max_size=14).map("".join))
def test_base_spans_of_any_text(text):
    base, whole = secrets.spans(text)
    assert secrets.shown(base) == plain_base(text)[0]
    assert set(base) <= set(whole)


def test_random_strings_are_told_from_text():
    import random

    rng = random.Random(4)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(b64) for _ in range(40)) for _ in range(200)]
    caught = sum(bool(secrets.random_spans(f"see {k} here")) for k in keys)
    assert caught >= 190
    words = ["internationalization", "donaudampfschifffahrtsgesellschaft", "some/long/path/to/a/file/somewhere", "UPPER_CASE_CONSTANT_NAME", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "0" * 40, "1234567890" * 4, "abcabcabcabcabcabcabcabcabc", "-" * 60, "thhentrecongrthtionedly"]
    assert [w for w in words if secrets.random_spans(f"a {w} b")] == []
    assert secrets.random_spans("x " * 10 + keys[0])[0][:2] == (20, 60)


def test_secrets_beside_other_characters_of_a_run():
    """Values after '=' and tokens in runs that no alphabet holds whole are tested on their own."""
    import random

    rng = random.Random(7)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    drawn = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for before, letters, after in (("AWS_SECRET_ACCESS_KEY=", b64, ""), ("sig=", b64, "=="), ("KEY=", b64[:62], "=x"), ("path_x/", b64[:62], ""), ("id-", b64[:62] + "++//", ""), ("a+b/", b64[:62] + "-_-_", ""), ("=", b64, "")):
        caught = 0
        for _ in range(100):
            text = f"see {before}{(key := drawn(40, letters))}{after} here"
            at = text.index(key)
            caught += any(s <= at + 2 and at + 38 <= e for s, e, _ in secrets.random_spans(text))
        assert caught >= 90, before
    text = "x AWS_SECRET_ACCESS_KEY=" + "wJalrXUtnFEMIK7MDENGbPxRfiCYzq5TgH2vLs9a" + " y"
    assert secrets.redacted(text, secrets.spans(text)[1]) == "x AWS_SECRET_ACCESS_KEY=[SECRET] y"
    for clean in ("some/long_path/to-a/file_of/some-where/else", "name=internationalization", "a=b=c=d=e=f=g=h=i=j=k=l", "key=12345678901234567890123"):
        assert secrets.random_spans(f"a {clean} b") == []


def test_redaction(odd):
    found = {r["doc_id"]: r["text"] for r in secrets.redact(odd).collect()}
    assert found[9] == "[SECRET] [SECRET]"
    assert found[4] is None and found[1].startswith("The quick")
    assert secrets.redact(odd).columns == odd.columns


def test_packing_in_ranges_by_bytes(ready, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_BYTES", 4096)
    docs = ready.read.parquet(f"{SMALL}/documents.parquet")
    found = packing.pack(docs)
    assert found.rdd.getNumPartitions() > int(ready.conf.get("spark.sql.shuffle.partitions"))
    check_pieces(docs, found)


def test_permutations_are_permutations():
    assert sorted(pii.permuted(k, 1000, b"k", "t") for k in range(1000)) == list(range(1000))
    assert len({pii.like(f"{k:03d}", b"k", "t") for k in range(1000)}) == 1000
    assert re.fullmatch(r"[A-Z][a-z]-\d\d é", pii.like("Ab-12 é", b"k", "t"))


def test_surrogates_keep_type_gender_script_and_format():
    text = "Write to a.b1@mail.example.org or +1 (386) 555-3733 from 25.86.162.211, card 4111 1111 1111 1111, ssn 123-45-6789, on 2020-01-02. Mr John Smith, Mrs Jane Smith; Mr Smith. Госпожа Иванова"
    made, found = pii.replaced(text)
    assert [k for _, _, k in found] == ["email", "phone", "ip", "card", "ssn", "name", "name", "name", "name"]
    assert [text[s:e] for s, e, k in found if k == "name"] == ["John Smith", "Jane Smith", "Smith", "Иванова"]
    m = re.fullmatch(r"Write to [a-z]\.[a-z]\d@[a-z]{4}\.[a-z]{7}\.org or \+1 \(\d{3}\) \d{3}-\d{4} from (\S+), card (4\d{3} \d{4} \d{4} \d{4}), ssn \d{3}-\d\d-\d{4}, on 2020-01-02\. Mr ([A-Z]\w+o) (\w+), Mrs ([A-Z]\w+a) (\w+); Mr (\w+)\. Госпожа ([А-Я][а-я]+)", made)
    assert m and m[4] == m[6] == m[7]
    assert all(0 <= int(x) <= 255 for x in m[1].split("."))
    digits = m[2].replace(" ", "")
    assert pii.check_digit(digits[:-1]) == int(digits[-1])
    assert not any(x in made for x in ("a.b1@", "3733", "25.86.162.211", "4111 1111", "123-45-6789", "John", "Smith", "Иванова"))
    assert pii.replaced(text)[0] == made and pii.replaced(text, b"another key")[0] != made


def test_op8(ready, odd, none):
    docs = {r["doc_id"]: r["text"] for r in ready.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = registry.op8_pii_surrogates(ready, SMALL).collect()
    assert len(found) == len(docs)
    for r in found:
        values = [docs[r["doc_id"]][int(s) : int(e)] for _, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        assert r["n_entities"] == len(values)
        assert (r["text"] == docs[r["doc_id"]]) == (not values)
        assert not [v for v in values if v in r["text"]]
    emails = {e for t in docs.values() for e in re.findall(r"[\w.]+@[\w.]+\w", t)}
    assert emails and not any(e in r["text"] for r in found for e in emails)
    assert {r["doc_id"]: r["text"] for r in pii.surrogates(odd).collect()}[4] is None
    assert pii.surrogates(none).count() == 0


def test_names_that_clash_are_keyed_anew(ready, monkeypatch):
    real = pii.name_part
    monkeypatch.setattr(pii, "name_part", lambda w, g, given, key, attempt=0: "Same" if not attempt and not given else real(w, g, given, key, attempt))
    docs = ready.createDataFrame([(1, "Mr Smith and Mr Jones")], "doc_id bigint, text string")
    rows = [("smith", "", False, "same"), ("jones", "", False, "same")]
    again = {("jones", "", False): 0, ("smith", "", False): 1}
    made = pii.replaced(docs.first()["text"], pii.KEY, again)[0]
    assert len(rows) == 2 and made.count("Same") == 1
