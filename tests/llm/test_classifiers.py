"""Toxicity and language: held-out quality, what the models may not see, odd rows; and the pipeline."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import exact, langid, registry, secrets, simhash, toxicity
from quarry.llm.common import need
from tests.conftest import SMALL
from tests.llm.test_text_operators import check_pieces

MIDDLE = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (rank[label].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_op3(ready):
    labels = {r["doc_id"]: r["toxic"] for r in ready.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    found = registry.op3_toxicity(ready, MIDDLE).collect()
    assert len(found) == ready.read.parquet(f"{MIDDLE}/documents.parquet").count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    label = np.array([labels[r["doc_id"]] == 1 for r in held])
    assert auc(np.array([r["score"] for r in held]), label) > 0.85
    assert sum(r["predicted"] for r, y in zip(held, label) if not y) <= 1


def test_pairs_weigh_more_than_their_parts():
    """Neither an insult nor a group alone is toxic here: only interactions can tell."""
    rng = np.random.default_rng(1)
    terms, y = [], []
    for _ in range(1500):
        insult, group = (rng.random(2) < 0.5).astype(int).tolist()
        noise = rng.integers(10, 200, 6)
        terms.append(np.unique(np.concatenate([noise, [1] * insult, [2] * group])).astype(np.uint32))
        y.append(float(insult and group or not insult and not group))
    half = len(y) // 2
    model = toxicity.fit(terms[:half], np.array(y[:half]), 700, 800)
    model.prepared()
    told = [model.margin(np.array([model.place[t] for t in t_ids.tolist() if t in model.place], np.int64)) > 0 for t_ids in terms[half:]]
    assert np.mean(np.array(told) == np.array(y[half:])) > 0.85  # sums of weights can't do better than by chance
    at = [model.place[1], model.place[2]]
    both, one, other, none = (model.margin(np.array(p, np.int64)) for p in (at, at[:1], at[1:], []))
    assert both + none - one - other > 3


def test_toxicity_of_odd_rows(ready, odd, none):
    labels = ready.createDataFrame([(1, 1), (2, None), (None, 1), (1, 0)], "doc_id bigint, toxic int")
    model = toxicity.learn(need(odd, doc_id="bigint", text="string"), labels)
    found = toxicity.score(need(odd, doc_id="bigint", text="string"), model)
    assert found.count() == odd.count() and found.where("score is null").count() == 0
    assert toxicity.score(need(none, doc_id="bigint", text="string"), model).count() == 0
    empty = toxicity.learn(need(none, doc_id="bigint", text="string"), labels.limit(0))
    assert toxicity.score(need(odd, doc_id="bigint", text="string"), empty).where("abs(score - 1 / 3) > 1e-9").count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


def test_op6(ready):
    docs = {r["doc_id"]: r for r in ready.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    found = registry.op6_language_id(ready, MIDDLE).collect()
    assert len(found) == len(docs)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12])
def test_codewords_are_far_apart(n):
    words = langid.code(n)
    assert words.shape[0] == n
    apart = [(a != b).sum() for k, a in enumerate(words) for b in words[:k]]
    assert not apart or min(apart) >= {2: 1, 4: 4, 7: 32, 12: 8}[n]


def test_wrong_bits_are_corrected():
    words = langid.code(4)
    model = langid.Model(["a", "b", "c", "d"], words, np.zeros((langid.BUCKETS, 7), np.float32), np.zeros(7), np.ones((4, 7)))
    for k in range(4):
        for bit in range(7):
            sent = words[k].astype(float) * 5
            sent[bit] *= -1
            model.constant = sent
            assert model.predict("x")[0] == model.languages[k]


def test_long_texts_are_counted_whole():
    text = "abc déf " * 60_000
    raw = f" {text.lower()} ".encode()
    assert langid.counts(text).sum() == len(raw) - 2 + len(raw) - 3


def test_language_of_odd_rows(ready, odd, none):
    narrow = need(odd, doc_id="bigint", text="string", lang="string")
    model = langid.learn(narrow)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(narrow, model).collect()}
    assert found[4] == found[5] == found[6] == found[11] == "und" and found[1] == "en"
    assert langid.predict(narrow, langid.learn(need(none, doc_id="bigint", text="string", lang="string"))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(narrow.limit(0), model).count() == 0


def test_pipeline(ready):
    """Stage by stage against plain versions, on what each predecessor kept."""
    docs = ready.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(ready, docs, SMALL)
        if name == "packing":
            check_pieces(docs, out)
            break
        assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in out.collect()}
        gone = set(before) - set(after)
        if name == "toxicity":
            model = toxicity.learn(need(docs, doc_id="bigint", text="string"), ready.read.parquet(f"{SMALL}/labels.parquet"))
            assert gone == {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
        elif name == "exact_dedup":
            assert gone == {r["doc_id"] for r in exact.decide(docs).where("not kept").collect()}
        elif name == "simhash_near_dedup":
            for d in gone:
                mine = set(simhash.hashes(before[d]["text"], 5).tolist())
                assert any(len(mine & (o := set(simhash.hashes(before[k]["text"], 5).tolist()))) > 0.6 * len(mine | o) for k in before if k != d)
        else:
            assert not gone
            assert all(after[k]["text"] == secrets.redacted(before[k]["text"], secrets.spans(before[k]["text"])[1]) and after[k]["n_chars"] == len(after[k]["text"]) for k in after)
        docs = ready.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(ready, SMALL).count() > 0


def test_stages_handle_odd_and_empty_tables(ready, odd, none, tmp_path):
    ready.createDataFrame([(k, int(k == 7)) for k in range(1, 40)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, none):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(ready, docs, str(tmp_path))
            count = docs.count()
            assert (count > 0) == (table is odd), name
