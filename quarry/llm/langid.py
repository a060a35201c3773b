"""Language identification by error-correcting output codes.

Features of a text are its byte 3-grams and 4-grams (lower case), hashed to ``BUCKETS``; the square roots of their
counts, scaled to length one. Each language has a codeword, and a linear classifier predicts each bit of it. Up to seven languages have the exhaustive code,
more have random words of which the best set of several draws is taken. Decoding is weighted by loss: a bit
costs a language the logistic loss of its prediction, weighted by how often the bit's classifier was right
for that language in learning. The cheapest codeword wins; the score is its share in the softmax of the negative costs, and a text whose
two cheapest words are closer than ``MARGIN`` is flagged as ambiguous.

The classifiers are learned on the driver from a bounded sample: at most ``FIT_ROWS`` rows, spread evenly over all
languages there are, or ``LEAST_ROWS`` a language where that is more, chosen by hash of the id; one row for each id. No
language is left out. Prediction reads whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is all if nothing could be learned.
Rows without an id are not held out and not learned from. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import crc32_of, tidy

BUCKETS = 1 << 13
FIT_ROWS, LEAST_ROWS = 4000, 8
STEPS, RATE, PENALTY, SEED, MARGIN = 150, 20.0, 1e-5, 3, 0.5

_LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    for s in range(0, len(raw), 1 << 18):  # a very long text in parts that overlap by three bytes
        part = raw[s : s + (1 << 18) + 3]
        three = part[:-2] * np.uint32(0x9E3779B1) + part[1:-1] * np.uint32(0x85EBCA77) + part[2:] * np.uint32(0xC2B2AE3D)
        four = three[:-1] * np.uint32(0x27D4EB2F) + part[3:] * np.uint32(0x165667B1)
        more = s + (1 << 18) < len(raw)
        ends = (len(three) - 1 if more else len(three)), len(four)
        for grams, end in zip((three, four), ends, strict=True):
            out += np.bincount((grams[:end] * np.uint32(0x9E3779B1)) >> np.uint32(19), minlength=BUCKETS)
    return out


def features(c: np.ndarray) -> np.ndarray:
    x = np.sqrt(c, dtype=np.float32)
    norm = np.sqrt(np.float32(c.sum()))
    return x / norm if norm else x


def code(n: int) -> np.ndarray:
    """n codewords of -1 and 1."""
    if n <= 7:
        words = [w for w in product((-1, 1), repeat=n - 1) if 1 in w] if n > 1 else []
        return np.array([[-1] * len(words), *zip(*words, strict=True)], np.int8).reshape(n, -1)
    rng = np.random.default_rng(SEED)
    length = int(np.ceil(10 * np.log2(n)))
    drawn = [rng.choice([-1, 1], (n, length)).astype(np.int8) for _ in range(50)]
    near = [min((a != b).sum() for k, a in enumerate(m) for b in m[:k]) for m in drawn]
    return drawn[int(np.argmax(near))]


class Model:
    def __init__(self, languages: list[str], words: np.ndarray, weight: np.ndarray, constant: np.ndarray, trust: np.ndarray):
        self.languages, self.words, self.weight, self.constant, self.trust = languages, words, weight, constant, trust

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = features(counts(text)) @ self.weight + self.constant
        cost = (self.trust * np.logaddexp(0, -self.words * margin)).sum(1)
        order = np.argsort(cost, kind="stable")
        share = np.exp(cost[order[0]] - cost)
        gap = (cost[order[1]] - cost[order[0]]) * 1.0
        return self.languages[order[0]], float(1 / share.sum()), bool(gap < MARGIN)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    words = code(len(languages))
    bits = words.shape[1]
    weight, constant = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    target = words[y].astype(np.float32)
    kind = (1 / np.maximum(1, np.bincount(y, minlength=len(languages))))[y].astype(np.float32)  # languages weigh alike
    kind /= kind.sum()
    speed = np.zeros_like(weight)
    for _ in range(STEPS if bits else 0):
        margin = x @ weight + constant
        error = -target / (1 + np.exp(np.clip(target * margin, -30, 30))) * kind[:, None]
        speed = 0.9 * speed - RATE * (x.T @ error + PENALTY * weight)
        weight += speed
        constant -= RATE * 0.1 * error.sum(0)
    right = (np.sign(x @ weight + constant) == target).astype(np.float64)
    trust = np.array([right[y == k].mean(0) if (y == k).any() else np.ones(bits) for k in range(len(languages))]).reshape(len(languages), bits)
    trust /= np.maximum(trust.sum(1, keepdims=True), 1e-9)
    return Model(languages, words, weight, constant, trust * bits)


def learn(docs: DataFrame) -> Model:
    """From docs (doc_id, text, lang) outside the held-out part."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).where(crc32_of("doc_id") % 3 != 1)
    sizes = [(r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    languages = sorted(name for name, _ in sizes)
    each = max(FIT_ROWS // max(1, len(languages)), LEAST_ROWS)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("places", pa.binary()), ("n", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, numbers = [], []
            for t in b.column(1):
                c = counts(t.as_py())
                there = np.flatnonzero(c)
                places.append(there.astype(np.uint16).tobytes())
                numbers.append(c[there].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())], schema=schema)

    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros((0, 0)))
    # first by chance, twice as many as are needed; then exactly, among these few
    order = F.xxhash64("doc_id")
    shares = docs.sparkSession.createDataFrame(sizes, "lang string, n bigint")  # a row a language: the driver holds them anyway
    likely = known.join(F.broadcast(shares), "lang").where(F.pmod(order, F.lit(1 << 30)) < (F.least(F.lit(1.0), (2 * each + 20) / F.col("n")) * (1 << 30)).cast("bigint"))
    likely = likely.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.pmod(order, F.lit(1 << 30)), "doc_id")
    chosen = likely.withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).select("doc_id", "text", "lang")
    got = sorted(chosen.mapInArrow(tidy(work), "doc_id bigint, lang string, places binary, n binary").toLocalIterator(), key=lambda r: (r["doc_id"], r["lang"], r["places"]))
    number = {name: k for k, name in enumerate(languages)}
    x = np.zeros((len(got), BUCKETS), np.float32)
    for k, r in enumerate(got):
        c = np.zeros(BUCKETS, np.int64)
        c[np.frombuffer(bytes(r["places"]), np.uint16)] = np.frombuffer(bytes(r["n"]), np.uint32)
        x[k] = features(c)
    y = np.array([number[r["lang"]] for r in got], np.int64)
    return fit(x, y, languages)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous for docs (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(work), "doc_id bigint, lang_pred string, score double, ambiguous boolean")
