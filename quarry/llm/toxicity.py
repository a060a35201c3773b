"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words (letters only, lower case) and their beginnings of 4, 5 and 6 letters, hashed to
``BUCKETS``. The machine scores the set of terms: a weight for each, and for each pair the product of their factors, so
that a pair (an insult and who it is aimed at) can weigh other than its parts. Learning:

* a bounded sample of labelled rows, ``POSITIVE`` and ``NEGATIVE`` at most, the first by hash of the id; weights
  bring the sample back to the shares that all labelled rows have;
* of the terms in at least ``LEAST`` of its texts, the ``TERMS`` with the largest chi-squared statistic, counted by Spark;
* logistic loss, Adagrad over small batches, on the driver, which gets a bit for each of these terms and each text:
  ``TERMS`` / 8 bytes a row, whatever the texts' lengths.

Scoring reads whole texts, one at a time, and knows nothing but the text.

Defined results: null and empty texts have no terms and get the score of the constant alone. Without labelled rows of both kinds the
model is that constant, the smoothed share of toxic rows (a third if there are no labels at all). Rows without an id are never learned from and not held out.
Labels that are null are no labels; of repeated labels the largest counts. Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Tables, crc32_of, tidy, trim

BUCKETS = 1 << 20
POSITIVE, NEGATIVE = 2500, 5000
LEAST, TERMS, FACTORS = 5, 2048, 8
EPOCHS, BATCH, RATE, PENALTY, SEED = 30, 64, 0.05, 1e-4, 5

_WORD = re.compile(r"[^\W\d_]+")


def term_ids(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    parts = [f"={word}", *(word[:k] for k in (4, 5, 6) if len(word) >= k)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class Model:
    def __init__(self, constant: float, terms: np.ndarray, weight: np.ndarray, factor: np.ndarray):
        self.constant, self.terms, self.weight, self.factor = constant, terms, weight, factor
        self.place: dict[int, int] | None = None

    def __getstate__(self):
        return (self.constant, self.terms, self.weight, self.factor)

    def __setstate__(self, s):
        self.__init__(*s)

    def margin(self, places: np.ndarray) -> float:
        """Of a text that has the terms at these places."""
        if not len(places):
            return self.constant
        v = self.factor[places]
        total = v.sum(0)
        return float(self.constant + self.weight[places].sum() + 0.5 * (total @ total - (v * v).sum()))

    def prepared(self) -> dict[str, tuple[int, ...]]:
        self.place = {int(t): k for k, t in enumerate(self.terms)}
        return {}

    def scores(self, texts: list[str | None], known: dict[str, tuple[int, ...]]) -> list[float]:
        """known: places of the terms of words seen before."""
        out = []
        for t in texts:
            found: set[int] = set()
            for w in set(_WORD.findall(t.lower())) if t else ():
                p = known.get(w)
                if p is None:
                    p = known[w] = tuple(self.place[x] for x in term_ids(w) if x in self.place)
                if p:
                    found.update(p)
            m = self.margin(np.array(sorted(found), np.int64))
            out.append(1 / (1 + math.exp(-m)) if m > -500 else 0.0)
            if len(known) > 200_000:
                known.clear()
        return out


def held_out(key: str, parts: int = 5, remainder: int = 0) -> Column:
    return F.coalesce(crc32_of(key) % parts == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """(text, y) of the rows to learn from, and how many labelled rows there are of either kind."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(crc32_of("doc_id") % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y")).withColumn("y", (F.col("y") > 0).cast("int"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"))
    chosen = known.where("y = 1").orderBy(order, "doc_id").limit(POSITIVE).unionByName(known.where("y = 0").orderBy(order, "doc_id").limit(NEGATIVE))
    rows = docs.join(F.broadcast(chosen), "doc_id")  # at most POSITIVE + NEGATIVE rows
    return rows.select("doc_id", "text", "y"), counts.get(1, 0), counts.get(0, 0)


def terms_of(text: str | None) -> np.ndarray:
    """The distinct term ids of a text."""
    return np.unique(np.array([x for w in set(_WORD.findall((text or "").lower())) for x in term_ids(w)], np.uint32))


def chosen_terms(rows: DataFrame) -> np.ndarray:
    """The terms to learn with, counted by Spark: only these come to the driver. rows (doc_id, text, y)."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64()), ("toxic", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms_of(t.as_py()) for t in b.column(0)]
            every, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *found]), return_counts=True)
            toxic = np.zeros(len(every), np.int64)
            for t, y in zip(found, b.column(1).to_pylist(), strict=True):
                if y:
                    toxic[np.searchsorted(every, t)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(every.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(toxic)], schema=schema)

    share = rows.agg(F.avg("y")).first()[0]
    if share is None or not 0 < share < 1:
        return np.zeros(0, np.int64)
    n, toxic = F.col("n"), F.col("toxic")
    counted = rows.select("text", "y").mapInArrow(tidy(work), "term bigint, n bigint, toxic bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    chi = (toxic - n * share) * (toxic - n * share) / (n * share * (1 - share))
    best = counted.where(n >= LEAST).select("term", chi.alias("chi")).where("chi > 0").orderBy(F.desc("chi"), "term").limit(TERMS)
    return np.sort(np.array([r["term"] for r in best.select("term").collect()], np.int64))


def collected(rows: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the chosen terms each text has (a bit for each), and its label, in the order of the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("there", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.packbits(np.isin(chosen, terms_of(t.as_py()), assume_unique=True)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], schema=schema)

    got = sorted(((r["doc_id"], r["y"], bytes(r["there"])) for r in rows.select("doc_id", "text", "y").mapInArrow(tidy(work), "doc_id bigint, y int, there binary").toLocalIterator()))
    x = np.array([np.unpackbits(np.frombuffer(t, np.uint8), count=len(chosen)) for _, _, t in got], np.uint8).reshape(len(got), len(chosen))
    return x, np.array([y for _, y, _ in got], np.float64)


def fit(terms: list[np.ndarray], y: np.ndarray, positive: int, negative: int) -> Model:
    """From texts' term ids that are at hand."""
    every, n = np.unique(np.concatenate(terms), return_counts=True)
    toxic = np.zeros(len(every))
    for t, label in zip(terms, y, strict=True):
        if label:
            toxic[np.searchsorted(every, t)] += 1
    share = y.mean()
    chi = (toxic - n * share) ** 2 / (n * share * (1 - share)) * np.where(n >= LEAST, 1, 0)
    best = np.argsort(-chi, kind="stable")[:TERMS]
    chosen = np.sort(every[best[chi[best] > 0]]).astype(np.int64)
    x = np.zeros((len(y), len(chosen)), np.uint8)
    for k, t in enumerate(terms):
        x[k, np.isin(chosen, t, assume_unique=True)] = 1
    return trained(chosen, x, y, positive, negative)


def trained(chosen: np.ndarray, x: np.ndarray, y: np.ndarray, positive: int, negative: int) -> Model:
    """The machine for texts (rows of x) that have the chosen terms or not."""
    constant = math.log((positive + 1) / (negative + 2))
    if not len(y) or y.min() == y.max():
        return Model(constant, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(len(chosen)), 0.01 * rng.standard_normal((len(chosen), FACTORS))
    kind = np.where(y > 0, positive / max(1, y.sum()), negative / max(1, (1 - y).sum()))
    kind *= len(y) / kind.sum()
    g0, gw, gv = 1e-8, np.full(len(chosen), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(y), BATCH):
            rows = order[s : s + BATCH]
            xb = x[rows].astype(np.float64)
            total = xb @ v
            margin = constant + xb @ w + 0.5 * ((total**2).sum(1) - xb @ (v**2).sum(1))
            error = kind[rows] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            d0, dw = error.sum(), xb.T @ error + PENALTY * w
            dv = xb.T @ (error[:, None] * total) - (xb.T @ error)[:, None] * v + PENALTY * v
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            constant -= RATE * d0 / math.sqrt(g0)
            w -= RATE * dw / np.sqrt(gw)
            v -= RATE * dv / np.sqrt(gv)
    return Model(float(constant), chosen, w, v)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows, positive, negative = sample(docs, labels)
    tables = Tables(docs.sparkSession, "toxicity")
    rows = tables.keep(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")), "sample")  # one row for each id
    chosen = chosen_terms(rows)
    model = trained(chosen, *collected(rows, chosen), positive, negative)
    tables.drop("sample")
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs (narrow: an id and the text) with column score."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.prepared()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist(), known), pa.float64())], schema=schema)

    return docs.select("doc_id", text).mapInArrow(tidy(work), "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't call toxic, all columns."""

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model.prepared()
        yield from (pd.Series([s < 0.5 for s in model.scores(b.tolist(), known)], dtype=bool) for b in batches)
        trim()

    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(clean, "boolean")(F.col(f"`{text}`")))
