"""The corpus pipeline: toxicity, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of ``documents``.
Between stages the rows are written as Parquet and read again.

Defined results: an empty table gives no rows at any stage. Null texts count as empty, and null they stay; other columns
may be null and keep their values. Columns besides those of ``documents``, whatever their names, pass through all stages
but the last. Rows without an id stay unless toxic or an exact copy of a row with one. Repeated rows are copies: where one
id has one text several times, the rows share their decision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact, packing, secrets, simhash, toxicity
from quarry.llm.common import Tables, need, prepare, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go. Null and empty texts have the score of the model's constant."""
    prepare(spark)
    labels = need(table(spark, sf_dir, "labels"), doc_id="bigint", toxic="int")
    return toxicity.drop_toxic(docs, toxicity.learn(need(docs, doc_id="bigint", text="string"), labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then that of the smallest id. Null and empty texts are equal."""
    return exact.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: shingles of five words, a Jaccard similarity
    of at least 0.8, tested exactly on what SimHash's index finds. Texts without words are copies of each other; rows without
    an id stay."""
    prepare(spark)
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, with the length of the new text."""
    prepare(spark)
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, in the order of a space-filling curve. Null and empty texts are one end-of-text id."""
    prepare(spark)
    return packing.pack(need(docs, doc_id="bigint", text="string"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]
#: Classifier, fingerprints, tokens: SQL can't express them. tests/llm has a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.keep(docs, name)
            if k:
                tables.drop(STAGES[k - 1][0])
    return docs
