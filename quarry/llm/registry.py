"""The queries of this subpackage: opN_<name> over the whole intended table, and DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, embeddings, exact, langid, packing, pii, secrets, simhash, toxicity, warc
from quarry.llm.common import Tables, need, prepare, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return need(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = need(table(spark, sf_dir, "pages"), page_id="bigint", url="string", html="string")
    path = Tables(spark, "warc").path("archive")
    warc.write(pages, path)
    return warc.read(spark, path)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, need(table(spark, sf_dir, "labels"), doc_id="bigint", toxic="int"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return embeddings.near_groups(need(table(spark, sf_dir, "embeddings"), vec_id="bigint", embedding="array<double>"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir), shingle=3, lanes=1, distance=2)
    return found.select("doc_id", simhash.hex_fingerprint("f0").alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = need(table(spark, sf_dir, "documents"), doc_id="bigint", text="string", lang="string")
    found = langid.predict(docs, langid.learn(docs))
    return found.select("doc_id", toxicity.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return exact.decide(docs).select("doc_id", *exact.RESULT)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(documents(spark, sf_dir))


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


SQL_OP7 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), r AS (
  SELECT doc_id, n,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_warc_round_trip": op2_warc_round_trip,
        "op3_toxicity": op3_toxicity,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_language_id": op6_language_id,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_pii_surrogates": op8_pii_surrogates,
        "op9_hilbert_packing": op9_hilbert_packing,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": SQL_OP7}
