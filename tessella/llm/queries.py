"""The registered queries of the operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, secrets, sql
from .chat import formatted, read_back
from .codebooks import compressed
from .common import table
from .contamination import measure
from .divergence import audited
from .exactcopies import copies
from .lines import deduplicated
from .nearcopies import classes
from .pieces import tokenized
from .toxicity import fit, scored
from .urls import judged
from .vectors import near_vectors

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses.scanned(docs)
    return out.select("doc_id", F.concat_ws(",", "licenses").alias("licenses"), "n_matches", F.concat_ws(",", "matches").alias("matches"), "coverage")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenized(docs, PIECE_MODEL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = measure(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "longest_match", *[F.col(f"longest.{c}").alias(f"longest_{c}") for c in ("words", "at", "item", "item_at")])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: A conversation that holds the template's own control strings.
CONFLICT = """
SELECT CAST(c AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS turn, role, text
FROM VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]') AS v(c, n, role, text)
"""


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONFLICT))
    return read_back(formatted(rows))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digested(secrets.scanned(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


#: Fixed values of the contract.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_license_scan, op3_sentencepiece, op4_benchmark_decontamination, op5_line_dedup, op6_chat_formatting, op7_minhash_near_dedup, op8_secret_scan, op9_url_filter, op10_toxicity, op11_exact_dedup, op12_vector_codes, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": sql.CHAT, "op9_url_filter": sql.URLS, "op11_exact_dedup": sql.COPIES, "op12_vector_codes": sql.CODES, "op13_source_divergence": sql.DIVERGENCE}
