"""The test tables seen as a corpus: documents are passages, their sources chapters, their languages sections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections that languages stand for, and roles that ids stand for.
SECTION_OF = {"en": "summary", "fr": "management", "de": "diagnosis", "es": "references"}
ROLE_OF = ("evidence", "cross_reference", "definition", "table_caption", "table_body")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def section(lang: Column) -> Column:
    out = F.lit("other")
    for k, v in SECTION_OF.items():
        out = F.when(lang == k, v).otherwise(out)
    return out


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nbk_id, passage_id, chapter_section, passage_role, text, char_count, chunk_index."""
    d = table(spark, sf_dir, "documents")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLE_OF]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(F.col("source").alias("nbk_id"), F.col("doc_id").alias("passage_id"), section(F.col("lang")).alias("chapter_section"), role.alias("passage_role"), "text", F.col("n_chars").alias("char_count"), F.col("doc_id").alias("chunk_index"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), "embedding")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of ordered chunks."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("nbk_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("chapter_section"), "text", F.length("text").alias("char_count"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as chapters; every third has no article, every fifth no date."""
    c = table(spark, sf_dir, "customer")
    day = F.when(F.col("c_custkey") % 5 != 0, F.date_add(F.lit(date(1990, 1, 1)), (F.col("c_custkey") % 3600).cast("int")))
    article = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string"))
    return c.select(F.col("c_custkey").alias("nbk_id"), F.col("c_name").alias("title"), article.alias("pubmed_id"), F.array("c_mktsegment").alias("gene_symbols"), F.array("c_mktsegment").alias("primary_gene_symbols"), day.alias("last_updated_date"))


#: The same views in DuckDB.
PASSAGES_SQL = """
SELECT source AS nbk_id, doc_id AS passage_id,
  CASE lang WHEN 'en' THEN 'summary' WHEN 'fr' THEN 'management' WHEN 'de' THEN 'diagnosis' WHEN 'es' THEN 'references' ELSE 'other' END AS chapter_section,
  (['evidence', 'cross_reference', 'definition', 'table_caption', 'table_body'])[CAST(doc_id % 5 + 1 AS INT)] AS passage_role,
  text, n_chars AS char_count, doc_id AS chunk_index
FROM documents
"""
CHUNKS_SQL = "SELECT conv_id AS nbk_id, turn AS chunk_index, role AS chapter_section, text, length(text) AS char_count FROM conversations"
CHAPTERS_SQL = "SELECT c_custkey AS nbk_id, c_name AS title, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS pubmed_id, c_mktsegment AS gene, CASE WHEN c_custkey % 5 <> 0 THEN DATE '1990-01-01' + CAST(c_custkey % 3600 AS INT) END AS day FROM customer"
