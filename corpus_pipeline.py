"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Documents taken for toxic go; lines that repeat across documents stay once; one document of each
near-duplicate class stays; contaminated documents go; what is left is encoded and decoded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import contamination, lines, nearcopies, pieces, toxicity
from tessella.llm.common import checkpoint_dir, deleted, table
from tessella.llm.queries import PIECE_MODEL

#: Spark's limit of an Arrow batch by bytes, and what the stages take.
BATCH_LIMIT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"


def in_short_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with texts sent to Python workers in short batches.

    By default a batch has up to 10,000 rows or 64 MB. Its buffers lie beside an executor's heap and once more
    in each worker, and several stages in one application leave little room there. The limit is read when the
    stage's result is written, so that it stays set in the session; results don't depend on it.
    """

    @wraps(stage)
    def limited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_LIMIT, BATCH)
        return stage(spark, docs, sf_dir)

    return limited


@in_short_batches
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


@in_short_batches
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicated(docs)


@in_short_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@in_short_batches
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pieces.tokenized(docs.select("doc_id", "text"), PIECE_MODEL)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``; what a stage has written goes once the next has read it.

    Null, empty and very long texts, repeated rows and ids, and more columns are handled as each stage's
    operator says: null and empty texts stay to the end, of repeated rows one stays. An empty table gives
    an empty one. The session's own limit of batches is put back.
    """
    limit = spark.conf.get(BATCH_LIMIT, None)
    try:
        return staged(spark, sf_dir)
    finally:
        spark.conf.set(BATCH_LIMIT, limit) if limit is not None else spark.conf.unset(BATCH_LIMIT)


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{at}/{k}-{name}")
        if before:
            deleted(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
