"""Publish gates, conservation ledgers and checks of keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINIMUMS = {"chapters": 880, "passages": 40_000}


def gate(chapters: DataFrame, passages: DataFrame, vectors: DataFrame, model: str, *, minimums: dict[str, int] = MINIMUMS) -> DataFrame:
    """(check, value, wanted, ok): counts against minimums, a vector for every passage, one model."""
    counts = [
        chapters.agg(F.count("*").alias("value")).select(F.lit("chapters").alias("check"), "value", F.lit(minimums["chapters"]).cast("long").alias("wanted"), (F.col("value") >= minimums["chapters"]).alias("ok")),
        passages.agg(F.count("*").alias("value")).select(F.lit("passages").alias("check"), "value", F.lit(minimums["passages"]).cast("long").alias("wanted"), (F.col("value") >= minimums["passages"]).alias("ok")),
        passages.join(vectors, ["nbk_id", "passage_id"], "left_anti").agg(F.count("*").alias("value")).select(F.lit("passages without vector").alias("check"), "value", F.lit(0).cast("long").alias("wanted"), (F.col("value") == 0).alias("ok")),
        vectors.filter(F.col("model_name") != model).agg(F.count("*").alias("value")).select(F.lit("vectors of another model").alias("check"), "value", F.lit(0).cast("long").alias("wanted"), (F.col("value") == 0).alias("ok")),
    ]
    return reduce(DataFrame.unionAll, counts)


def exists(rows: DataFrame) -> DataFrame:
    """One row: whether there is any; a task stops at its first."""
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


def key_faults(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are null or not unique."""
    bad = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter(bad | (F.col("n") > 1))


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    return child.join(parent, list(on), "left_anti")


def outside_domain(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def ledger(audit: DataFrame) -> DataFrame:
    """Text accounted for in each document: captured + structural + skipped + unknown, and the share that isn't."""
    total = F.col("captured_text_chars") + F.col("structural_chars") + F.col("skipped_chars") + F.col("unknown_chars")
    lost = F.greatest(F.lit(0), F.col("body_text_chars") - total)
    return audit.withColumn("accounted_chars", total).withColumn("unaccounted_ratio", F.coalesce(F.try_divide(lost, F.col("body_text_chars")), F.lit(0.0)))


def role_histogram(passages: DataFrame, by: str = "nbk_id") -> DataFrame:
    """Passages of each role in a map, and the share of cross references."""
    per = passages.groupBy(by, "passage_role").agg(F.count("*").alias("n"))
    out = per.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("passage_role", "n")))).alias("roles"), F.sum(F.when(F.col("passage_role") == "cross_reference", F.col("n")).otherwise(0)).alias("x"), F.sum("n").alias("n"))
    return out.select(by, "roles", (F.col("x") / F.greatest(F.col("n"), F.lit(1))).alias("cross_reference_ratio"))


def set_difference(declared: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """Members that are missing, not declared, or of another digest; none if a bundle is whole."""
    a, b = declared.select(key, F.col(digest).alias("declared")), found.select(key, F.col(digest).alias("found"))
    return a.join(b, key, "full_outer").filter(~F.col("declared").eqNullSafe(F.col("found")))


def changed(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with a column taken from updates where it is another value (nulls compare); ``changed`` marks them."""
    new = updates.select(key, F.col(column).alias("_new"), F.lit(True).alias("_has"))
    joined = rows.join(new, key, "left")
    differs = F.coalesce("_has", F.lit(False)) & ~F.col(column).eqNullSafe(F.col("_new"))
    return joined.select(*[F.when(differs, F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns], differs.alias("changed"))
