"""Ranking quality, strata for benchmarks, close names, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.python import closeness_column, closest_column


def rank_metrics(queries: DataFrame, runs: DataFrame, *, by: str = "mode", query: str = "query_id") -> DataFrame:
    """P@1, MRR@5, Recall@5 and their mean for each mode.

    ``queries``: query, gold (id), golds (ids); ``runs``: mode, query, passage_id, rank. A query without
    a hit counts 0.
    """
    asked = queries.crossJoin(F.broadcast(runs.select(F.col(by).alias("_m")).distinct()))  # a row for each of a few modes
    top = runs.filter("rank <= 5").join(queries, query).groupBy(by, query).agg(
        F.min(F.when(F.col("passage_id") == F.col("gold"), F.col("rank"))).alias("r"), F.max(F.array_contains("golds", F.col("passage_id")).cast("int")).alias("any")
    )
    joined = asked.withColumnRenamed("_m", by).join(top, [by, query], "left")
    p1, mrr, rec = F.avg((F.coalesce(F.col("r"), F.lit(0)) == 1).cast("double")), F.avg(F.coalesce(F.lit(1.0) / F.col("r"), F.lit(0.0))), F.avg(F.coalesce(F.col("any"), F.lit(0)).cast("double"))
    out = joined.groupBy(by).agg(p1.alias("p_at_1"), mrr.alias("mrr_at_5"), rec.alias("recall_at_5"))
    return out.withColumn("composite", (F.col("p_at_1") + F.col("mrr_at_5") + F.col("recall_at_5")) / 3)


def document_metrics(runs: DataFrame, gold: DataFrame, query: str = "query_id") -> DataFrame:
    """MRR@10 by document and whether any of the first five is of the right section, averaged over all of ``gold``."""
    hit = runs.join(gold, query).groupBy(query).agg(F.min(F.when((F.col("rank") <= 10) & (F.col("nbk_id") == F.col("gold_doc")), F.col("rank"))).alias("r"), F.bool_or((F.col("rank") <= 5) & (F.col("nbk_id") == F.col("gold_doc")) & (F.col("chapter_section") == F.col("gold_section"))).alias("s"))
    return gold.join(hit, query, "left").agg(F.avg(F.coalesce(F.lit(1.0) / F.col("r"), F.lit(0.0))).alias("mrr_at_10"), F.avg(F.coalesce(F.col("s"), F.lit(False)).cast("double")).alias("section_precision_at_5"))


def buckets(runs: DataFrame, gold: DataFrame, modes: int, query: str = "query_id") -> DataFrame:
    """A: all modes have the gold passage in their first five; B: any has it in its first 50; else C.

    Queries and their hits grow with the input, which estimates of their size may not show: both joins are dealt out, none passes the driver.
    """
    hits = runs.join(gold.hint("merge"), query).filter(F.col("passage_id") == F.col("gold")).groupBy(query).agg(F.count_distinct(F.when(F.col("rank") <= 5, F.col("mode"))).alias("n"), F.min("rank").alias("r"))
    found = gold.join(hits.hint("merge"), query, "left")
    return found.select(query, F.when(F.coalesce("n", F.lit(0)) == modes, "A").when(F.col("r") <= 50, "B").otherwise("C").alias("bucket"))


def strata(rows: DataFrame, date: str, key: str, sample: int = 8, seed: int = 42) -> DataFrame:
    """Quartiles by date (the last takes what is left over), and a seeded sample of each: the smallest hashes.

    Positions come from counts per day, so that no task sorts all rows.
    """
    dated = rows.filter(F.col(date).isNotNull())
    per = dated.groupBy(date).agg(F.count("*").alias("_n"))
    # Windows over days, which are few: rows before each, and rows in all.
    every = Window.partitionBy()
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(every.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(every))
    in_day = F.row_number().over(Window.partitionBy(date).orderBy(key))
    placed = dated.join(before.select(date, "_before", "_total"), date).withColumn("_at", F.col("_before") + in_day - 1)
    quarter = F.expr("_total div 4")
    number = F.when(quarter == 0, F.lit(3)).otherwise(F.least(F.expr("_at").cast("long") / F.greatest(quarter, F.lit(1)), F.lit(3)).cast("int"))
    out = placed.withColumn("bucket", F.element_at(F.array(*[F.lit(b) for b in ("oldest_q", "old_mid", "new_mid", "newest_q")]), number + 1))
    # Filtered by rank, so that no task passes on more rows of a quarter than the sample has.
    w = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    drawn = out.select("bucket", key, F.row_number().over(w).alias("_r")).filter(F.col("_r") <= sample).select("bucket", key, F.lit(True).alias("_s"))
    return out.join(F.broadcast(drawn.distinct()), ["bucket", key], "left").select(*rows.columns, "bucket", F.coalesce("_s", F.lit(False)).alias("sampled"))


def close_names(names: DataFrame, wanted: str, *, name: str = "name", limit: int = 3, least: float = 70.0) -> DataFrame:
    """The names closest to a wish, from a similarity of ``least`` hundredths on."""
    scored = names.select(name).distinct().withColumn("score", closeness_column(wanted, name))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), name).limit(limit)


#: Wishes of a batch of close names: they go to every task.
WISHES = 1000


def close_names_batch(names: DataFrame, wanted: Sequence[str], *, name: str = "name", limit: int = 3, least: float = 70.0) -> DataFrame:
    """(wanted, name, score, rank): for each of up to ``WISHES`` wishes the names closest to it; names are compared once, where they are."""
    if not 0 < len(wanted) <= WISHES:
        raise ValueError(f"a batch has 1 to {WISHES} wishes")
    wishes = list(dict.fromkeys(wanted))
    near = names.select(F.col(name).alias("name")).distinct().select("name", F.explode(closest_column(wishes, "name", least)).alias("x"))
    ranked = near.select(F.element_at(F.array(*[F.lit(w) for w in wishes]), F.col("x.k") + 1).alias("wanted"), "name", F.col("x.score").alias("score"))
    w = Window.partitionBy("wanted").orderBy(F.desc("score"), "name")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def largest(rows: DataFrame, n: int, by: str = "nbk_id", size: str = "char_count", key: str = "passage_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(size), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


#: Steps of the grid of quantiles between which a median is looked for.
STEPS = 256


def median_latency(samples: DataFrame, by: str, value: str) -> DataFrame:
    """The sample at place n // 2 + 1 of each group, exactly; null samples come first.

    A mergeable sketch of quantiles, which is off by a ten-thousandth of the places at most, gives two samples between
    which the median has to lie. What is below is counted, and only samples between the two, about a hundredth of a group,
    are sorted: as counts by value, so that repeated ones are one row.
    """
    grid = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    seen = samples.groupBy(by).agg(F.count("*").alias("n"), F.count(value).alias("_some"), F.percentile_approx(value, grid, 10_000).alias("_q"))
    at = F.expr("n div 2 + 1 - (n - _some)")
    step = F.floor(F.lit(STEPS) * at / F.col("_some")).cast("int")
    low = F.get("_q", F.greatest(step - 1, F.lit(0)))
    high = F.get("_q", F.least(step + 2, F.lit(STEPS)))
    sought = seen.select(by, at.alias("_at"), F.when(at > 0, low).alias("_low"), F.when(at > 0, high).alias("_high"))
    # A row for each group is joined to its samples; nulls are a group too.
    met = samples.select(F.col(by).alias("_by"), F.col(value).alias("_v")).join(sought, F.col("_by").eqNullSafe(F.col(by)))
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    counts = met.filter(F.col("_low").isNotNull() & (F.col("_v") <= F.col("_high"))).groupBy(by, "_at", F.when(inside, F.col("_v")).alias("_v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_at")) & (F.col("_upto") - F.col("c") < F.col("_at")))
    none = sought.filter(F.col("_low").isNull()).select(by, F.lit(None).cast(samples.schema[value].dataType).alias("p50"))
    return found.select(by, F.col("_v").alias("p50")).unionByName(none)


def response_size(objects: DataFrame, text: str, by: str, *, objects_most: int = 10_000, text_most: int = 2 << 20, total_most: int = 8 << 20) -> DataFrame:
    """Objects, largest and total bytes of each response, and whether it keeps to the ceilings."""
    out = objects.groupBy(by).agg(F.count(text).alias("n_objects"), F.coalesce(F.max(F.octet_length(text)), F.lit(0)).alias("max_bytes"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("total_bytes"))
    return out.withColumn("within_limits", (F.col("n_objects") <= objects_most) & (F.col("max_bytes") <= text_most) & (F.col("total_bytes") <= total_most))
