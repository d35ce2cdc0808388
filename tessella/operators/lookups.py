"""Point and batch lookups, ordered neighbours, outlines and assembly of sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import expr as E


def by_ids(rows: DataFrame, ids: Sequence, key: str = "passage_id") -> DataFrame:
    """A row for each id, in their order and as often as given; missing ids have nulls and ``missing`` true."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    wanted = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], f"position int, {key} {kind}")
    known = rows.withColumn("_there", F.lit(True))
    return wanted.join(known, key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def for_pairs(rows: DataFrame, pairs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key (several columns) is in a list of keys."""
    return rows.join(pairs.select(*on).distinct(), list(on), "left_semi")


def missing(rows: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key isn't done yet, such as passages without a vector."""
    return rows.join(done.select(*on), list(on), "left_anti")


def with_chapters(passages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Passages with the columns of their chapter: title, dates, symbols and article; those without a chapter go.

    Chapters are few beside passages, but no bound is known: the plan sends them to every task only if they turn out small.
    """
    c = chapters.select("nbk_id", *[F.col(a).alias(b) for a, b in CHAPTER_COLUMNS.items() if a in chapters.columns])
    clash = [b for b in CHAPTER_COLUMNS.values() if b in passages.columns]
    return passages.drop(*clash).join(c, "nbk_id")


#: Columns of a chapter, and their names beside a passage's own.
CHAPTER_COLUMNS = {
    "title": "chapter_title", "pubmed_id": "pubmed_id", "authors": "authors", "initial_pub_date": "initial_pub_date", "last_updated_date": "chapter_last_updated",
    "gene_symbols": "gene_symbols", "primary_gene_symbols": "primary_gene_symbols", "omim_ids": "omim_ids",
}


def chapter_of(chapters: DataFrame, nbk_id: str | None = None, pubmed_id: str | None = None) -> DataFrame:
    """The chapter of a book id or of an article's number."""
    if (nbk_id is None) == (pubmed_id is None):
        raise ValueError("give a book id or an article's number")
    return chapters.filter(F.col("nbk_id") == nbk_id if nbk_id is not None else F.col("pubmed_id") == pubmed_id)


def passages_of(passages: DataFrame, nbk_id: str, section: str | None = None) -> DataFrame:
    """A document's passages in order, or those of one section."""
    out = passages.filter(F.col("nbk_id") == nbk_id)
    return (out if section is None else out.filter(F.col("chapter_section") == section)).orderBy("chunk_index")


def of_size(passages: DataFrame, least: int, most: int, role: str | None = None, chars: str = "char_count") -> DataFrame:
    """Passages from ``least`` to ``most`` characters, of a role."""
    out = passages.filter(F.col(chars).between(least, most))
    return out if role is None else out.filter(F.col("passage_role") == role)


def resolved_names(members: DataFrame, names: DataFrame, *, short: str = "short_name", key: str = "nbk_id", order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Members with the id of their short name, the last of a name listed twice; and those whose name isn't listed."""
    last = names.groupBy(short).agg(F.max_by(key, order).alias(key))
    met = members.join(last, short, "left")
    return met.filter(F.col(key).isNotNull()), met.filter(F.col(key).isNull()).drop(key)


def resolved_gene(chapters: DataFrame, gene: str, limit: int | None = None) -> DataFrame:
    """Documents that answer for a symbol: those that hold it and have an article, the latest first."""
    return documents_of(chapters.filter(F.coalesce("pubmed_id", F.lit("")) != ""), gene, limit)


def chapter_outline(chapters: DataFrame, passages: DataFrame, today: Column) -> DataFrame:
    """Each chapter with title, dates, its nine sections, tables and how stale it is."""
    o = outline(passages)
    each = F.struct("section_order", F.col("chapter_section").alias("section"), "passage_count", "total_chars", "token_estimate", "note")
    sections = o.groupBy("nbk_id").agg(F.array_sort(F.collect_list(each)).alias("sections"))
    none = F.array().cast("array<struct<chunk_index:int,table_id:string,caption:string>>")
    tables = table_index(passages) if {"passage_type", "table_data"} <= set(passages.columns) else passages.select("nbk_id", none.alias("tables"), F.lit(0).alias("table_count")).limit(0)
    out = chapters.select("nbk_id", "title", *[c for c in ("authors", "initial_pub_date", "last_updated_date") if c in chapters.columns]).join(sections, "nbk_id").join(tables, "nbk_id", "left")
    years = E.years_since("last_updated_date", today)
    out = out.withColumn("table_count", F.coalesce("table_count", F.lit(0))).withColumn("years_since_update", years)
    out = out.withColumn("staleness", E.staleness_band("years_since_update"))
    return out.withColumn("stale_for_therapy", E.stale_for_therapy("staleness", "sections"))


def after(rows: DataFrame, keys: Sequence[str], values: Sequence, limit: int) -> DataFrame:
    """The next rows of a keyset cursor: keys compared as one row value."""
    cursor = F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, values, strict=True)])
    return rows.filter(F.struct(*keys) > cursor).orderBy(*keys).limit(limit)


def windows(rows: DataFrame, before: int, behind: int, *, doc: str = "nbk_id", section: str | None = "chapter_section", order: str = "chunk_index", value: str = "passage_id") -> DataFrame:
    """For every row its neighbours (arrays in order) and whether there are more; within a section unless that is None."""
    if not (0 <= before <= 5 and 0 <= behind <= 5):
        raise ValueError("at most five neighbours on a side")
    w = Window.partitionBy(doc, *([section] if section else [])).orderBy(order)

    def side(first: int, last: int) -> Column:
        return F.collect_list(value).over(w.rowsBetween(first, last)) if first <= last else F.array().cast("array<string>")

    n_before = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    n_behind = F.count(F.lit(1)).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.select("*", side(-before, -1).alias("before"), side(1, behind).alias("after"), (n_before > before).alias("has_more_before"), (n_behind > behind).alias("has_more_after"))


def outline(passages: DataFrame, chars: str = "char_count") -> DataFrame:
    """The nine sections of every document, with counts and characters; sections without passages have 0."""
    sections = passages.sparkSession.createDataFrame([(n, s) for n, s in enumerate(C.SECTIONS)], "section_order int, chapter_section string")
    per = passages.groupBy("nbk_id", "chapter_section").agg(F.count("*").alias("passage_count"), F.coalesce(F.sum(chars), F.lit(0)).cast("long").alias("total_chars"))
    # Nine rows for each document: a bounded, fixed expansion.
    grid = passages.select("nbk_id").distinct().withColumn("_s", F.explode(F.lit(list(range(len(C.SECTIONS)))))).join(F.broadcast(sections), F.col("_s") == F.col("section_order"))
    out = grid.join(per, ["nbk_id", "chapter_section"], "left").select("nbk_id", "section_order", "chapter_section", F.coalesce("passage_count", F.lit(0)).cast("long").alias("passage_count"), F.coalesce("total_chars", F.lit(0)).cast("long").alias("total_chars"))
    note = F.when((F.col("chapter_section") == "summary") & (F.col("passage_count") == 0), "not extracted")
    return out.withColumn("token_estimate", F.expr("total_chars div 4")).withColumn("note", note)


def table_index(passages: DataFrame) -> DataFrame:
    """Every document's tables in order, and how many."""
    t = passages.filter("passage_type = 'table'").groupBy("nbk_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "table_id", F.coalesce("table_data.caption", F.lit("")).alias("caption")))).alias("tables"))
    return t.withColumn("table_count", F.size("tables"))


def table_of(passages: DataFrame, doc: str, table_id: str) -> DataFrame:
    d = F.col("table_data")
    empty = F.array().cast("array<string>")
    return passages.filter((F.col("nbk_id") == doc) & (F.col("table_id") == table_id) & (F.col("passage_type") == "table")).select("nbk_id", "table_id", F.coalesce(d["caption"], F.lit("")).alias("caption"), F.coalesce(d["header"], empty).alias("header"), F.coalesce(d["rows"], F.array().cast("array<array<string>>")).alias("rows"), F.coalesce(d["footnotes"], F.lit("")).alias("footnotes"))


def assembled(passages: DataFrame, *, dedupe: bool = True, by: Sequence[str] = ("nbk_id", "chapter_section")) -> DataFrame:
    """The text of every section: passages in order, overlaps taken out, or joined by blank lines. A section has to fit a task."""
    parts = passages.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("parts"))
    return parts.select(*by, F.size("parts").alias("n_parts"), (E.without_overlap("parts") if dedupe else F.array_join("parts", "\n\n")).alias("text"))


def within_budget(rows: DataFrame, most: int, *, doc: str, order: Sequence[Column], text: str = "text") -> DataFrame:
    """Texts in order, cut where a document's budget of characters is used up."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(most) - used).cast("int")
    return rows.withColumn("_left", left).withColumn("kept", F.left(F.col(text), F.col("_left"))).withColumn("truncated", F.length(text) > F.col("_left")).drop("_left")


def section_order(section: Column) -> list[Column]:
    """Summary, diagnosis, management, then the others by name."""
    return [F.when(section == "summary", 0).when(section == "diagnosis", 1).when(section == "management", 2).otherwise(3), section]


def documents_of(chapters: DataFrame, gene: str, limit: int | None = None) -> DataFrame:
    """Documents that hold a symbol, the latest first, those without a date last."""
    out = chapters.filter(F.array_contains("gene_symbols", gene)).orderBy(F.desc_nulls_last("last_updated_date"), "nbk_id")
    return out if limit is None else out.limit(limit)


def defining(chapters: DataFrame) -> DataFrame:
    """(symbol, nbk_id, title): for every symbol the document it defines, if any.

    A document qualifies if the symbol is primary, its only one, or a word of the title; of those the
    primary ones come first, then fewest symbols, newest, smallest id.
    """
    each = chapters.withColumn("symbol", F.explode("gene_symbols"))
    primary = F.coalesce(F.array_contains("primary_gene_symbols", F.col("symbol")), F.lit(False))
    word = F.regexp_like("title", F.concat(F.lit(r"(?iU)\b\Q"), F.col("symbol"), F.lit(r"\E\b")))
    fit = each.withColumn("_p", primary).filter(F.col("_p") | (F.size("gene_symbols") == 1) | F.coalesce(word, F.lit(False)))
    w = Window.partitionBy("symbol").orderBy(F.desc("_p"), F.size("gene_symbols"), F.desc_nulls_last("last_updated_date"), "nbk_id")
    return fit.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("symbol", "nbk_id", "title")


def primary_symbols(title: Column, symbols: Column) -> Column:
    """Symbols that are words of a title, letters in either case."""
    return F.filter(symbols, lambda g: F.regexp_like(F.upper(title), F.concat(F.lit(r"(?U)\b\Q"), F.upper(g), F.lit(r"\E\b"))))


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values of a key in the order of their first appearance."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("values"))


def first_unless_given(rows: DataFrame, key: str, value: str, order: str, given: DataFrame) -> DataFrame:
    """The first value of a key, unless an authoritative table (key, value, order) has one: then its last."""
    first = rows.groupBy(key).agg(F.min_by(value, order).alias("_first"))
    last = given.groupBy(key).agg(F.max_by(value, order).alias("_given"))
    return first.join(last, key, "full_outer").select(key, F.coalesce("_given", "_first").alias(value))


def distinct_items(rows: DataFrame, array: str) -> DataFrame:
    return rows.select(F.explode(array).alias("item")).filter("item is not null").distinct()


def matched_sections(sections: Sequence[str], wanted: str | None) -> list[str]:
    """Sections that a comma-separated wish means: by alias, by name, as a part of a name, or else the closest name."""
    from ..functions.python import ratio

    aliases = {"mgmt": "management", "tx": "management", "rx": "management", "dx": "diagnosis", "diag": "diagnosis", "cf": "clinical_features", "molgen": "molecular_genetics", "counseling": "genetic_counseling", "refs": "references"}
    wishes = [w.strip().lower() for w in (wanted or "").split(",") if w.strip()]
    if not wishes:
        return list(sections)
    out: list[str] = []
    for wish in wishes:
        name = aliases.get(wish, wish)
        hits = [s for s in sections if s == name] + [s for s in sections if name in s.lower() and s != name]
        if not hits and sections:
            best = max(sections, key=lambda s: (ratio(name, s), -list(sections).index(s)))
            hits = [best] if ratio(name, best) >= 70 else []
        out += [h for h in hits if h not in out]
    return out


def worklist(chapters: DataFrame, passages: DataFrame, least: int = 3) -> DataFrame:
    """Chapters with passages in at least so many sections: nbk_id, title, last_updated_date and how many sections are filled.

    Passages are counted by chapter and section first; chapters meet only these counts.
    """
    filled = passages.groupBy("nbk_id", "chapter_section").agg(F.count("*").alias("n")).groupBy("nbk_id").agg(F.count_distinct(F.when(F.col("n") > 0, F.col("chapter_section"))).alias("populated_sections"))
    kept = filled.filter(F.col("populated_sections") >= least)
    return chapters.join(kept, "nbk_id").select(*[c for c in ("nbk_id", "title", "last_updated_date", "gene_symbols") if c in chapters.columns], "populated_sections")
