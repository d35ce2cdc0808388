"""Registered queries of the retrieval engine, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import expr as E
from ..functions import lexical, python, wordpiece
from ..operators import chunks as chunking
from ..operators import cells, evaluate, lookups, postings, quality, search
from ..session import shared_folder
from ..sources import pages as html
from . import details  # noqa: F401  (registers its queries)
from .model import CHAPTERS_SQL, CHUNKS_SQL, PASSAGES_SQL, chapters, chunks, passages, table, vectors
from .registry import oracle_sql, queries, query  # noqa: F401

# Search ----------------------------------------------------------------------------------------------------

#: Words that occur in the test prose; two of them say what the query is after.
QUESTION = "management that with this from prevention"
TERMS = ["management", "that", "with", "this", "from", "prevention"]
_TERMS_SQL = "['management', 'that', 'with', 'this', 'from', 'prevention']"
TODAY = date(2000, 1, 1)


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query's vector: the one stored for id 0 (a single row)."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]]


_LEXICAL = f"""
p AS ({PASSAGES_SQL}),
w AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM p),
n AS (SELECT *, list_transform({_TERMS_SQL}, lambda t: len(list_filter(ws, lambda x: x = t))) AS ns FROM w),
r AS (SELECT nbk_id, passage_id, chapter_section, passage_role, text, char_count, chunk_index,
  len(list_filter(range(1, greatest(len(ws) - 5, 1) + 1), lambda k: ws[k:k+5] = {_TERMS_SQL})) * 0.1 AS phrase_rank,
  list_min(ns) * 0.1 AS strict_rank, list_sum(ns) * 0.1 AS recall_rank, len(list_filter(ns, lambda x: x > 0)) AS recall_overlap_count FROM n),
s AS (SELECT *, (phrase_rank * 3.0 + strict_rank * 2.0 + recall_rank) * CASE WHEN phrase_rank = 0 AND strict_rank = 0 AND recall_rank > 0 AND recall_overlap_count <= 2
  THEN least(1.0, greatest(0.25, char_count / 400.0)) ELSE 1.0 END AS lexical_rank FROM r WHERE recall_overlap_count >= 2)
"""
_DENSE = """
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
d AS (SELECT passage_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) AS dense_score FROM p JOIN embeddings ON vec_id = passage_id)
"""


_HYBRID = f"""WITH {_LEXICAL}, {_DENSE},
l AS (SELECT passage_id, lexical_rank FROM s ORDER BY lexical_rank DESC, nbk_id, passage_id LIMIT 200),
e AS (SELECT * FROM d WHERE dense_score IS NOT NULL ORDER BY dense_score DESC, passage_id LIMIT 200),
c AS (SELECT p.*, coalesce(l.lexical_rank, 0.0) AS lexical_rank, e.dense_score,
  CASE chapter_section WHEN 'summary' THEN 0 WHEN 'diagnosis' THEN 0 WHEN 'management' THEN 1 WHEN 'other' THEN 7 WHEN 'references' THEN 50 ELSE 100 END AS pri
  FROM (SELECT coalesce(l.passage_id, e.passage_id) AS id FROM l FULL OUTER JOIN e ON l.passage_id = e.passage_id) i JOIN p ON p.passage_id = i.id LEFT JOIN l ON l.passage_id = i.id LEFT JOIN e ON e.passage_id = i.id),
a AS (SELECT *, row_number() OVER (ORDER BY lexical_rank DESC, pri, nbk_id, passage_id) AS lexical_position, chapter_section = 'references' AS guarded FROM c),
b AS (SELECT *, CASE WHEN dense_score IS NOT NULL AND NOT guarded THEN row_number() OVER (PARTITION BY dense_score IS NOT NULL AND NOT guarded ORDER BY dense_score DESC, lexical_position) END AS dense_position FROM a),
f AS (SELECT *, CASE WHEN NOT guarded THEN 1.0 / (60 + lexical_position) + coalesce(1.0 / (60 + dense_position), 0.0) END AS rrf_score FROM b),
g AS (SELECT *, rrf_score * CASE passage_role WHEN 'cross_reference' THEN 0.4 WHEN 'definition' THEN 0.95 WHEN 'table_caption' THEN 0.85 ELSE 1.0 END * (1.0 + CASE WHEN chapter_section = 'management' THEN 0.3 ELSE 0.0 END) AS adjusted_score FROM f)
SELECT position, passage_id, nbk_id, chapter_section, round(lexical_rank, 6) AS lexical_rank, round(dense_score, 6) AS dense_score, lexical_position, dense_position, round(rrf_score, 6) AS rrf_score, round(adjusted_score, 6) AS adjusted_score
FROM (SELECT *, row_number() OVER (ORDER BY guarded, adjusted_score DESC NULLS LAST, rrf_score DESC NULLS LAST, CASE WHEN NOT guarded THEN dense_score END DESC NULLS LAST, CASE WHEN guarded THEN lexical_position END, pri, nbk_id, passage_id) AS position FROM g) WHERE position <= 20"""


def _shown(out: DataFrame) -> DataFrame:
    return out.select("position", "passage_id", "nbk_id", "chapter_section", *[F.round(c, 6).alias(c) for c in ("lexical_rank", "dense_score")], "lexical_position", "dense_position", *[F.round(c, 6).alias(c) for c in ("rrf_score", "adjusted_score")])


@query(_HYBRID)
def hybrid_search_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.search(passages(spark, sf_dir), vectors(spark, sf_dir), QUESTION, _vector(spark, sf_dir), limit=20))


@query(_HYBRID)
def indexed_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored postings of plain words, which are written first."""
    p = passages(spark, sf_dir)
    index = postings.created(spark, shared_folder(spark), kind="plain")
    index.add(p, unique=True)
    return _shown(search.search(p, vectors(spark, sf_dir), QUESTION, _vector(spark, sf_dir), limit=20, index=index))


@query(f"WITH {_LEXICAL} SELECT passage_id, nbk_id, round(CAST(lexical_rank AS DOUBLE), 6) AS lexical_rank, recall_overlap_count FROM s WHERE chapter_section IN ('summary', 'management') ORDER BY lexical_rank DESC, nbk_id, passage_id LIMIT 50")
def lexical_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    within = search.Filters(sections=("summary", "management")).apply(passages(spark, sf_dir))
    out = search.lexical_top(search.term_ranks(within, TERMS), len(TERMS), search.depth("off", 16))
    return out.select("passage_id", "nbk_id", F.round("lexical_rank", 6).alias("lexical_rank"), "recall_overlap_count")


@query(f"WITH {_LEXICAL} SELECT passage_id, recall_overlap_count, round(CAST(recall_rank AS DOUBLE), 6) AS recall_rank FROM r WHERE recall_overlap_count >= 2")
def recall_term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.term_ranks(passages(spark, sf_dir), TERMS).filter(E.enough_overlap(F.col("recall_overlap_count"), F.lit(len(TERMS))))
    return out.select("passage_id", "recall_overlap_count", F.round("recall_rank", 6).alias("recall_rank"))


_DENSE_TOP = f"WITH p AS ({PASSAGES_SQL}), {_DENSE} SELECT passage_id, round(dense_score, 6) AS dense_score FROM d ORDER BY d.dense_score DESC, passage_id LIMIT 200"


@query(_DENSE_TOP)
def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.dense_top(passages(spark, sf_dir), vectors(spark, sf_dir), _vector(spark, sf_dir), search.DEPTH)
    return out.select("passage_id", F.round("dense_score", 6).alias("dense_score"))


@query(_DENSE_TOP)
def indexed_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from stored cells, which are trained and filed first; the test vectors have no clusters, so that all cells are read."""
    v = passages(spark, sf_dir).select("nbk_id", "passage_id").join(vectors(spark, sf_dir), "passage_id").select("nbk_id", "passage_id", "embedding")
    index = cells.trained(v, shared_folder(spark))
    index.add(v)
    return index.top(_vector(spark, sf_dir), search.DEPTH, exact=True).rows.select("passage_id", F.round("dense_score", 6).alias("dense_score"))


@query(f"WITH {_LEXICAL}, {_DENSE}, x AS (SELECT s.passage_id AS a, e.passage_id AS b FROM s FULL OUTER JOIN (SELECT * FROM d WHERE dense_score >= 0) e ON s.passage_id = e.passage_id) SELECT coalesce(a, b) AS passage_id, a IS NOT NULL AS lexical, b IS NOT NULL AS dense FROM x")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    n = F.lit(len(TERMS))
    found = search.term_ranks(p, TERMS).filter(E.enough_overlap(F.col("recall_overlap_count"), n)).select("passage_id", F.lit(True).alias("l"))
    q = F.array(*[F.lit(x) for x in _vector(spark, sf_dir)])
    dense = p.select("passage_id").join(vectors(spark, sf_dir), "passage_id").filter(E.cosine("embedding", q) >= 0).select("passage_id", F.lit(True).alias("d"))
    return found.join(dense, "passage_id", "full_outer").select("passage_id", F.coalesce("l", F.lit(False)).alias("lexical"), F.coalesce("d", F.lit(False)).alias("dense"))


_BATCH = """
WITH q AS (SELECT item_id AS query_index, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains(
  ['a','an','the','and','or','of','in','is','it','to','for','on','at','be','as','by','do','up','if','no','so','we','he','she','they','you','our','are','was','not','but','has','had','its','can','may','who','how','all','one','two'], w))) AS ts FROM benchmark WHERE item_id < 5),
t AS (SELECT query_index, len(ts) AS size, unnest(ts) AS w FROM q),
c AS (SELECT source AS nbk_id, doc_id AS passage_id, w, count(*) AS n FROM (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY ALL),
s AS (SELECT query_index, size, nbk_id, passage_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS overlap FROM c JOIN t USING (w) GROUP BY query_index, size, nbk_id, passage_id),
h AS (SELECT query_index, nbk_id, passage_id, overlap, round(n * CAST(0.1 AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY query_index ORDER BY n DESC, nbk_id, passage_id) AS rank FROM s WHERE overlap >= greatest(1, ceil(size * 0.25)) QUALIFY rank <= 10)
"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The reference takes 1 to 5 searches in a batch, and this is one batch; batch_ranks has no such limit.
    asked = table(spark, sf_dir, "benchmark").filter("item_id < 5").select(F.col("item_id").alias("query_index"), F.col("text").alias("query"))
    return search.batch_ranks(passages(spark, sf_dir), asked).withColumn("score", F.round("score", 6))


@query(f"{_BATCH} SELECT * FROM h")
def multi_query_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir)


@query(f"{_BATCH}, m AS (SELECT passage_id, list_sort(list(query_index)) AS every FROM h GROUP BY passage_id) SELECT query_index, passage_id, CASE WHEN len(every) > 1 AND query_index <> every[1] THEN array_to_string(list_filter(every, lambda x: x <> query_index), ',') END AS also_matched FROM h JOIN m USING (passage_id)")
def cross_query_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.also_matched(_batch(spark, sf_dir).select("query_index", "passage_id"))
    return out.withColumn("also_matched", F.array_join(F.transform("also_matched", lambda x: x.cast("string")), ","))


@query("SELECT item_id, array_to_string(list_sort(list_filter([CASE WHEN contains(l, 'managing') OR contains(l, 'therapy') OR contains(l, 'prevent') OR contains(l, 'management') OR contains(l, 'treatment') OR contains(l, 'surgery') OR contains(l, 'prophylactic') OR contains(l, 'risk-reducing') OR contains(l, 'screening') OR contains(l, 'surveillance') OR contains(l, 'intervention') THEN 'management' END, CASE WHEN contains(l, 'diagnosis') OR contains(l, 'diagnostic criteria') OR contains(l, 'establishing') OR contains(l, 'confirming') OR contains(l, 'differential') THEN 'diagnosis' END, CASE WHEN contains(l, 'inheritance') OR contains(l, 'penetrance') OR contains(l, 'autosomal') OR contains(l, 'x-linked') OR contains(l, 'variant spectrum') OR contains(l, 'molecular genetics') THEN 'genetics' END], lambda x: x IS NOT NULL)), ',') AS intents FROM (SELECT item_id, lower(text || CASE item_id % 4 WHEN 0 THEN ' Managing therapy' WHEN 1 THEN ' autosomal diagnosis' WHEN 2 THEN ' penetrance' ELSE '' END) AS l FROM benchmark)")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.element_at(F.array(F.lit(" Managing therapy"), F.lit(" autosomal diagnosis"), F.lit(" penetrance"), F.lit("")), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(E.query_intents(F.concat("text", more)), ",").alias("intents"))


@query("SELECT doc_id, n_chars FROM documents WHERE text ILIKE '%ing th%' AND text ILIKE '%an_ %'")
def ilike_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter(search.contains_pattern("text", "ing th") & search.contains_pattern("text", "an_ ")).select("doc_id", "n_chars")


@query("WITH g AS (SELECT n_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS a, list_sort(list(DISTINCT CASE WHEN c_acctbal < 0 THEN c_mktsegment END) FILTER (c_acctbal < 0)) AS b FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey) SELECT n_nationkey, 'primary' AS gene_role FROM g WHERE list_contains(b, 'BUILDING') UNION ALL SELECT n_nationkey, 'mentioned' FROM g WHERE list_contains(a, 'BUILDING') AND NOT coalesce(list_contains(b, 'BUILDING'), false) UNION ALL SELECT n_nationkey, 'any' FROM g WHERE list_contains(a, 'BUILDING')")
def entity_role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy("n_nationkey").agg(F.collect_set("c_mktsegment").alias("gene_symbols"), F.collect_set(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))).alias("primary_gene_symbols"))
    parts = [g.filter(search.gene_filter("BUILDING", r)).select("n_nationkey", F.lit(r).alias("gene_role")) for r in ("primary", "mentioned", "any")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Lookups ---------------------------------------------------------------------------------------------------


@query("SELECT conv_id AS nbk_id, turn AS chunk_index, array_to_string(list(turn) OVER (a ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ',') AS before, array_to_string(list(turn) OVER (a ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), ',') AS after, count(*) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2 AS has_more_before, count(*) OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > 1 AS has_more_after FROM conversations WINDOW a AS (PARTITION BY conv_id ORDER BY turn)")
def passage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookups.windows(chunks(spark, sf_dir), 2, 1, section=None, value="chunk_index")
    join = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return out.select("nbk_id", "chunk_index", join("before"), join("after"), "has_more_before", "has_more_after")


@query("SELECT conv_id AS nbk_id, turn AS chunk_index, role AS chapter_section, lag(turn) OVER a AS before, lead(turn) OVER a AS after FROM conversations WINDOW a AS (PARTITION BY conv_id, role ORDER BY turn)")
def passage_window_in_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookups.windows(chunks(spark, sf_dir), 1, 1, value="chunk_index")
    return out.select("nbk_id", "chunk_index", "chapter_section", F.get("before", F.lit(0)).alias("before"), F.get("after", F.lit(0)).alias("after"))


@query(f"""WITH p AS ({PASSAGES_SQL}), s AS (SELECT unnest(range(9)) AS section_order, unnest(['summary', 'diagnosis', 'clinical_features', 'management', 'genetic_counseling', 'molecular_genetics', 'resources', 'other', 'references']) AS chapter_section),
a AS (SELECT nbk_id, chapter_section, count(*) AS n, sum(char_count) AS c FROM p GROUP BY ALL)
SELECT nbk_id, CAST(section_order AS INT) AS section_order, chapter_section, coalesce(n, 0) AS passage_count, CAST(coalesce(c, 0) AS BIGINT) AS total_chars, CAST(coalesce(c, 0) // 4 AS BIGINT) AS token_estimate, CASE WHEN chapter_section = 'summary' AND n IS NULL THEN 'not extracted' END AS note FROM (SELECT DISTINCT nbk_id FROM p) CROSS JOIN s LEFT JOIN a USING (nbk_id, chapter_section)""")
def outline_fixed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.outline(passages(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_rows_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), ["doc_id"])


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) IN (SELECT item_id, item_id % 3 FROM benchmark)")
def rowvalue_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conv_id"), (F.col("item_id") % 3).alias("turn"))
    return lookups.for_pairs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), pairs, ["conv_id", "turn"])


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) > (3, 1) ORDER BY conv_id, turn LIMIT 25")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return lookups.after(c, ["conv_id", "turn"], [F.lit(3).cast("long"), F.lit(1).cast("long")], 25)


@query("SELECT i.position, i.doc_id, lang, n_chars, d.doc_id IS NULL AS missing FROM (SELECT unnest([0, 1, 2, 3, 4]) AS position, unnest([5, 2, 5, 999999999, 0]) AS doc_id) i LEFT JOIN documents d ON d.doc_id = i.doc_id")
def batch_lookup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return lookups.by_ids(d, [5, 2, 5, 999_999_999, 0], "doc_id")


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS item FROM part")
def distinct_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.distinct_items(table(spark, sf_dir, "part").withColumn("a", F.split("p_name", " ")), "a")


@query("SELECT k AS n_nationkey, array_to_string(list(v ORDER BY o), '|') AS segments FROM (SELECT c_nationkey AS k, c_mktsegment AS v, min(c_custkey) AS o FROM customer GROUP BY ALL) GROUP BY k")
def ordered_distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookups.ordered_distinct(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")
    return out.select(F.col("c_nationkey").alias("n_nationkey"), F.array_join("values", "|").alias("segments"))


@query("SELECT coalesce(a.k, b.k) AS nation, coalesce(b.v, a.v) AS name FROM (SELECT c_nationkey AS k, arg_min(c_name, c_custkey) AS v FROM customer GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, arg_max(s_name, s_suppkey) AS v FROM supplier GROUP BY 1) b ON a.k = b.k")
def first_wins_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_custkey").alias("o"))
    given = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("o"))
    return lookups.first_unless_given(first, "nation", "name", "o", given)


@query("WITH c AS (SELECT p_partkey AS nbk_id, p_name AS title, p_type, p_brand, list_sort(list_distinct([split_part(p_name, ' ', 1), p_brand])) AS g FROM part), e AS (SELECT unnest(g) AS symbol, * FROM c), f AS (SELECT * FROM e WHERE len(g) = 1 OR regexp_matches(title, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(symbol) || '([^A-Za-z0-9_]|$)')) SELECT symbol, nbk_id, title FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY len(g), nbk_id) = 1")
def defining_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    c = p.select(F.col("p_partkey").alias("nbk_id"), F.col("p_name").alias("title"), F.array_distinct(F.array(F.split("p_name", " ")[0], F.col("p_brand"))).alias("gene_symbols"), F.array().cast("array<string>").alias("primary_gene_symbols"), F.lit(None).cast("date").alias("last_updated_date"))
    return lookups.defining(c)


@query("SELECT o_custkey AS nbk_id, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_custkey, o_orderkey LIMIT 30")
def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("gene_symbols", F.array("o_orderstatus")).withColumnRenamed("o_orderdate", "last_updated_date")
    out = o.filter(F.array_contains("gene_symbols", "F")).orderBy(F.desc_nulls_last("last_updated_date"), "o_custkey", "o_orderkey").limit(30)
    return out.select(F.col("o_custkey").alias("nbk_id"), "o_orderkey", F.col("last_updated_date").alias("o_orderdate"))


@query(f"WITH c AS ({CHUNKS_SQL}), u AS (SELECT *, coalesce(sum(char_count) OVER (PARTITION BY nbk_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c) SELECT nbk_id, chunk_index, sha256(left(text, CAST(greatest(0, 1000 - used) AS INT))) AS kept_sha256, char_count > greatest(0, 1000 - used) AS truncated FROM u")
def budget_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookups.within_budget(chunks(spark, sf_dir), 1000, doc="nbk_id", order=[F.col("chunk_index")])
    return out.select("nbk_id", "chunk_index", F.sha2("kept", 256).alias("kept_sha256"), "truncated")


@query(f"WITH c AS ({CHUNKS_SQL}) SELECT nbk_id, chapter_section, CAST(count(*) AS INT) AS n_parts, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY chunk_index)) AS text_sha256 FROM c GROUP BY ALL")
def section_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.assembled(chunks(spark, sf_dir), dedupe=False).select("nbk_id", "chapter_section", "n_parts", F.sha2("text", 256).alias("text_sha256"))


@query()
def section_assembly_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 300 characters that overlap by 60, put together again; tests hold it against a loop."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("nbk_id"), "text")
    cut = d.select("nbk_id", F.lit("all").alias("chapter_section"), F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 240).cast("int")), lambda k: F.substr("text", k * 240 + 1, F.lit(300)))).alias("chunk_index", "text"))
    return lookups.assembled(cut).select("nbk_id", "n_parts", F.sha2("text", 256).alias("text_sha256"))


# Aggregates and gates --------------------------------------------------------------------------------------


@query("SELECT source, count(DISTINCT CASE WHEN n_chars > 1000 THEN lang END) AS long_langs, count(*) AS n FROM documents GROUP BY source HAVING count(DISTINCT CASE WHEN n_chars > 1000 THEN lang END) >= 3")
def having_distinct_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct(F.when(F.col("n_chars") > 1000, F.col("lang"))).alias("long_langs"), F.count("*").alias("n"))
    return out.filter("long_langs >= 3")


@query("WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () // 4 AS q FROM orders WHERE o_orderdate IS NOT NULL) SELECT bucket, count(*) AS n, min(o_orderkey) AS least, max(o_orderdate) AS latest FROM (SELECT *, (['oldest_q', 'old_mid', 'new_mid', 'newest_q'])[CAST(CASE WHEN q = 0 THEN 3 ELSE least(pos // q, 3) END + 1 AS INT)] AS bucket FROM o) GROUP BY bucket")
def quartile_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.strata(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    return s.groupBy("bucket").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderdate").alias("latest"))


@query("SELECT passage_role, count(*) AS n FROM (SELECT (['evidence', 'cross_reference', 'definition', 'table_caption', 'table_body'])[CAST(doc_id % 5 + 1 AS INT)] AS passage_role FROM documents) GROUP BY 1")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).groupBy("passage_role").agg(F.count("*").alias("n"))


@query(f"WITH p AS ({PASSAGES_SQL}) SELECT nbk_id, round(sum(CASE WHEN passage_role = 'cross_reference' THEN 1 ELSE 0 END) / count(*), 6) AS cross_reference_ratio, CAST(sum(CASE WHEN passage_role = 'evidence' THEN 1 END) AS BIGINT) AS evidence FROM p GROUP BY nbk_id")
def role_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.role_histogram(passages(spark, sf_dir))
    return out.select("nbk_id", F.round("cross_reference_ratio", 6).alias("cross_reference_ratio"), F.try_element_at("roles", F.lit("evidence")).alias("evidence"))


@query("SELECT 'chapters' AS \"check\", count(DISTINCT source) AS value, 10 AS wanted, count(DISTINCT source) >= 10 AS ok FROM documents UNION ALL SELECT 'passages', count(*), 100, count(*) >= 100 FROM documents UNION ALL SELECT 'passages without vector', count(*), 0, count(*) = 0 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'vectors of another model', count(*), 0, count(*) = 0 FROM embeddings WHERE label = 9")
def metrics_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), F.when(F.col("label") == 9, "other").otherwise("m").alias("model_name"))
    v = e.join(p.select("nbk_id", "passage_id"), "passage_id", "left")
    return quality.gate(p.select("nbk_id").distinct(), p, v, "m", minimums={"chapters": 10, "passages": 100})


@query("SELECT d.doc_id FROM labels d WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.orphans(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"), ["doc_id"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_faults(table(spark, sf_dir, "lineitem").select("l_orderkey"), ["l_orderkey"])


@query("WITH a AS (SELECT doc_id AS k, quality AS d FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS k, toxic AS f FROM labels WHERE doc_id % 3 <> 1) SELECT coalesce(a.k, b.k) AS doc_id, d AS declared, f AS found FROM a FULL OUTER JOIN b ON a.k = b.k WHERE d IS DISTINCT FROM f")
def manifest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return quality.set_difference(lab.filter("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("h")), lab.filter("doc_id % 3 <> 1").select("doc_id", F.col("toxic").alias("h")), "doc_id", "h")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE n_regionkey + n_nationkey % 3 END AS n_regionkey, n_nationkey % 2 = 1 AND n_nationkey % 3 <> 0 AS changed FROM nation")
def idempotent_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    new = n.filter("n_nationkey % 2 = 1").select("n_nationkey", (F.col("n_regionkey") + F.col("n_nationkey") % 3).alias("n_regionkey"))
    return quality.changed(n, new, "n_nationkey", "n_regionkey")


@query("SELECT conv_id, count(text) AS n_objects, max(strlen(text)) AS max_bytes, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes, count(text) <= 4 AND max(strlen(text)) <= 2000 AND sum(strlen(text)) <= 4000 AS within_limits FROM conversations GROUP BY conv_id")
def response_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.response_size(table(spark, sf_dir, "conversations"), "text", "conv_id", objects_most=4, text_most=2000, total_most=4000)


@query("SELECT event_type, value AS p50 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = n // 2 + 1")
def latency_p50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.median_latency(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT source AS nbk_id, doc_id AS passage_id, n_chars AS char_count FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def largest_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.largest(passages(spark, sf_dir).select("nbk_id", "passage_id", "char_count"), 3)


_RUNS = "SELECT m.mode, l.doc_id AS query_id, (l.doc_id * (7 + m.k) + r.rank * (1 + l.quality)) % 23 AS passage_id, r.rank FROM labels l, (SELECT unnest(['lexical', 'off', 'rrf']) AS mode, unnest([1, 2, 4]) AS k) m, (SELECT unnest(range(1, 11)) AS rank) r"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Made ranked lists for three modes, and their gold passages, from the labels."""
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "query_id")
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(k).alias("k")) for m, k in (("lexical", 1), ("off", 2), ("rrf", 4))])).alias("m")
    runs = lab.select("query_id", "quality", modes).select("query_id", "quality", "m.*", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank"))
    runs = runs.select("mode", "query_id", ((F.col("query_id") * (7 + F.col("k")) + F.col("rank") * (1 + F.col("quality"))) % 23).alias("passage_id"), "rank")
    gold = lab.select("query_id", (F.col("query_id") % 23).alias("gold"), F.array(F.col("query_id") % 23, (F.col("query_id") + 1) % 23).alias("golds"))
    return runs, gold


@query(f"WITH r AS ({_RUNS}), q AS (SELECT doc_id AS query_id, doc_id % 23 AS gold, (doc_id + 1) % 23 AS second FROM labels), h AS (SELECT mode, query_id, min(CASE WHEN passage_id = gold THEN rank END) AS f, max(CASE WHEN passage_id IN (gold, second) THEN 1 ELSE 0 END) AS s FROM r JOIN q USING (query_id) WHERE rank <= 5 GROUP BY ALL), m AS (SELECT mode, avg(CASE WHEN f = 1 THEN 1.0 ELSE 0.0 END) AS p1, avg(coalesce(1.0 / f, 0.0)) AS mrr, avg(s) AS rec FROM h GROUP BY mode) SELECT mode, round(p1, 6) AS p_at_1, round(mrr, 6) AS mrr_at_5, round(rec, 6) AS recall_at_5, round((p1 + mrr + rec) / 3, 6) AS composite FROM m")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, gold = _runs(spark, sf_dir)
    out = evaluate.rank_metrics(gold, runs)
    return out.select("mode", *[F.round(c, 6).alias(c) for c in ("p_at_1", "mrr_at_5", "recall_at_5", "composite")])


@query(f"WITH r AS ({_RUNS}), q AS (SELECT doc_id AS query_id, doc_id % 23 AS gold FROM labels), h AS (SELECT query_id, count(DISTINCT CASE WHEN rank <= 5 THEN mode END) AS n, min(rank) AS best FROM r JOIN q USING (query_id) WHERE passage_id = gold GROUP BY 1) SELECT query_id, CASE WHEN n = 3 THEN 'A' WHEN best <= 50 THEN 'B' ELSE 'C' END AS bucket FROM q LEFT JOIN h USING (query_id)")
def bench_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, gold = _runs(spark, sf_dir)
    return evaluate.buckets(runs, gold.select("query_id", "gold"), 3)


@query(f"WITH r AS (SELECT * FROM ({_RUNS}) WHERE mode = 'rrf'), h AS (SELECT query_id, min(CASE WHEN rank <= 10 AND passage_id % 7 = query_id % 7 THEN rank END) AS f, bool_or(rank <= 5 AND passage_id % 7 = query_id % 7 AND passage_id % 2 = query_id % 2) AS s FROM r GROUP BY 1) SELECT round(avg(coalesce(1.0 / f, 0.0)), 6) AS mrr_at_10, round(avg(CASE WHEN s THEN 1.0 ELSE 0.0 END), 6) AS section_precision_at_5 FROM h")
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, gold = _runs(spark, sf_dir)
    runs = runs.filter("mode = 'rrf'").withColumn("nbk_id", F.col("passage_id") % 7).withColumn("chapter_section", F.col("passage_id") % 2)
    gold = gold.select("query_id", (F.col("query_id") % 7).alias("gold_doc"), (F.col("query_id") % 2).alias("gold_section"))
    return evaluate.document_metrics(runs, gold).select(*[F.round(c, 6).alias(c) for c in ("mrr_at_10", "section_precision_at_5")])


# Scalar functions ------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{200b}-\x{200d}\x{202a}-\x{202e}\x{2060}\x{2066}-\x{2069}\x{feff}]', '', 'g')) AS clean_sha256, sha256(text) AS raw_sha256 FROM documents")
def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = E.fence("text", "documents", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", fenced.alias("f")).select("doc_id", F.sha2("f.text", 256).alias("clean_sha256"), F.col("f.raw_sha256").alias("raw_sha256"))


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents")
def text_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(r"WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), c AS (SELECT *, regexp_replace(left(t, 200), '\s+$', '') AS cut FROM s), b AS (SELECT *, regexp_extract(cut, '(?s)^(.*) [^ ]*$', 1) AS head FROM c) SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN length(head) > 100 THEN regexp_replace(head, '\s+$', '') || '…' ELSE cut || '…' END AS snippet FROM b")
def leading_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", E.leading_excerpt("text", 200).alias("snippet"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.lit("")).alias("title"))


@query(r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&[a-zA-Z0-9#]+;', '', 'g'), '[\x{a0}\x{2009}\x{202f}]', ' ', 'g'), '\s+', ' ', 'g'), '(?i)\s*(Show details|Hide details)\s*', '', 'g'))) AS text_sha256 FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(E.html_text("html"), 256).alias("text_sha256"))


@query()
def html_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, metadata and sections of every page; tests hold the reader against hand-made pages."""
    out = html.scraped(table(spark, sf_dir, "pages").select("page_id", "html"))
    return out.select("page_id", "title", "authors", "update_info", "last_updated", "n_references", F.size("sections").alias("n_sections"))


@query(r"SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), '[-\s]+', '_', 'g'), '^(the_|a_|an_)', ''), '(_section|_chapter)$', ''), 50) AS section_key FROM pages")
def section_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", E.section_key("url").alias("section_key"))


_TITLES = ["Summary of it", "References", "Resources for you", "Genetic Counseling", "Molecular  Genetics", "Pathogenic variant list", "Differential Diagnosis", "Clinical Features", "Establishing the Diagnosis", "Treatment of Manifestations", "Nomenclature", ""]


@query("SELECT item_id, title, CASE WHEN regexp_matches(title, '(?i)^\\s*summary\\b') THEN 'summary' WHEN regexp_matches(title, '(?i)^\\s*references?\\b') THEN 'references' WHEN regexp_matches(title, '(?i)^\\s*resources\\b') THEN 'resources' WHEN regexp_matches(title, '(?i)genetic\\s+counsel') THEN 'genetic_counseling' WHEN regexp_matches(title, '(?i)molecular\\s+genetics|pathogenic\\s+variants?') THEN 'molecular_genetics' WHEN regexp_matches(title, '(?i)differential\\s+diagnos|clinical\\s+(description|characteristics|features)') THEN 'clinical_features' WHEN regexp_matches(title, '(?i)diagnos') THEN 'diagnosis' WHEN regexp_matches(title, '(?i)^\\s*(treatment|surveillance|management|therapy|prevention)\\b') THEN 'management' ELSE 'other' END AS section FROM (SELECT item_id, (" + str(_TITLES) + ")[CAST(item_id % 12 + 1 AS INT)] AS title FROM benchmark)")
def canonical_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (F.col("item_id") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", title.alias("title"), E.canonical_section(title).alias("section"))


@query("SELECT conv_id, turn, CASE WHEN role = 'system' THEN CASE WHEN length(text) <= 2 * 20 + 50 THEN 'table_caption' ELSE 'table_body' END WHEN length(text) <= 200 AND (regexp_matches(lower(text), '\\bsee\\s+') OR contains(lower(text), 'for details') OR contains(lower(text), 'refer to ') OR contains(lower(text), 'for more information') OR contains(lower(text), 'described in')) THEN 'cross_reference' WHEN length(text) <= 120 AND regexp_matches(text, '^[A-Za-z0-9_][A-Za-z0-9_\\s\\-/()]{0,40}:\\s+\\S') THEN 'definition' ELSE 'evidence' END AS passage_role FROM (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN 'See here for details.' WHEN 1 THEN 'Term: ' || CAST(conv_id AS VARCHAR) ELSE regexp_replace(text, '[^ -~]', 'x', 'g') END AS text FROM conversations)")
def role_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, "See here for details.").when(F.col("turn") % 3 == 1, F.concat(F.lit("Term: "), F.col("conv_id").cast("string"))).otherwise(F.regexp_replace("text", "[^ -~]", "x"))
    c = table(spark, sf_dir, "conversations").withColumn("text", text)
    role = E.passage_role("text", F.lit("A > Related"), F.when(F.col("role") == "system", "table").otherwise("narrative"), F.length("text"), F.lit("twenty characters ..."[:20]))
    return c.select("conv_id", "turn", role.alias("passage_role"))


@query("SELECT o_orderkey, years, CASE WHEN years < 2 THEN 'current' WHEN years < 4 THEN 'aging' WHEN years < 7 THEN 'stale' WHEN years IS NOT NULL THEN 'very_stale' END AS band FROM (SELECT o_orderkey, round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') / 365.25, 1) + 0.0 AS years FROM orders)")
def staleness_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = E.years_since(F.col("o_orderdate").cast("date"), F.lit(TODAY))
    return table(spark, sf_dir, "orders").select("o_orderkey", years.alias("years")).withColumn("band", E.staleness_band("years"))


@query("SELECT o_orderkey, 'NBK' || o_custkey || '. Updated ' || coalesce(strftime(d, '%Y-%m-%d'), 'date n/a') || '. Passage NBK' || o_custkey || ':' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.' AS citation, 'https://www.ncbi.nlm.nih.gov/books/NBK' || o_custkey || '/' AS url FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS d FROM orders)")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(F.lit("NBK"), F.col("o_custkey").cast("string"))
    day = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.citation(doc, day, E.passage_id(doc, F.col("o_orderkey") % 10000)).alias("citation"), E.source_url(doc).alias("url"))


@query("SELECT p_partkey, CASE WHEN s IS NULL THEN raw ELSE 'NBK' || CASE WHEN ltrim(s, '0') = '' THEN '0' ELSE ltrim(s, '0') END END AS nbk_id FROM (SELECT p_partkey, raw, nullif(regexp_extract(raw, '^NBK([0-9]+)$', 1), '') AS s FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE '' END || 'NBK' || repeat('0', CAST(p_partkey % 3 AS INT)) || CAST(p_partkey % 50 AS VARCHAR) AS raw FROM part))")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(""), F.lit("NBK"), F.expr("repeat('0', cast(p_partkey % 3 as int))"), (F.col("p_partkey") % 50).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", E.canonical_id(raw).alias("nbk_id"))


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents), s AS (SELECT doc_id, ws, len(ws) AS n, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 510 THEN [0] ELSE range(0, CAST(ceil((len(ws) - 510) / 460.0) AS BIGINT) * 460 + 1, 460) END) AS f FROM w) SELECT doc_id, CAST(f // 460 AS INT) AS chunk, CAST(f AS INT) AS first, sha256(array_to_string(ws[f + 1:f + 510], ' ')) AS window_sha256 FROM s")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("ws"))
    return chunking.chunked(d, "ws").select("doc_id", "chunk", "first", F.sha2(F.array_join("window", " "), 256).alias("window_sha256"))


#: Pieces of single letters and digits, and the commonest words of the lexicon's own lists.
LETTERS = ["[UNK]", *[f"{mark}{chr(c)}" for mark in ("", "##") for c in (*range(97, 123), *range(48, 58))], *C.ENGLISH_STOP_WORDS[:40]]
LETTERS = list(dict.fromkeys(LETTERS))


@query()
def wordpiece_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of tokens of all texts, cut from the source; tests hold them against the tokens of each text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = wordpiece.windows(d, LETTERS, size=chunking.SIZE, overlap=chunking.OVERLAP)
    return out.select("doc_id", "chunk", "first", "n_tokens", "begin", "end", F.sha2("window", 256).alias("window_sha256"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN '| k | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) END AS body, r_regionkey % 2 = 0 AS even FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])).alias("rows"))
    rows = F.when(F.col("r_regionkey") % 2 == 0, F.col("rows")).otherwise(F.concat("rows", F.array(F.array(F.lit("short")))))
    header = F.array(F.lit("k"), F.lit("n"))
    whole = E.markdown_table(F.lit("Nations"), header, rows, F.lit(""))
    return n.select("r_regionkey", F.substr(whole, F.lit(len("Nations\n\n") + 1)).alias("body"), E.table_cells(F.lit("table"), header, rows).isNotNull().alias("even"))


# What SQL doesn't have --------------------------------------------------------------------------------------


@query()
def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase, strict and recall rank over stems; tests hold the parts against hand-made documents."""
    ranks = lexical.text_rank_column(lexical.parse('"that thing" with -idiot'), "text")
    return table(spark, sf_dir, "documents").select("doc_id", ranks.alias("r")).select("doc_id", "r.*")


@query()
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked fragments of the first hits of a search."""
    top = search.settled(search.lexical_top(search.term_ranks(passages(spark, sf_dir), TERMS), len(TERMS), 20))
    n, most = lexical.snippet_limits(400)
    return top.select("passage_id", lexical.headline_column(lexical.parse(QUESTION), "text", fragments=n, most=most).alias("snippet"))


@query()
def cover_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments around the covers of a phrase in all texts that hold one of its words; tests hold them against enumerated covers."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").filter(F.lower("text").contains("disgusting") | F.lower("text").contains("idiot"))
    n, most = lexical.snippet_limits(400)
    return texts.select("doc_id", lexical.cover_headline_column(lexical.parse("disgusting idiot"), "text", fragments=n, most=most).alias("snippet"))


@query()
def embed_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic vectors for passages that have none."""
    todo = lookups.missing(passages(spark, sf_dir).select("passage_id", "text"), vectors(spark, sf_dir), ["passage_id"])
    v = todo.select("passage_id", python.made_vectors(E.table_for_embedding("text"), 384).alias("e"))
    return v.select("passage_id", F.size("e").alias("dim"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256 FROM documents")
def nfc_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(python.nfc("text"), 256).alias("nfc_sha256"))


@query()
def close_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nation names closest to a misspelt one."""
    return evaluate.close_names(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "NATION_07")


@query("SELECT doc_id, chapter_section, row_number() OVER (PARTITION BY chapter_section ORDER BY doc_id) AS position FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'summary' WHEN 'fr' THEN 'management' WHEN 'de' THEN 'diagnosis' ELSE 'references' END AS chapter_section FROM documents WHERE doc_id % 5 = 2 UNION SELECT doc_id, CASE lang WHEN 'en' THEN 'summary' WHEN 'fr' THEN 'management' WHEN 'de' THEN 'diagnosis' ELSE 'references' END FROM documents WHERE n_chars > 2000)")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    both = p.filter("passage_role = 'definition'").select("passage_id", "chapter_section").union(p.filter("char_count > 2000").select("passage_id", "chapter_section")).distinct()
    return both.select(F.col("passage_id").alias("doc_id"), "chapter_section", F.row_number().over(Window.partitionBy("chapter_section").orderBy("passage_id")).alias("position"))


# Chapters, names and candidates -----------------------------------------------------------------------------


@query(f"WITH c AS ({CHAPTERS_SQL}) SELECT o_orderkey AS passage_id, nbk_id, title AS chapter_title, pubmed_id, day AS chapter_last_updated, gene FROM orders JOIN c ON nbk_id = o_custkey")
def passages_with_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("passage_id"), F.col("o_custkey").alias("nbk_id"))
    out = lookups.with_chapters(p, chapters(spark, sf_dir))
    return out.select("passage_id", "nbk_id", "chapter_title", "pubmed_id", "chapter_last_updated", F.get("gene_symbols", F.lit(0)).alias("gene"))


@query(f"""WITH c AS ({CHAPTERS_SQL}), f AS (SELECT o_custkey AS nbk_id, o_orderpriority AS section, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT nbk_id, count(DISTINCT section) FILTER (WHERE n > 0) AS populated_sections FROM f GROUP BY nbk_id)
SELECT nbk_id, title, day AS last_updated_date, gene, populated_sections FROM c JOIN p USING (nbk_id) WHERE populated_sections >= 3""")
def chapter_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters joined to their aggregated passages: customers with orders of at least three priorities."""
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("nbk_id"), F.col("o_orderpriority").alias("chapter_section"))
    return lookups.worklist(chapters(spark, sf_dir), p).select("nbk_id", "title", "last_updated_date", F.get("gene_symbols", F.lit(0)).alias("gene"), "populated_sections")


#: A batch of wishes; the last one is misspelt by two signs.
_WISHES = ["Supplier#000000001", "Supplier#000000005", "Supplier#000000009", "Suplier000000007"]


@query(f"""SELECT wanted, s_name AS name, CAST(CASE WHEN wanted = s_name THEN 100 ELSE 100.0 * 32 / 34 END AS DOUBLE) AS score, 1 AS rank
FROM supplier JOIN (SELECT unnest({_WISHES!r}) AS wanted) ON s_name = CASE WHEN wanted LIKE '%#%' THEN wanted ELSE 'Supplier#000000007' END""")
def close_names_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest supplier for each of a batch of names: itself, or the one that was meant."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    wanted = _WISHES
    return evaluate.close_names_batch(names, wanted, limit=1)


@query(f"WITH c AS ({CHAPTERS_SQL}) SELECT nbk_id, title FROM c WHERE pubmed_id = '11' UNION ALL SELECT nbk_id, title FROM c WHERE nbk_id = 12")
def chapter_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chapters(spark, sf_dir)
    return lookups.chapter_of(c, pubmed_id="11").unionByName(lookups.chapter_of(c, nbk_id=12)).select("nbk_id", "title")


@query("SELECT conv_id AS nbk_id, turn AS chunk_index, role AS chapter_section, sha256(text) AS text_sha256 FROM conversations WHERE conv_id = 3 AND role = 'user'")
def document_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.passages_of(chunks(spark, sf_dir), 3, "user").select("nbk_id", "chunk_index", "chapter_section", F.sha2("text", 256).alias("text_sha256"))


@query(f"WITH p AS ({PASSAGES_SQL}) SELECT passage_id, char_count FROM p WHERE char_count BETWEEN 200 AND 1500 AND passage_role = 'evidence'")
def size_and_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.of_size(passages(spark, sf_dir), 200, 1500, "evidence").select("passage_id", "char_count")


@query("WITH n AS (SELECT CAST(n_nationkey % 20 AS VARCHAR) AS short_name, arg_max(n_name, n_nationkey) AS nbk_id FROM nation GROUP BY 1) SELECT s_suppkey, short_name, nbk_id FROM (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS short_name FROM supplier) LEFT JOIN n USING (short_name)")
def short_name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 20).cast("string").alias("short_name"), F.col("n_name").alias("nbk_id"), F.col("n_nationkey").alias("line_no"))
    found, skipped = lookups.resolved_names(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("short_name")), names)
    return found.unionByName(skipped.withColumn("nbk_id", F.lit(None).cast("string"))).select("s_suppkey", "short_name", "nbk_id")


@query(f"WITH c AS ({CHAPTERS_SQL}) SELECT nbk_id, title, day FROM c WHERE gene = 'BUILDING' AND pubmed_id IS NOT NULL ORDER BY day DESC NULLS LAST, nbk_id LIMIT 10")
def gene_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.resolved_gene(chapters(spark, sf_dir), "BUILDING", 10).select("nbk_id", "title", F.col("last_updated_date").alias("day"))


_SECTIONS_SQL = "(['summary', 'diagnosis', 'clinical_features', 'management', 'other'])[CAST(o_orderkey % 5 + 1 AS INT)]"


@query(f"""WITH c AS ({CHAPTERS_SQL}), p AS (SELECT o_custkey AS nbk_id, {_SECTIONS_SQL} AS section, length(o_orderpriority) AS chars FROM orders),
a AS (SELECT nbk_id, count(*) AS passages, sum(chars) AS chars, count_if(section = 'management') AS m, count_if(section = 'summary') AS s FROM p GROUP BY 1),
y AS (SELECT *, round(date_diff('day', day, DATE '2000-01-01') / 365.25, 1) + 0.0 AS years FROM c JOIN a USING (nbk_id))
SELECT nbk_id, title, years, CASE WHEN years < 2 THEN 'current' WHEN years < 4 THEN 'aging' WHEN years < 7 THEN 'stale' WHEN years IS NOT NULL THEN 'very_stale' END AS staleness,
coalesce(years >= 4 AND m > 0, false) AS stale_for_therapy, 9 AS n_sections, CAST(passages AS BIGINT) AS passages, CAST(chars AS BIGINT) AS chars, s = 0 AS no_summary FROM y""")
def chapter_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.element_at(F.array(*[F.lit(x) for x in ("summary", "diagnosis", "clinical_features", "management", "other")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("nbk_id"), section.alias("chapter_section"), F.length("o_orderpriority").alias("char_count"))
    out = lookups.chapter_outline(chapters(spark, sf_dir), p, F.lit(TODAY))
    total = lambda c: F.aggregate("sections", F.lit(0).cast("long"), lambda n, s: n + s[c])
    return out.select("nbk_id", "title", F.col("years_since_update").alias("years"), "staleness", "stale_for_therapy", F.size("sections").alias("n_sections"), total("passage_count").alias("passages"), total("total_chars").alias("chars"), F.exists("sections", lambda s: F.coalesce(s["note"], F.lit("")) == "not extracted").alias("no_summary"))


@query(f"WITH {_LEXICAL} SELECT count(*) AS unfiltered, count_if(f) AS candidates, count_if(f AND v) AS embedded, count_if(f AND NOT v) AS missing FROM (SELECT chapter_section IN ('summary', 'management') AS f, passage_id IN (SELECT vec_id FROM embeddings) AS v FROM s)")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir)
    within = search.Filters(sections=("summary", "management")).apply(p)
    return search.diagnostics(search.term_ranks(p, TERMS), within, vectors(spark, sf_dir), len(TERMS))


@query("SELECT min(d) AS oldest, date_diff('day', CAST(min(d) AS DATE), DATE '2000-01-01') > 180 AS stale FROM (SELECT o_orderdate AS d, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def first_hits_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3)
    hits = top.select(F.col("o_orderdate").alias("ingested_at"), F.row_number().over(Window.partitionBy().orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("position"))
    return search.freshness(hits, F.lit(TODAY))


@query(f"WITH {_LEXICAL}, {_DENSE} SELECT i.passage_id, round(d.dense_score, 6) AS dense_score, round(CAST(coalesce(r.recall_rank, 0) AS DOUBLE), 6) AS recall_rank, coalesce(r.recall_overlap_count, 0) AS overlap FROM (SELECT DISTINCT doc_id AS passage_id FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)) i LEFT JOIN d ON d.passage_id = i.passage_id LEFT JOIN r ON r.passage_id = i.passage_id AND r.recall_overlap_count > 0")
def debug_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of given passages: those that are labelled toxic."""
    p = passages(spark, sf_dir)
    ids = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("passage_id"))
    ranks = search.term_ranks(p, TERMS).select("passage_id", "phrase_rank", "strict_rank", "recall_rank", "recall_overlap_count").filter("recall_overlap_count > 0")
    out = search.scored_candidates(p, vectors(spark, sf_dir), ids, _vector(spark, sf_dir), ranks)
    return out.select("passage_id", F.round("dense_score", 6).alias("dense_score"), F.round("recall_rank", 6).alias("recall_rank"), F.col("recall_overlap_count").alias("overlap"))


@query(f"""WITH {_LEXICAL},
x AS (SELECT 0 AS query_index, passage_id, nbk_id, lexical_rank FROM s WHERE chapter_section IN ('summary', 'management') UNION ALL SELECT 1, passage_id, nbk_id, lexical_rank FROM s WHERE chapter_section = 'summary'),
h AS (SELECT *, row_number() OVER (PARTITION BY query_index ORDER BY lexical_rank DESC, nbk_id, passage_id) AS position FROM x QUALIFY position <= 15)
SELECT query_index, passage_id, position, CASE WHEN query_index = 1 AND count(*) OVER (PARTITION BY passage_id) = 2 THEN 0 END AS also FROM h""")
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches in a batch, with filters of their own."""
    specs = [{"query": QUESTION, "vector": [1.0], "mode": "off", "limit": 15, "filters": search.Filters(sections=s)} for s in (("summary", "management"), ("summary",))]
    out = search.batch_search(passages(spark, sf_dir), vectors(spark, sf_dir), specs)
    return out.select("query_index", "passage_id", "position", F.get("also_matched", F.lit(0)).alias("also"))


#: Five searches of a batch: mode, vector and sections of each.
_SPECS = [("rrf", 0, ()), ("rrf", 1, ("management",)), ("rrf", 2, ("summary", "diagnosis")), ("off", 0, ("summary",)), ("rrf", 3, ("references", "management"))]


def _one_of_batch(k: int, vec: int, sections: tuple[str, ...]) -> str:
    where = f" WHERE chapter_section IN ({', '.join(repr(x) for x in sections)})" if sections else ""
    one = _HYBRID.replace(PASSAGES_SQL, f"SELECT * FROM ({PASSAGES_SQL}){where}").replace("vec_id = 0", f"vec_id = {vec}").replace("position <= 20", "position <= 15")
    return f"SELECT {k} AS query_index, passage_id, position, lexical_rank, dense_score FROM ({one})"


def _off_of_batch(k: int, sections: tuple[str, ...]) -> str:
    where = f" WHERE chapter_section IN ({', '.join(repr(x) for x in sections)})"
    return f"SELECT {k} AS query_index, passage_id, row_number() OVER (ORDER BY l.lexical_rank DESC, nbk_id, passage_id) AS position, round(l.lexical_rank, 6) AS lexical_rank, NULL AS dense_score FROM (WITH {_LEXICAL} SELECT * FROM s{where}) l QUALIFY position <= 15"


@query(" UNION ALL ".join(f"({_one_of_batch(k, v, x) if mode == 'rrf' else _off_of_batch(k, x)})" for k, (mode, v, x) in enumerate(_SPECS)))
def batch_search_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five searches in a batch, four with vectors, with filters of their own."""
    stored = {r.vec_id: [float(x) for x in r.embedding] for r in table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin([v for _, v, _ in _SPECS])).collect()}
    specs = [{"query": QUESTION, "vector": stored[v], "mode": mode, "limit": 15, "filters": search.Filters(sections=x)} for mode, v, x in _SPECS]
    out = search.batch_search(passages(spark, sf_dir), vectors(spark, sf_dir), specs)
    return out.select("query_index", "passage_id", "position", F.round("lexical_rank", 6).alias("lexical_rank"), F.round("dense_score", 6).alias("dense_score"))


@query("SELECT EXISTS (SELECT 1 FROM events WHERE value > 5) AS found")
def any_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.exists(table(spark, sf_dir, "events").filter("value > 5"))


@query(r"SELECT doc_id, sha256(left(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{200b}-\x{200d}\x{202a}-\x{202e}\x{2060}\x{2066}-\x{2069}\x{feff}]', '', 'g'), 280)) AS message_sha256 FROM documents")
def message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(E.message_text("text"), 256).alias("message_sha256"))


@query("WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains(['the','and','for','they','you','our','are','was','not','but','has','had','its','can','may','who','how','all','one','two','she'], w))) AS ts FROM benchmark) SELECT item_id, len(ts) AS n_terms, CASE WHEN len(ts) = 0 THEN 'x:*' ELSE array_to_string(list_sort(ts), ' | ') END AS query FROM q")
def any_term_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.filter(F.split(E.any_query("text"), r" \| "), lambda t: t != "x:*")
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(terms).alias("n_terms"), F.when(F.size(terms) == 0, "x:*").otherwise(F.array_join(F.array_sort(terms), " | ")).alias("query"))


@query()
def inverted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stems of all passages with their places; tests hold it against the lexemes of each text."""
    return search.postings(passages(spark, sf_dir)).select("lexeme", "passage_id", "places")


@query()
def indexed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text ranks read from the inverted table; tests hold them against ranks of each text."""
    return search.indexed_ranks(search.postings(passages(spark, sf_dir)), '"that thing" with or this -idiot').drop("nbk_id")


# Modes, fallbacks and shapes of a search ----------------------------------------------------------------------


@query(f"WITH {_LEXICAL}, l AS (SELECT *, CASE chapter_section WHEN 'summary' THEN 0 WHEN 'diagnosis' THEN 0 WHEN 'management' THEN 1 WHEN 'other' THEN 7 ELSE 50 END AS pri FROM s ORDER BY lexical_rank DESC, nbk_id, passage_id LIMIT 90), o AS (SELECT *, row_number() OVER (ORDER BY lexical_rank DESC, pri, nbk_id, passage_id) AS position FROM l) SELECT position, passage_id, round(CAST(lexical_rank AS DOUBLE), 6) AS lexical_rank FROM o WHERE position <= 30")
def lexical_mode_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode without vectors, in which sections decide between equal ranks."""
    out = search.search(passages(spark, sf_dir), vectors(spark, sf_dir), QUESTION, [], mode="lexical", limit=30)
    return out.select("position", "passage_id", F.round("lexical_rank", 6).alias("lexical_rank"))


@query(f"SELECT position, passage_id, lexical_rank, dense_score, CAST(NULL AS DOUBLE) AS rrf_score FROM ({_one_of_batch(0, 0, ('references',))})")
def guarded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that meets nothing but guarded sections: no fusion, lexical order."""
    out = search.search(passages(spark, sf_dir), vectors(spark, sf_dir), QUESTION, _vector(spark, sf_dir), filters=search.Filters(sections=("references",)), limit=15)
    return out.select("position", "passage_id", *[F.round(c, 6).alias(c) for c in ("lexical_rank", "dense_score", "rrf_score")])


_PRIMARY = _HYBRID.replace(PASSAGES_SQL, f"SELECT * FROM ({PASSAGES_SQL}) WHERE passage_id % 3 = 1").replace("AS adjusted_score FROM f", "* CASE WHEN passage_id % 2 = 0 THEN 1.25 ELSE 1.0 END AS adjusted_score FROM f")


@query(f"SELECT position, passage_id, adjusted_score, passage_id % 2 = 0 AS primary_match FROM ({_PRIMARY})")
def primary_boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for a symbol that a third of all passages hold, half of them as a primary one."""
    symbol = F.concat(F.lit("S"), (F.col("passage_id") % 3).cast("string"))
    p = passages(spark, sf_dir).withColumn("gene_symbols", F.array(symbol)).withColumn("primary_gene_symbols", F.when(F.col("passage_id") % 2 == 0, F.array(symbol)).otherwise(F.array().cast("array<string>")))
    out = search.search(p, vectors(spark, sf_dir), QUESTION, _vector(spark, sf_dir), filters=search.Filters(gene="S1"), limit=20)
    return out.select("position", "passage_id", F.round("adjusted_score", 6).alias("adjusted_score"), "primary_match")


@query(f"""WITH {_LEXICAL}, {_DENSE}, l AS (SELECT nbk_id, passage_id, lexical_rank FROM s ORDER BY lexical_rank DESC, nbk_id, passage_id LIMIT 200),
e AS (SELECT * FROM d WHERE dense_score IS NOT NULL ORDER BY dense_score DESC, passage_id LIMIT 200),
u AS (SELECT passage_id, lexical_rank, NULL AS dense_score, 0 AS part, nbk_id FROM l UNION ALL SELECT passage_id, 0.0, dense_score, 1, '' FROM e WHERE passage_id NOT IN (SELECT passage_id FROM l))
SELECT row_number() OVER (ORDER BY part, u.lexical_rank DESC, u.dense_score DESC NULLS LAST, nbk_id, passage_id) AS position, passage_id, round(CAST(u.lexical_rank AS DOUBLE), 6) AS lexical_rank, round(u.dense_score, 6) AS dense_score FROM u""")
def appended_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical hits, then those that only vectors found."""
    p = passages(spark, sf_dir)
    v = p.select("nbk_id", "passage_id").join(vectors(spark, sf_dir), "passage_id")
    lexical_hits = search.lexical_top(search.term_ranks(p, TERMS), len(TERMS), search.DEPTH)
    dense = search.dense_top(p, vectors(spark, sf_dir), _vector(spark, sf_dir), search.DEPTH).join(v.select("nbk_id", "passage_id"), "passage_id")
    out = search.appended(lexical_hits, dense)
    return out.select("position", "passage_id", F.round("lexical_rank", 6).alias("lexical_rank"), F.round("dense_score", 6).alias("dense_score"))


_EXCERPT_SQL = r"s AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM h), c AS (SELECT *, regexp_replace(left(t, 300), '\s+$', '') AS cut FROM s), b AS (SELECT *, regexp_extract(cut, '(?s)^(.*) [^ ]*$', 1) AS head FROM c), x AS (SELECT *, CASE WHEN length(t) <= 300 THEN t WHEN length(head) > 150 THEN regexp_replace(head, '\s+$', '') || '…' ELSE cut || '…' END AS snippet FROM b)"


@query(f"""WITH h AS (WITH {_LEXICAL} SELECT passage_id, nbk_id, text, lexical_rank, row_number() OVER (ORDER BY lexical_rank DESC, nbk_id, passage_id) AS position FROM s QUALIFY position <= 10), {_EXCERPT_SQL}
SELECT 'brief' AS shape, position, passage_id, snippet, NULL AS text_sha256, round(CAST(lexical_rank AS DOUBLE), 6) AS lexical_rank FROM x
UNION ALL SELECT 'full', position, passage_id, NULL, sha256(text), NULL FROM x UNION ALL SELECT 'ids_only', position, passage_id, NULL, NULL, NULL FROM x""")
def response_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hits in the three shapes of a response; scores only where they are asked for."""
    at = shared_folder(spark)
    search.search(passages(spark, sf_dir), vectors(spark, sf_dir), QUESTION, [], mode="off", limit=10).write.parquet(at)
    hits = spark.read.parquet(at)
    brief = search.shaped(hits, "brief", include=("score_breakdown",)).withColumn("shape", F.lit("brief"))
    full = search.shaped(hits, "full").withColumn("shape", F.lit("full")).withColumn("text_sha256", F.sha2("text", 256)).drop("text")
    ids = search.shaped(hits, "ids_only", include=("score_breakdown",)).withColumn("shape", F.lit("ids_only"))
    out = brief.unionByName(full, allowMissingColumns=True).unionByName(ids, allowMissingColumns=True)
    return out.select("shape", "position", "passage_id", "snippet", "text_sha256", F.round("lexical_rank", 6).alias("lexical_rank"))
