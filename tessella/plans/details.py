"""Queries for the parts around a search: fields and domains, chapters read from XML, landed responses, side tables, versions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import lookups, quality, requests, versions
from ..session import shared_folder
from ..sources import chapters as xml
from ..sources import pages as html
from ..sources import text as files
from .model import CHAPTERS_SQL, PASSAGES_SQL, chapters, passages, table
from .registry import query


def text(value: Column) -> Column:
    return value.cast("string")


# Fields and domains ----------------------------------------------------------------------------------------


@query(f"WITH p AS ({PASSAGES_SQL}) SELECT passage_id, CASE WHEN passage_id % 7 <> 0 THEN passage_role END AS passage_role FROM p")
def role_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles outside the domain become null."""
    said = F.when(F.col("passage_id") % 7 == 0, F.upper("passage_role")).otherwise(F.col("passage_role"))
    return passages(spark, sf_dir).select("passage_id", E.known_role(said).alias("passage_role"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NBK' || o_custkey ELSE 'pmid:' || o_orderkey END AS record_id FROM orders")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from book urls, or from the article where a url is of something else or isn't there."""
    url = F.when(F.col("o_orderkey") % 3 == 0, E.source_url(F.concat(F.lit("NBK"), text(F.col("o_custkey"))))).when(F.col("o_orderkey") % 3 == 1, "https://example.org/books/")
    return table(spark, sf_dir, "orders").select("o_orderkey", E.record_id(url, text(F.col("o_orderkey"))).alias("record_id"))


@query(r"""SELECT doc_id, array_to_string(list_filter([
CASE WHEN doc_id % 130 NOT BETWEEN 1 AND 100 THEN 'limit' END,
CASE WHEN doc_id % 3 = 0 THEN 'nbk_id' END,
CASE WHEN doc_id % 9 > 5 THEN 'neighbors' END,
CASE WHEN doc_id % 4 = 1 THEN 'passage_id' END,
CASE WHEN length(text) NOT BETWEEN 1 AND 512 THEN 'query' END,
CASE WHEN doc_id % 5 <> 0 AND doc_id % 1000 NOT BETWEEN 80 AND 800 THEN 'snippet_chars' END], lambda x: x IS NOT NULL), ',') AS faults FROM documents""")
def request_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of all documents, with what of each is outside its domain."""
    k, n = F.col("doc_id"), text(F.col("doc_id"))
    asked = table(spark, sf_dir, "documents").select(
        k,
        F.col("text").alias("query"),
        (k % 130).alias("limit"),
        (k % 9).alias("neighbors"),
        F.concat(F.when(k % 3 == 0, "nbk").otherwise("NBK"), n).alias("nbk_id"),
        F.when(k % 2 == 0, E.passage_id(F.lit("NBK1"), k % 10000)).when(k % 4 == 1, F.concat(F.lit("NBK1:"), F.lit("12"))).alias("passage_id"),
        F.when(k % 5 != 0, k % 1000).alias("snippet_chars"),
    )
    good, bad = requests.parted(asked)
    return good.select(k, F.lit("").alias("faults")).unionByName(bad.select(k, F.array_join("faults", ",").alias("faults")))


@query(f"SELECT doc_id, length(text) < 15 OR len(list_filter({list(html.UNWANTED)!r}, lambda x: contains(lower(text), x))) > 0 AS unwanted FROM documents")
def unwanted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", E.unwanted("text", html.UNWANTED).alias("unwanted"))


_WHITE = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"SELECT doc_id, sha256(trim(regexp_replace(text, '{_WHITE}', ' ', 'g'))) AS text_sha256 FROM documents")
def squeezed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(E.squeezed("text"), 256).alias("text_sha256"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS pmid, CASE WHEN o_orderkey BETWEEN 1900 AND 2099 THEN CAST(o_orderkey AS VARCHAR) ELSE strftime(o_orderdate, '%Y') END AS year, 'Doe A, Roe B' AS authors,
'Course of order ' || o_orderkey AS title, 'Journal of ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Trade' ELSE 'Transport' END AS journal FROM orders""")
def reference_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of orders taken apart; every third title is in quotes, every fourth has no number, and the first thing that looks like a year counts as one."""
    k = F.col("o_orderkey")
    title = F.concat(F.lit("Course of order "), text(k))
    journal = F.concat(F.lit("Journal of "), F.when(k % 2 == 0, "Trade").otherwise("Transport"))
    line = F.concat(F.lit("Doe A, Roe B. "), F.when(k % 3 == 0, F.concat(F.lit('"'), title, F.lit('"'))).otherwise(title), F.lit(". "), journal, F.lit(". "), F.date_format("o_orderdate", "yyyy"), F.lit(";1:2-3."), F.when(k % 4 != 0, F.concat(F.lit(" PMID: "), text(k))).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.reference_fields(line).alias("r")).select("o_orderkey", "r.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%B %-d, %Y') END END AS last_updated FROM orders")
def update_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of an update in two notations; a date that isn't of an update doesn't count."""
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    said = F.concat(F.when(F.col("o_orderkey") % 5 != 0, "Last Update: ").otherwise("Posted: "), day, F.lit("; next in May 4, 2030"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.last_updated_text(said).alias("last_updated"))


@query("""SELECT o_orderkey, TRY_CAST(printf('%04d-%02d-%02d', year(o_orderdate), CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 14 END, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE o_orderkey % 33 END) AS DATE) AS day FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 11 = 0""")
def days_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of years, months and days, of which some are left out and some don't exist."""
    k = F.col("o_orderkey")
    year = F.when(k % 11 != 0, F.date_format("o_orderdate", "yyyy")).otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", E.date_of(year, F.when(k % 4 != 0, (k % 14).cast("int")), F.when(k % 6 != 0, (k % 33).cast("int"))).alias("day"))


@query("""SELECT s_nationkey, string_agg(s_name || CASE WHEN s_suppkey % 3 <> 0 THEN ' No ' || s_suppkey ELSE '' END, ', ' ORDER BY s_suppkey) AS authors, any_value(r_name || ' > ' || n_name) AS heading_path
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY s_nationkey""")
def authors_and_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the authors of their nation, whose heading stands under its region's."""
    given = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("No "), text(F.col("s_suppkey"))))
    people = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.col("s_name").alias("surname"), given.alias("given")))).alias("a"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return people.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_nationkey", E.author_list(F.col("a")).alias("authors"), E.heading_path(F.array("r_name", "n_name")).alias("heading_path"))


@query("SELECT c_custkey, array_to_string(list_filter(['BUILDING', 'Machinery', 'HOLD', 'house'], lambda x: regexp_matches(upper(c_name || ' ' || c_mktsegment || '-house.'), '\\b' || upper(x) || '\\b')), ',') AS symbols FROM customer")
def symbols_of_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that are whole words of a title."""
    title = F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit("-house."))
    known = F.array(*[F.lit(x) for x in ("BUILDING", "Machinery", "HOLD", "house")])
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(lookups.primary_symbols(title, known), ",").alias("symbols"))


@query("SELECT DISTINCT c_mktsegment AS item FROM customer WHERE c_custkey % 2 = 0")
def known_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct symbols of all chapters, without nulls."""
    symbols = F.array(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.lit(None).cast("string"))
    return lookups.distinct_items(table(spark, sf_dir, "customer").select(symbols.alias("symbols")), "symbols")


@query(f"""WITH c AS ({CHAPTERS_SQL}), o AS (SELECT nbk_id, title, day, row_number() OVER (ORDER BY day DESC NULLS LAST, nbk_id) AS r FROM c WHERE gene = 'BUILDING')
SELECT nbk_id, title, day, r <= 10 AS among_first FROM o""")
def gene_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a symbol, and which of them a limit would give."""
    c = chapters(spark, sf_dir)
    first = lookups.documents_of(c, "BUILDING", 10).select("nbk_id", F.lit(True).alias("_f"))
    return lookups.documents_of(c, "BUILDING").join(F.broadcast(first), "nbk_id", "left").select("nbk_id", "title", F.col("last_updated_date").alias("day"), F.coalesce("_f", F.lit(False)).alias("among_first"))


@query("""WITH a AS (SELECT o_custkey AS nbk_id, CAST(sum(o_orderkey % 1000) AS BIGINT) AS body, CAST(sum(CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 8 <> 3 THEN 0 WHEN o_orderkey % 16 = 0 THEN 2 * (o_orderkey % 1000) ELSE o_orderkey % 1000 END) AS BIGINT) AS accounted FROM orders GROUP BY 1)
SELECT nbk_id, accounted AS accounted_chars, round(CASE WHEN body = 0 THEN 0.0 ELSE greatest(0, body - accounted) / body END, 9) AS unaccounted_ratio FROM a""")
def conservation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each customer's orders as text that was captured, structure, skipped, unknown or lost; some count twice."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 1000
    part = lambda c, name: F.sum(F.when(c, n).otherwise(0)).alias(name)
    twice = F.sum(F.when(k % 4 == 0, F.when(k % 16 == 0, 2 * n).otherwise(n)).otherwise(0)).alias("captured_text_chars")
    audit = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("nbk_id")).agg(F.sum(n).alias("body_text_chars"), twice, part(k % 4 == 1, "structural_chars"), part(k % 4 == 2, "skipped_chars"), part(k % 8 == 3, "unknown_chars"))
    return quality.ledger(audit).select("nbk_id", "accounted_chars", F.round("unaccounted_ratio", 9).alias("unaccounted_ratio"))


# Tables ----------------------------------------------------------------------------------------------------


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as passages of a hundred documents, every second one a table, every third without a caption."""
    k = F.col("o_orderkey")
    data = F.struct(F.when(k % 3 != 0, F.concat(F.lit("Order "), text(k))).alias("caption"), F.array(F.lit("priority"), F.lit("status")).alias("header"), F.array(F.array("o_orderpriority", "o_orderstatus")).alias("rows"), F.lit(None).cast("string").alias("footnotes"))
    return table(spark, sf_dir, "orders").select((k % 100).alias("nbk_id"), k.alias("chunk_index"), F.when(k % 2 == 0, "table").otherwise("narrative").alias("passage_type"), F.concat(F.lit("t"), text(k % 700)).alias("table_id"), data.alias("table_data"))


_TABLE_SQL = "SELECT o_orderkey % 100 AS nbk_id, o_orderkey AS chunk_index, 't' || o_orderkey % 700 AS table_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'Order ' || o_orderkey ELSE '' END AS caption, o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0"


@query(f"SELECT nbk_id, CAST(count(*) AS INT) AS table_count, sha256(string_agg(table_id || '=' || caption, ',' ORDER BY chunk_index)) AS tables_sha256 FROM ({_TABLE_SQL}) GROUP BY nbk_id")
def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of every document in order, and how many."""
    said = F.array_join(F.transform("tables", lambda t: F.concat(t["table_id"], F.lit("="), t["caption"])), ",")
    return lookups.table_index(_tables(spark, sf_dir)).select("nbk_id", "table_count", F.sha2(said, 256).alias("tables_sha256"))


@query(f"SELECT nbk_id, table_id, caption, 'priority|status' AS header, o_orderpriority || '|' || o_orderstatus AS cells, '' AS footnotes FROM ({_TABLE_SQL}) WHERE nbk_id = 4 AND table_id = 't4'")
def table_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document's table by its id."""
    out = lookups.table_of(_tables(spark, sf_dir), 4, "t4")
    return out.select("nbk_id", "table_id", "caption", F.array_join("header", "|").alias("header"), F.array_join(F.flatten("rows"), "|").alias("cells"), "footnotes")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderpriority || ' / ' || o_orderstatus END || '|Key|n' || o_orderkey AS header FROM orders")
def header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two header rows as one: repeated and empty labels go, and marks of footnotes."""
    k = F.col("o_orderkey")
    rows = F.array(F.array(F.col("o_orderpriority"), F.lit("Key"), F.lit("")), F.array(F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat("o_orderstatus", F.lit("  12"))), F.lit("Key"), F.concat(F.lit("n"), text(k), F.lit("   3 "))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(E.flat_header(rows, F.lit(3)), "|").alias("header"))


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
b AS (SELECT doc_id, unnest(ls[5:]) AS line, generate_subscripts(ls[5:], 1) AS k FROM l WHERE len(ls) >= 4),
c AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM b),
h AS (SELECT doc_id, length(ls[1]) + length(ls[3]) + length(ls[4]) AS used FROM l WHERE len(ls) >= 4),
m AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS body FROM c JOIN h USING (doc_id) WHERE upto + used <= 1920 GROUP BY doc_id),
t AS (SELECT l.doc_id, text, len(ls) AS n, array_to_string([ls[1], '', ls[3], ls[4]], chr(10)) || coalesce(chr(10) || body, '') AS cut FROM l LEFT JOIN m USING (doc_id))
SELECT doc_id, sha256(CASE WHEN n >= 4 AND length(cut) < length(text) THEN cut ELSE text END) AS text_sha256 FROM t""")
def embedding_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as tables, cut to the budget of an encoder: head lines stay, rows while they fit."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(E.table_for_embedding("text"), 256).alias("text_sha256"))


# Chapters in XML -------------------------------------------------------------------------------------------


def _chapter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a chapter in XML, a section for each turn: prose, lists, definitions and boxes by turns, and tables after prose."""
    c = table(spark, sf_dir, "conversations")
    body = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "x"), "&", "&amp;")
    body = F.replace(F.replace(body, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    p, role, turn = F.concat(F.lit("<p>"), body, F.lit("</p>")), F.col("role"), F.col("turn")
    grid = F.concat(F.lit('<table-wrap><table><thead><tr><th colspan="2">'), role, F.lit('</th></tr></thead><tbody><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table></table-wrap>'))
    block = (
        F.when(turn % 4 == 1, F.concat(F.lit("<list><list-item><label>1</label>"), p, F.lit("<list><list-item><p>inner</p></list-item></list></list-item></list>")))
        .when(turn % 4 == 2, F.concat(F.lit("<def-list><def-item><term>"), role, F.lit("</term><def>"), p, F.lit("</def></def-item></def-list>")))
        .when(turn % 4 == 3, F.concat(F.lit("<boxed-text><caption><title>Box</title></caption>"), p, F.lit("</boxed-text>")))
        .otherwise(F.concat(p, grid))
    )
    title = F.when(turn % 3 == 0, "Management").when(turn % 3 == 1, "Establishing the Diagnosis").otherwise(role)
    sec = F.concat(F.lit("<sec><title>"), title, F.lit("</title>"), block, F.lit("</sec>"))
    one = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", sec.alias("sec")))), lambda x: x["sec"]), "").alias("secs"))
    meta = F.concat(F.lit("<book-part><book-part-meta><title-group><title>Talk "), text(F.col("conv_id")), F.lit("</title></title-group><contrib-group><contrib><name><surname>Doe</surname><given-names>A</given-names></name></contrib></contrib-group><pub-history><date date-type=\"created\"><year>2001</year></date><date date-type=\"updated\"><year>2010</year><month>2</month></date><date date-type=\"revised\"><year>2012</year></date></pub-history></book-part-meta><body>"))
    return one.select(F.concat(F.lit("NBK"), text(F.col("conv_id"))).alias("nbk_id"), F.lit("talk").alias("short_name"), F.concat(meta, "secs", F.lit("</body></book-part>")).cast("binary").alias("content"))


_BLOCKS_SQL = """
t AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '[^ -~]', 'x', 'g') AS x, CASE turn % 3 WHEN 0 THEN 'Management' WHEN 1 THEN 'Establishing the Diagnosis' ELSE role END AS title FROM conversations),
q AS (SELECT *, trim(regexp_replace(x, ' +', ' ', 'g')) AS s FROM t),
b AS (SELECT conv_id, turn, 0 AS part, title, CASE turn % 4 WHEN 1 THEN trim('- 1 ' || s) || chr(10) || '  - inner' WHEN 2 THEN '- **' || role || '**: ' || s WHEN 3 THEN '**Box**' || CASE WHEN s <> '' THEN chr(10) || chr(10) || s ELSE '' END ELSE trim(x) END AS text, NULL AS cells FROM q
 UNION ALL SELECT conv_id, turn, 1, title, NULL, role FROM q WHERE turn % 4 = 0),
k AS (SELECT *, count(cells) OVER (PARTITION BY conv_id ORDER BY turn, part) AS n FROM b WHERE cells IS NOT NULL OR text <> ''),
w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS chunk_index, CASE title WHEN 'Management' THEN 'management' WHEN 'Establishing the Diagnosis' THEN 'diagnosis' ELSE 'other' END AS chapter_section,
 title || CASE WHEN cells IS NOT NULL THEN ' > Table ' || n ELSE '' END AS heading_path, CASE WHEN cells IS NOT NULL THEN 'table-' || n END AS table_id,
 CASE WHEN cells IS NULL THEN text ELSE 'table-' || n || chr(10) || chr(10) || '| ' || cells || ' | ' || cells || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a | b |' || chr(10) || '| a | c |' END AS text FROM k)
"""


@query(f"WITH {_BLOCKS_SQL} SELECT 'NBK' || conv_id || ':' || lpad(CAST(chunk_index AS VARCHAR), 4, '0') AS passage_id, CAST(chunk_index AS INT) AS chunk_index, chapter_section, heading_path, table_id, sha256(text) AS text_hash, CAST(length(text) AS INT) AS char_count FROM w")
def parsed_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of chapters in XML, with their numbers, headings and tables; no text is over one window here."""
    _, found, _ = xml.tables_of(xml.parsed(_chapter_files(spark, sf_dir)))
    return found.select("passage_id", "chunk_index", "chapter_section", "heading_path", "table_id", "text_hash", "char_count")


@query(f"WITH {_BLOCKS_SQL} SELECT 'NBK' || conv_id AS nbk_id, 'Talk ' || conv_id AS title, 'Doe A' AS authors, DATE '2001-01-01' AS initial_pub_date, DATE '2010-02-01' AS last_updated_date, count(*) AS passages, CAST(sum(length(text)) AS BIGINT) AS captured FROM w GROUP BY conv_id")
def parsed_chapter_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters in XML with their dates (an update goes before a revision), and what their audits count."""
    heads, _, audit = xml.tables_of(xml.parsed(_chapter_files(spark, sf_dir)))
    counts = audit.select("nbk_id", F.col("passage_count").alias("passages"), F.col("captured_text_chars").alias("captured"))
    return heads.join(counts, "nbk_id").select("nbk_id", "title", "authors", "initial_pub_date", "last_updated_date", "passages", "captured")


@query("""WITH g AS (SELECT o_custkey AS nbk_id, o_orderpriority AS v, min(o_orderkey) AS k FROM orders GROUP BY ALL), m AS (SELECT o_custkey AS nbk_id, o_orderstatus AS v, min(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
SELECT c_custkey AS nbk_id, coalesce((SELECT string_agg(v, ',' ORDER BY k) FROM g WHERE g.nbk_id = c_custkey), '') AS gene_symbols, coalesce((SELECT string_agg(v, ',' ORDER BY k) FROM m WHERE m.nbk_id = c_custkey), '') AS omim_ids FROM customer""")
def chapter_side_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with their side data in order of first appearance; empty where there is none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("nbk_id"), F.col("o_orderpriority").alias("gene"), F.col("o_orderstatus").alias("omim"), F.col("o_orderkey").alias("line_no"))
    out = xml.enriched(chapters(spark, sf_dir).select("nbk_id", "title"), o, o.filter("line_no % 2 = 0"))
    return out.select("nbk_id", F.array_join("gene_symbols", ",").alias("gene_symbols"), F.array_join("omim_ids", ",").alias("omim_ids"))


# Landed responses ------------------------------------------------------------------------------------------


@query("SELECT o_custkey AS asked, CAST(count(*) AS INT) AS count, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:3], ',') AS ids FROM orders GROUP BY o_custkey")
def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of a search: the count is of all ids, of which the first three are taken."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("asked")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    body = F.to_json(F.struct(F.struct(text(F.size("ids")).alias("count"), F.transform("ids", text).alias("idlist")).alias("esearchresult")))
    return html.search_result(per.select("asked", body.alias("body")), most=3).select("asked", "count", F.array_join("ids", ",").alias("ids"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS pmid, 'Order of ' || o_custkey AS title, 'RESULTS: ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || 'status ' || o_orderstatus ELSE '' END AS abstract, 'Doe A, The Group' AS authors,
CASE WHEN o_orderkey % 3 <> 0 THEN 'Trade' END AS journal, strftime(o_orderdate, '%Y') AS year, 'article' AS kind FROM orders""")
def article_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of XML responses: labelled parts, marks inside titles, names of groups."""
    k = F.col("o_orderkey")
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *[F.lit(x) if isinstance(x, str) else x for x in inner], F.lit(f"</{name}>"))
    parts = F.concat(F.lit('<AbstractText Label="RESULTS">'), "o_orderpriority", F.lit("</AbstractText>"), F.when(k % 2 == 0, tag("AbstractText", "status <b>", F.col("o_orderstatus"), "</b>")).otherwise(""))
    body = tag("Set", "<PubmedArticle>", tag("PMID", text(k)), tag("ArticleTitle", "Order\n  <i>of</i> ", text(F.col("o_custkey"))), tag("Abstract", parts), "<AuthorList><Author><LastName>Doe</LastName><Initials>A</Initials></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList>", tag("Journal", F.when(k % 3 != 0, "<Title>Trade</Title>").otherwise("")), tag("PubDate", tag("Year", F.date_format("o_orderdate", "yyyy"))), "</PubmedArticle>")
    out = html.articles(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")))
    return out.withColumn("authors", F.array_join("authors", ", "))


@query("""SELECT o_orderkey, 'prlinks' AS link_type, 'http://p/' || o_custkey || '=' || o_orderstatus AS links FROM orders WHERE o_orderkey % 3 <> 1
UNION ALL SELECT o_orderkey, 'llinks', 'http://l/' || o_orderkey || '=' || o_orderpriority || ';http://m=' FROM orders WHERE o_orderkey % 3 <> 1
UNION ALL SELECT o_orderkey, 'books', 'https://www.ncbi.nlm.nih.gov/books/NBK' || o_custkey || '/=NCBI Bookshelf' FROM orders WHERE o_orderkey % 3 = 1""")
def link_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of XML responses by kind, once each; every third first response has none, so that the second one counts."""
    k = F.col("o_orderkey")
    other = F.concat(F.lit("<ObjUrl><Url>http://l/"), text(k), F.lit("</Url><Category>"), "o_orderpriority", F.lit("</Category></ObjUrl>"))
    provider = F.concat(F.lit("<ObjUrl><Url>http://p/"), text(F.col("o_custkey")), F.lit("</Url><Provider><Name>"), "o_orderstatus", F.lit("</Name></Provider></ObjUrl>"))
    first = F.when(k % 3 != 1, F.concat(F.lit("<L>"), provider, other, provider, F.lit("<ObjUrl><Url>http://m</Url></ObjUrl></L>"))).otherwise("<L></L>")
    second = F.concat(F.lit("<L><LinkSetDb><LinkName>pubmed_books</LinkName><Link><Id>"), text(F.col("o_custkey")), F.lit("</Id></Link></LinkSetDb></L>"))
    out = html.links(table(spark, sf_dir, "orders").select("o_orderkey", first.alias("body"), second.alias("more")), fallback="more")
    return out.select("o_orderkey", "link_type", F.array_join(F.transform("links", lambda x: F.concat(x["url"], F.lit("="), F.coalesce(x["provider"], F.lit("")))), ";").alias("links"))


@query("""WITH l AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS p, 'https://x/books/NBK' || o_orderkey AS url FROM orders WHERE o_orderkey % 4 <> 0)
SELECT o_custkey, arg_min(url, (p, o_orderkey)) AS book_url FROM l GROUP BY o_custkey""")
def book_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first book url of each customer, of preferred priorities first."""
    k = F.col("o_orderkey")
    url = F.concat(F.when(k % 4 != 0, "https://x/books/NBK").otherwise("https://x/pmc/"), text(k))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("db"), url.alias("url"), k.alias("at"))
    return html.book_url(rows, ["2-HIGH", "1-URGENT"], "o_custkey", at="at")


# Side tables, lines and versions ---------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS nbk_id, c_name AS short_name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS gene FROM customer WHERE c_custkey % 5 <> 0")
def side_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a tab-separated side table, with comments, blank lines and short ones, and read again."""
    k, at = F.col("c_custkey"), shared_folder(spark)
    line = F.concat(F.when(k % 5 == 0, "  # ").otherwise(" "), text(k), F.lit("\t"), "c_name", F.when(k % 7 != 0, F.concat(F.lit("\t"), "c_mktsegment")).otherwise(""), F.when(k % 4 == 0, "\n\n").otherwise(" "))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(at)
    return files.side_table(spark, at, ["nbk_id", "short_name", "gene"]).drop("line_no")


@query("SELECT CAST(min(o_orderkey) AS VARCHAR) AS f0, 'NBK7' AS f5 FROM orders WHERE o_orderkey = 7")
def listing_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a listing that names a book, among shorter ones and those of other books."""
    k, at = F.col("o_orderkey"), shared_folder(spark)
    line = F.concat(text(k), F.when(k % 5 == 0, ",a,b").otherwise(F.concat(F.lit(",a,b,c,d, NBK"), text(k))))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(at)
    return files.listing(spark, at, "NBK7").select("f0", "f5")


@query("SELECT conv_id, turn, sha256(text) AS text_sha256 FROM conversations WHERE turn % 3 <> 0")
def lines_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines, a third of them as comments, and read again."""
    at = shared_folder(spark)
    line = F.concat(F.when(F.col("turn") % 3 == 0, "# ").otherwise("  "), F.to_json(F.struct("conv_id", "turn", "text")), F.when(F.col("turn") % 4 == 0, "\n\n").otherwise(""))
    table(spark, sf_dir, "conversations").select(line.alias("value")).write.text(at)
    return files.json_lines(spark, at, "conv_id long, turn long, text string").select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT 'corpus-' || o_orderkey || '.tar.gz' AS name, o_orderkey AS position FROM orders WHERE o_orderkey % 6 = 5 ORDER BY o_orderkey LIMIT 1")
def release_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first asset of a release that is a corpus."""
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 1, "corpus-").otherwise("notes-"), text(k), F.when(k % 3 == 2, ".tar.gz").otherwise(".zip"))
    return files.release_asset(table(spark, sf_dir, "orders").select(name.alias("name"), k.alias("position")), "corpus-").select("name", "position")


@query(f"WITH c AS ({CHAPTERS_SQL}) SELECT nbk_id, title, count(o_orderkey) AS passages, '2026-01-02-r2' AS version FROM c LEFT JOIN orders ON o_custkey = nbk_id GROUP BY ALL")
def published_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus published twice on a day, read from the version that the pointer names."""
    root = shared_folder(spark)
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("nbk_id"), F.col("o_orderkey").alias("passage_id"))
    versions.publish(spark, root, {"chapters": chapters(spark, sf_dir).limit(0), "passages": p.limit(0)}, date(2026, 1, 2))
    version = versions.publish(spark, root, {"chapters": chapters(spark, sf_dir), "passages": p}, date(2026, 1, 2))
    now = versions.open_corpus(spark, root)
    counts = now["passages"].groupBy("nbk_id").agg(F.count("*").alias("passages"))
    return now["chapters"].join(counts, "nbk_id", "left").select("nbk_id", "title", F.coalesce("passages", F.lit(0)).alias("passages"), F.lit(version).alias("version"))


@query("WITH v AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS version FROM orders) SELECT version, row_number() OVER (ORDER BY version DESC) <= 2 AS keep FROM v")
def version_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as versions, of which the newest two are kept."""
    log = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("version")).distinct()
    return versions.kept_versions(log)
