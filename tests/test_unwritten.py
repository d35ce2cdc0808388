"""Queries that SQL can't express, each executed whole and held against plain loops."""

import re

import pytest

from tessella.functions import expr as E
from tessella.functions import lexical, python
from tessella.operators import search
from tessella.plans import catalogue
from tessella.plans.model import passages
from tessella.sources import pages
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def run(spark, name):
    return catalogue.queries()[name](spark, DATA)


def indexed(r):
    section = {"en": "summary", "fr": "management", "de": "diagnosis", "es": "references"}.get(r.lang, "other")
    return lexical.lexemes(f"{section} {r.text or ''}" if r.text is not None else section)


def test_inverted_table(spark, texts):
    want = {}
    for i, r in texts.items():
        for w, at in lexical.lexemes(" ".join(["", {"en": "summary", "fr": "management", "de": "diagnosis", "es": "references"}.get(r.lang, "other"), r.text or ""])):
            want.setdefault((w, i), []).append(at)
    assert {(r.lexeme, r.passage_id): r.places for r in run(spark, "inverted_table").collect()} == want


def test_indexed_ranks(spark, texts):
    q = lexical.parse('"that thing" with or this -idiot')
    assert q.clauses == [([["thing"]], []), ([], [["idiot"]])] or len(q.clauses) == 2
    some, want = lexical.wanted(q), {}
    for i, r in texts.items():
        doc = indexed(r)
        if any(w in some for w, _ in doc):
            want[i] = lexical.rank(q, doc)
    got = {r.passage_id: (r.phrase_rank, r.strict_rank, r.recall_rank, r.recall_overlap_count) for r in run(spark, "indexed_ranks").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)


def test_indexed_search_ranks_by_stems(spark):
    rows = [("N1", "a", "management", "evidence", "surveillance of carriers by imaging"), ("N1", "b", "management", "evidence", "a carrier is screened"), ("N2", "c", "summary", "evidence", "carrying nothing")]
    p = spark.createDataFrame(rows, "nbk_id string, passage_id string, chapter_section string, passage_role string, text string").withColumn("char_count", F.length("text"))
    v = spark.createDataFrame([("a", [1.0, 0.0])], "passage_id string, embedding array<float>")
    plain = search.search(p, v, "screening carriers", [1.0, 0.0], mode="lexical")
    index = search.postings(p)
    stems = search.search(p, v, "screening carriers", [1.0, 0.0], mode="lexical", index=index)
    assert [r.passage_id for r in plain.collect()] == ["a"] and [r.passage_id for r in stems.collect()] == ["b", "a"]
    shown = search.shaped(stems, query="screening carriers").collect()
    assert "**carrier**" in shown[0].snippet and "**screened**" in shown[0].snippet


def test_section_assembly_dedup(spark, texts):
    def loop(text):
        parts = [text[k * 240 : k * 240 + 300] for k in range((max(len(text), 1) - 1) // 240 + 1)] or [""]
        out, last = parts[0], parts[0]
        for nxt in parts[1:]:
            k = next((n for n in range(min(len(last), len(nxt)), 29, -1) if last[-n:] == nxt[:n]), 0)
            last = nxt[k:]
            out += last
        return out

    import hashlib

    got = {r.nbk_id: r.text_sha256 for r in run(spark, "section_assembly_dedup").collect()}
    assert got == {i: hashlib.sha256(loop(r.text).encode()).hexdigest() for i, r in texts.items() if r.text}


def test_overlap_of_repeating_parts(spark):
    """Parts that repeat inside themselves: the longest start counts."""
    def loop(items):
        out, last = items[0], items[0]
        for nxt in items[1:]:
            k = next((n for n in range(min(len(last), len(nxt)), 29, -1) if last[-n:] == nxt[:n]), 0)
            last = nxt[k:]
            out += last
        return out

    cases = [["ab" * 40, "ab" * 30 + "c"], ["x" * 100, "x" * 70], ["-" * 29, "-" * 29], [r"\E(?=\Q." * 8, r"\E(?=\Q." * 6 + "end"], ["start " * 9, "start " * 7, "start " * 6], ["a" * 50 + "é" * 40, "é" * 35 + "b"]]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, parts array<string>")
    assert {r.k: r.t for r in df.select("k", E.without_overlap("parts").alias("t")).collect()} == {k: loop(c) for k, c in enumerate(cases)}


def test_headline(spark, texts):
    q = lexical.parse(catalogue.QUESTION)
    n, most = lexical.snippet_limits(400)
    got = run(spark, "headline").collect()
    assert len(got) == 20
    for r in got:
        text = texts[r.passage_id].text
        assert r.snippet == lexical.headline(text, {*q.any_of, *q.phrase}, fragments=n, most=most)
        assert r.snippet.replace("**", "").split(" ... ")[0] in text.replace("**", "")
        # Most words of the question are stop words of English.
        assert ("**" in r.snippet) == bool({lexical.stem(w) for w in lexical.WORD.findall(text)} & {*q.any_of})


def test_headline_takes_the_densest_fragments():
    """Against the definition: at each turn the fragment, from a hit on, that holds most hits left, the first of equals."""
    text = " ".join("hit" if k in (3, 40, 41, 43, 90, 91, 92, 150) else f"w{k}" for k in range(200))
    out = lexical.headline(text, {"hit"}, fragments=2, most=10)
    assert out.count(" ... ") == 1 and [x.count("**hit**") for x in out.split(" ... ")] == [3, 3]
    words = re.findall(r"w\d+", out)
    assert "w42" in words and "w150" not in words


def test_embed_fake(spark, texts):
    have = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    p = passages(spark, DATA).select("passage_id", E.table_for_embedding("text").alias("t")).collect()
    want = {r.passage_id: round(sum(map(float, python.made_vector(r.t, 384))), 3) for r in p if r.passage_id not in have}
    got = {r.passage_id: (r.dim, round(r.total, 3)) for r in run(spark, "embed_fake").collect()}
    assert got.keys() == want.keys() and all(d == 384 and abs(t - want[i]) < 0.01 for i, (d, t) in got.items())


def test_close_match(spark):
    names = sorted({r.n_name for r in spark.read.parquet(f"{DATA}/nation.parquet").collect()}, key=lambda n: (-python.closeness("NATION_07", n), n))
    assert [r[0] for r in run(spark, "close_match").collect()] == [n for n in names if python.closeness("NATION_07", n) >= 70][:3]


def test_html_scrape(spark):
    rows = {r.page_id: pages.read(r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in run(spark, "html_scrape").collect():
        w = rows[r.page_id]
        assert (r.title, r.authors, r.update_info, r.last_updated, r.n_references, r.n_sections) == (w["title"], w["authors"], w["update_info"], w["last_updated"], w["n_references"], len(w["sections"]))


def test_alternatives_in_queries():
    q = lexical.parse("cat or dog -bird")
    assert q.clauses == [([["cat"]], []), ([["dog"]], [["bird"]])] and q.required == [["cat"]]
    assert lexical.rank(q, lexical.lexemes("a cat and a bird"))[1] > 0
    assert lexical.rank(q, lexical.lexemes("a dog and a bird"))[1] == 0
    assert lexical.rank(q, lexical.lexemes("a dog"))[1] > 0
    assert lexical.any_query([]) == "x:*" and lexical.any_query(["a", "b"]) == "a | b"


def test_records_stay_together(spark):
    body = "<R><PubmedBookArticle><PMID>9</PMID><BookTitle>B</BookTitle><ArticleTitle>Chapter</ArticleTitle><Abstract><AbstractText>one <i>marked</i> part</AbstractText></Abstract><ContributionDate><Year>2001</Year></ContributionDate></PubmedBookArticle><PubmedArticle><PMID>1</PMID><ArticleTitle>T</ArticleTitle><AuthorList><Author><LastName>Doe</LastName></Author><Author><LastName>Roe</LastName><ForeName>A</ForeName></Author></AuthorList></PubmedArticle></R>"
    got = pages.articles(spark.createDataFrame([(7, body), (8, "<broken"), (9, None)], "k int, body string")).collect()
    assert [(r.k, r.pmid, r.title, r.abstract, r.authors, r.kind) for r in got] == [(7, "1", "T", None, ["Doe", "Roe A"], "article"), (7, "9", "Chapter", "one marked part", [], "book")]
    one = "<L><ObjUrl><Url>u1</Url><Category>c1</Category></ObjUrl><ObjUrl><Url>u2</Url><Category>c2</Category><Provider><Name>p2</Name></Provider></ObjUrl><LinkSetDb><LinkName>pubmed_books</LinkName><Link><Id>5</Id></Link></LinkSetDb></L>"
    rows = spark.createDataFrame([(1, one, None), (2, "<L/>", one)], "k int, body string, more string")
    found = {(r.k, r.link_type): [(x.url, x.provider) for x in r.links] for r in pages.links(rows, fallback="more").collect()}
    for k in (1, 2):
        assert found[k, "llinks"] == [("u1", "c1")] and found[k, "prlinks"] == [("u2", "p2")] and found[k, "books"][0][0].endswith("/NBK5/")


def test_excerpt_limits(spark):
    with pytest.raises(ValueError, match="80 to 800"):
        search.shaped(spark.createDataFrame([(1, "x")], "passage_id int, text string"), chars=10)
    with pytest.raises(ValueError, match="1 to 5"):
        search.batch_search(None, None, [{}] * 6)
