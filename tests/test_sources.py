"""Chapters, pages, side tables and versions, from files written here."""

import datetime
import io
import tarfile

from pyspark.sql import functions as F

from tessella import streaming
from tessella.functions import python
from tessella.operators import versions
from tessella.sources import chapters, pages, text

XML = """<book-part><book-part-meta><book-part-id pub-id-type="pmid">77</book-part-id><title-group><title>BRCA9 Disorder</title></title-group>
<contrib-group><contrib><name><surname>Doe</surname><given-names>Ann</given-names></name></contrib></contrib-group>
<pub-history><date date-type="created"><year>2001</year></date><date date-type="updated"><year>x</year></date><date date-type="revised"><year>2010</year></date></pub-history></book-part-meta>
<body><sec><title>Management</title><p>First part.</p><list><list-item><label>1</label><p>one</p><list><list-item><p>two</p></list-item></list></list-item></list>
<table-wrap><caption><title>T</title></caption><table><thead><tr><th rowspan="2">A</th><th colspan="2">B</th></tr><tr><th>C</th><th>D  1</th></tr></thead>
<tbody><tr><td rowspan="2">r</td><td>1</td><td>2</td></tr><tr><td colspan="2">3</td></tr></tbody></table><table-wrap-foot><p>note</p></table-wrap-foot></table-wrap>
<sec><title>Related</title><p>See elsewhere for details.</p></sec><odd>left out</odd></sec></body></book-part>"""


def test_chapter():
    row = chapters.parse(XML.encode(), "NBK5", "brca9")
    assert row["error"] is None and row["authors"] == "Doe Ann" and row["pubmed_id"] == "77"
    assert row["initial_pub_date"] == datetime.date(2001, 1, 1)
    assert row["last_updated_date"] is None  # an update that can't be read isn't replaced by the revision
    kinds = [(p["passage_id"], p["chapter_section"], p["passage_role"], p["heading_path"]) for p in row["passages"]]
    assert kinds == [("NBK5:0000", "management", "evidence", "Management"), ("NBK5:0001", "management", "table_body", "Management > Table 1"), ("NBK5:0002", "management", "cross_reference", "Management > Related")]
    assert row["passages"][0]["text"] == "First part.\n\n- 1 one\n  - two"
    t = row["passages"][1]["table_data"]
    assert t["header"] == ["A", "B / C", "B / D"] and t["rows"] == [["r", "1", "2"], ["r", "3", "3"]] and t["footnotes"] == "note"
    assert row["audit"]["unknown_tags"] == {"odd": 8}


def test_faulty_chapters():
    assert "syntax" in chapters.parse(b"<a>", "N", "s")["error"]
    assert "entities" in chapters.parse(b'<!DOCTYPE a [<!ENTITY x "y">]><a/>', "N", "s")["error"]
    ragged = XML.replace('<td colspan="2">3</td>', "<td>3</td>")
    assert "wide" in chapters.parse(ragged.encode(), "N", "s")["error"]
    flat = chapters.parse(b"<book-part><book-part-meta><title-group><title>Resources</title></title-group></book-part-meta><body><p>x</p></body></book-part>", "N", "s")
    assert flat["passages"][0]["chapter_section"] == "resources"


def test_ingest(spark, tmp_path):
    archive = tmp_path / "a.tar.gz"
    with tarfile.open(archive, "w:gz") as tar:
        for name, data in (("x/brca9.nxml", XML.encode()), ("x/bad.nxml", b"<a>"), ("x/readme.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "side").mkdir()
    (tmp_path / "side/genes.txt").write_bytes("#nbk\tshort\tgene\n\nNBK5\tbrca9\tBRCA9\nNBK5\tbrca9\tÉ2\nNBK5\tbrca9\tBRCA9\n".encode("latin-1"))
    files = chapters.unpacked(spark, str(archive))
    ids = spark.createDataFrame([("brca9", "NBK5"), ("bad", "NBK6")], "short_name string, nbk_id string")
    documents = chapters.parsed(files.join(ids, "short_name")).cache()
    assert documents.filter("error is not null").count() == 1
    c, p, audit = chapters.tables_of(documents)
    genes = text.side_table(spark, str(tmp_path / "side/genes.txt"), ["nbk_id", "short_name", "gene"])
    c = chapters.enriched(c, genes, genes.select("nbk_id", F.col("gene").alias("omim"), "line_no").limit(0))
    row = c.first()
    assert row.gene_symbols == ["BRCA9", "É2"] and row.primary_gene_symbols == ["BRCA9"] and row.omim_ids == []
    assert p.count() == 3 and audit.first().passage_count == 3
    root = str(tmp_path / "corpus")
    day = datetime.date(2026, 1, 2)
    first = versions.publish(spark, root, {"chapters": c, "passages": p}, day)
    assert [versions.publish(spark, root, {"chapters": c, "passages": p}, day) for _ in range(3)] == ["2026-01-02-r2", "2026-01-02-r3", "2026-01-02-r4"]
    assert versions.open_corpus(spark, root)["passages"].count() == 3
    assert versions.retire(spark, root, 2) == [first]
    assert versions.digests(spark, f"{root}/2026-01-02-r4/chapters").count() >= 1


def test_small_sources(spark, tmp_path):
    (tmp_path / "l.csv").write_text("a,b,c,d,e,NBK1\nx,b,c,d,e,NBK2\ny,b,c,d,e,NBK2\nshort\n")
    assert text.listing(spark, str(tmp_path / "l.csv"), "NBK2").first().f0 == "x"
    (tmp_path / "q.jsonl").write_text('# note\n\n{"query": "a"}\n')
    assert [r.query for r in text.json_lines(spark, str(tmp_path / "q.jsonl"), "query string").collect()] == ["a"]
    r = spark.createDataFrame([('{"esearchresult": {"count": "3", "idlist": ["1", "2", "3"]}}',)], "body string")
    assert pages.search_result(r, most=2).first().asDict() == {"count": 3, "ids": ["1", "2"]}
    a = spark.createDataFrame([("<A><PMID>5</PMID><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label='X'>one</AbstractText><AbstractText Label='Y'>two</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>A</ForeName></Author></AuthorList></A>",)], "body string")
    got = pages.articles(a).first()
    assert (got.pmid, got.title, got.abstract, got.authors, got.journal) == ("5", "T", "X: one\n\nY: two", ["Doe A"], None)
    links = spark.createDataFrame([("<L><ObjUrl><Url>u</Url><Category>c</Category><Provider><Name>p</Name></Provider></ObjUrl><ObjUrl><Url>u</Url><Category>c</Category><Provider><Name>p</Name></Provider></ObjUrl></L>",)], "body string")
    assert [len(r.links) for r in pages.links(links).collect()] == [1]
    urls = spark.createDataFrame([("k", "z", "/books/NBK1"), ("k", "y", "/books/NBK2"), ("k", "y", "/x")], "k string, db string, url string")
    assert pages.book_url(urls, ["y"], "k").first().book_url == "/books/NBK2"


def test_pages():
    html = '<title>X - NCBI Bookshelf</title><div class="main-content lit-style"><h1><span class="title">X Syndrome</span></h1><p>Author: A. Doe</p><p>Last Updated: March 3, 2021.</p><div id="NBK1.9"><h2>Management</h2><p>Treatment of the thing by surgery and therapy here.</p><div><p>Treatment of the thing by surgery and therapy here.</p></div><h3>Surveillance</h3><p>Do a check up each year for all of them.</p></div></div>'
    got = pages.read(html)
    assert got["title"] == "X Syndrome" and got["authors"] == "A. Doe" and got["last_updated"] == "March 3, 2021"
    assert [(s["key"], s["level"], s["parent"]) for s in got["sections"]] == [("management", 2, None), ("surveillance", 3, "management")]
    assert got["sections"][0]["content"].count("Treatment") == 1
    assert pages.read(None)["title"] == "Unknown Document"
    assert pages.read("<title>Y - GeneReviews</title><body><h2>One part</h2><p>Words that are long enough to stay.</p></body>")["sections"][0]["title"] == "One part"


def test_backfill(spark, tmp_path):
    new = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y")], "nbk_id string, passage_id string, text string")
    new.write.parquet(str(tmp_path / "in"))
    done = spark.createDataFrame([("a", "1")], "nbk_id string, passage_id string")
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    q = streaming.backfill(stream, lambda: done, lambda df: df.select("nbk_id", "passage_id", python.made_vectors("text", 8).alias("e")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r.passage_id, len(r.e)) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("2", 8)]
