"""Op 9 on hand-made graphs of pages."""

import random
from urllib.parse import urlsplit

import duckdb
from llm_classes import DATA

from tessella.llm import sql, urls
from tessella.llm.queries import URL_RULES, op9_url_filter


def judged(spark, rows, rules=URL_RULES, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as verdict")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(df, rules, **options).collect()}


def test_rules(spark):
    got = judged(spark, [(1, "https://A.Example.org/es/x?y#z", None), (2, "http://example.org/en/12", ""), (3, "http://x.example.org/en/2", None), (4, "http://shop.com/de/", None), (5, "http://shop.com/es/", None), (6, None, None), (7, "no scheme", None), (8, "http://org", None), (9, "http://notexample.org/es/", None), (10, "http://shop.com#/de/", None), (11, "http://É.com/fr/é", None)])
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("shop.com", "/es/", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("org", "", None, "allow") and got[9][2] == "org/" and got[10] == ("shop.com", "", None, "allow") and got[11][0] == "É.com"


def link(url):
    return f"<html><head><LINK href='{url}' rel=canonical></head></html>"


def test_classes(spark):
    rows = [
        (1, "http://a.net/1", link("http://bad.com/de/x")),  # names a blocked page that wasn't fetched
        (2, "http://b.net/", '<meta http-equiv="refresh" content="0; url=/moved?a=1&amp;b=2">'),
        (3, "http://b.net/moved?a=1&b=2", link("//a.net/1#part")),  # joins 1
        (4, "http://c.net/x/y", link("z")),
        (5, "http://c.net/x/z", link("http://ok.org/")),  # allowed by a rule
        (6, "http://C.net/x/z#frag", link("http://bad.com/de/q")),  # the same page as 5: allow comes first
        (7, "http://bad.com/de/q", None),  # its own rule
        (8, "http://d.net/", "<p>rel=canonical refresh</p>"),
        (9, "http://e.net/", None),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow"}
    redirects = spark.createDataFrame([("http://e.net/", "http://x.com/de/"), (None, "http://x.com/de/")], "src string, dst string")
    assert judged(spark, rows, redirects=redirects)[9][3] == "block"


def test_long_chain_and_star(spark):
    chain = [(k, f"http://n.net/{k}", link(f"http://n.net/{k + 1}")) for k in range(60)]
    star = [(100 + k, f"http://m.net/{k}", link("http://m.com/de/")) for k in range(200)]
    got = judged(spark, [*chain, (60, "http://n.net/60", link("http://n.com/de/")), *star])
    assert {v[3] for v in got.values()} == {"block"}


def test_empty(spark):
    assert judged(spark, []) == {}


def test_query(spark):
    rows = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    out = op9_url_filter(spark, DATA)
    for r in out.collect():
        u = urlsplit(rows[r.page_id])
        assert (r.host, r.path) == (u.netloc, u.path)
    assert "Python" not in out._jdf.queryExecution().toString()


def test_against_sql_on_linked_pages(spark, tmp_path):
    """The registered SQL on pages most of which name another as canonical: chains, circles, stars and classes with both rules."""
    r = random.Random(3)
    urls_ = [f"http://{h}/{p}{k}" for k in range(30) for h, p in (("a.net", "x"), ("shop.com", "de/"), ("shop.com", "fr/"), ("b.net", "y"), ("www.example.org", "es/"))]
    rows = []
    for k, u in enumerate(urls_):
        to = r.choice(urls_) if k % 4 == 0 else urls_[(k + 7) % len(urls_)] if k % 4 == 1 else urls_[0] if k % 20 == 2 else None
        rows.append((k, u, f'<html><head><link rel="canonical" href="{to}"></head></html>' if to and to != u else "<p>none</p>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    names = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(tuple(str(x[c]) for c in names) for x in op9_url_filter(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(tuple(map(str, x)) for x in con.execute(f"select {', '.join(names)} from ({sql.URLS})").fetchall())
    assert {x[4] for x in got if x[3] == "None"} == {"allow", "block"}
