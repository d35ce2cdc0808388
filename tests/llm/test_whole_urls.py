"""Op 9 on pages that name several urls, and relative ones."""

import pytest
from test_urls import judged, link


def refresh(url):
    return f'<meta http-equiv="refresh" content="0; url={url}">'


def test_every_link_counts(spark):
    rows = [
        (1, "http://a.net/1", link("http://a.net/2") + refresh("http://bad.com/de/x")),
        (2, "http://a.net/2", None),
        (3, "http://b.net/1", link("http://b.net/2") + '<link rel="canonical" href="http://bad.com/de/y">'),
        (4, "http://c.net/1", refresh("/2") + refresh("http://bad.com/de/z")),
        (5, "http://c.net/2", "<p>"),
        (6, "http://d.net/1", link("mailto:a@bad.com") + link("#de")),
    ]
    got = {k: v[3] for k, v in judged(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow"}


@pytest.mark.parametrize("href, meant", [("../x", "http://com.com/de/x"), ("./x", "http://com.com/de/q/x"), ("?p=1", "http://com.com/de/q/r?p=1"), ("../../de/./y/..", "http://com.com/de/"), ("/a/../de/k", "http://com.com/de/k")])
def test_relative_links(spark, href, meant):
    """A page that fits no rule is joined to the page meant, and with it to what that one names."""
    rows = [(1, "http://COM.com/de/q/r", link(href)), (2, meant, None), (3, "http://e.net/", link(meant))]
    got = judged(spark, rows, rules=[("block", "e.net", "/")])
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block"}
    got = judged(spark, rows, rules=[("block", "com.com", meant[len("http://com.com") :].split("?")[0])])
    assert got[3][3] == "block"
