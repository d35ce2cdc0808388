"""URL filtering with redirect equivalence. DataFrame functions only.

A rule (action, host, path) fits its host and all subdomains where the url's path starts with the rule's;
the longest fitting rule decides. Pages without a rule take the decision of their equivalence class: the
connected component over canonical links and redirects. In a class an explicit allow comes before any
block; without either a page is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few, without
from .graph import components

Rule = tuple[str, str, str]
OWN = ["host", "path", "rule", "verdict"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A canonical link or a refresh, attributes in either order.
_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"'>\s]+)"""


def parsed(df: DataFrame, url: str, into: str = "") -> DataFrame:
    """``df`` with host, path, scheme and node of a url column, their names led by ``into``.

    Host and path follow the first ``://`` and are empty for null or without. The node is an id of the
    resource: the url without its fragment and dot segments, scheme and host in lower case; null if it is
    no absolute url. ``way`` is the path without dot segments. Each step is a column of its own, so that no part of a url is computed twice.
    """
    c = {k: f"_{into}{k}" for k in ("at", "rest", "site", "tail")}
    out = df.withColumn(c["at"], F.coalesce(F.locate("://", F.col(url)), F.lit(0)))
    out = out.withColumn(c["rest"], F.when(F.col(c["at"]) > 0, F.substr(url, F.col(c["at"]) + 3)).otherwise(F.lit("")))
    out = out.withColumn(c["site"], F.regexp_extract(c["rest"], r"^[^/?#]*", 0))
    out = out.withColumn(c["tail"], F.substr(c["rest"], F.length(c["site"]) + 1))
    out = out.withColumn(f"{into}host", F.translate(c["site"], _UPPER, _LOWER)).withColumn(f"{into}path", F.regexp_extract(c["tail"], r"^[^?#]*", 0))
    out = out.withColumn(f"{into}scheme", F.when(F.col(c["at"]) > 1, F.translate(F.substr(url, F.lit(1), F.col(c["at"]) - 1), _UPPER, _LOWER)))
    out = out.withColumn(f"{into}way", without_dots(F.col(f"{into}path")))
    query = F.regexp_extract(F.substr(c["tail"], F.length(f"{into}path") + 1), r"^[^#]*", 0)
    whole = F.concat(f"{into}scheme", F.lit("://"), f"{into}host", F.when(F.col(f"{into}way") == "", F.lit("/")).otherwise(F.col(f"{into}way")), query)
    return out.withColumn(f"{into}node", F.unhex(F.md5(whole))).drop(*c.values())


def without_dots(path: Column) -> Column:
    """A path with its segments ``.`` and ``..`` resolved (RFC 3986, 5.2.4)."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.split(F.substr(path, F.lit(2)), "/", -1), none, lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.array_append(a, s)))
    kept = F.concat(kept, F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(none))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def fitting(rules: Sequence[Rule], h: Column, p: Column) -> tuple[Column, Column]:
    """Rule (host and path as one text) and action of the longest fitting rule; nulls if none fits.

    Of equally long rules an allow wins, then the smaller text.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a, rule_host, rule_path in reversed(order):
        fits = ((h == rule_host) | h.endswith(f".{rule_host}")) & p.startswith(rule_path)
        name, action = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(a)).otherwise(action)
    return name, action


def targets(pages: DataFrame, url: str, html: str, scratch: Scratch) -> DataFrame:
    """(src, dst): urls of pages and every absolute url that each names as canonical or redirects to."""
    low = F.lower(html)
    out = pages.select(F.col(url).alias("src"), F.col(html).alias("html"), low.contains("canonical").alias("l"), low.contains("refresh").alias("r")).filter("l or r")
    none = F.array().cast("array<string>")
    links = F.concat(*[F.regexp_extract_all("html", F.lit(_LINK), F.lit(k)) for k in (1, 2, 3)])
    moves = F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(1))
    named = F.concat(F.when(F.col("l"), links).otherwise(none), F.when(F.col("r"), moves).otherwise(none))
    out = out.select("src", F.explode(F.array_distinct(named)).alias("href"))
    out = out.select("src", F.trim(F.replace("href", F.lit("&amp;"), F.lit("&"))).alias("href"))
    # Few pages name another url. A copy of them keeps the steps that follow from being folded into one expression.
    out = scratch.put(out.filter("href != ''"))
    out = parsed(out, "src").withColumn("site", F.concat("scheme", F.lit("://"), "host"))
    href, folder = F.col("href"), F.regexp_extract("path", r"^(?s:.*)/", 0)
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat("scheme", F.lit(":"), href))
        .when(href.startswith("/"), F.concat("site", href))
        .when(href.startswith("?"), F.concat("site", F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")), href))
        # A part of the same page, or what is no place on a host (mailto:), is no other url.
        .when(href.startswith("#") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat("site", F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )
    return out.select("src", whole.alias("dst"))


def judged(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Each page with host, path, rule and verdict (allow or block).

    ``redirects`` may give more edges, as (src, dst) urls. A page without url, or whose url has no ``://``,
    has an empty host and path, fits no rule and is allowed. Null or empty html names no other url.
    Repeated urls are one resource, and get one verdict; an empty table gives an empty one. Very long urls and
    pages are read whole. Columns that clash with the results are replaced.
    """
    keep = without(pages, OWN)
    with Scratch(pages.sparkSession) as scratch:
        fate = few(fates(pages, rules, url, html, redirects, scratch))
    # A row travels as one column, so that no name of its own meets those that are used here.
    own = parsed(pages.select(F.struct(*keep).alias("row"), F.col(url).alias("url")), "url")
    name, action = fitting(rules, F.col("host"), F.col("path"))
    result = [*[F.col("row")[c].alias(c) for c in keep], F.col("host"), F.col("path"), name.alias("rule")]
    met = own.filter("node is not null").join(fate, F.col("node") == F.col("_node"), "left").select(*result, F.coalesce(action, "_fate", F.lit("allow")).alias("verdict"))
    # Pages without a url are in no class; they meet none, as all of them would do so in one task.
    return met.unionByName(own.filter("node is null").select(*result, F.coalesce(action, F.lit("allow")).alias("verdict")))


def fates(pages: DataFrame, rules: Sequence[Rule], url: str, html: str, redirects: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(_node, _fate) of the nodes whose class holds one with a rule, as a stored table."""
    links = targets(pages, url, html, scratch)
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    links = scratch.put(links.filter("src is not null and dst is not null"))
    links = scratch.put(parsed(parsed(links, "src"), "dst", "to_").select("host", "path", "node", "to_host", F.col("to_way").alias("to_path"), "to_node"))
    links = links.filter("node is not null and to_node is not null")
    groups = components(links.filter("node != to_node").select(F.col("node").alias("u"), F.col("to_node").alias("v")), scratch).select(F.col("node").alias("_node"), F.col("component").alias("_group"))
    # Urls that are only named decide for their class as pages do.
    ends = links.select("host", "path", "node").union(links.select("to_host", "to_path", "to_node"))
    _, action = fitting(rules, F.col("host"), F.col("path"))
    ruled = ends.select(F.col("node").alias("_node"), action.alias("a")).filter("a is not null").distinct()
    fate = scratch.put(ruled.join(few(groups), "_node").groupBy("_group").agg(F.bool_or(F.col("a") == "allow").alias("allow")))
    return scratch.put(groups.join(few(fate), "_group").select("_node", F.when(F.col("allow"), "allow").otherwise("block").alias("_fate")), stay=True)
