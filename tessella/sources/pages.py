"""Web pages: main content, title, metadata, sections and references, from a small tree of the page."""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = ("h2", "h3")
#: Blocks that hold one of these are none of the document's own.
UNWANTED = ("federal government", "the .gov means", "https://", "the site is secure", "sharing sensitive information", "encrypted and transmitted securely", "javascript to function", "ncbi web site requires", "show details", "author information and affiliations", "email:")
NO_TITLES = ("bookshelf", "ncbi bookshelf")
DATE = re.compile(r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b", re.I)
SCHEMA = "title string, authors string, update_info string, publication_info string, last_updated string, n_references int, sections array<struct<key:string,title:string,level:int,parent:string,content:string>>"


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                todo += reversed(n.children)
        return "".join(out)

    def has(self, *tags: str) -> bool:
        return any(n.tag in tags for n in self.walk() if n is not self)

    def find(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if n is not self and test(n)), None)

    def spans(self) -> Iterator[tuple[str, Node]]:
        """Bits of text with their elements."""
        for n in self.walk():
            for c in n.children:
                if isinstance(c, str):
                    yield c, n


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES and self.at.tag in CLOSES[tag]:
            self.at = self.at.parent
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def clean(text: str) -> str:
    text = re.sub(r"&[a-zA-Z0-9#]+;", "", re.sub(r"<[^>]+>", "", text))
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFC", text))
    text = re.sub(r"(?i)\s*(Show details|Hide details)\s*", "", text)
    return re.sub(r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "", text).strip()


def key(title: str) -> str:
    out = re.sub(r"[-\s]+", "_", re.sub(r"[^\w\s-]", "", title.lower()).strip())
    return re.sub(r"(_section|_chapter)$", "", re.sub(r"^(the_|a_|an_)", "", out))[:50]


def wanted(text: str) -> bool:
    return len(text) >= 15 and not any(p in text.lower() for p in UNWANTED)


def main_content(root: Node) -> Node | None:
    """The first that fits of ever looser descriptions of a page's main part."""
    divs = [n for n in root.walk() if n.tag == "div"]

    def by_class(pattern: str, nodes: list[Node]) -> Node | None:
        return next((n for n in nodes if re.search(pattern, n.attrs.get("class", ""), re.I)), None)

    exact = next((n for n in divs if n.attrs.get("class") == "main-content lit-style"), None)
    if exact:
        return exact
    loose = [by_class("main-content", divs), by_class("main.*content", divs)]
    loose += [n for n in divs if n.attrs.get("id", "").startswith("NBK")]
    loose += [by_class(p, divs) for p in ("content", "main", "article", "chapter", "body")] + [next((n for n in divs if n.attrs.get("role") == "main"), None)]
    loose += [root.find(lambda n, t=t: n.tag == t) for t in ("main", "article", "section")]
    for n in loose:
        if n is not None and n.has(*HEADINGS):
            return n
    many = (n for n in root.walk() if n.tag in ("div", "section", "article") and sum(x.tag in HEADINGS for x in n.walk()) >= 3)
    return next(many, None) or root.find(lambda n: n.tag == "body")


def title_of(root: Node, content: Node) -> str:
    def good(text: str) -> str | None:
        return text if (text := text.strip()) and text.lower() not in NO_TITLES else None

    tries: list[Callable[[], str | None]] = []
    for h in (n for n in content.walk() if n.tag == "h1"):
        inner = h.find(lambda n: n.tag == "span" and "title" in n.attrs.get("class", "").split())
        tries += [lambda s=s: good(s.text()) for s in (inner, h) if s is not None]
    tries.append(lambda: good(n.text()) if (n := content.find(lambda n: n.attrs.get("itemprop") == "name")) else None)
    tries.append(lambda: good(re.sub(r"(?i)\s*-\s*(NCBI\s*Bookshelf|GeneReviews|PubMed).*$", "", n.text().strip())) if (n := root.find(lambda n: n.tag == "title")) else None)
    for test in (lambda n: re.search("title", n.attrs.get("class", ""), re.I), lambda n: re.search("heading", n.attrs.get("class", ""), re.I), lambda n: "data-title" in n.attrs):
        tries.append(lambda t=test: good(n.text()) if (n := content.find(t)) else None)
    for attr, name in (("property", "og:title"), ("name", "dc.title")):
        tries.append(lambda a=attr, v=name: good(n.attrs.get("content", "")) if (n := root.find(lambda n: n.tag == "meta" and n.attrs.get(a) == v)) else None)
    return next(filter(None, (t() for t in tries)), "Unknown Document")


def about(content: Node, patterns: tuple[str, ...], rest: bool = False) -> str | None:
    """Text of the element where one of the patterns stands (or what follows it there)."""
    for p in patterns:
        for text, n in content.spans():
            if re.search(p, text, re.I):
                whole = n.text().strip()
                found = whole if not rest else whole[m.end() :].strip() if (m := re.search(p, whole, re.I)) else ""
                if found:
                    return found
    return None


def last_updated(content: Node) -> str | None:
    for text, n in content.spans():
        if re.search(r"updated?|revised?", text, re.I) and (m := DATE.search(n.text())):
            return m[0].strip()
    return None


def collected(nodes: list, seen: set[int]) -> str:
    """Blocks of text once each: no node twice, no text twice."""
    out: list[str] = []
    for n in nodes:
        for x in n.walk() if isinstance(n, Node) else ():
            if x.tag in ("p", "ul", "ol", "dl", "table") and id(x) not in seen and not any(id(a) in seen for a in _above(x)):
                seen.add(id(x))
                text = clean(x.text())
                if wanted(text) and text not in out:
                    out.append(text)
    return " ".join(out)


def _above(n: Node) -> Iterator[Node]:
    while (n := n.parent) is not None:
        yield n


def until(children: list, start: int, stop: tuple[str, ...]) -> list:
    end = next((k for k in range(start, len(children)) if isinstance(children[k], Node) and children[k].tag in stop), len(children))
    return children[start:end]


def sections(content: Node) -> list[dict]:
    """Sections (level 2) and theirs (level 3): of divs whose id has a dot, or else by headings alone."""
    out: dict[str, dict] = {}
    seen: set[int] = set()
    used: set[int] = set()

    def put(title: str, text: str, level: int, parent: str | None, least: int) -> str | None:
        if len(title) >= 3 and len(text) > least:
            out.setdefault(f"{parent or ''}/{key(title)}", {"key": key(title), "title": title, "level": level, "parent": parent, "content": text})
            return key(title)
        return None

    divs = [n for n in content.walk() if n.tag == "div" and "." in n.attrs.get("id", "") and not n.attrs["id"].startswith("_")]
    for d in divs:
        head = next((c for c in d.children if isinstance(c, Node) and c.tag == "h2"), None) or d.find(lambda n: n.tag == "h2")
        if head is None or any(id(a) in used for a in _above(d)):
            continue
        used.add(id(d))
        title = head.text().strip()
        subs = [(k, c) for k, c in enumerate(d.children) if isinstance(c, Node) and c.tag == "h3"]
        first = subs[0][0] if subs else len(d.children)
        own = put(title, clean(f"{title} {collected(d.children[:first], seen)}"), 2, None, 50)
        for k, h in subs:
            put(h.text().strip(), collected(until(d.children, k + 1, HEADINGS), seen), 3, own, 30)
    if not out:
        parent = None
        for h in (n for n in content.walk() if n.tag in HEADINGS):
            kids = h.parent.children
            body = collected(until(kids, kids.index(h) + 1, ("h2",) if h.tag == "h2" and not any(isinstance(c, Node) and c.tag == "h3" for c in kids) else HEADINGS), seen)
            title = h.text().strip()
            name = put(title, clean(f"{title} {body}") if h.tag == "h2" else body, 2 if h.tag == "h2" else 3, None if h.tag == "h2" else parent, 30)
            parent = name if h.tag == "h2" else parent
    return list(out.values())


def references(content: Node, most: int = 50) -> list[str]:
    lists = (n for n in content.walk() if re.search("ref", f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}", re.I))
    items = [clean(x.text()) for n in lists for x in n.walk() if x.tag in ("li", "p")]
    return list(dict.fromkeys(t for t in items if len(t) > 20))[:most]


def read(html: str | None) -> dict:
    root = Tree(html or "").root
    content = main_content(root)
    if content is None:
        return {"title": "Unknown Document", "authors": None, "update_info": None, "publication_info": None, "last_updated": None, "n_references": 0, "sections": []}
    return {
        "title": title_of(root, content),
        "authors": about(content, (r"Author[s]?\s*:", r"By\s*:", r"Written\s*by"), rest=True),
        "update_info": about(content, (r"Last\s*(Updated?|Revision)", r"Updated?\s*:", r"Revision\s*History", r"Initial\s*Posting")),
        "publication_info": about(content, ("Copyright", "Published", "Citation")),
        "last_updated": last_updated(content),
        "n_references": len(references(content)),
        "sections": sections(content),
    }


def scraped(pages: DataFrame, html: str = "html") -> DataFrame:
    """Each page with title, metadata and sections; the html itself is left out."""
    keep = [c for c in pages.columns if c != html]
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([read(h) for h in b[html]], columns=[c.split()[0] for c in re.split(r", (?=\w+ (?:string|int|array))", SCHEMA)], index=b.index)
            yield pd.concat([b[keep], found], axis=1)

    return pages.mapInPandas(run, f"{kinds}, {SCHEMA}")


# Records of the live services, from landed responses --------------------------------------------------------


def search_result(responses: DataFrame, body: str = "body", most: int | None = None) -> DataFrame:
    """Count and ids of a JSON search response; ``ids`` may be cut, the count is of all."""
    r = F.from_json(body, "esearchresult struct<count:string,idlist:array<string>>")["esearchresult"]
    ids = F.coalesce(r["idlist"], F.array().cast("array<string>"))
    return responses.select(*[c for c in responses.columns if c != body], F.coalesce(r["count"].cast("int"), F.lit(0)).alias("count"), (ids if most is None else F.slice(ids, 1, most)).alias("ids"))


_ARTICLES = "pmid string, title string, abstract string, authors array<string>, journal string, year string, kind string"


def _text(node: ET.Element | None) -> str | None:
    """All text of an element, with that of the marks inside, white space squeezed; null if there is none."""
    return (re.sub(r"\s+", " ", "".join(node.itertext())).strip() or None) if node is not None else None


def read_articles(body: str | None) -> list[dict]:
    """Title, labelled abstract, authors, journal and year of each record (article or book chapter) of an XML response."""
    try:
        root = ET.fromstring(body or "")
    except ET.ParseError:
        return []
    out, records = [], [(kind, r) for kind, tag in (("article", "PubmedArticle"), ("book", "PubmedBookArticle")) for r in root.iter(tag)]
    for kind, record in records or ([("article", root)] if root.find(".//ArticleTitle") is not None else []):
        if record is not None:
            find = lambda *paths: next((t for p in paths if (t := _text(record.find(p)))), None)  # noqa: B023, E731
            parts = [(x.get("Label"), _text(x)) for x in record.iterfind(".//Abstract/AbstractText")]
            authors = []
            for a in record.iterfind(".//AuthorList/Author"):
                name = " ".join(filter(None, (_text(a.find("LastName")), _text(a.find("ForeName")) or _text(a.find("Initials")))))
                if name or (name := _text(a.find("CollectiveName"))):
                    authors.append(name)
            out.append({
                "pmid": find(".//PMID"), "title": find(".//ArticleTitle", ".//BookTitle"),
                "abstract": "\n\n".join(f"{label}: {t}" if label else t for label, t in parts if t) or None, "authors": authors,
                "journal": find(".//Journal/Title", ".//Book/BookTitle"), "year": find(".//PubDate/Year", ".//ContributionDate/Year"), "kind": kind,
            })
    return out


def articles(responses: DataFrame, body: str = "body") -> DataFrame:
    """The records of XML responses, one a row, articles before book chapters; a response without any, or of broken XML, gives none."""
    keep = [c for c in responses.columns if c != body]

    # Each response is read as a whole, so that the parts of a record stay together.
    @F.pandas_udf(f"array<struct<{_ARTICLES}>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(read_articles)

    return responses.select(*keep, F.explode(run(body)).alias("_r")).select(*keep, "_r.*")


#: Places of linked records, by what the name of a link set holds.
BOOKS, ARTICLES_AT = "https://www.ncbi.nlm.nih.gov/books/{}/", "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC{}/"


def read_links(body: str | None) -> list[dict]:
    """Url, kind and provider of each link of an XML response, once each, in their order.

    Links that a provider gives are ``prlinks``, others ``llinks`` with their category for a provider; sets
    of linked records give ``books`` and ``pmc`` links by id.
    """
    try:
        root = ET.fromstring(body or "")
    except ET.ParseError:
        return []
    found: dict[tuple[str, str], str | None] = {}
    for link in root.iter("ObjUrl"):
        provider = _text(link.find("Provider/Name"))
        if url := _text(link.find("Url")):
            found.setdefault((url, "prlinks" if provider else "llinks"), provider or _text(link.find("Category")))
    for linked in root.iter("LinkSetDb"):
        name = (_text(linked.find("LinkName")) or "").lower()
        for number in filter(None, (_text(x.find("Id")) for x in linked.iterfind("Link"))):
            if "books" in name:
                found.setdefault((BOOKS.format(number if number.startswith("NBK") else f"NBK{number}"), "books"), "NCBI Bookshelf")
            elif "pmc" in name:
                found.setdefault((ARTICLES_AT.format(number), "pmc"), "PubMed Central")
    return [{"url": url, "link_type": kind, "provider": provider, "at": k} for k, ((url, kind), provider) in enumerate(found.items())]


def links(responses: DataFrame, body: str = "body", fallback: str | None = None) -> DataFrame:
    """Distinct links of XML link records with their providers and kinds, grouped by kind.

    ``fallback`` names a column with another response, read where the first has no link.
    """
    keep = [c for c in responses.columns if c not in (body, fallback)]

    @F.pandas_udf("array<struct<at int, url string, provider string, link_type string>>")
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([read_links(a) or read_links(b) for a, b in zip(first, second, strict=True)], first.index, object)

    each = responses.select(*keep, F.explode(run(F.col(body), F.col(fallback) if fallback else F.lit(None).cast("string"))).alias("_r")).select(*keep, "_r.*")
    first = each.groupBy(*keep, "url", "link_type").agg(F.min_by(F.struct("at", "url", "provider"), "at").alias("l"))
    return first.groupBy(*keep, "link_type").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: F.struct(x["url"].alias("url"), x["provider"].alias("provider"))).alias("links"))


def book_url(links_: DataFrame, preferred: list[str], by: str, db: str = "db", url: str = "url", at: str | None = None) -> DataFrame:
    """The first book url of each key: of the preferred sources, in their order, or else of any; ``at`` says what comes first."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(db)).cast("int"), F.lit(0))
    first = [F.col(at)] if at else []
    return links_.filter(F.col(url).contains("/books/")).groupBy(by).agg(F.min_by(url, F.struct(F.when(order == 0, 1 << 20).otherwise(order), *first, F.col(url))).alias("book_url"))
