"""Chapters in XML: documents, passages, tables and what was left out, parsed by one task a document.

The body is walked once into a flat run of blocks (prose or table, with their headings); numbering,
chunking and roles follow from the place in that run.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from .archives import archived

PROSE, GROUPS, TABLE = ("p",), ("list", "def-list", "boxed-text"), "table-wrap"
STRUCTURE = ("title", "label")
SKIPPED = ("fig", "graphic", "media", "disp-formula", "fn-group", "ref-list", "ack", "sec-meta", "related-object", "xref")

PASSAGE = "nbk_id string, passage_id string, chapter_section string, heading_path string, section_level int, chunk_index int, text string, text_hash string, char_count int, token_estimate int, passage_type string, passage_role string, table_id string, table_data struct<caption:string,header:array<string>,rows:array<array<string>>,footnotes:string>"
CHAPTER = "nbk_id string, short_name string, title string, pubmed_id string, authors string, initial_pub_date date, last_updated_date date"
AUDIT = "nbk_id string, body_text_chars long, captured_text_chars long, structural_chars long, skipped_chars long, unknown_chars long, unknown_tags map<string,long>, passage_count long"
PARSED = f"{CHAPTER}, error string, passages array<struct<{', '.join(re.sub(r'^(\w+) ', r'\1:', p) for p in re.split(r', (?=\w+ )', PASSAGE))}>>, audit struct<{', '.join(re.sub(r'^(\w+) ', r'\1:', p) for p in re.split(r', (?=\w+ )', AUDIT))}>"

Tokens = Callable[[str], list[tuple[int, int]]]


def blank_tokens(text: str) -> list[tuple[int, int]]:
    """Words by white space: the stand-in where a model's tokenizer isn't at hand."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def name(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def plain(node) -> str:
    return "" if node is None else "".join(node.itertext()).strip()


def squeezed(node) -> str:
    return " ".join(plain(node).split())


def spaced(node) -> str:
    return "" if node is None else " ".join(node.itertext()).strip()


def bullets(node, depth: int = 0) -> str:
    """A list as lines; nested lists are indented, labels lead their items."""
    out = []
    for item in (x for x in node if name(x) == "list-item"):
        label = next((squeezed(x) for x in item if name(x) == "label"), "")
        words = [squeezed(x) for x in item if name(x) not in ("list", "label")]
        out.append("  " * depth + "- " + " ".join(filter(None, [label, *words])))
        out += [bullets(x, depth + 1) for x in item if name(x) == "list"]
    return "\n".join(filter(None, out))


def definitions(node) -> str:
    pairs = [({name(x): squeezed(x) for x in item}) for item in node if name(item) == "def-item"]
    return "\n".join(f"- **{p.get('term', '')}**: {p.get('def', '')}" for p in pairs)


def boxed(node) -> str:
    """A box: its caption in bold, then its blocks, parted by blank lines."""
    out = []
    for x in node:
        kind = name(x)
        if kind in ("caption", "title"):
            out.append(f"**{squeezed(x)}**")
        elif kind == "sec":
            out.append(boxed(x))
        elif kind in GROUPS:
            out.append(rendered(x))
        else:
            out.append(squeezed(x))
    return "\n\n".join(filter(None, out))


def rendered(node) -> str:
    return {"list": bullets, "def-list": definitions, "boxed-text": boxed}.get(name(node), squeezed)(node)


def span(cell, key: str) -> int:
    value = cell.get(key) or "1"
    return max(1, int(value)) if value.isdigit() else 1


def grid(rows) -> list[list[str]]:
    """Cells of rows in a full grid: a spanning cell stands in every place it covers."""
    out: list[dict[int, str]] = []
    for r, row in enumerate(rows):
        while len(out) <= r:
            out.append({})
        at = 0
        for cell in (c for c in row if name(c) in ("td", "th")):
            while at in out[r]:
                at += 1
            for down in range(min(span(cell, "rowspan"), len(rows) - r)):
                while len(out) <= r + down:
                    out.append({})
                for over in range(span(cell, "colspan")):
                    out[r + down][at + over] = spaced(cell)
            at += span(cell, "colspan")
    return [[row[k] for k in sorted(row)] for row in out]


def one_header(rows: list[list[str]]) -> list[str]:
    out = []
    for k in range(max(map(len, rows), default=0)):
        labels = [re.sub(r"\s{2,}\d+\s*$", "", row[k]).strip() if k < len(row) else "" for row in rows]
        out.append(" / ".join(dict.fromkeys(filter(None, labels))))
    return out


def table(node, ordinal: int) -> dict:
    key = node.get("id") or f"table-{ordinal}"
    caption = node.find("caption")
    parts = [] if caption is None else [spaced(x) for x in caption if name(x) in ("title", "p")]
    body = node.find("table")
    head = [] if body is None else one_header(grid(body.findall("thead/tr")))
    rows = [] if body is None else grid(body.findall("tbody//tr"))
    foot = node.find("table-wrap-foot")
    notes = [] if foot is None else list(filter(None, (spaced(x) for x in foot.iter() if name(x) in ("p", "fn")))) or [spaced(foot)]
    return {"table_id": key, "caption": " - ".join(filter(None, parts)) or key, "header": head, "rows": rows, "footnotes": "\n".join(filter(None, notes))}


def markdown(t: dict) -> str:
    """A table as markdown; raises ValueError on rows that aren't as wide as the header."""
    row = lambda cells: f"| {' | '.join(cells)} |"
    if t["header"] and any(len(r) != len(t["header"]) for r in t["rows"]):
        raise ValueError("a row isn't as wide as the header")
    head = [row(t["header"]), row(["---"] * len(t["header"]))] if t["header"] else []
    return "\n".join([t["caption"], "", *head, *map(row, t["rows"]), *(["", t["footnotes"]] if t["footnotes"] else [])])


def section_of(title: str) -> str:
    return next((s for p, s in C.SECTION_RULES if re.search(p, title, re.I)), "other") if title else "other"


def role_of(text: str, path: str, kind: str, caption: str = "") -> str:
    n = len(text)
    if kind == "table":
        return "table_caption" if caption and n <= 2.0 * len(caption) + 50 else "table_body"
    heads = [h.strip() for h in path.split(" > ") if h.strip()]
    last, low = heads[-1] if heads else "", text.lower()
    if n <= 200 and (re.search(r"\bsee\s+", low) or any(p in low for p in C.CROSS_REFERENCE_PHRASES)) and last.endswith(C.CROSS_REFERENCE_HEADINGS):
        return "cross_reference"
    term = text.strip()
    named = last == "Nomenclature" and any(re.match(rf"^\w[\w\s\-/()]{{0,60}} {p} \S", term, re.I) for p in C.NOMENCLATURE_PHRASES)
    return "definition" if n <= 120 and (re.match(r"^\w[\w\s\-/()]{0,40}:\s+\S", term) or named) else "evidence"


@dataclass
class Block:
    titles: tuple[str, ...]
    level: int
    text: str = ""
    table: dict | None = None


@dataclass
class Ledger:
    structural: int = 0
    skipped: int = 0
    unknown: dict[str, int] = field(default_factory=dict)


def blocks(section, titles: tuple[str, ...], level: int, ledger: Ledger) -> Iterator[Block]:
    """Prose between tables and inner sections is one block; source order is kept."""
    here = (*titles, plain(section.find("title")) or "(untitled)")
    prose: list[str] = []

    def flush() -> Iterator[Block]:
        if prose:
            yield Block(here, level, "\n\n".join(prose))
            prose.clear()

    for x in section:
        kind = name(x)
        if kind in PROSE or kind in GROUPS:
            if text := plain(x) if kind in PROSE else rendered(x):
                prose.append(text)
        elif kind == TABLE:
            yield from flush()
            yield Block(here, level, table={"node": x})
        elif kind == "sec":
            yield from flush()
            yield from blocks(x, here, level + 1, ledger)
        elif n := len(squeezed(x)):
            if kind in STRUCTURE:
                ledger.structural += n
            elif kind in SKIPPED:
                ledger.skipped += n
            else:
                ledger.unknown[kind] = ledger.unknown.get(kind, 0) + n
    yield from flush()


def windows(text: str, tokens: Tokens, size: int, overlap: int) -> list[tuple[str, int]]:
    """Texts of token windows and their numbers of tokens."""
    spans = tokens(text)
    n, step = len(spans), size - overlap
    if n <= size:
        return [(text, n)]
    firsts = range(0, -(-(n - size) // step) * step + 1, step)
    return [(text[spans[f][0] : spans[min(f + size, n) - 1][1]], min(size, n - f)) for f in firsts]


def day(node) -> date | None:
    if node is None:
        return None
    try:
        y, m, d = (int(plain(node.find(k)) or default) for k, default in (("year", ""), ("month", "1"), ("day", "1")))
        return date(y, m, d)
    except ValueError:
        return None


def parse(raw: bytes, nbk_id: str, short_name: str, tokens: Tokens = blank_tokens, size: int = 510, overlap: int = 50) -> dict:
    """A document's row; ``error`` says why there are no passages."""
    import hashlib

    row: dict = {"nbk_id": nbk_id, "short_name": short_name, "passages": [], "error": None, "title": short_name, "pubmed_id": None, "authors": None, "initial_pub_date": None, "last_updated_date": None, "audit": None}
    if re.search(rb"<!(?:DOCTYPE[^>]*\[|ENTITY)", raw[:65536]):
        return row | {"error": "entities aren't allowed"}
    try:
        root = ET.fromstring(raw)
    except ET.ParseError as e:
        return row | {"error": f"XML syntax: {e}"}
    part = root if root.find("book-part-meta") is not None else next((p for p in root.iter("book-part") if p.find("book-part-meta") is not None), None)
    if part is None:
        return row | {"error": "no book-part-meta"}
    meta = part.find("book-part-meta")
    title = plain(meta.find("title-group/title")) or short_name
    people = [" ".join(filter(None, [plain(c.find("name/surname")), plain(c.find("name/given-names"))])) for c in meta.findall("contrib-group/contrib")]
    history = meta.find("pub-history")
    if history is not None:
        dates = {d.get("date-type"): d for d in reversed(history.findall("date"))}
        first, latest = dates.get("created"), dates.get("updated", dates.get("revised"))
    else:
        dates = {d.get("pub-type"): d for d in reversed(meta.findall("pub-date"))}
        first, latest = dates.get("initial"), dates.get("last-revision", dates.get("updated"))
    row |= {"title": title, "pubmed_id": plain(meta.find("book-part-id[@pub-id-type='pmid']")) or None, "authors": ", ".join(filter(None, people)) or None, "initial_pub_date": day(first), "last_updated_date": day(latest)}
    body, ledger, out, tables = part.find("body"), Ledger(), [], 0
    tops = [] if body is None else body.findall("sec")
    run = [b for s in tops for b in blocks(s, (), 1, ledger)] if tops else list(blocks(body, (title,), 1, ledger)) if body is not None else []
    for b in run:
        path, kind, data = " > ".join(b.titles), "narrative", None
        if b.table:
            tables += 1
            kind, data = "table", table(b.table["node"], tables)
            path = f"{path} > Table {tables}"
            try:
                whole = markdown(data)
            except ValueError as e:
                return row | {"error": f"table {data['table_id']}: {e}"}
            pieces = [(whole, len(whole.split()))]
        else:
            pieces = windows(b.text, tokens, size, overlap)
        for text, n in pieces:
            out.append({"nbk_id": nbk_id, "passage_id": f"{nbk_id}:{len(out):04d}", "chapter_section": section_of(b.titles[0]), "heading_path": path, "section_level": b.level, "chunk_index": len(out), "text": text, "text_hash": hashlib.sha256(text.encode()).hexdigest(), "char_count": len(text), "token_estimate": n, "passage_type": kind, "passage_role": role_of(text, path, kind, data["caption"] if data else ""), "table_id": data and data["table_id"], "table_data": data and {k: data[k] for k in ("caption", "header", "rows", "footnotes")}})
    row["passages"] = out
    row["audit"] = {"nbk_id": nbk_id, "body_text_chars": len(squeezed(body)) if body is not None else 0, "captured_text_chars": sum(p["char_count"] for p in out), "structural_chars": ledger.structural, "skipped_chars": ledger.skipped, "unknown_chars": sum(ledger.unknown.values()), "unknown_tags": ledger.unknown, "passage_count": len(out)}
    return row


def parsed(files: DataFrame, tokens: Tokens = blank_tokens, size: int = 510, overlap: int = 50) -> DataFrame:
    """Documents of (nbk_id, short_name, content): one row each, passages and audit nested, faults in ``error``."""
    if overlap >= size:
        raise ValueError("the overlap has to be smaller than the window")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse(bytes(c), i, s, tokens, size, overlap) for i, s, c in zip(b.nbk_id, b.short_name, b.content, strict=True)]
            yield pd.DataFrame(rows, columns=["nbk_id", "short_name", "title", "pubmed_id", "authors", "initial_pub_date", "last_updated_date", "error", "passages", "audit"])

    return files.select("nbk_id", "short_name", "content").mapInPandas(run, PARSED)


def tables_of(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chapters, passages and audits of parsed documents; faulty ones are in none of them."""
    good = documents.filter("error is null")
    chapters = good.drop("error", "passages", "audit")
    return chapters, good.select(F.explode("passages").alias("p")).select("p.*"), good.select("audit.*")


def enriched(chapters: DataFrame, genes: DataFrame, omim: DataFrame) -> DataFrame:
    """Chapters with their symbols and OMIM ids (arrays in order of first appearance, empty without)."""
    from ..operators.lookups import ordered_distinct, primary_symbols

    g = ordered_distinct(genes, "nbk_id", "gene", "line_no").withColumnRenamed("values", "gene_symbols")
    o = ordered_distinct(omim, "nbk_id", "omim", "line_no").withColumnRenamed("values", "omim_ids")
    empty = F.array().cast("array<string>")
    out = chapters.join(g, "nbk_id", "left").join(o, "nbk_id", "left").withColumn("gene_symbols", F.coalesce("gene_symbols", empty)).withColumn("omim_ids", F.coalesce("omim_ids", empty))
    return out.withColumn("primary_gene_symbols", primary_symbols(F.col("title"), F.col("gene_symbols")))


def unpacked(spark: SparkSession, archive: str, suffix: str = ".nxml") -> DataFrame:
    """(short_name, content) of the members of an archive, or of a folder of archives, each streamed by a task of its own."""
    return archived(spark, archive, suffix).select("short_name", "content")
