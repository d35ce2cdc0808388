"""Column expressions for passages, sections, citations and scores; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mapped(key: Column, values: dict, default) -> Column:
    """Look a key up in a small fixed map."""
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.coalesce(key, F.lit(""))), F.lit(default))


# Text ------------------------------------------------------------------------------------------------------


def squeezed(text: Column | str) -> Column:
    """Runs of (Unicode) white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def stripped(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def right_stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def leading_excerpt(text: Column | str, most: int) -> Column:
    """At most ``most`` characters, cut back to the last blank beyond the middle, with an ellipsis if cut."""
    whole = stripped(text)
    cut = right_stripped(F.left(whole, F.lit(most)))
    before = F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)
    shorter = F.when(F.length(before) > most // 2, right_stripped(before)).otherwise(cut)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(shorter, F.lit("…")))


def html_text(html: Column | str) -> Column:
    """Tags, entities, show/hide labels and controls gone, odd blanks made plain, white space squeezed."""
    out = F.regexp_replace(F.regexp_replace(col(html), C.HTML_TAG, ""), C.HTML_ENTITY, "")
    out = F.regexp_replace(F.regexp_replace(out, C.ODD_BLANK, " "), r"(?U)\s+", " ")
    out = F.regexp_replace(out, C.DETAILS_LABEL, "")
    return F.trim(F.regexp_replace(out, C.CONTROL, ""))


def section_key(title: Column | str) -> Column:
    """A title as a key: lower case, marks gone, blanks and dashes as underscores, at most 50 characters."""
    out = stripped(F.regexp_replace(F.lower(col(title)), C.KEY_MARK, ""))
    out = F.regexp_replace(F.regexp_replace(out, C.KEY_BLANK, "_"), C.KEY_ARTICLE, "")
    return F.left(F.regexp_replace(out, C.KEY_KIND, ""), F.lit(50))


def reference_fields(text: Column | str) -> Column:
    """pmid, year, authors, title and journal of a reference as far as they are found."""
    t = col(text)
    some = lambda x: F.nullif(x, F.lit(""))
    authors = some(stripped(F.regexp_extract(t, C.REFERENCE_AUTHORS, 1)))
    quoted, plain = some(stripped(F.regexp_extract(t, C.REFERENCE_QUOTED, 1))), some(stripped(F.regexp_extract(t, C.REFERENCE_TITLE, 1)))
    title = F.coalesce(quoted, plain)
    journal = F.coalesce(some(stripped(F.regexp_extract(t, C.REFERENCE_JOURNAL, 1))), some(F.regexp_extract(t, C.REFERENCE_JOURNAL_WORDS, 1)))
    return F.struct(
        some(F.regexp_extract(t, C.REFERENCE_PMID, 1)).alias("pmid"),
        some(F.regexp_extract(t, C.REFERENCE_YEAR, 0)).alias("year"),
        F.when(~authors.rlike(r"\d{4}"), authors).alias("authors"),
        F.when(F.length(title) > 10, title).alias("title"),
        F.when((F.length(journal) > 3) & ~journal.rlike(r"\d"), journal).alias("journal"),
    )


def last_updated_text(text: Column | str) -> Column:
    """The first date in a text that speaks of an update."""
    found = F.regexp_extract(col(text), C.UPDATE_DATE, 0)
    return F.when(col(text).rlike(C.UPDATE_WORD), F.nullif(found, F.lit("")))


def fenced_text(text: Column | str) -> Column:
    return F.regexp_replace(col(text), C.FORBIDDEN, "")


def message_text(text: Column | str, most: int = 280) -> Column:
    """A message for others: what may not leave the fence is gone, and at most ``most`` characters are left."""
    return F.left(fenced_text(text), F.lit(most))


def fence(text: Column | str, source: str, record: Column, at: Column | None = None) -> Column:
    """Untrusted text, normalised (NFC) and without what may not leave the fence, with where it is from and the digest of its raw form."""
    from .python import nfc

    raw = col(text)
    return F.struct(F.lit("untrusted_text").alias("kind"), fenced_text(nfc(raw)).alias("text"), F.struct(F.lit(source).alias("source"), record.alias("record_id"), (at if at is not None else F.lit(None).cast("timestamp")).alias("retrieved_at")).alias("provenance"), F.sha2(raw, 256).alias("raw_sha256"))


def unwanted(text: Column | str, phrases: tuple[str, ...], least: int = 15) -> Column:
    """Whether a block is too short, or holds one of the phrases in any case."""
    low = F.lower(col(text))
    found = F.lit(False)
    for p in phrases:
        found = found | low.contains(p.lower())
    return (F.length(col(text)) < least) | found


def heading_path(titles: Column) -> Column:
    return F.concat_ws(" > ", titles)


def author_list(authors: Column) -> Column:
    """``Surname Given, …`` of an array of (surname, given)."""
    return F.array_join(F.transform(authors, lambda a: F.trim(F.concat_ws(" ", a["surname"], a["given"]))), ", ")


# Identifiers -----------------------------------------------------------------------------------------------


def canonical_id(raw: Column | str) -> Column:
    """Leading zeros of the number of an ``NBK`` id are dropped; anything else stays."""
    return F.regexp_replace(col(raw), r"^NBK0+(?=\d+$)", "NBK")


def passage_id(doc: Column, chunk: Column) -> Column:
    return F.format_string("%s:%04d", doc, chunk)


def citation(doc: Column, updated: Column, passage: Column) -> Column:
    return F.concat(doc, F.lit(". Updated "), F.coalesce(F.date_format(updated, "yyyy-MM-dd"), F.lit("date n/a")), F.lit(". Passage "), passage, F.lit("."))


def source_url(doc: Column) -> Column:
    return F.concat(F.lit("https://www.ncbi.nlm.nih.gov/books/"), doc, F.lit("/"))


def record_id(url: Column | str, pmid: Column | str) -> Column:
    """The book id of a url, or else ``pmid:`` and the article's number."""
    return F.coalesce(F.nullif(F.regexp_extract(col(url), r"/books/(NBK\d+)", 1), F.lit("")), F.concat(F.lit("pmid:"), col(pmid)))


# Sections and roles ----------------------------------------------------------------------------------------


def canonical_section(title: Column | str) -> Column:
    out = F.lit("other")
    for pattern, section in reversed(C.SECTION_RULES):
        out = F.when(col(title).rlike(f"(?i){pattern}"), F.lit(section)).otherwise(out)
    return F.when(F.coalesce(col(title), F.lit("")) == "", F.lit("other")).otherwise(out)


def last_heading(path: Column) -> Column:
    parts = F.filter(F.transform(F.split(path, " > "), lambda h: stripped(h)), lambda h: h != "")
    return F.get(parts, F.size(parts) - 1)


def passage_role(text: Column | str, path: Column | str, kind: Column | str, chars: Column | str, caption: Column | None = None) -> Column:
    """table_caption / table_body for tables, else cross_reference, definition or evidence."""
    text, path, kind, chars = map(col, (text, path, kind, chars))
    caption = F.coalesce(caption if caption is not None else F.lit(None).cast("string"), F.lit(""))
    low, head = F.lower(text), F.coalesce(last_heading(path), F.lit(""))
    trigger = text.rlike(r"(?iU)\bsee\s+")
    for p in C.CROSS_REFERENCE_PHRASES:
        trigger = trigger | low.contains(p)
    ends = F.lit(False)
    for h in C.CROSS_REFERENCE_HEADINGS:
        ends = ends | head.endswith(h)
    term = stripped(text)
    named = F.lit(False)
    for p in C.NOMENCLATURE_PHRASES:
        named = named | term.rlike(rf"(?iU)^\w[\w\s\-/()]{{0,60}} {p} \S")
    definition = (chars <= 120) & (term.rlike(r"(?U)^\w[\w\s\-/()]{0,40}:\s+\S") | ((head == "Nomenclature") & named))
    return (
        F.when((kind == "table") & (caption != "") & (chars <= F.length(caption) * 2.0 + 50), "table_caption")
        .when(kind == "table", "table_body")
        .when((chars <= 200) & trigger & ends, "cross_reference")
        .when(definition, "definition")
        .otherwise("evidence")
    )


def known_role(role: Column | str) -> Column:
    return F.when(col(role).isin(*C.ROLES), col(role))


# Dates -----------------------------------------------------------------------------------------------------


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Month and day default to 1; null if there is no such date."""
    whole = F.format_string("%04d-%02d-%02d", F.try_to_number(year, F.lit("9999")).cast("int"), F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1)))
    return F.try_to_date(whole, "yyyy-MM-dd")


def years_since(day: Column | str, today: Column) -> Column:
    return F.round(F.date_diff(today, col(day)) / F.lit(365.25), 1)


def staleness_band(years: Column | str) -> Column:
    y = col(years)
    return F.when(y < 2.0, "current").when(y < 4.0, "aging").when(y < 7.0, "stale").when(y.isNotNull(), "very_stale")


def stale_for_therapy(band: Column | str, sections: Column | str) -> Column:
    """Stale, with at least one management passage; ``sections`` has section and passage_count."""
    some = F.exists(col(sections), lambda s: (s["section"] == "management") & (s["passage_count"] > 0))
    return F.coalesce(col(band).isin("stale", "very_stale") & some, F.lit(False))


# Tables ----------------------------------------------------------------------------------------------------


def table_cells(kind: Column, header: Column, rows: Column) -> Column:
    """Header and rows, only of tables whose rows are all as wide as the header."""
    even = F.forall(rows, lambda r: F.size(r) == F.size(header))
    return F.when((kind == "table") & header.isNotNull() & rows.isNotNull() & even, F.struct(header.alias("header"), rows.alias("rows")))


def markdown_table(caption: Column, header: Column, rows: Column, notes: Column) -> Column:
    """A table as markdown; null if a row isn't as wide as the header (the document is set aside, not the run)."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = line(F.transform(header, lambda _: F.lit("---")))
    body = F.transform(rows, line)
    head = F.when(F.size(header) > 0, F.array(line(header), rule)).otherwise(F.array().cast("array<string>"))
    lead = F.array(F.coalesce(caption, F.lit("")), F.lit(""))
    tail = F.when(F.coalesce(notes, F.lit("")) != "", F.array(F.lit(""), notes)).otherwise(F.array().cast("array<string>"))
    even = (F.size(header) == 0) | F.forall(rows, lambda r: F.size(r) == F.size(header))
    return F.when(even, F.array_join(F.concat(lead, head, body, tail), "\n"))


def flat_header(rows: Column, width: Column) -> Column:
    """One label per column of several header rows: distinct labels that aren't empty, joined by `` / ``."""

    def column(i: Column) -> Column:
        cells = F.filter(F.transform(rows, lambda r: F.get(r, i)), lambda c: F.coalesce(c, F.lit("")) != "")
        return F.regexp_replace(F.array_join(F.array_distinct(cells), " / "), r"\s{2,}\d+\s*$", "")

    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), column)).otherwise(F.array().cast("array<string>"))


def table_for_embedding(text: Column | str, tokens: int = 480) -> Column:
    """A table's text cut to a budget of four characters a token: caption, head and rule stay, rows while they fit."""
    whole = col(text)
    lines = F.split(whole, "\n", -1)
    head = F.concat(F.slice(lines, 1, 1), F.array(F.lit("")), F.slice(lines, 3, 2))
    used = F.aggregate(head, F.lit(0), lambda n, x: n + F.length(x))
    start = F.struct(head.alias("kept"), used.alias("used"), F.lit(True).alias("open"))

    def step(s: Column, row: Column) -> Column:
        fits = s["open"] & (s["used"] + F.length(row) <= tokens * 4)
        return F.struct(F.when(fits, F.concat(s["kept"], F.array(row))).otherwise(s["kept"]).alias("kept"), F.when(fits, s["used"] + F.length(row)).otherwise(s["used"]).alias("used"), fits.alias("open"))

    body = F.when(F.size(lines) > 4, F.slice(lines, 5, F.greatest(F.size(lines) - 4, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    cut = F.array_join(F.aggregate(body, start, step)["kept"], "\n")
    return F.when((F.size(lines) >= 4) & (F.length(cut) < F.length(whole)), cut).otherwise(whole)


# Assembly --------------------------------------------------------------------------------------------------


def without_overlap(parts: Column | str, least: int = 30) -> Column:
    """Parts joined, each less the longest start (of ``least`` characters or more) that ends the trimmed part before it.

    Such a start stands where the part's first ``least`` characters do: only those places are compared.
    """

    def step(state: Column, part: Column) -> Column:
        before, head = state["last"], F.left(part, F.lit(least))
        # Cut before each place of the head: what is left from a cut on is a start to try, the longest first.
        literal = F.concat(F.lit("(?=\\Q"), F.replace(head, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
        near = (F.length(part) >= least) & before.contains(head)
        pieces = F.when(near, F.split(F.right(before, F.length(part)), literal, -1)).otherwise(F.array().cast("array<string>"))
        ends = F.transform(F.array(pieces), lambda a: F.transform(a, lambda _, i: F.array_join(F.slice(a, i + 1, F.size(a)), "")))[0]
        fits = F.filter(ends, lambda x: (F.length(x) >= least) & part.startswith(x))
        cut = F.substr(part, F.coalesce(F.length(F.get(fits, F.lit(0))), F.lit(0)) + 1)
        return F.struct(F.concat(state["text"], cut).alias("text"), cut.alias("last"))

    a = col(parts)
    first = F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    start = F.struct(first.alias("text"), first.alias("last"))
    rest = F.when(F.size(a) > 1, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.aggregate(rest, start, step)["text"]


# Vectors and scores ----------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null for a zero vector."""
    a, b = col(a), col(b)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def recall_terms(query: Column | str) -> Column:
    """Distinct lower-case words of three or more letters or digits, in order, less the stop words."""
    words = F.regexp_extract_all(F.lower(col(query)), F.lit("[a-z0-9]+"), 0)
    stop = F.array(*[F.lit(w) for w in C.STOP_WORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def any_query(query: Column | str) -> Column:
    """A query's recall terms as alternatives, or what matches nothing by itself."""
    terms = recall_terms(query)
    return F.when(F.size(terms) > 0, F.array_join(terms, " | ")).otherwise(F.lit("x:*"))


def lexical_score(phrase: Column, strict: Column, recall: Column, terms: Column, overlap: Column, chars: Column) -> Column:
    """3 * phrase + 2 * strict + recall; short texts that only match few of many terms are damped."""
    weak = (phrase == 0) & (strict == 0) & (recall > 0) & (terms >= 4) & (overlap <= 2)
    damp = F.least(F.lit(1.0), F.greatest(F.lit(0.25), chars / F.lit(400.0)))
    return (phrase * 3.0 + strict * 2.0 + recall) * F.when(weak, damp).otherwise(1.0)


def enough_overlap(overlap: Column, terms: Column) -> Column:
    return overlap >= F.greatest(F.lit(1), F.ceil(terms * F.lit(0.25)).cast("int"))


def query_intents(query: Column | str) -> Column:
    low = F.lower(col(query))
    found = [F.when(F.greatest(*[low.contains(p) for p in patterns]), F.lit(name)) for name, (patterns, _) in C.INTENTS.items()]
    return F.array_sort(F.array_compact(F.array(*found)))


def section_priority(section: Column | str) -> Column:
    return mapped(col(section), C.SECTION_PRIORITY, C.UNKNOWN_PRIORITY)


def intent_boost(section: Column | str, intents: Column) -> Column:
    out = F.lit(0.0)
    for name, (_, gains) in C.INTENTS.items():
        out = out + F.when(F.array_contains(intents, name), mapped(col(section), gains, 0.0)).otherwise(0.0)
    return out


def adjusted_score(rrf: Column, role: Column, section: Column, intents: Column, primary: Column) -> Column:
    return rrf * mapped(role, C.ROLE_WEIGHT, 1.0) * (1.0 + intent_boost(section, intents)) * F.when(primary, C.PRIMARY_BOOST).otherwise(1.0)
