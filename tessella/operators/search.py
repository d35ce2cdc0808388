"""Hybrid search: lexical and dense top-K, their union, reciprocal-rank fusion and the boosts.

Filters are applied before either top-K, texts are joined only to the few candidates that are left, and
the final windows run over at most 2 * K rows. A batch of queries is a column ``query_index``: every
window is then partitioned by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import expr as E
from ..functions import lexical
from ..session import FEW, few, shared_folder, ship
from . import postings as stored
from . import requests

#: Candidates of each branch for fusion.
DEPTH = 200


def depth(mode: str, limit: int) -> int:
    return DEPTH if mode == "rrf" else max(3 * limit, 50)


@dataclass
class Filters:
    """What a search is limited to; a part that is None or empty limits nothing."""

    gene: str | None = None
    gene_role: str = "any"
    nbk_id: str | None = None
    sections: Sequence[str] = ()
    heading: str | None = None

    def conditions(self) -> list[Column]:
        out = [gene_filter(self.gene, self.gene_role)] if self.gene else []
        out += [F.col("nbk_id") == self.nbk_id] if self.nbk_id is not None else []
        out += [F.col("chapter_section").isin(*self.sections)] if self.sections else []
        return out + ([contains_pattern("heading_path", self.heading)] if self.heading is not None else [])

    def apply(self, passages: DataFrame) -> DataFrame:
        out = passages
        for c in self.conditions():
            out = out.filter(c)
        return out

    def names(self) -> list[str]:
        out = [f"gene={self.gene}"] if self.gene else []
        out += [f"nbk_id={self.nbk_id}"] if self.nbk_id is not None else []
        out += [f"sections={','.join(self.sections)}"] if self.sections else []
        return out + ([f"heading_path_contains={self.heading}"] if self.heading is not None else [])


def gene_filter(gene: str, role: str = "any") -> Column:
    """Membership in the symbols: any, in the primary ones, or mentioned without being primary."""
    some, first = F.array_contains("gene_symbols", gene), F.array_contains("primary_gene_symbols", gene)
    return {"any": some, "primary": first, "mentioned": some & ~first}[role]


def contains_pattern(column: str, part: str) -> Column:
    """Case-insensitive ``%part%``; ``%`` and ``_`` in it are wildcards, a backslash makes the next one plain."""
    out, k = [], 0
    while k < len(part):
        c = part[k]
        if c == "\\":
            nxt = part[k + 1] if k + 1 < len(part) else "\\"
            out.append(f"\\{nxt}" if nxt in "%_\\" else nxt)
            k += 2
            continue
        out.append(c)
        k += 1
    return F.col(column).ilike(f"%{''.join(out)}%")


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(E.col(text)), F.lit("[a-z0-9]+"), 0)


def term_ranks(passages: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """Phrase, strict and recall rank and overlap of plain words, without Python.

    recall counts all occurrences of the terms, strict the occurrences of the rarest if all are there,
    phrase the places where they stand side by side; each occurrence is a tenth.
    """
    low = F.col("_l")
    # A passage without any of the terms is left before its words are looked at.
    some = F.lit(False)
    for t in terms:
        some = some | low.contains(t)
    # Two blanks between words and one at either end, so that neighbours share none and each word has its own.
    spaced = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", "  "), F.lit(" "))
    out = once(once(passages, F.lower(F.col(text)), "_l").filter(some), spaced, "_w").drop("_l")

    def times(part: str) -> Column:
        return (F.length("_w") - F.length(F.replace("_w", F.lit(part), F.lit("")))) / F.lit(len(part))

    # Different words side by side can't overlap themselves.
    phrase = times(f" {'  '.join(terms)} ") if terms else F.lit(0)
    names = [f"n{k}" for k in range(len(terms))]
    found = F.struct(phrase.cast("int").alias("p"), *[times(f" {t} ").cast("int").alias(c) for c, t in zip(names, terms, strict=True)])
    out = once(out, found, "_c")
    n = [F.col("_c")[c] for c in names]
    least = F.least(*n) if len(n) > 1 else n[0] if n else F.lit(0)
    return out.select(
        *passages.columns,
        (F.col("_c")["p"] * F.lit(0.1)).alias("phrase_rank"),
        (least * F.lit(0.1)).alias("strict_rank"),
        (sum(n, F.lit(0)) * F.lit(0.1)).alias("recall_rank"),
        sum(((x > 0).cast("int") for x in n), F.lit(0)).alias("recall_overlap_count"),
    )


def once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with a column that is worked out once a row: filters on it aren't moved below, where each use would work it out again."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def lexical_top(ranked: DataFrame, terms: int, k: int, chars: str = "char_count") -> DataFrame:
    """Passages with enough overlap, by lexical rank; needs the columns of ``term_ranks``."""
    score = E.lexical_score(F.col("phrase_rank"), F.col("strict_rank"), F.col("recall_rank"), F.lit(terms), F.col("recall_overlap_count"), F.col(chars))
    out = ranked.filter(E.enough_overlap(F.col("recall_overlap_count"), F.lit(terms))).withColumn("lexical_rank", score)
    return out.orderBy(F.desc("lexical_rank"), "nbk_id", "passage_id").limit(k)


def dense_top(passages: DataFrame, vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(passage_id, dense_score): exact cosine over all filtered passages that have a vector; no cosine, no row."""
    q = F.array(*[F.lit(float(x)) for x in query])
    on = [c for c in ("nbk_id", "passage_id") if c in vectors.columns]
    scored = once(passages.select(*on).join(vectors, on).select("passage_id", "embedding"), E.cosine("embedding", q), "dense_score").drop("embedding")
    return scored.filter("dense_score is not null").orderBy(F.desc("dense_score"), "passage_id").limit(k)


def candidates(lexical: DataFrame, dense: DataFrame, passages: DataFrame) -> DataFrame:
    """Both branches by id; rows that only the dense one found are joined to their passages, with a lexical rank of 0."""
    on = [c for c in ("nbk_id", "passage_id") if c in dense.columns]
    both = lexical.select(*on, "lexical_rank").join(dense, on, "full_outer")
    return passages.join(F.broadcast(both), on).withColumn("lexical_rank", F.coalesce("lexical_rank", F.lit(0.0)))


def appended(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Both tops as one list (``position``): lexical hits in their order, then what only the dense one found, in its order, with a lexical rank of 0.

    Both are bounded tops, so that one window orders them.
    """
    on = [c for c in ("nbk_id", "passage_id") if c in dense.columns]
    first = lexical.select(*on, "lexical_rank", F.lit(None).cast("double").alias("dense_score"), F.lit(0).alias("_part"))
    rest = dense.join(lexical.select(*on), on, "left_anti").select(*on, F.lit(0.0).alias("lexical_rank"), "dense_score", F.lit(1).alias("_part"))
    order = Window.partitionBy().orderBy("_part", F.desc("lexical_rank"), F.desc_nulls_last("dense_score"), *on)
    return first.unionByName(rest).withColumn("position", F.row_number().over(order)).drop("_part")


def fused(rows: DataFrame, intents: Sequence[str] | Column = (), *, k: int = C.RRF_K, by: Sequence[str] = ()) -> DataFrame:
    """Rows in their final order (``position``), with ranks and scores.

    Guarded sections take no part in dense ranks and fusion, and come last in lexical order. Without any
    dense score the order is lexical. A dense-only row has a lexical rank too, behind all others.
    """
    keys = list(by)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy()
    tie = [E.section_priority("chapter_section"), F.col("nbk_id"), F.col("passage_id")]
    guarded = F.col("chapter_section").isin(*C.GUARDED)
    evidence = ~guarded & F.col("dense_score").isNotNull()
    out = rows.withColumn("_priority", tie[0]).withColumn("_guarded", guarded)
    out = out.withColumn("lexical_position", F.row_number().over(part.orderBy(F.desc("lexical_rank"), *tie)))
    out = out.withColumn("_evidence", evidence)
    order = (Window.partitionBy(*keys, "_evidence") if keys else Window.partitionBy("_evidence")).orderBy(F.desc("dense_score"), "lexical_position")
    out = out.withColumn("dense_position", F.when(F.col("_evidence"), F.row_number().over(order)))
    out = out.withColumn("_active", F.max(F.col("_evidence").cast("int")).over(part) == 1)
    rrf = F.lit(1.0) / (k + F.col("lexical_position")) + F.coalesce(F.lit(1.0) / (k + F.col("dense_position")), F.lit(0.0))
    out = out.withColumn("rrf_score", F.when(F.col("_active") & ~F.col("_guarded"), rrf))
    primary = F.col("primary_match") if "primary_match" in rows.columns else F.lit(False)
    wanted = intents if isinstance(intents, Column) else F.array(*[F.lit(i) for i in intents]) if intents else F.array().cast("array<string>")
    role = F.col("passage_role") if "passage_role" in rows.columns else F.lit("evidence")
    out = out.withColumn("adjusted_score", E.adjusted_score(F.col("rrf_score"), role, F.col("chapter_section"), wanted, primary))
    final = [F.col("_active") & F.col("_guarded"), F.desc_nulls_last("adjusted_score"), F.desc_nulls_last("rrf_score"), F.when(F.col("_active") & ~F.col("_guarded"), F.col("dense_score")).desc_nulls_last(), F.when(F.col("_active") & F.col("_guarded"), F.col("lexical_position")), F.when(F.col("_active"), F.col("_priority")).otherwise(F.col("lexical_position")), F.col("nbk_id"), F.col("passage_id")]
    return out.withColumn("position", F.row_number().over(part.orderBy(*final))).drop("_priority", "_guarded", "_evidence", "_active")


def search(passages: DataFrame, vectors: DataFrame, query: str, vector: Sequence[float], *, filters: Filters | None = None, mode: str = "rrf", limit: int = 20, index: stored.Index | DataFrame | None = None, near=None) -> DataFrame:
    """The first ``limit`` passages for a query; modes rrf, lexical and off.

    With a stored ``index`` only its blocks that can hold the best passages are ranked; of the kind english phrase, strict
    and recall ranks are those of full-text search, by stems. A table of ``postings`` gives the same ranks, all of them.
    Without one they are counts of plain words. ``near`` is a stored index of vectors (``cells.Cells``) to take the place of all vectors.
    """
    if mode not in ("rrf", "lexical", "off"):
        raise ValueError("mode is rrf, lexical or off")
    requests.check(query=query, limit=limit)
    f, k = filters or Filters(), depth(mode, limit)
    within = f.apply(passages)
    terms = list(dict.fromkeys(w for w in _plain(query) if len(w) >= 3 and w not in C.STOP_WORDS))
    if isinstance(index, stored.Index):
        narrowed = f.gene is not None or f.nbk_id is not None
        found = index.top(query, within, k, chapters=within.select("nbk_id").distinct() if narrowed else None).rows
    else:
        ranks = term_ranks(within, terms) if index is None else within.join(indexed_ranks(index, query, within), ["nbk_id", "passage_id"])
        found = lexical_top(ranks, len(terms), k)
    if f.gene:
        within = within.withColumn("primary_match", F.array_contains("primary_gene_symbols", f.gene))
    if mode == "rrf":
        dense = near.top(vector, k, within=within if f.names() else None).rows if near else dense_top(within, vectors, vector, k)
        rows = fused(candidates(found, dense, within), intents(query))
    else:
        by = ["lexical_rank"] if mode == "off" else ["lexical_rank", "_priority"]
        rows = found.withColumn("_priority", E.section_priority("chapter_section"))
        order = [F.desc("lexical_rank"), *([F.col("_priority")] if len(by) > 1 else []), F.col("nbk_id"), F.col("passage_id")]
        rows = rows.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(*order))).drop("_priority")
    return rows.orderBy("position").limit(limit)


def _plain(query: str) -> list[str]:
    import re

    return [w.lower() for w in re.findall(r"[A-Za-z0-9]+", query)]


def intents(query: str) -> list[str]:
    low = query.casefold()
    return sorted(name for name, (patterns, _) in C.INTENTS.items() if any(p in low for p in patterns))


def suggestions(query: str, filters: Filters, found: int, unfiltered: int | None) -> list[str]:
    """What to try when nothing was found; counts of lexical candidates with and without filters."""
    n, out = unfiltered or 0, []
    if filters.gene and n and found < n / 10:
        out.append("gene-filter-drops-all")
    if len(query) > 80 or len(query.split()) > 8:
        out.append("broaden-query")
    if filters.sections and n and not found:
        out.append("section-filter-drops-all")
    if filters.nbk_id is not None and n and not found:
        out.append("nbk-id-filter-drops-all")
    return out


def shaped(rows: DataFrame, mode: str = "brief", *, chars: int = 300, include: Sequence[str] = (), exclude: Sequence[str] = (), query: str | None = None) -> DataFrame:
    """Columns of a response: brief has an excerpt, full the text, ids_only ids; score_breakdown and table_data are on demand.

    With the ``query`` the excerpt is of fragments around its covers, marked, and of 80 to 800 characters.
    """
    requests.check(snippet_chars=chars)
    ids = [c for c in ("position", "passage_id", "nbk_id", "chapter_section", "rrf_score", "lexical_position") if c in rows.columns]
    if mode == "ids_only":
        return rows.select(*ids)
    scores = [c for c in ("lexical_rank", "dense_score", "dense_position", "adjusted_score") if c in rows.columns and "score_breakdown" in include]
    body = F.col("text") if mode == "full" else E.leading_excerpt("text", chars).alias("snippet")
    if query is not None and mode != "full":
        rows = settled(rows)
        n, most = lexical.snippet_limits(chars)
        body = lexical.cover_headline_column(lexical.parse(query), "text", fragments=n, most=most).alias("snippet")
    more = [c for c in ("heading_path",) if c in rows.columns and c not in exclude] + [c for c in ("table_data",) if c in rows.columns and c in include]
    return rows.select(*ids, *more, *scores, body)


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, after which Python is asked: else a projection would be moved below the limit, which then sorts all texts."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("_r")).select("_r.*")


def also_matched(hits: DataFrame) -> DataFrame:
    """Hits of a batch, (query_index, passage_id): all but the first query's get the other queries that found them."""
    w = Window.partitionBy("passage_id")
    every = F.array_sort(F.collect_set("query_index").over(w))
    other = F.array_except(every, F.array("query_index"))
    return hits.withColumn("_all", every).withColumn("also_matched", F.when((F.size("_all") > 1) & (F.col("query_index") != F.get("_all", F.lit(0))), other)).drop("_all")


def postings(passages: DataFrame, text: Column | str | None = None) -> DataFrame:
    """(lexeme, passage_id, nbk_id, places): the inverted table of all passages, made once when they come in.

    The indexed text is heading path, section and text. Written sorted by lexeme, it is read only where a query's terms stand.
    A passage's rows are made where its text is; only rows of keys that stand more than once, which are counted first, are
    gathered from everywhere, with the places of all texts of a key.
    """
    at = text if text is not None else lexical.searchable(*[c if c in passages.columns else F.lit("") for c in ("heading_path", "chapter_section", "text")])
    texts = passages.select("nbk_id", "passage_id", (F.col(at) if isinstance(at, str) else at).alias("_text"))
    ship(passages.sparkSession)
    kinds = ", ".join(f"{c} {t}" for c, t in texts.dtypes[:-1])

    def each(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(stored.gathered(lexical.lexemes), f"{kinds}, lexeme string, places array<int>").select("lexeme", "passage_id", "nbk_id", "places")

    def merged(rows: DataFrame) -> DataFrame:
        places = F.array_sort(F.flatten(F.collect_list("places")))
        return rows.groupBy("lexeme", "passage_id", "nbk_id").agg(places.alias("places"))

    again = passages.groupBy(F.col("nbk_id").alias("_n"), F.col("passage_id").alias("_p")).agg(F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    if not (n := again.limit(FEW + 1).count()):
        return each(texts)
    if n > FEW:
        return merged(each(texts))
    same = F.col("nbk_id").eqNullSafe(F.col("_n")) & F.col("passage_id").eqNullSafe(F.col("_p"))
    once_, often = (texts.join(F.broadcast(again), same, how) for how in ("left_anti", "left_semi"))
    return each(once_).unionByName(merged(each(often)))


def indexed_ranks(index: DataFrame, query: str, within: DataFrame | None = None) -> DataFrame:
    """(nbk_id, passage_id, phrase_rank, strict_rank, recall_rank, recall_overlap_count) of passages that hold a term of the query, from the inverted table.

    Passages that aren't ``within`` are left before any is ranked.
    """
    q = lexical.parse(query)
    found = index.filter(F.col("lexeme").isin(*sorted(lexical.wanted(q)))) if lexical.wanted(q) else index.limit(0)
    if within is not None:
        found = found.join(within.select("nbk_id", "passage_id"), ["nbk_id", "passage_id"], "left_semi")
    doc = F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(F.col("lexeme").alias("lexeme"), p.alias("place")))))
    ranked = found.groupBy("nbk_id", "passage_id").agg(doc.alias("x")).select("nbk_id", "passage_id", lexical.rank_column(q, "x").alias("r"))
    return ranked.select("nbk_id", "passage_id", F.col("r.phrase").alias("phrase_rank"), F.col("r.strict").alias("strict_rank"), F.col("r.recall").alias("recall_rank"), F.col("r.overlap").alias("recall_overlap_count"))


def scored_candidates(passages: DataFrame, vectors: DataFrame, ids: DataFrame, vector: Sequence[float], ranks: DataFrame) -> DataFrame:
    """Given passages with their cosine and lexical ranks, whatever a search would have kept; for looking into one."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    dense = vectors.join(ids.select("passage_id").distinct(), "passage_id", "left_semi").select("passage_id", E.cosine("embedding", q).alias("dense_score"))
    out = ids.select("passage_id").distinct().join(passages, "passage_id").join(dense, "passage_id", "left").join(ranks, "passage_id", "left")
    return out.fillna(0.0, ["phrase_rank", "strict_rank", "recall_rank"]).fillna(0, ["recall_overlap_count"])


def diagnostics(ranks: DataFrame, within: DataFrame, vectors: DataFrame, terms: int) -> DataFrame:
    """One row: lexical candidates with and without the filters, and of those inside how many have a vector."""
    enough = ranks.filter(E.enough_overlap(F.col("recall_overlap_count"), F.lit(terms))).select("passage_id")
    inside = enough.join(within.select("passage_id", F.lit(True).alias("_i")), "passage_id", "left").join(vectors.select("passage_id", F.lit(True).alias("_v")).distinct(), "passage_id", "left")
    i, v = F.coalesce("_i", F.lit(False)), F.coalesce("_v", F.lit(False))
    return inside.agg(F.count("*").alias("unfiltered"), F.count_if(i).alias("candidates"), F.count_if(i & v).alias("embedded"), F.count_if(i & ~v).alias("missing"))


def freshness(hits: DataFrame, now: Column, *, at: str = "ingested_at", first: int = 3, days: int = 180) -> DataFrame:
    """One row: the oldest of the first hits, and whether it is older than so many days."""
    return hits.filter(F.col("position") <= first).agg(F.min(at).alias("oldest")).select("oldest", F.coalesce(F.date_diff(now, F.col("oldest")) > days, F.lit(False)).alias("stale"))


def batch_search(passages: DataFrame, vectors: DataFrame, specs: Sequence[dict], *, most: int = 5) -> DataFrame:
    """A batch of 1 to ``most`` searches (query, vector, and filters, mode and limit if any), with what other queries found too.

    Texts are read once for all searches: a passage gives the counts of all their words and which filters it meets, a
    small row that is written to the shared folder. The best of each search come from these, its vectors by one join;
    only the few candidates meet their texts again. Results are those of ``search`` for each.
    """
    if not 1 <= len(specs) <= most:
        raise ValueError(f"a batch has 1 to {most} searches")
    asked = [_Asked(k, s) for k, s in enumerate(specs)]
    small = _small_rows(passages, asked)
    each = small.select("*", F.explode("specs").alias("s")).filter("s.inside").select(*small.columns, "s.*").drop("specs")
    of = {name: F.element_at(F.array(*[F.lit(getattr(a, name)) for a in asked]), F.col("query_index") + 1) for name in ("terms", "depth", "limit", "mode")}
    score = E.lexical_score(F.col("phrase_rank"), F.col("strict_rank"), F.col("recall_rank"), of["terms"], F.col("recall_overlap_count"), F.col("char_count"))
    order = Window.partitionBy("query_index").orderBy(F.desc("lexical_rank"), "nbk_id", "passage_id")
    found = each.filter(E.enough_overlap(F.col("recall_overlap_count"), of["terms"])).withColumn("lexical_rank", score)
    deepest = max(a.depth for a in asked)
    lexical_hits = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= deepest).filter(F.col("_r") <= of["depth"]).select("query_index", "nbk_id", "passage_id", "lexical_rank")
    if fusing := [a for a in asked if a.mode == "rrf"]:
        both = lexical_hits.join(_dense_hits(each, vectors, fusing, deepest, of["depth"]), ["query_index", "nbk_id", "passage_id"], "full_outer")
    else:
        both = lexical_hits.withColumn("dense_score", F.lit(None).cast("double"))
    rows = passages.join(F.broadcast(both), ["nbk_id", "passage_id"]).withColumn("lexical_rank", F.coalesce("lexical_rank", F.lit(0.0)))
    if any(a.filters.gene for a in asked):
        gene = F.element_at(F.array(*[F.lit(a.filters.gene) for a in asked]), F.col("query_index") + 1)
        rows = rows.withColumn("primary_match", F.coalesce(F.array_contains("primary_gene_symbols", gene), F.lit(False)))
    intent = F.element_at(F.array(*[F.array(*[F.lit(i) for i in a.intents]).cast("array<string>") for a in asked]), F.col("query_index") + 1)
    rrf = fused(rows.filter(of["mode"] == "rrf"), intent, by=["query_index"])
    plain = rows.filter(of["mode"] != "rrf").withColumn("_p", F.when(of["mode"] == "lexical", E.section_priority("chapter_section")).otherwise(0))
    place = Window.partitionBy("query_index").orderBy(F.desc("lexical_rank"), "_p", "nbk_id", "passage_id")
    out = rrf.unionByName(plain.withColumn("position", F.row_number().over(place)).drop("_p"), allowMissingColumns=True)
    return also_matched(out.filter(F.col("position") <= of["limit"]))


class _Asked:
    """One search of a batch."""

    def __init__(self, index: int, spec: dict):
        self.index, self.query, self.vector = index, spec["query"], [float(x) for x in spec["vector"]]
        self.filters, self.mode, self.limit = spec.get("filters") or Filters(), spec.get("mode", "rrf"), spec.get("limit", 20)
        if self.mode not in ("rrf", "lexical", "off"):
            raise ValueError("mode is rrf, lexical or off")
        requests.check(query=self.query, limit=self.limit)
        self.named = list(dict.fromkeys(w for w in _plain(self.query) if len(w) >= 3 and w not in C.STOP_WORDS))
        self.terms, self.depth, self.intents = len(self.named), depth(self.mode, self.limit), intents(self.query)


def _small_rows(passages: DataFrame, asked: list[_Asked]) -> DataFrame:
    """(nbk_id, passage_id, char_count, specs): for each search whether its filters are met, and the ranks of plain words."""
    low = F.col("_l")
    spaced = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", "  "), F.lit(" "))
    rows = once(once(passages, F.lower(F.col("text")), "_l"), spaced, "_w")

    def times(part: str) -> Column:
        return ((F.length("_w") - F.length(F.replace("_w", F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")

    words_ = list(dict.fromkeys(w for a in asked for w in a.named))
    phrases = list(dict.fromkeys(f" {'  '.join(a.named)} " for a in asked if a.named))
    counts = [*[times(f" {w} ").alias(f"w{k}") for k, w in enumerate(words_)], *[times(p).alias(f"p{k}") for k, p in enumerate(phrases)]]
    rows = once(rows, F.struct(*counts) if counts else F.struct(F.lit(0).alias("w0")), "_c")

    def ranks(a: _Asked) -> Column:
        n = [F.coalesce(F.col("_c")[f"w{words_.index(w)}"], F.lit(0)) for w in a.named]
        phrase = F.coalesce(F.col("_c")[f"p{phrases.index(' ' + '  '.join(a.named) + ' ')}"], F.lit(0)) if n else F.lit(0)
        least = F.least(*n) if len(n) > 1 else n[0] if n else F.lit(0)
        inside = F.lit(True)
        for c in a.filters.conditions():
            inside = inside & F.coalesce(c, F.lit(False))
        parts = [inside.alias("inside"), (phrase * F.lit(0.1)).alias("phrase_rank"), (least * F.lit(0.1)).alias("strict_rank"), (sum(n, F.lit(0)) * F.lit(0.1)).alias("recall_rank"), sum(((x > 0).cast("int") for x in n), F.lit(0)).alias("recall_overlap_count")]
        return F.struct(F.lit(a.index).alias("query_index"), *parts)

    out = rows.select("nbk_id", "passage_id", "char_count", F.array(*[ranks(a) for a in asked]).alias("specs"))
    at = shared_folder(passages.sparkSession)
    out.write.parquet(at)
    return passages.sparkSession.read.schema(out.schema).parquet(at)


def _dense_hits(each: DataFrame, vectors: DataFrame, asked: list[_Asked], deepest: int, own_depth: Column) -> DataFrame:
    """(query_index, nbk_id, passage_id, dense_score) of the nearest passages of each search that uses vectors; vectors are read once."""
    on = [c for c in ("nbk_id", "passage_id") if c in vectors.columns]
    inside = each.filter(F.col("query_index").isin([a.index for a in asked])).groupBy("nbk_id", "passage_id").agg(F.collect_set("query_index").alias("_q"))
    scores = F.array(*[F.struct(F.lit(a.index).alias("query_index"), F.when(F.array_contains("_q", a.index), E.cosine("embedding", F.array(*[F.lit(x) for x in a.vector]))).alias("dense_score")) for a in asked])
    scored = inside.join(vectors, on).select("nbk_id", "passage_id", F.explode(scores).alias("s")).select("nbk_id", "passage_id", "s.*").filter("dense_score is not null")
    w = Window.partitionBy("query_index").orderBy(F.desc("dense_score"), "passage_id")
    best = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= deepest).filter(F.col("_r") <= own_depth)
    return best.drop("_r")


def batch_ranks(passages: DataFrame, queries: DataFrame, *, query: str = "query", index: str = "query_index", limit: int = 10) -> DataFrame:
    """Lexical top ``limit`` for each of a batch of queries: terms meet words by a join, not every text every query.

    Score: a tenth for each occurrence of a term; at least a quarter of the terms have to occur.
    """
    terms = queries.select(index, E.recall_terms(query).alias("_t")).withColumn("_size", F.size("_t")).select(index, "_size", F.explode("_t").alias("w"))
    counted = passages.select("nbk_id", "passage_id", F.explode(words("text")).alias("w")).join(few(terms.select("w").distinct()), "w", "left_semi").groupBy("nbk_id", "passage_id", "w").agg(F.count("*").alias("n"))
    scored = counted.join(terms, "w").groupBy(index, "_size", "nbk_id", "passage_id").agg(F.sum("n").alias("n"), F.count("*").alias("overlap"))
    scored = scored.filter(E.enough_overlap(F.col("overlap"), F.col("_size"))).withColumn("score", F.col("n") * F.lit(0.1))
    order = Window.partitionBy(index).orderBy(F.desc("score"), "nbk_id", "passage_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(index, "nbk_id", "passage_id", "overlap", "score", "rank")
