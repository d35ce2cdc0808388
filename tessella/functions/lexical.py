"""Full-text search: lexemes with places, query parsing, cover-density rank and highlighted fragments.

Only stemming and ranking need Python; they run as Arrow-batched pandas UDFs, once a passage when it is
indexed, and on the rows that a query's terms have already selected. Stems are those of the published
Porter2 rules; the rank is the cover density of Clarke, Cormack and Tudhope.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C
from .batches import sliced
from .constants import STOP_WORDS

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")

#: What takes a place of its own. Tags, entities and protocols take none; a compound stands before its parts, an address before its host and path.
TOKEN = re.compile(
    r"""(?P<skip></?[A-Za-z][^<>]*>|<!--.*?-->|&(?:[A-Za-z]+|\#[0-9]+);|[A-Za-z]+://)
    |(?P<mail>[^\W_][\w.+-]*@(?:[^\W_][\w-]*\.)+[A-Za-z]{2,})
    |(?P<host>(?:[^\W_][\w-]*\.)+[A-Za-z]{2,}(?![\w-]))(?P<path>(?::[0-9]+)?/[^\s<>"]*)?
    |(?P<file>[^\W_]+(?:/[^\W_][\w.-]*)+|(?:/[^\W_][\w.-]*)+)
    |(?P<number>[-+]?[0-9]+(?:\.[0-9]+)*(?:[eE][-+]?[0-9]+)?(?![^\W_]))
    |(?P<compound>[^\W\d_][^\W_]*(?:-[^\W_]+)+)
    |(?P<word>[^\W_]+)""",
    re.VERBOSE | re.DOTALL,
)
ENGLISH_STOP_WORDS = frozenset(C.ENGLISH_STOP_WORDS)


def stem(word: str) -> str:
    """The stem of a word in lower case by Porter2; words with letters that aren't of ASCII stay. Words are remembered unless they are long."""
    return _known(word) if len(word) <= 40 else _stem(word)


_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")
_BEGINNING = re.compile("|".join(C.STEM_BEGINNINGS))
_KEYS = {id(t): tuple(t) for t in (C.STEM_SECOND, C.STEM_THIRD)}


def _ending(word: str, endings) -> str | None:
    """The longest of the endings (a tuple, or a table's keys) that the word has."""
    if not word.endswith(endings if isinstance(endings, tuple) else _KEYS[id(endings)]):
        return None
    return next((word[-n:] for n in range(min(7, len(word)), 0, -1) if word[-n:] in endings), None)


def _stem(word: str) -> str:
    w = word.lower().replace("\u2019", "'").lstrip("'")
    if len(w) <= 2 or not w.isascii():
        return w
    if w in C.STEM_EXCEPTIONS:
        return C.STEM_EXCEPTIONS[w]
    if w in C.STEM_INVARIANTS:
        return w
    # A y that begins a word or follows a vowel is a consonant.
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    begin = _BEGINNING.match(w) or _REGION.search(w)
    r1 = begin.end() if begin else len(w)
    again = _REGION.search(w, r1)
    r2 = again.end() if again else len(w)

    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in C.STEM_SINGULARS:
        return w
    if end := _ending(w, ("eed", "eedly")):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif (end := _ending(w, ("ed", "edly", "ing", "ingly"))) and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    if (end := _ending(w, C.STEM_SECOND)) and len(w) - len(end) >= r1:
        left = w[: -len(end)]
        if end == "ogi" and left[-1:] != "l" or end == "li" and left[-1:] not in tuple("cdeghkmnrt"):
            pass
        else:
            w = left + C.STEM_SECOND[end]
    if (end := _ending(w, C.STEM_THIRD)) and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + C.STEM_THIRD[end]
    if (end := _ending(w, C.STEM_FOURTH)) and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) > r2 or len(w) > r1 and not _SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


_known = lru_cache(100_000)(_stem)


def tokens(text: str):
    """(word in lower case, whether it is one of language, match) of what takes a place, in order."""
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "word":
            yield m[0].lower(), not m[0][0].isdigit(), m
        elif kind == "compound":
            whole = m[0].lower()
            yield whole, True, m
            for part in whole.split("-"):
                yield part, not part[0].isdigit(), m
        elif kind == "path":
            yield m[0].lower(), False, m
            yield m["host"].lower(), False, m
            yield m["path"].lower(), False, m
        else:
            yield m[0].lower(), False, m


def _lexemes(text: str) -> tuple[str | None, ...]:
    """What stands in each place: a lexeme, or nothing for a stop word."""
    return tuple(word if not spoken else None if word in ENGLISH_STOP_WORDS else stem(word) for word, spoken, _ in tokens(text))


#: Signs around a word that take no place.
_AROUND = ".,;:!?()\"'"


def _piece(text: str) -> tuple[str | None, ...]:
    """``_lexemes`` of what stands between white space; one word with signs around it needs no pattern."""
    word = text if text.isalpha() else text.strip(_AROUND)
    if word.isalpha() and word.isascii():
        low = word.lower()
        return (None if low in ENGLISH_STOP_WORDS else stem(low),)
    return _lexemes(text)


_chunk = lru_cache(1 << 17)(_piece)


def in_places(text: str) -> Iterator[tuple[str | None, ...]]:
    """What stands in the places of a text, piece by piece.

    Only a tag reaches over white space; without one pieces of text between it are cut once and remembered, unless they are long.
    """
    if "<" in text:
        yield _lexemes(text)
    else:
        for piece in text.split():
            yield _chunk(piece) if len(piece) <= 40 else _lexemes(piece)


def lexemes(text: str | None) -> list[tuple[str, int]]:
    """Lexemes with their places (from 1): stems of words, numbers and addresses as they are; stop words take a place but give none."""
    out, at = [], 0
    for found in in_places(text or ""):
        for lexeme in found:
            at += 1
            if lexeme is not None:
                out.append((lexeme, at))
    return out


def _beginnings(stems: set[str]) -> set[str]:
    """First two letters of words that may have one of the stems: rules change endings only, but for the exceptions."""
    return {w[:2] for w in stems} | {w[:2] for w, to in C.STEM_EXCEPTIONS.items() if to in stems}


def lexemes_among(text: str | None, some: set[str]) -> list[tuple[str, int]]:
    """Those of ``lexemes`` that are asked for; words that begin otherwise are counted, but not stemmed."""
    text = text or ""
    if "<" in text:
        return [x for x in lexemes(text) if x[0] in some]
    out, at, begin = [], 0, _beginnings(some)
    for piece in text.split():
        word = piece if piece.isalpha() else piece.strip(_AROUND)
        if word.isalpha() and word.isascii():
            # One word, with signs around it at most.
            at += 1
            if word[:2].lower() in begin and (x := _chunk(word)[0] if len(word) <= 40 else _lexemes(word)[0]) in some:
                out.append((x, at))
        else:
            found = _chunk(piece) if len(piece) <= 40 else _lexemes(piece)
            out += [(x, at + k) for k, x in enumerate(found, 1) if x in some]
            at += len(found)
    return out


def searchable(path: Column | str, section: Column | str, text: Column | str) -> Column:
    """The text that is indexed for a passage: heading path, section and text."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (path, section, text)])


class Phrase(list):
    """Lexemes that follow each other; ``steps`` are their places from the first one on, so that a stop word between them leaves a gap."""

    def __init__(self, found: list[tuple[str, int]] = ()):
        super().__init__(w for w, _ in found)
        self.steps = [at - found[0][1] for _, at in found]


@dataclass
class Query:
    """A query's phrase, its required and excluded terms (web syntax), and the terms that any of may match.

    ``clauses`` are the alternatives that ``or`` parts, each with its required and excluded phrases;
    ``required`` and ``excluded`` are those of the first.
    """

    text: str
    phrase: Phrase = field(default_factory=Phrase)
    required: list[Phrase] = field(default_factory=list)
    excluded: list[Phrase] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    clauses: list[tuple[list[Phrase], list[Phrase]]] = field(default_factory=list)


def parse(text: str) -> Query:
    """Quoted parts are phrases, ``-`` excludes, ``or`` parts alternatives; all else is required.

    Recall terms are plain words of three characters on. A term that is a stop word of English counts as a term, but matches
    nothing. Compounds and addresses match as wholes that stand beside their parts.
    """
    plain = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", text)]
    terms = list(dict.fromkeys(w for w in plain if len(w) >= 3 and w not in STOP_WORDS))
    q = Query(text, phrase=Phrase(lexemes(text)), any_of=[w for t in terms for w, _ in lexemes(t)], terms=terms)
    q.clauses = [(q.required, q.excluded)]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if not minus and word.lower() == "or":
            q.clauses.append(([], []))
            continue
        if part := Phrase(lexemes(quoted or word)):
            q.clauses[-1][1 if minus else 0].append(part)
    return q


def any_query(terms: list[str]) -> str:
    """The text of a query that any of the terms matches; one that matches nothing by itself if there are none."""
    return " | ".join(terms) if terms else "x:*"


def _places(doc: dict[str, list[int]], phrase: Phrase) -> list[tuple[int, int]]:
    """Where a phrase stands: first and last place."""
    left = set(doc.get(phrase[0], ()))
    for w, step in zip(phrase[1:], phrase.steps[1:], strict=True):
        left &= {p - step for p in doc.get(w, ())}
    return [(p, p + phrase.steps[-1]) for p in sorted(left)]


def cover_density(parts: list[list[tuple[int, int]]], gap: int = 1) -> float:
    """Sum over minimal covers of all parts of 1 / (1 + places that belong to none)."""
    if not parts or not all(parts):
        return 0.0
    events = sorted((b, e, k) for k, spans in enumerate(parts) for b, e in spans)
    seen: dict[int, tuple[int, int]] = {}
    total, last = 0.0, None
    for b, e, k in events:
        seen[k] = (b, e)
        if len(seen) == len(parts):
            begin = min(x for x, _ in seen.values())
            if last is None or begin > last:
                noise = e - begin + 1 - sum(y - x + 1 for x, y in seen.values())
                total += 1.0 / (gap + max(0, noise))
                last = begin
    return 0.1 * total


def rank(query: Query, doc: list[tuple[str, int]]) -> tuple[float, float, float, int]:
    """Phrase, strict and recall rank, and how many recall terms the document holds."""
    at: dict[str, list[int]] = {}
    for w, p in doc:
        at.setdefault(w, []).append(p)
    # A place that a stop word takes inside the phrase is one that belongs to none.
    phrase = 0.1 * len(_places(at, query.phrase)) / (query.phrase.steps[-1] - len(query.phrase) + 2) if query.phrase else 0.0
    strict = 0.0
    for required, excluded in query.clauses:
        if required and not any(_places(at, p) for p in excluded):
            strict += cover_density([_places(at, p) for p in required])
    recall = 0.1 * sum(len(at.get(w, ())) for w in dict.fromkeys(query.any_of))
    return phrase, strict, recall, sum(w in at for w in query.any_of)


def wanted(query: Query) -> set[str]:
    """The stems that a query asks for, or excludes."""
    return {*query.phrase, *query.any_of, *(w for clause in query.clauses for parts in clause for part in parts for w in part)}


#: Places that a task ranks at a time (a document with more is ranked alone).
PLACES = 1 << 15

_RANKS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("phrase", "strict", "recall")] + [T.StructField("overlap", T.IntegerType())])


def rank_column(query: Query, doc: Column | str) -> Column:
    """A struct of phrase, strict, recall and overlap for lexemes with their places, as ``postings`` have them."""

    @F.arrow_udf(_RANKS)
    def ranked(docs: pa.Array) -> pa.Array:
        return ranks(query, docs)

    return ranked(doc)


def ranks(query: Query, docs: pa.Array) -> pa.StructArray:
    """Ranks of many documents, lists of (lexeme, place); a few of them are held at a time. Null ones rank nowhere."""
    out = [array("d"), array("d"), array("d"), array("i")]
    for part in sliced(docs, pc.list_value_length(docs), PLACES, PLACES):
        # Only the values of these rows; null rows have none.
        flat, at = part.flatten(), 0
        found = list(zip(flat.field("lexeme").to_pylist(), flat.field("place").to_pylist(), strict=True))
        for size in part.value_lengths().to_pylist():
            row = rank(query, found[at : at + size]) if size is not None else (0.0, 0.0, 0.0, 0)
            at += size or 0
            for column, x in zip(out, row, strict=True):
                column.append(x)
    return pa.StructArray.from_arrays([pa.array(c, pa.int32() if c.typecode == "i" else pa.float64()) for c in out], names=_RANKS.names)


def text_rank_column(query: Query, text: Column | str) -> Column:
    """The same from texts: only the words that the query asks for are kept of each."""
    some = wanted(query)

    @F.pandas_udf(_RANKS)
    def ranked(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            rows.append(rank(query, lexemes_among(t, some)))
        return pd.DataFrame(rows, columns=["phrase", "strict", "recall", "overlap"])

    return ranked(text)


def headline(text: str, wanted: set[str], *, fragments: int = 2, most: int = 30, least: int = 10) -> str:
    """The fragments with the most wanted words, marked with ``**``, joined by `` ... ``."""
    found = list(WORD.finditer(text))
    hits = [k for k, m in enumerate(found) if stem(m[0]) in wanted]
    if not found:
        return ""
    if not hits:
        end = found[min(least, len(found)) - 1].end()
        return text[:end]
    chosen: list[tuple[int, int]] = []
    free = hits
    while free and len(chosen) < max(1, fragments):
        # The hits from each on that fit one fragment; both ends only move on.
        ends = [bisect_left(free, h + most) for h in free]
        k = max(range(len(free)), key=lambda k: (ends[k] - k, -k))  # noqa: B023
        best, last_hit = free[k], free[ends[k] - 1]
        first = max(0, best - max(0, least - (last_hit - best + 1)) // 2)
        last = min(len(found) - 1, max(last_hit, first + least - 1), first + most - 1)
        chosen.append((first, last))
        free = [x for x in free if not first <= x <= last]
    out = []
    for first, last in sorted(chosen):
        piece, at = [], found[first].start()
        for m in found[first : last + 1]:
            piece.append(text[at : m.start()])
            piece.append(f"**{m[0]}**" if stem(m[0]) in wanted else m[0])
            at = m.end()
        out.append("".join(piece))
    return " ... ".join(out)


def headline_column(query: Query, text: Column | str, *, fragments: int = 2, most: int = 30) -> Column:
    wanted = {*query.any_of, *query.phrase}

    @F.pandas_udf(T.StringType())
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: headline(t or "", wanted, fragments=fragments, most=most))

    return marked(text)


def minimal_covers(parts: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The stretches of places that hold a span of every part and no smaller stretch that does, from left to right."""
    if not parts or not all(parts):
        return []
    latest: dict[int, int] = {}
    out: list[tuple[int, int]] = []
    # By ends: once all parts were seen, the least of their latest beginnings begins a cover.
    for end, begin, k in sorted((e, b, k) for k, spans in enumerate(parts) for b, e in spans):
        latest[k] = max(begin, latest.get(k, begin))
        if len(latest) == len(parts):
            first = min(latest.values())
            if not out or first > out[-1][0]:
                if out and out[-1][1] == end:
                    out.pop()
                out.append((first, end))
    return out


def cover_headline(text: str, query: Query, *, fragments: int = 2, most: int = 30, least: int = 10, short: int = 3) -> str:
    """Fragments around covers of the query, its words marked with ``**``, joined by `` ... ``.

    The query is the phrase; if it has no lexeme, the required parts; else any of the terms. Covers are cut into pieces of
    ``most`` words that begin and end with words of the query; those with the most of them, then the shortest, then the first
    are shown, grown on both sides to ``most`` words. Words of up to ``short`` characters that aren't the query's are trimmed
    at ends that were grown. Without a cover the first ``least`` words are shown.
    """
    shown: list[re.Match] = []
    at_place: list[int] = []
    doc: dict[str, list[int]] = {}
    stems: list[set[str]] = []
    for place, (word, spoken, m) in enumerate(tokens(text), 1):
        if not shown or shown[-1] is not m:
            shown.append(m)
            stems.append(set())
        at_place.append(len(shown) - 1)
        lexeme = stem(word) if spoken else word
        if not spoken or word not in ENGLISH_STOP_WORDS:
            doc.setdefault(lexeme, []).append(place)
            stems[-1].add(lexeme)
    if not shown:
        return ""
    required = [parts for parts, _ in query.clauses if parts]
    if query.phrase:
        choices = [[query.phrase]]
    else:
        choices = required or [[Phrase([(w, 1)])] for w in query.any_of]
    asked = {w for parts in choices for part in parts for w in part}
    hit = [bool(s & asked) for s in stems]
    covers = sorted({(at_place[b - 1], at_place[e - 1]) for parts in choices for b, e in minimal_covers([_places(doc, p) for p in parts])})
    pieces: set[tuple[int, int]] = set()
    for first, last in covers:
        while first <= last:
            end = max(k for k in range(first, min(last, first + most - 1) + 1) if hit[k])
            pieces.add((first, end))
            first = next((k for k in range(end + 1, last + 1) if hit[k]), last + 1)
    taken: list[tuple[int, int]] = []
    for first, last in sorted(pieces, key=lambda p: (-sum(hit[p[0] : p[1] + 1]), p[1] - p[0], p[0])):
        if len(taken) == max(1, fragments):
            break
        if any(first <= b and a <= last for a, b in taken):
            continue
        free = lambda k: 0 <= k < len(shown) and not any(a <= k <= b for a, b in taken)  # noqa: E731, B023
        begin, end = first, last
        room = (most - (last - first + 1)) // 2
        while room and free(begin - 1):
            begin, room = begin - 1, room - 1
        while end - begin + 1 < most and free(end + 1):
            end += 1
        weak = lambda k: not hit[k] and len(shown[k][0]) <= short
        while begin < first and weak(begin):
            begin += 1
        while end > last and weak(end):
            end -= 1
        taken.append((begin, end))
    if not taken:
        taken = [(0, min(least, len(shown)) - 1)]
    out = []
    for begin, end in sorted(taken):
        piece, at = [], shown[begin].start()
        for k in range(begin, end + 1):
            piece.append(text[at : shown[k].start()])
            piece.append(f"**{shown[k][0]}**" if hit[k] else shown[k][0])
            at = shown[k].end()
        out.append("".join(piece))
    return " ... ".join(out)


def cover_headline_column(query: Query, text: Column | str, *, fragments: int = 2, most: int = 30) -> Column:
    @F.pandas_udf(T.StringType())
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cover_headline(t or "", query, fragments=fragments, most=most))

    return marked(text)


def snippet_limits(chars: int) -> tuple[int, int]:
    """Fragments and words a fragment for a snippet of so many characters."""
    return max(1, chars // 200), max(15, min(60, chars // 7))
