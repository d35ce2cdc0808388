"""License scans by patience alignment.

A template is held against windows of a text: stretches of at most ``SPREAD`` times its words, in which
enough words are of the template for it to be there at all. Text and template are aligned on the words
that each holds exactly once, by the longest increasing subsequence of their places; the gaps between
anchors are aligned in the same way, after what agrees at either end. Coverage is the share of the
template's words that are aligned. It is reported from ``FLOOR`` on, and a match from ``LEAST`` on.

Windows begin at each word of the template, so that a text takes time in proportion to its length and to the
template's. Most are left by a bound: no more words can be aligned than text and template have in common,
each as often as it stands in both.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship
from .common import extended, held, slices, without
from .contamination import words
from .templates import TEMPLATES

LEAST, FLOOR, SPREAD = 0.85, 0.5, 1.5
OWN = ["licenses", "n_matches", "matches", "coverage"]
SLICE = 4 << 20


def increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (a, b), sorted by a, whose b increase: patience sorting with links back."""
    tops, piles, before = [], [], []
    for k, (_, b) in enumerate(places):
        p = bisect_left(tops, b)
        if p == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[p], piles[p] = b, k
        before.append(piles[p - 1] if p else -1)
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(places[k])
        k = before[k]
    return out[::-1]


def aligned(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of places (in the text, in the template) whose words agree, both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        here, there = Counter(text[a0:a1]), Counter(template[b0:b1])
        at = {w: k for k, w in enumerate(template[b0:b1], b0) if there[w] == 1}
        anchors = increasing([(k, at[w]) for k, w in enumerate(text[a0:a1], a0) if here[w] == 1 and w in at])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Finder:
    """All templates, their words numbered together; 0 is any other word."""

    def __init__(self, templates: list[tuple[str, str]], least: float = LEAST, spread: float = SPREAD, floor: float = FLOOR):
        self.number: dict[bytes, int] = {}
        self.templates = []
        for name, text in templates:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text.encode())]
            if ids:
                self.templates.append((name, ids, -int(-least * len(ids) // 1), -int(-min(least, floor) * len(ids) // 1), int(spread * len(ids)) + 1))
        self.member = np.zeros((len(self.templates), len(self.number) + 1), np.int32)
        for k, (_, ids, *_) in enumerate(self.templates):
            self.member[k, ids] = 1

    def find(self, text: bytes | None) -> tuple[list[tuple[str, int, int, float]], float]:
        """(template, first word, end, coverage) of the matches, by place, and the largest coverage from the floor on; overlapping matches go to the most words aligned."""
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words(text)), np.int64)
        if not len(ids):
            return [], 0.0
        count = np.minimum(np.bincount(ids, minlength=self.member.shape[1]), 1)
        count[0] = 0
        kinds = self.member @ count
        found, most = [], 0.0
        for k, (name, own, need, least, wide) in enumerate(self.templates):
            # Distinct words of the text bound the distinct words that can be aligned.
            distinct = int(self.member[k].sum())
            if kinds[k] < distinct - (len(own) - least):
                continue
            hits = np.concatenate([[0], np.cumsum(self.member[k][ids])])
            begin = np.flatnonzero(self.member[k][ids])
            begin = begin[hits[np.minimum(begin + wide, len(ids))] - hits[begin] >= least]
            begin = begin[self.common(ids, begin, wide, own) >= least].tolist()
            free = 0
            for b in begin:
                if b < free:
                    continue
                pairs = aligned(ids[b : b + wide].tolist(), own)
                if pairs and pairs[0][0]:
                    # A stray word before may have cut the end off: look again from where the template begins.
                    later = aligned(ids[b + pairs[0][0] : b + pairs[0][0] + wide].tolist(), own)
                    if len(later) >= len(pairs):
                        b, pairs = b + pairs[0][0], later
                most = max(most, len(pairs) / len(own) if len(pairs) >= least else 0.0)
                if len(pairs) >= need:
                    found.append((len(pairs), name, b + pairs[0][0], b + pairs[-1][0] + 1, len(pairs) / len(own)))
                    free = b + pairs[-1][0] + 1
        taken: list[tuple[str, int, int, float]] = []
        for n, name, b, e, share in sorted(found, key=lambda f: (-f[0], -f[4], f[1], f[2])):
            if all(e <= x or y <= b for _, x, y, _ in taken):
                taken.append((name, b, e, share))
        return sorted(taken, key=lambda m: (m[1], m[0])), most

    @staticmethod
    def common(ids: np.ndarray, begin: np.ndarray, wide: int, own: list[int]) -> np.ndarray:
        """Words that windows and a template have in common, each as often as in both."""
        out = np.zeros(len(begin), np.int64)
        if len(begin):
            end = np.minimum(begin + wide, len(ids))
            for word, times in Counter(own).items():
                at = np.flatnonzero(ids == word)
                out += np.minimum(times, np.searchsorted(at, end) - np.searchsorted(at, begin))
        return out


def scanned(docs: DataFrame, *, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, spread: float = SPREAD, floor: float = FLOOR) -> DataFrame:
    """Each row with licenses (names in order), n_matches, matches and the largest coverage.

    Matches are ``name:first:end:coverage`` with places in words (a-z, 0-9 and all beyond ASCII, A-Z
    lower-cased) and coverage in hundredths. Null and empty texts, and texts without words, match nothing and have a coverage of 0.
    Of templates that overlap in a text the one with the most aligned words stays, then the one better
    covered, then the smaller name. ``coverage`` is that of the best alignment of any template, also of one
    that is no match, and 0 below ``floor``. Very long texts are scanned whole; an empty table gives an empty one. Repeated rows are scanned each on its own. Columns that clash with
    the results are replaced. Templates are few: they travel with the tasks, at most 1 MB of them.
    """
    if sum(len(n) + len(t) for n, t in templates) > 1 << 20:
        raise ValueError("templates are limited to 1 MB")
    ship(docs.sparkSession)
    keep = without(docs, OWN)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("licenses", T.ArrayType(T.StringType())), T.StructField("n_matches", T.LongType()), T.StructField("matches", T.ArrayType(T.StringType())), T.StructField("coverage", T.DoubleType())])

    def run(batches, name=uuid4().hex):
        own = held(name, lambda: Finder(templates, least, spread, floor))
        for batch, texts in slices(batches, text, SLICE):
            rows, most = zip(*map(own.find, texts), strict=True) if texts else ((), ())
            yield extended(batch, keep, {
                "licenses": pa.array([sorted({m[0] for m in r}) for r in rows], pa.list_(pa.string())),
                "n_matches": pa.array([len(r) for r in rows], pa.int64()),
                "matches": pa.array([[f"{n}:{b}:{e}:{round(100 * c)}" for n, b, e, c in r] for r in rows], pa.list_(pa.string())),
                "coverage": pa.array(most, pa.float64()),
            })

    return docs.select(*keep).mapInArrow(run, schema)
