"""Weighted ratios by plain dynamic programming and all pairs; headlines by enumerated covers."""

import itertools
import random

import pytest
from conftest import DATA

from tessella.functions import lexical, python
from tessella.operators import evaluate
from tessella.plans import catalogue


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def plain(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100


def test_common_subsequences():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert python.common(a, b) == lcs(a, b)
        if a and b:
            short, long = sorted((a, b), key=len)
            parts = {long[i : i + len(short)] for i in range(len(long))} | {long[:i] for i in range(1, len(short))}
            best = max(plain(short, p) for p in parts)
            if len(short) == len(long):
                best = max(best, *(plain(long, p) for p in {short[i:] for i in range(len(short))} | {short[:i] for i in range(1, len(short))}))
            assert python.partial_ratio(a, b) == pytest.approx(best)


@pytest.mark.parametrize(
    "a, b, score",
    [
        ("BRCA1", "BRCA2", 80.0), ("BRCA1", "BRCA1", 100.0), ("BRCA", "BRCA1", 200 * 4 / 9), ("", "x", 0.0), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95.0), ("fuzzy was a bear", "fuzzy fuzzy was a bear", 95.0),
        ("this is a test", "this is a test!", 200 * 14 / 29), ("a b", "b a", 95.0), ("TP53", "TP53 tumour protein", 90.0), ("TP", "XXTPXX" * 5, 60.0), ("word one", "other word entirely unlike this", 85.5),
    ],
)
def test_weighted_ratio(a, b, score):
    assert python.closeness(a, b) == pytest.approx(score) == python.closeness(b, a)


def test_the_filter_loses_nothing():
    r = random.Random(2)
    names = ["".join(r.choice("ABC1 ") for _ in range(r.randint(1, 9))) for _ in range(120)]
    ruled = 0
    for a, b in itertools.combinations(names, 2):
        score = python.closeness(a, b)
        for least in (60, 70, 90):
            if not python.may_reach(a, b, least):
                ruled += 1
                assert score < least, (a, b, score)
    assert ruled > 1000


def test_batch_equals_all_pairs(spark):
    r = random.Random(3)
    names = ["".join(r.choice("ABCD1 ") for _ in range(r.randint(1, 8))) for _ in range(150)]
    wanted = ["AB1", "A B", "DCBA", "", "AB1"]
    got = [tuple(x) for x in evaluate.close_names_batch(spark.createDataFrame([(n,) for n in [*names, *names[:9], None]], "name string"), wanted).collect()]
    want = []
    for w in dict.fromkeys(wanted):
        near = sorted(((n, python.closeness(w, n)) for n in set(names) if python.closeness(w, n) >= 70), key=lambda x: (-x[1], x[0]))[:3]
        want += [(w, n, pytest.approx(s), k) for k, (n, s) in enumerate(near, 1)]
    assert sorted(got, key=lambda x: (x[0], x[3])) == sorted(want, key=lambda x: (x[0], x[3]))
    with pytest.raises(ValueError):
        evaluate.close_names_batch(None, [])


def enumerated(parts):
    """Minimal covers by trying every choice of spans."""
    if not parts or not all(parts):
        return []
    spans = {(min(b for b, _ in c), max(e for _, e in c)) for c in itertools.product(*parts)}
    return sorted(s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans))


def test_covers():
    r = random.Random(4)
    for _ in range(400):
        width = r.randint(0, 2)
        parts = [sorted({(b, b + (width if k == 0 else 0)) for b in r.sample(range(1, 25), r.randint(0, 5))}) for k in range(r.randint(1, 3))]
        assert lexical.minimal_covers(parts) == enumerated(parts), parts


@pytest.mark.parametrize(
    "text, query, shown",
    [
        ("an annual imaging of the carriers is advised", "annual imaging", "**annual** **imaging** of the carriers is advised"),
        ("imaging comes first and annual later", "annual imaging", "**imaging** comes first and **annual** later"),
        ("of the to carriers in it", "carriers", "**carriers**"),
        ("Risk-reducing surgery", "risk-reducing", "**Risk-reducing** surgery"),
        ("one two three", "", "one two three"),
        ("", "x", ""),
    ],
)
def test_headlines(text, query, shown):
    assert lexical.cover_headline(text, lexical.parse(query), fragments=1, most=8) == shown


def test_covers_come_before_single_words():
    text = "alpha " + "x " * 40 + "alpha beta " + "y " * 40 + "beta"
    out = lexical.cover_headline(text, lexical.parse("alpha beta"), fragments=2, most=6)
    assert out.count("**alpha** **beta**") == 1 and " ... " not in out
    # No phrase lexeme, no required part: any of the terms.
    q = lexical.Query("x", any_of=["beta"])
    assert lexical.cover_headline(text, q, fragments=2, most=4).count("**beta**") == 2


def test_registered_headline(spark):
    q, n = lexical.parse("disgusting idiot"), 0
    fragments, most = lexical.snippet_limits(400)
    got = {r.doc_id: r.snippet for r in catalogue.queries()["cover_headline"](spark, DATA).collect()}
    for d in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        if d.text and any(w in d.text.lower() for w in ("disgusting", "idiot")):
            places = {}
            for w, at in lexical.lexemes(d.text):
                places.setdefault(w, []).append(at)
            covers = enumerated([[(p, p + 1) for p in places.get(q.phrase[0], []) if p + 1 in places.get(q.phrase[1], [])]])
            assert got[d.doc_id] == lexical.cover_headline(d.text, q, fragments=fragments, most=most)
            assert not covers or got[d.doc_id].count("**") >= 4
            n += 1
    assert n == len(got) > 0
