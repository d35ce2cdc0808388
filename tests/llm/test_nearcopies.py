"""Op 7 against the probability Jaccard similarity and the Jaccard similarity of all pairs."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
from llm_classes import DATA, Classes

from tessella.llm import nearcopies as n
from tessella.llm.contamination import words
from tessella.llm.queries import op7_minhash_near_dedup


def weighted(a, b):
    """The probability Jaccard similarity of two counters, by its definition."""
    every = a.keys() | b.keys()
    return sum(1 / sum(max(Fraction(a[e], a[d]), Fraction(b[e], b[d])) for e in every) for d in a.keys() & b.keys())


def similar(a, b):
    s, u = len(a.keys() & b.keys()), len(a.keys() | b.keys())
    if 5 * s >= 4 * u:
        return True
    return bool(s) and a.total() + b.total() > len(a) + len(b) and weighted(a, b) >= Fraction(4, 5)


def brute(rows):
    """The class id of each row of (id, text)."""
    classes, sets = Classes(), []
    for k, (_, t) in enumerate(rows):
        w = words((t or "").encode())
        size = min(5, len(w))
        s = Counter([tuple(w[j : j + size]) for j in range(len(w) - size + 1)] if w else [("raw", t)] if t else [("row", k)])
        sets.append(s)
        for j in range(k):
            if similar(s, sets[j]):
                classes.join(j, k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[classes.find(k)] = min(i, least.get(classes.find(k), i))
    return [least.get(classes.find(k)) for k in range(len(rows))]


def check(documents, rows):
    df = documents(rows).selectExpr("*", "1 as t", "2 as class_id")
    got = sorted(map(repr, [(r[0], r.class_id) for r in n.classes(df).collect()]))
    assert got == sorted(map(repr, [(i, c) for (i, _), c in zip(rows, brute(rows), strict=True)]))


def copy(r, text, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10_000))
    return " ".join(w)


def test_copies(documents, make):
    r = random.Random(1)
    rows = []
    for _ in range(25):
        base = make(r.choice([6, 30, 120, 400]))
        rows += [(len(rows) + k, copy(r, base, r.randint(0, 1 + len(base.split()) // 60))) for k in range(r.randint(1, 6))]
    check(documents, rows + [(1000 + k, make(80)) for k in range(40)])


def test_one_large_family(documents, make, monkeypatch):
    """Copies of copies, more of them than a block holds."""
    monkeypatch.setattr("tessella.llm.runs.BLOCK", 64)
    r = random.Random(2)
    base = make(150)
    check(documents, [(k, copy(r, base, r.randint(0, 5))) for k in range(300)])


def test_odd_rows(documents, make):
    a = make(40)
    check(documents, [(3, a), (2, a.upper()), (2, a), (None, a), (9, None), (8, None), (7, ""), (6, ""), (5, "!!"), (4, "!!"), (11, "?"), (12, "one two"), (13, "One, two."), (None, make(20)), (14, make(30_000))])
    check(documents, [])


def test_one_stays(documents, make):
    a = make(40)
    b, c = make(20), make(25)
    out = n.deduplicated(documents([(3, a), (2, a), (2, a), (5, None), (6, None), (7, ""), (8, make(9)), (None, a), (None, b), (None, c), (None, c), (2, c)]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, k) for k in (2, 2, 5, 6, 7, 8)] + [(True, 0)]
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    x[200:] = 0
    y[:60] = 0
    true = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(60, 200))
    hits = []
    for seed in range(40):
        e = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
        a, b = np.flatnonzero(x), np.flatnonzero(y)
        first = n.signatures(np.concatenate([e[a], e[b]]), np.concatenate([x[a], y[b]]), np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)]), 2)
        assert first.all()
        hits.append((first[0] == first[1]).mean())
    assert abs(np.mean(hits) - true) < 0.03


def test_exact_probability_jaccard():
    r = random.Random(4)
    for _ in range(60):
        a, b = (Counter(r.choices(range(r.randint(1, 30)), k=r.randint(1, 60))) for _ in range(2))
        (x, m), (y, w) = (map(np.array, zip(*sorted(c.items()), strict=True)) for c in (a, b))
        assert abs(n.probability_jaccard(x, m, y, w) - weighted(a, b)) < 1e-12


def test_counts_decide(documents, make):
    """Texts that are alike by how often something occurs, though not by their sets, and the other way round."""
    rows = []
    for _ in range(6):
        refrain = make(12)
        many = " ".join([refrain] * 40)
        rows += [(len(rows), f"{many} {make(25)}"), (len(rows) + 1, f"{many} {make(25)}"), (len(rows) + 2, f"{refrain} {make(60)}")]
        base = make(80)
        rows += [(len(rows), base), (len(rows) + 1, f"{base} {base} {base}"), (len(rows) + 2, f"{base} {many}")]
    check(documents, rows)
    classes = [c for _, c in zip(rows, brute(rows), strict=True)]
    assert classes[0] == classes[1] != classes[2]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in op7_minhash_near_dedup(spark, DATA).collect()}
    assert got == {i: c for (i, _), c in zip(rows, brute(rows), strict=True)}
