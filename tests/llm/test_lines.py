"""Op 5 against all pairs of lines."""

import random

from llm_classes import DATA, Classes
from pyspark.sql import functions as F

from tessella.llm import lines
from tessella.llm.queries import op5_line_dedup


def alike(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(rows):
    """(text, n_lines, n_dropped) for rows of (id, text)."""
    every = {x for _, t in rows for x in (t or "").split("\n") if len(x) >= lines.SHORTEST}
    classes, lengths = Classes(), {}
    for x in every:
        classes.find(x)
        lengths.setdefault(len(x), []).append(x)
    for x in every:
        for n in (len(x), len(x) + 1):
            for y in lengths.get(n, ()):
                if alike(x, y):
                    classes.join(x, y)
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if x in every:
                g = classes.find(x)
                key = (i is None, i)
                first[g] = min(first.get(g, key), key)
    out = []
    for i, t in rows:
        if t is None:
            out.append((None, 0, 0))
            continue
        kept, seen, gone = [], set(), 0
        for x in t.split("\n"):
            if x in every:
                g = classes.find(x)
                if g in seen or first[g] != (i is None, i):
                    gone += 1
                    continue
                seen.add(g)
            kept.append(x)
        out.append(("\n".join(kept), len(t.split("\n")), gone))
    return out


def check(documents, rows):
    got = lines.deduplicated(documents(rows).selectExpr("*", "'x' as n_lines", "1 as _gone2")).collect()
    assert sorted(map(repr, [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got])) == sorted(map(repr, [(i, *w) for (i, _), w in zip(rows, brute(rows), strict=True)]))


def edited(r, line):
    k = r.randrange(len(line))
    return r.choice([line[:k] + line[k + 1 :], line[:k] + "q" + line[k:], line[:k] + "z" + line[k + 1 :], line])


def test_edits(documents, make):
    r = random.Random(5)
    pool = [make(r.randint(3, 30)) for _ in range(25)]
    rows = [(k, "\n".join(edited(r, edited(r, r.choice(pool)) if r.random() < 0.3 else r.choice(pool)) if r.random() < 0.8 else make(2) for _ in range(r.randint(1, 12)))) for k in range(60)]
    check(documents, rows)


def test_crowds(documents, make):
    """Very many lines that share a half, that differ in one place, and chains of edits."""
    base = make(20)
    n = len(base)
    other = [base[:k] + c + base[k + 1 :] for k in (5, n - 5) for c in "0123456789ABCDEFGHIJ"]
    longer = [base[:k] + "#" + base[k:] for k in range(0, n, 3)]
    halves = [base[: n // 2] + make(8) for _ in range(30)] + [make(8) + base[n // 2 :] for _ in range(30)]
    chain, line = [], make(12)
    for k in range(len(line) - 5):
        line = line[:k] + "~" + line[k + 1 :]
        chain.append(line)
    every = [base, *other, *longer, *halves, *chain, *chain]
    check(documents, [(k, x) for k, x in enumerate(every)])


def test_odd_rows(documents, make):
    a, b, c = make(10), make(12), "é" * 25
    check(documents, [(2, f"{a}\n\n{b}\r\n{a}\nshort\nshort\n"), (1, f"{b}\n{c}"), (None, f"{a}\n{c}"), (3, None), (4, ""), (5, "\n\n"), (6, a), (6, a), (7, make(30000)), (8, f"{c}è")])
    check(documents, [])


def test_emptied_documents_go(documents, make):
    a = make(10)
    got = lines.cleaned(documents([(1, a), (2, f"{a}\n \n"), (3, ""), (4, None), (5, f"{a}\nown words")]))
    assert sorted((r.doc_id, r.text) for r in got.filter("text is not null").collect()) == [(1, a), (3, ""), (5, "own words")]
    assert got.filter("text is null").count() == 1 and got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_bit_parallel_distance(spark):
    r = random.Random(2)
    pairs = []
    for _ in range(300):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 12)))
        b = a
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(b))
            b = r.choice([b[:k] + b[k + 1 :], b[:k] + "b" + b[k:], b[:k] + "a" + b[k + 1 :]])
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (1, 2, 3):
        assert df.filter(lines.within(F.col("a"), F.col("b"), most) != (F.levenshtein("a", "b") <= most)).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {i: (n, gone) for (i, _), (_, n, gone) in zip(rows, brute(rows), strict=True)}
    got = op5_line_dedup(spark, DATA)
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
