"""Op 13: pairs and terms against fractions counted in Python, and its SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tessella.llm import divergence, sql
from tessella.llm.queries import op13_source_divergence

DATA = "/root/testdata/sf0.001"
SCHEMA = "lang string, source string, text string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def expected(rows, least=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text)]) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df, count, total = Counter(), {r[1]: Counter() for r in rows if r[0] == lang}, Counter()
        for own, source, words in found:
            if own == lang:
                df.update(set(words))
                count[source].update(words)
                total.update(words)
        kept = [t for t in df if df[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in count.items()}, share(total)
        for s in count:
            pairs = [(b, sum((p[s][t] - p[b][t]) ** 2 // p[b][t] for t in kept)) for b in count if b != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1)]
    return sorted(out)


def got(spark, rows, **more):
    return sorted(map(tuple, divergence.audited(spark.createDataFrame(rows, SCHEMA), **more).collect()))


def made(seed, n, sources, langs="ab"):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "kmnprsté" for b in ("a", "e", "I", "o", "Ü", "中")]
    return [(r.choice(langs), f"s{min(r.randrange(sources), r.randrange(sources))}", " ".join(r.choice(words[: r.randint(2, len(words))]) for _ in range(r.randint(0, 60)))) for _ in range(n)]


def test_all_pairs_and_terms(spark):
    rows = made(1, 200, 6)
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("bands", [(2, 3), (5, 2), (1, 1)])
def test_blocks_and_bands(spark, monkeypatch, bands):
    """Languages of many blocks of terms and bands of sources."""
    monkeypatch.setattr(divergence, "TERMS", bands[0])
    monkeypatch.setattr(divergence, "GROUPS", bands[1])
    rows = made(2, 120, 9)
    assert got(spark, rows, ranks=5) == expected(rows, ranks=5)


ODD = [
    (None, None, None), ("", "", "x x x"), (None, "s", "x"), ("", None, "X y"), ("l", "a", "q"), ("l", "b", ""), ("l", "c", None), ("l", "d", "1 2 3 _ -"),
    ("m", "a", "Theé THEÉ 中文 a1b"), ("m", "b", "theé 中文"), ("m", "c", "theÉ theé 中文  "), ("m", "a", "Theé"), ("m", "a", "Theé"), ("alone", "a", "w w"), ("alone", "a", "w"), ("alone", "a", "w v"),
]


def test_odd_rows(spark):
    assert got(spark, ODD) == expected(ODD)


def test_empty(spark):
    assert got(spark, []) == []


def test_very_long_text_and_clashing_columns(spark):
    rows = [("e", "a", "ab cd " * 300_000), ("e", "b", "cd " * 10), ("e", "b", "ab cd")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", term int, value string")
    assert sorted(map(tuple, divergence.audited(df).collect())) == expected(rows)


def test_counts_are_given_away(spark, monkeypatch):
    """Many different words of one document, none kept."""
    rows = [("e", "a", " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}" for k in range(210_000))), ("e", "b", "zz"), ("e", "c", "zz zz"), ("e", "a", "zz")]
    assert got(spark, rows) == expected(rows)


def test_shares_of_very_large_counts():
    import numpy as np

    count, of = np.array([0, 8 * 10**11, 10**15 - 1]), np.array([10**15 + 7] * 3)
    assert divergence.share(count, of).tolist() == [1 + 10**9 * (int(c) + 1) // int(d) for c, d in zip(count, of, strict=True)]


def test_the_sql(spark, tmp_path):
    spark.createDataFrame(ODD + made(4, 80, 4), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    documents = duckdb.sql(f"SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")  # noqa: F841
    assert sorted(map(tuple, op13_source_divergence(spark, str(tmp_path)).collect())) == sorted(duckdb.sql(sql.DIVERGENCE).fetchall())


def test_query(spark):
    documents = duckdb.sql(f"SELECT * FROM '{DATA}/documents.parquet'")  # noqa: F841
    assert sorted(map(tuple, op13_source_divergence(spark, DATA).collect())) == sorted(duckdb.sql(sql.DIVERGENCE).fetchall())
