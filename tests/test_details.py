"""Domains of requests, medians and joined tops, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate, requests, search


def test_requests_are_judged_alike_alone_and_in_rows(spark):
    rows = [
        ("NBK1", "NBK1:0001", "x", 1, 0, 80), ("NBK", "NBK1:001", "", 0, -1, 79), ("nbk1", "NBK1:00011", "y" * 512, 100, 5, 800),
        ("NBK1\n", "NBK1:0001\n", "y" * 513, 101, 6, 801), (None, None, None, None, None, None), ("NBK٣", "xNBK1:0001", "é" * 512, 50, 3, 300),
    ]
    fields = ("nbk_id", "passage_id", "query", "limit", "neighbors", "snippet_chars")
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, nbk_id string, passage_id string, query string, `limit` int, neighbors int, snippet_chars int")

    def alone(r):
        out = []
        for f, v in zip(fields, r, strict=True):
            try:
                requests.check(**{f: v})
            except ValueError:
                out.append(f)
        return sorted(out)

    good, bad = requests.parted(df)
    want = {k: alone(r) for k, r in enumerate(rows)}
    assert {r.k: r.faults for r in bad.collect()} == {k: w for k, w in want.items() if w}
    assert {r.k for r in good.collect()} == {0, 4}
    assert want[1] == sorted(fields) and want[2] == ["nbk_id", "passage_id"] and want[3] == sorted(fields)
    assert requests.parted(df.select("k"))[0].count() == len(rows) and requests.parted(df.limit(0))[1].count() == 0
    with pytest.raises(TypeError):
        requests.check(other=1)
    with pytest.raises(ValueError, match=r"limit \(1 to 100\), query \(1 to 512 characters\)"):
        requests.check(limit=0, query="")


def test_medians_of_any_samples(spark):
    rng = random.Random(3)
    groups = {
        "one": [5.0], "two": [2.0, 1.0], "nulls": [None, None, 1.0], "half": [None, 1.0, 2.0], "only nulls": [None], "equal": [7.0] * 400,
        "continuous": [rng.random() for _ in range(5001)], "skewed": [rng.random() ** 20 for _ in range(4000)] + [None] * 37, None: [3.0, 1.0, 2.0],
        "steps": [float(rng.randrange(5)) for _ in range(3000)], "negative": [rng.gauss(0, 1e6) for _ in range(2500)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    want = {g: sorted(vs, key=lambda v: (v is not None, v or 0.0))[len(vs) // 2] for g, vs in groups.items()}
    got = evaluate.median_latency(df, "g", "v").collect()
    assert len(got) == len(groups) and {r.g: r.p50 for r in got} == want
    assert evaluate.median_latency(df.limit(0), "g", "v").collect() == []
    whole = spark.createDataFrame([("a", k) for k in range(1000)], "g string, v int")
    assert [(r.g, r.p50) for r in evaluate.median_latency(whole, "g", "v").collect()] == [("a", 500)]


def test_tops_one_after_the_other(spark):
    lexical = spark.createDataFrame([("N", "a", 0.5), ("N", "b", 0.5), ("M", "c", 0.9)], "nbk_id string, passage_id string, lexical_rank double")
    dense = spark.createDataFrame([("N", "a", 0.1), ("N", "d", 0.2), ("M", "a", 0.3)], "nbk_id string, passage_id string, dense_score double")
    got = [(r.nbk_id, r.passage_id, r.lexical_rank, r.dense_score) for r in search.appended(lexical, dense).orderBy("position").collect()]
    assert got == [("M", "c", 0.9, None), ("N", "a", 0.5, None), ("N", "b", 0.5, None), ("M", "a", 0.0, 0.3), ("N", "d", 0.0, 0.2)]
    assert search.appended(lexical.limit(0), dense.limit(0)).collect() == []
    assert search.appended(lexical, dense.limit(0)).count() == 3
