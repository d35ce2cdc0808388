"""Op 1 against all pairs in double precision."""

import math

import numpy as np
from llm_classes import DATA, Classes

from tessella.llm import vectors
from tessella.llm.queries import op1_embedding_near_dedup


def brute(rows):
    """(n_links, component) by row number; rows are (id, list or None)."""
    ok = [None if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, float) for _, v in rows]
    links, classes = [0] * len(rows), Classes()
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] is not None and ok[b] is not None and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / math.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.9:
                links[a] += 1
                links[b] += 1
                classes.join(a, b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[classes.find(a)] = min(i, least.get(classes.find(a), i))
    return [(links[a], least.get(classes.find(a))) for a in range(len(rows))]


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in vectors.near_vectors(df).collect())
    assert got == sorted((str(i), n, c) for (i, _), (n, c) in zip(rows, brute(rows), strict=True))


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(30):
        centre = rng.standard_normal(48)
        rows += [(100 * k + j, (centre + rng.uniform(0.05, 0.5) * rng.standard_normal(48)).tolist()) for j in range(rng.integers(1, 20))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    want = {i: n for (i, _), (n, _) in zip(rows, brute(rows), strict=True)}
    # Many of these pairs are just at the threshold: none may be made up, and hardly any be missed.
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.995 * sum(want.values())


def test_odd_vectors(spark):
    a = [1.0, 2.0, 3.0]
    check(spark, [(5, a), (3, a), (3, a), (None, a), (4, [2.0, 4.0, 6.0]), (9, None), (10, []), (11, [0.0, 0.0, 0.0]), (12, [1.0, None, 3.0]), (13, [float("nan"), 1.0, 1.0]), (14, [float("inf"), 1.0, 1.0]), (15, [1.0, 2.0]), (16, [1e-200, 2e-200, 3e-200]), (17, [-1.0, -2.0, -3.0]), (None, None)])


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_crowd_in_blocks(spark):
    """More vectors of one direction than a block holds, each another."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal(32)
    check(spark, [(k, (base + 0.1 * rng.standard_normal(32)).tolist()) for k in range(600)] + [(1000 + k, rng.standard_normal(32).tolist()) for k in range(50)])


def test_recall_at_the_threshold(spark):
    """Pairs at cosines from 0.9 to 0.92 among other vectors: at least nine tenths are found."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        o = rng.standard_normal(64)
        o -= o @ a * a
        o /= np.linalg.norm(o)
        c = rng.uniform(0.9001, 0.92)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * o).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vectors.near_vectors(df).filter("n_links > 0").count()
    assert found >= 0.98 * len(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    u = vectors.unit(rng.standard_normal((2000, 64)))
    codes = vectors.Codes(u)
    a, b = np.arange(1000), np.arange(1000, 2000)
    error = codes.estimate(a, b) - (u[a] * u[b]).sum(1)
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) < vectors.EPSILON * codes.slack[a]).all()


def test_query(spark, tmp_path):
    """The query against all pairs: on the test table, and on one with links, copies and odd rows."""
    rng = np.random.default_rng(9)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    linked = []
    for k in range(40):
        centre = rng.standard_normal(64)
        linked += [(50 * k + j, (centre + 0.15 * rng.standard_normal(64)).tolist()) for j in range(rng.integers(1, 12))]
    linked += [(9000, linked[0][1]), (9001, linked[0][1]), (9002, None), (9003, [0.0] * 64), (9004, [float("nan")] * 64)]
    for name, own in (("given", rows), ("linked", linked)):
        spark.createDataFrame([(i, v, "l") for i, v in own], "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        out = op1_embedding_near_dedup(spark, f"{tmp_path}/{name}")
        assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted((i, n, c, i == c) for (i, _), (n, c) in zip(own, brute(own), strict=True))
    assert sum(n for n, _ in brute(linked)) > 300


def test_tables_share_signs(spark, monkeypatch):
    """With fewer hyperplanes than tables need: rows stay small, no pair counts twice, recall is as predicted."""
    monkeypatch.setattr(vectors, "SIGNS", 64)
    bits, count = vectors.tables(10_000)
    assert bits * count > 64 and count > 14
    rng = np.random.default_rng(10)
    a = vectors.unit(rng.standard_normal((4000, 64)))
    o = rng.standard_normal((4000, 64))
    b = 0.9 * a + math.sqrt(1 - 0.81) * vectors.unit(o - (o * a).sum(1)[:, None] * a)
    same = 1 - math.acos(0.9) / math.pi
    for few in (12, count):
        p, q = (vectors.keys(vectors.signs(x, 64), bits, few, 64) for x in (a, b))
        assert abs((p == q).any(1).mean() - (1 - vectors.missed(bits, few, same))) < 0.02
    base = rng.standard_normal(32)
    check(spark, [(k, (base + 0.1 * rng.standard_normal(32)).tolist()) for k in range(300)] + [(1000 + k, rng.standard_normal(32).tolist()) for k in range(50)])


def test_rows_stay_small_with_many_tables():
    """A row's signs take 64 bytes however many vectors there are."""
    for n in (10**4, 10**6, 10**8, 10**9):
        bits, count = vectors.tables(n)
        assert -(-min(vectors.SIGNS, bits * count) // 8) <= 64
        assert vectors.missed(bits, count, 1 - math.acos(0.9) / math.pi) <= 0.001 + 1e-9


def test_blocks_of_a_crowd(spark, monkeypatch):
    """The same with blocks of which many make up a bucket: each two meet, and no pair counts twice."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(31)
    check(spark, [(k, (base + 0.1 * rng.standard_normal(31)).tolist()) for k in range(300)] + [(1000 + k, rng.standard_normal(31).tolist()) for k in range(50)] + [(5000, base.tolist())] * 3)


def test_stored_codes_read_back():
    rng = np.random.default_rng(7)
    for dim in (1, 3, 64, 65):
        codes = vectors.Codes(vectors.unit(rng.standard_normal((20, dim))))
        back = vectors.Codes.read(codes.stored(), dim)
        a, b = np.arange(19), np.arange(1, 20)
        assert np.array_equal(codes.estimate(a, b), back.estimate(a, b)) and np.array_equal(codes.q, back.q)


def test_clashing_columns_and_long_vectors(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal(20_000).tolist()
    df = spark.createDataFrame([(1, v, 5, 6), (2, v, 5, 6), (3, v[::-1], 5, 6)], "vec_id long, embedding array<float>, r int, component_id int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}
