"""Op 12: codes against rounds computed in full with whole numbers of any size."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tessella.llm import codebooks, sql
from tessella.llm.queries import op12_vector_codes

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def lloyd(rows, entries=16, rounds=6):
    """{row: (code, error, label_error)} and the digest, in plain Python."""
    kept = [(i, [math.floor(4096 * x) for x in v], g) for i, v, g in rows if v and len(v) % 8 == 0 and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 8
    first = sorted(kept, key=lambda r: (r[0] is None, r[0]))[:entries]
    cut = lambda v, p: v[p * width : p * width + width]
    book = [[cut(v, p) for _, v, _ in first] for p in range(8)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(book[p])), key=lambda j: (d(cut(v, p), book[p][j]), j))
    for _ in range(rounds):
        own = [[near(v, p) for p in range(8)] for _, v, _ in kept]
        for p in range(8):
            for j in range(len(book[p])):
                of = [cut(v, p) for (_, v, _), o in zip(kept, own, strict=True) if o[p] == j]
                if of:
                    book[p][j] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    out, by = [], defaultdict(int)
    for i, v, g in kept:
        own = [near(v, p) for p in range(8)]
        error = sum(d(cut(v, p), book[p][own[p]]) for p in range(8))
        by[g] += error
        out.append((i, "".join(f"{o:02x}" for o in own), error, g))
    sha = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[g], sha) for i, c, e, g in out), key=repr)


def got(spark, rows, **more):
    return sorted(map(tuple, codebooks.compressed(spark.createDataFrame(rows, SCHEMA), **more).collect()), key=repr)


def clouds(n, dim, spread, seed=1, scale=1.0):
    r = np.random.default_rng(seed)
    middle = r.standard_normal((9, dim)) * scale
    return [(int(k), (middle[k % 9] + spread * scale * r.standard_normal(dim)).tolist(), int(k % 4) if k % 7 else None) for k in r.permutation(n)]


@pytest.mark.parametrize("spread, scale", [(0.05, 1.0), (1.0, 1.0), (0.5, 1e-3), (0.3, 900.0)])
def test_rounds(spark, spread, scale):
    rows = clouds(300, 24, spread, scale=scale)
    assert got(spark, rows) == lloyd(rows)


def test_ties(spark):
    """Few different whole-numbered parts: many equal distances, equal entries and entries that stay unused."""
    r = np.random.default_rng(3)
    rows = [(k, (r.integers(-1, 2, 16) / 4096).tolist(), k % 3) for k in range(400)]
    assert got(spark, rows) == lloyd(rows)
    rows = [(k, [0.25] * 8, None) for k in range(40)] + [(99, [-0.25] * 8, None)]
    assert got(spark, rows) == lloyd(rows)


def test_odd_vectors(spark):
    rows = clouds(60, 16, 0.4) + [(61, None, 1), (62, [], 1), (63, [float("nan")] * 16, 1), (64, [1.0] * 15 + [float("inf")], 1), (65, [1.0] * 15 + [None], 1), (None, [0.5] * 16, None), (5, [0.1] * 16, 2), (5, [0.1] * 16, 2)]
    assert got(spark, rows) == lloyd(rows)
    assert got(spark, [*rows, (70, [1.0] * 8, 1), (71, [1.0] * 9, 1), (72, [1e9] * 16, 1), (73, [1e300] * 16, 1)]) == lloyd(rows)


@pytest.mark.parametrize("n", [1, 5, 16])
def test_few_vectors(spark, n):
    rows = clouds(n, 8, 0.3)
    assert got(spark, rows) == lloyd(rows)


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, None), (2, [float("nan")] * 8, 3)]) == []


def test_clashing_columns_and_long_vectors(spark):
    v = np.random.default_rng(2).standard_normal((20, 8000)).tolist()
    df = spark.createDataFrame([(k, x, "l", 1, 2) for k, x in enumerate(v)], "vec_id int, embedding array<float>, label string, d int, code int")
    out = codebooks.compressed(df, rounds=1)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 20


def test_bounds_hold_and_spare_work():
    """After each round bounds are true, and far fewer distances are computed than there are."""
    r = np.random.default_rng(5)
    x = np.floor(4096 * (r.standard_normal((12, 8, 8))[r.integers(0, 12, 4000)] + 0.1 * r.standard_normal((4000, 8, 8)))).astype(np.int64)
    book = x[:16].transpose(1, 0, 2).copy()
    state, work = codebooks.Assigned.first(x, book), []
    for _ in range(6):
        sums = np.zeros((8, 16, 9), np.int64)
        for p in range(8):
            np.add.at(sums[p, :, :8], state.own[:, p], x[:, p])
            sums[p, :, 8] = np.bincount(state.own[:, p], minlength=16)
        before, book = book, codebooks.moved_entries(book, sums)
        work.append(state.moved(x, book, before))
        d = np.stack([codebooks.squares(x, book[:, j]) for j in range(16)], 2)
        assert (state.own == d.argmin(2)).all()
        far = np.sqrt(d.astype(np.float64))
        assert (state.lower.astype(np.float64) <= far).all()
        assert (state.upper.astype(np.float64) >= np.take_along_axis(far, state.own[:, :, None].astype(int), 2)[:, :, 0]).all()
    assert work[-1] < 0.2 * x.shape[0] * 8 * 16


def test_rounding_outwards():
    x = np.concatenate([np.random.default_rng(1).uniform(0, 70_000, 10_000), [0.0, 1e-12, 65504.0, 1e9]])
    assert (codebooks.up(x).astype(np.float64) >= x).all() and (codebooks.down(x).astype(np.float64) <= x).all() and (codebooks.down(-x) == 0).all()


def test_query(spark):
    embeddings = duckdb.sql(f"SELECT * FROM '{DATA}/embeddings.parquet'")  # noqa: F841
    assert sorted(map(tuple, op12_vector_codes(spark, DATA).collect())) == sorted(duckdb.sql(sql.CODES).fetchall())
