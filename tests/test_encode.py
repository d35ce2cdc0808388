"""The encoder stage: vectors as one by one, calls of like lengths, one loading a worker."""

import os

import numpy as np
import pytest

from tessella.functions.python import made_vector
from tessella.operators import encode


def made(dim=8, log=None):
    def load():
        if log:
            with open(log, "a") as f:
                f.write(f"{os.getpid()}\n")
        return lambda texts: [made_vector(t, dim) for t in texts]

    return load


def test_vectors_are_those_of_each_text(spark, tmp_path):
    rows = [(k, "x" * (k * 37 % 200) + str(k)) for k in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(6)
    log = str(tmp_path / "loaded")
    got = {r.id: r.embedding for r in encode.encoded(df, made(log=log), model=log, dim=8).collect()}
    for k, t in rows:
        want = None if t is None else np.array(made_vector(t, 8)) / np.linalg.norm(made_vector(t, 8))
        assert got[k] is None if want is None else np.allclose(got[k], want, atol=1e-6)
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) >= 1
    q = encode.encoded(df.filter("id = 3"), made(), model="q", dim=8, query=True).first().embedding
    assert np.allclose(q, np.array(made_vector(encode.QUERY_PREFIX + rows[3][1], 8)) / np.linalg.norm(made_vector(encode.QUERY_PREFIX + rows[3][1], 8)), atol=1e-6)


def test_calls():
    texts = ["a" * n for n in (5, 900, 1, 40, 41, 39, 2, 70_000, 3)]
    got = encode.calls(texts, 3, 200)
    assert sorted(k for c in got for k in c) == list(range(len(texts)))
    assert [k for c in got for k in c] == sorted(range(len(texts)), key=lambda k: len(texts[k]))
    assert all(len(c) <= 3 and (len(c) == 1 or len(c) * max(len(texts[k]) for k in c) <= 200) for c in got)


@pytest.mark.parametrize("give", [lambda t: [[1.0] * 7 for _ in t], lambda t: [[0.0] * 8 for _ in t], lambda t: [[float("nan")] * 8 for _ in t], lambda t: [[1.0] * 8]])
def test_wrong_models_are_errors(give):
    with pytest.raises(ValueError):
        encode.encode(["a", "b"], give, 8)
