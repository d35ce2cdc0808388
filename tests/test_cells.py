"""The stored index of vectors: recall against all vectors, cells read, filters, segments."""

import numpy as np
import pytest
from conftest import DATA

from tessella.operators import cells, search
from tessella.plans import catalogue

SCHEMA = "nbk_id string, passage_id long, embedding array<float>"
TOPICS, EACH, DIM = 60, 100, 24


@pytest.fixture(scope="module")
def filed(spark, tmp_path_factory):
    """Vectors around topics; a chapter has three topics."""
    r = np.random.default_rng(1)
    topics = r.standard_normal((TOPICS, DIM))
    rows = [(f"N{t // 3}", t * EACH + k, (topics[t] + 0.4 * r.standard_normal(DIM)).astype("f4").tolist()) for t in range(TOPICS) for k in range(EACH)]
    v = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    index = cells.trained(v, str(tmp_path_factory.mktemp("cells") / "c"))
    assert index.add(v, batch=0) and not index.add(v, batch=0)
    return v, cells.opened(spark, index.root), topics


def nearest(v, q, k):
    return [(r.passage_id, round(r.dense_score, 9)) for r in search.dense_top(v, v, q, k).collect()]


def got(near):
    return [(r.passage_id, round(r.dense_score, 9)) for r in near.rows.collect()]


def test_recall_and_cells_read(filed):
    v, index, topics = filed
    for t in (0, 7, 59):
        q = (topics[t] + 0.2 * np.random.default_rng(t).standard_normal(DIM)).tolist()
        for within, k in ((None, 40), (v.filter("passage_id % 2 = 0"), 20), (v.filter(f"nbk_id = 'N{t // 3}'"), 40)):
            want, near = nearest(v if within is None else within, q, k), index.top(q, k, within=within)
            assert len({x for x, _ in want} & {x for x, _ in got(near)}) >= 0.95 * k
            assert within is not None or near.read < 0.1 * near.cells + 1


def test_few_are_left_by_a_filter(filed):
    """All cells are read before less than K vectors are given."""
    v, index, topics = filed
    within = v.filter("passage_id % 601 = 5")
    near = index.top(topics[0].tolist(), 50, within=within)
    assert got(near) == nearest(within, topics[0].tolist(), 50) and near.read == near.cells


def test_vectors_without_structure(spark, tmp_path):
    """Cells say nothing here, so that nearly all are read, and recall stays."""
    r = np.random.default_rng(3)
    v = spark.createDataFrame([("N", k, x.astype("f4").tolist()) for k, x in enumerate(r.standard_normal((1500, 32)))], SCHEMA).cache()
    index = cells.trained(v, str(tmp_path / "c"))
    index.add(v)
    q = r.standard_normal(32).tolist()
    assert len({x for x, _ in nearest(v, q, 50)} & {x for x, _ in got(index.top(q, 50))}) >= 45
    assert got(index.top(q, 50, exact=True)) == nearest(v, q, 50)


def test_only_the_cells_folders_are_read(filed):
    _, index, topics = filed
    some = index.rows_of(index.order(topics[0].tolist())[:2]).inputFiles()
    assert {f.rsplit("/", 2)[-2] for f in some} == {f"cell={c}" for c in index.order(topics[0].tolist())[:2]}


def test_segments_and_odd_vectors(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [("N", k, x.tolist()) for k, x in enumerate(r.standard_normal((80, 8)))]
    odd = [("N", 900, None), ("N", 901, []), ("N", 902, [0.0] * 8), ("N", 903, [float("nan")] * 8), ("N", 904, [1.0] * 7), (None, 905, [1.0] * 8), ("N", 906, [1.0] * 7 + [None]), ("N", 5, rows[5][2])]
    index = cells.trained(spark.createDataFrame(rows + odd, SCHEMA), str(tmp_path / "c"), cells=5)
    q = rows[3][2]
    assert index.top(q, 3).rows.count() == 0
    index.add(spark.createDataFrame(rows + odd, SCHEMA), batch=1)
    turned = [("N", 3, [-x for x in q]), ("N", 1000, q)]
    index.add(spark.createDataFrame(turned, SCHEMA), batch=2)
    index.segments.remove(spark.createDataFrame([("N", 7)], "nbk_id string, passage_id long"))
    now = spark.createDataFrame([x for x in rows if x[1] not in (3, 7)] + turned, SCHEMA)
    want = nearest(now, q, 100)
    assert got(index.top(q, 100, exact=True)) == want and want[0][0] == 1000 and len(want) == 80
    index.compact()
    assert len(index.segments.marks()) == 1 and got(cells.opened(spark, index.root).top(q, 100, exact=True)) == want
    assert index.top([1.0], 3).rows.count() == index.top([0.0] * 8, 3).rows.count() == 0
    with pytest.raises(ValueError):
        index.top(q, 0)
    with pytest.raises(ValueError):
        cells.trained(spark.createDataFrame(odd[:4], SCHEMA), str(tmp_path / "d"))


def test_search_takes_the_index(spark, filed):
    v, index, topics = filed
    p = v.selectExpr("nbk_id", "passage_id", "'management' AS chapter_section", "'evidence' AS passage_role", "'annual imaging' AS text", "14 AS char_count")
    q = topics[4].tolist()
    want = search.search(p, v, "imaging", q, filters=search.Filters(nbk_id="N1")).collect()
    assert [r.passage_id for r in search.search(p, v, "imaging", q, filters=search.Filters(nbk_id="N1"), near=index).collect()] == [r.passage_id for r in want]


def test_registered_query(spark):
    key = lambda name: sorted(map(tuple, catalogue.queries()[name](spark, DATA).collect()))
    assert key("indexed_dense_topk") == key("dense_topk_cosine")
