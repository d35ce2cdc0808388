"""The pipeline: each stage against a brute-force version of its operator, on what the stage before kept."""

import corpus_pipeline as cp
import test_contamination
import test_lines
import test_nearcopies
from llm_classes import DATA
from test_pieces import LIBRARY

from tessella.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, tmp_path):
    kept = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, kept[-1], DATA).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(df.columns == COLUMNS for df in kept[:5])
    scores = toxicity.scored(kept[0], toxicity.fit(kept[0], spark.read.parquet(f"{DATA}/labels.parquet")))
    assert texts(kept[1]) == texts(scores.filter("score < 0.7"))
    rows = texts(kept[1])
    assert texts(kept[2]) == sorted((i, t) for (i, _), (t, _, gone) in zip(rows, test_lines.brute(rows), strict=True) if not gone or t.strip())
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())
    rows = texts(kept[2])
    assert texts(kept[3]) == [r for r, c in zip(rows, test_nearcopies.brute(rows), strict=True) if not r[1] or r[0] == c]
    rows = texts(kept[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert texts(kept[4]) == [r for r, b in zip(rows, test_contamination.brute([t for _, t in rows], items), strict=True) if not b[3]]
    assert {r.doc_id: r.n_tokens for r in kept[5].collect()} == {i: len(LIBRARY.encode(t)) for i, t in texts(kept[4])}
    whole = {r.doc_id: r.ids_sha256 for r in cp.run(spark, DATA).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in kept[5].collect()}


def staged(spark, docs, sf_dir, at):
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs


def tables(spark, at):
    """A folder with the small tables that the stages read besides documents."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(50).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_odd_rows(spark, documents, make, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns whose names clash with the stages' own."""
    line = make(12)
    rows = [(1, line), (1, line), (2, f"{make(30)}\n{line}"), (2, make(20)), (None, make(25)), (3, None), (4, ""), (5, "\n \n"), (6, make(30_000)), (7, make(6).upper())]
    docs = documents(rows).selectExpr("*", "1 as n_hit", "'x' as __ts_t", "2 as class_id", "3 as score", "4 as n_dropped", "cast(null as int) as gone", "5 as d")
    out = staged(spark, docs, tables(spark, tmp_path / "in"), tmp_path)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    # The repeated row of 1 goes with its copy; line and text of 2 stay apart from each other, as do all others.
    assert got == [(False, k) for k in (1, 2, 2, 3, 4, 5, 6, 7)] + [(True, 0)]


def test_empty_tables(spark, documents, tmp_path):
    folder = tables(spark, tmp_path / "in")
    assert staged(spark, documents([]), folder, tmp_path / "a").count() == 0
    documents([]).write.parquet(f"{folder}/documents.parquet")
    assert cp.run(spark, folder).count() == 0
