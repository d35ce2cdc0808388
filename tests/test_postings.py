"""Stored postings: the same passages as ranking all of them, fewer blocks and files read, segments over segments."""

import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessella.functions import lexical
from tessella.operators import postings, search
from tessella.plans import catalogue
from tessella.plans.model import passages

WORDS = "carrier screening surgery imaging management prevention risk-reducing the of a that tumor gene repair annual".split()
SCHEMA = "nbk_id string, passage_id string, chapter_section string, passage_role string, text string, gene_symbols array<string>, primary_gene_symbols array<string>, heading_path string"


def made(seed, n, chapters=6):
    """Chapters of very unlike size; few passages are long and full of the terms."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        c = min(r.randrange(chapters), r.randrange(chapters))
        rare = r.random() < 0.05
        text = " ".join(r.choice(WORDS[:6] if rare else WORDS[6:] + ["x%d" % r.randrange(50)] * 3 + WORDS[:1]) for _ in range(r.choice((4, 20, 150)) if not rare else 120))
        out.append((f"N{c}", f"N{c}:{k:05}", r.choice(("summary", "management", "references")), "evidence", text, [f"G{c}"], [f"G{c}"] if c % 2 else [], "Top > Part"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("char_count", F.length("text"))


def full(p, within, query, k, kind):
    asked = postings.KINDS[kind](query)
    if kind == "plain":
        ranks = search.term_ranks(within, asked.named)
    else:
        text = {(r.nbk_id, r.passage_id): " ".join([r.heading_path, r.chapter_section, r.text]) for r in p.collect()}
        rows = [(*key, *lexical.rank(asked.q, lexical.lexemes(t))) for key, t in text.items()]
        ranks = within.join(p.sparkSession.createDataFrame(rows, "nbk_id string, passage_id string, phrase_rank double, strict_rank double, recall_rank double, recall_overlap_count int"), ["nbk_id", "passage_id"])
    return [(r.nbk_id, r.passage_id, round(r.lexical_rank, 9)) for r in search.lexical_top(ranks, asked.terms, k).collect()]


def found(rows):
    return [(r.nbk_id, r.passage_id, round(r.lexical_rank, 9)) for r in rows.collect()]


QUERIES = ["carrier screening", '"tumor gene" annual -repair', "risk-reducing surgery of a carrier or imaging", "that the", "management prevention imaging surgery screening"]


@pytest.fixture(scope="module", params=["english", "plain"])
def filed(request, spark, tmp_path_factory):
    p = frame(spark, made(1, 900)).cache()
    index = postings.created(spark, str(tmp_path_factory.mktemp("index") / "i"), kind=request.param, buckets=16, block=16)
    assert index.add(p)
    return p, postings.opened(spark, index.root)


@pytest.mark.parametrize("query", QUERIES)
def test_the_best_are_those_of_ranking_all(spark, filed, monkeypatch, query):
    p, index = filed
    if index.kind == "plain" and query == "that the":
        query = "gene that"
    monkeypatch.setattr(postings, "SMALL", 0)
    for within, chapters in ((p.filter("chapter_section = 'management'"), None), (p.filter("nbk_id = 'N5'"), p.filter("nbk_id = 'N5'").select("nbk_id").distinct())):
        want = full(p, within, query, 25, index.kind)
        assert found(index.top(query, within, 25, chapters=chapters).rows) == want
    monkeypatch.setattr(postings, "SMALL", 512)
    assert found(index.top(query, p, 25).rows) == full(p, p, query, 25, index.kind)


def test_blocks_of_which_no_passage_can_win_are_passed_over(spark, filed, monkeypatch):
    p, index = filed
    monkeypatch.setattr(postings, "SMALL", 0)
    got = index.top("carrier screening", p, 5)
    assert 0 < got.ranked < 0.5 * got.blocks
    # The driver holds few bounds, or none.
    monkeypatch.setattr(postings, "KNOWN", 10)
    again = index.top("carrier screening", p, 5)
    assert (again.blocks, again.ranked) == (got.blocks, got.ranked) and found(again.rows) == found(got.rows)


def test_only_the_lexemes_folders_are_read(spark, filed):
    _, index = filed
    every = index.segments.rows(index.schema()).inputFiles()
    some = index.rows_of(["gene"]).inputFiles()
    assert len({f.rsplit("/", 2)[-2] for f in some}) == 1 and len(some) < 0.3 * len(every)


def test_bounds_hold(spark, filed):
    """No passage scores more than its block's bound."""
    p, index = filed
    for query in QUERIES:
        asked = postings.KINDS[index.kind](query)
        if not asked.words:
            continue
        size = F.length(F.bin(F.length("text").cast("long"))).cast("int")
        scored = index._scored(p, index.ranks(asked), asked).withColumn("size", size)
        blocks = index.bounds(asked).withColumn("size", F.floor(F.col("part") / postings._PARTS).cast("int")).groupBy("nbk_id", "size").agg(F.max("bound").alias("bound"))
        joined = scored.join(blocks, ["nbk_id", "size"], "left")
        assert joined.filter("bound is null or lexical_rank > bound + 1e-6").count() == 0


def test_segments(spark, tmp_path):
    rows = made(3, 120)
    first, second = frame(spark, rows[:100]), frame(spark, [(*r[:4], "surgery surgery fresh", *r[5:]) for r in rows[90:]])
    index = postings.created(spark, str(tmp_path / "i"), block=8, buckets=4)
    assert index.top("surgery", first, 10).rows.count() == 0
    assert index.segments.missing(first).count() == 100
    assert index.add(first, batch=0) and not index.add(first, batch=0)
    assert index.add(second, batch=1) and not index.add(second, batch=1)
    gone = first.limit(5).select("nbk_id", "passage_id")
    lost = {tuple(r) for r in gone.collect()}
    assert index.segments.missing(second).count() == 0 and index.segments.missing(frame(spark, rows[100:] + [("N9", "no", *rows[0][2:])])).count() == 1
    assert index.segments.remove(gone, batch=2) and not index.segments.remove(gone, batch=2)
    now = [r for r in rows[:90] if r[:2] not in lost] + [(*r[:4], "surgery surgery fresh", *r[5:]) for r in rows[90:] if r[:2] not in lost]
    now += [] if lost <= {r[:2] for r in rows[:100]} else [None]
    p = frame(spark, now).cache()
    want = full(p, p, "surgery imaging", 50, "english")
    assert found(index.top("surgery imaging", p, 50).rows) == want
    index.compact()
    assert len(index.segments.marks()) == 1 and not index.add(second, batch=1)
    assert found(postings.opened(spark, index.root).top("surgery imaging", p, 50).rows) == want
    # Comes back.
    assert index.add(frame(spark, [r for r in rows if r[:2] in lost]), batch=3)
    p = frame(spark, now + [r for r in rows if r[:2] in lost]).cache()
    assert found(index.top("surgery imaging", p, 50).rows) == full(p, p, "surgery imaging", 50, "english")


def test_odd_passages(spark, tmp_path):
    index = postings.created(spark, str(tmp_path / "i"), buckets=4)
    rows = [("N1", "a", "summary", "evidence", None, [], [], None), ("N1", "a", "summary", "evidence", "gene", [], [], None), (None, "b", "summary", "evidence", "gene", [], [], None), ("N1", "c", "summary", "evidence", "", [], [], None), ("N1", "d", "other", "evidence", "gene " * 50_000, [], [], None)]
    p = frame(spark, rows)
    index.add(p)
    assert {(r[0], r[1]) for r in found(index.top("gene", p, 10).rows)} == {("N1", "a"), ("N1", "d")}
    with pytest.raises(ValueError):
        postings.created(spark, str(tmp_path / "x"), kind="german")


@pytest.mark.parametrize("f", [search.Filters(), search.Filters(gene="G1"), search.Filters(sections=("management",)), search.Filters(nbk_id="N0", heading="top")])
def test_search_with_a_stored_index(spark, filed, f):
    p, index = filed
    v = spark.createDataFrame([(r.nbk_id, r.passage_id, [float(k % 7), 1.0]) for k, r in enumerate(p.select("nbk_id", "passage_id").limit(40).collect())], "nbk_id string, passage_id string, embedding array<float>")
    for mode in ("rrf", "lexical"):
        plain = None if index.kind == "plain" else search.postings(p)
        want = search.search(p, v, "carrier screening", [1.0, 0.5], filters=f, mode=mode, index=plain).collect()
        got = search.search(p, v, "carrier screening", [1.0, 0.5], filters=f, mode=mode, index=index).collect()
        assert [(r.position, r.nbk_id, r.passage_id) for r in got] == [(r.position, r.nbk_id, r.passage_id) for r in want]


def test_stream(spark, tmp_path):
    """A stream's passages are indexed batch by batch; started again from nothing, the same batches add nothing."""
    from tessella import streaming

    rows = made(5, 60)
    for k in range(3):
        frame(spark, rows[20 * k : 20 * k + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    p = frame(spark, rows)
    index = postings.created(spark, str(tmp_path / "i"), buckets=4)
    stream = lambda: spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for at in ("a", "b"):
        q = streaming.index_passages(stream(), index, str(tmp_path / at))
        q.awaitTermination()
        assert len(index.segments.marks()) == 3
    assert found(index.top("surgery", p, 50).rows) == full(p, p, "surgery", 50, "english")


def test_registered_query(spark):
    p = passages(spark, DATA)
    want = [r[:] for r in catalogue.queries()["hybrid_search_rrf"](spark, DATA).orderBy("position").collect()]
    assert [r[:] for r in catalogue.queries()["indexed_hybrid_rrf"](spark, DATA).orderBy("position").collect()] == want and p.count()
