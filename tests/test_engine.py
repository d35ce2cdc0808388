"""Functions, search, lookups and evaluation on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import expr as E
from tessella.functions import lexical, python
from tessella.operators import chunks, evaluate, lookups, quality, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("title", "section"), [("Summary", "summary"), ("Differential Diagnosis", "clinical_features"), ("Establishing the Diagnosis", "diagnosis"), ("Therapy", "management"), ("", "other"), (None, "other")])
def test_canonical_section(spark, title, section):
    assert one(spark, E.canonical_section(F.lit(title).cast("string"))) == section


def test_roles(spark):
    rows = [("See X for details.", "A > Related", "narrative", None, "cross_reference"), ("Étude: a word", "A", "narrative", None, "definition"), ("Foo is a synonym of bar", "A > Nomenclature", "narrative", None, "definition"), ("Plain text.", "A", "narrative", None, "evidence"), ("Cap", "T", "table", "Cap", "table_caption"), ("x" * 400, "T", "table", "Cap", "table_body")]
    df = spark.createDataFrame([(t, p, k, c, len(t), w) for t, p, k, c, w in rows], "text string, path string, kind string, caption string, n int, want string")
    out = df.select("want", E.passage_role("text", "path", "kind", "n", F.col("caption")).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_excerpt(spark):
    assert one(spark, E.leading_excerpt(F.lit(" \n short\t"), 10)) == "short"
    assert one(spark, E.leading_excerpt(F.lit("several words that go on"), 15)) == "several words…"
    assert one(spark, E.leading_excerpt(F.lit("unbrokenunbrokenunbroken"), 10)) == "unbrokenun…"


def test_overlap_matches_a_loop(spark):
    base = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(900))
    parts = [base[k : k + 200] for k in range(0, 900, 150)]

    def loop(items):
        out, last = items[0], items[0]
        for nxt in items[1:]:
            k = next((n for n in range(min(len(last), len(nxt)), 29, -1) if last[-n:] == nxt[:n]), 0)
            last = nxt[k:]
            out += last
        return out

    got = one(spark, E.without_overlap(F.array(*[F.lit(p) for p in parts])))
    assert got == loop(parts)
    assert one(spark, E.without_overlap(F.array().cast("array<string>"))) == ""


def test_table_budget(spark):
    text = "\n".join(["cap", "", "| h |", "| - |", *["| " + "x" * 96 + " |"] * 40])
    got = one(spark, E.table_for_embedding(F.lit(text)))
    assert got.startswith("cap\n\n| h |\n| - |") and len(got) < len(text)
    assert one(spark, E.table_for_embedding(F.lit("short"))) == "short"


def test_markdown(spark):
    rows = F.array(F.array(F.lit("1"), F.lit("2")))
    assert one(spark, E.markdown_table(F.lit("C"), F.array(F.lit("a"), F.lit("b")), rows, F.lit("n"))) == "C\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nn"
    assert one(spark, E.markdown_table(F.lit("C"), F.array(F.lit("a")), rows, F.lit(""))) is None


def test_reference_and_dates(spark):
    r = one(spark, E.reference_fields(F.lit("Smith J, Doe A. A title of some length. Nature Genetics. 2019;3:1. PMID: 123")))
    assert (r.pmid, r.year, r.authors, r.title) == ("123", "2019", "Smith J, Doe A", "A title of some length")
    assert one(spark, E.date_of(F.lit("2020"), F.lit(2), F.lit(30))) is None
    assert one(spark, E.date_of(F.lit("2020"), F.lit(None).cast("int"), F.lit(None).cast("int"))) == datetime.date(2020, 1, 1)
    assert one(spark, E.stale_for_therapy(F.lit("stale"), F.array(F.struct(F.lit("management").alias("section"), F.lit(1).alias("passage_count")))))


def test_cosine_of_zero_is_null(spark):
    z = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, E.cosine(z, z)) is None


def corpus(spark):
    rows = [
        ("NBK1", "NBK1:0000", "summary", "evidence", "surveillance of carriers", 0),
        ("NBK1", "NBK1:0001", "management", "evidence", "surveillance of carriers by annual imaging of carriers", 1),
        ("NBK1", "NBK1:0002", "references", "evidence", "surveillance surveillance surveillance carriers", 2),
        ("NBK2", "NBK2:0000", "management", "cross_reference", "imaging", 0),
        ("NBK2", "NBK2:0001", "management", "evidence", "nothing of it", 1),
    ]
    p = spark.createDataFrame(rows, "nbk_id string, passage_id string, chapter_section string, passage_role string, text string, chunk_index int")
    p = p.withColumn("char_count", F.length("text")).withColumn("heading_path", F.col("chapter_section"))
    p = p.withColumn("gene_symbols", F.array(F.col("nbk_id"), F.lit("G"))).withColumn("primary_gene_symbols", F.array("nbk_id"))
    v = spark.createDataFrame([(r[1], [1.0, float(k)]) for k, r in enumerate(rows)] + [("gone", [1.0, 1.0])], "passage_id string, embedding array<float>")
    return p, v


def test_fusion_order(spark):
    p, v = corpus(spark)
    out = search.search(p, v, "surveillance of carriers", [1.0, 0.0], limit=10).collect()
    assert [r.position for r in out] == [1, 2, 3, 4, 5]
    assert out[-1].chapter_section == "references"  # guarded, though it has the best lexical rank
    assert out[-1].dense_position is None and out[-1].rrf_score is None
    by = {r.passage_id: r for r in out}
    assert by["NBK2:0001"].lexical_rank == 0 and by["NBK2:0001"].rrf_score is not None  # found by the vector alone
    assert by["NBK2:0000"].adjusted_score == pytest.approx(by["NBK2:0000"].rrf_score * 0.4 * 1.3)  # management intent
    assert by["NBK1:0000"].rrf_score == pytest.approx(1 / (60 + by["NBK1:0000"].lexical_position) + 1 / 61)


def test_modes_and_fallbacks(spark):
    p, v = corpus(spark)
    lexical_only = search.search(p, v.limit(0), "surveillance of carriers", [1.0, 0.0])
    assert [r.passage_id for r in lexical_only.collect()][0] == "NBK1:0002"
    assert search.search(p, v, "of it", [1.0, 0.0], mode="lexical").count() == 0  # no recall term
    assert search.search(p, v, "of it", [1.0, 0.0]).count() == 5
    with pytest.raises(ValueError, match="mode"):
        search.search(p, v, "x", [1.0], mode="best")
    assert search.shaped(lexical_only, "ids_only").columns[:2] == ["position", "passage_id"]


def test_filters_do_not_leak(spark):
    p, v = corpus(spark)
    f = search.Filters(gene="NBK2", gene_role="primary", sections=("management",), heading="MANAGE")
    assert {r.nbk_id for r in search.search(p, v, "imaging of carriers", [1.0, 0.0], filters=f).collect()} == {"NBK2"}
    assert search.Filters(gene="NBK2", gene_role="mentioned").apply(p).count() == 0
    assert search.Filters(heading="100%\\_").apply(p).count() == 0
    assert search.suggestions("x " * 9, search.Filters(gene="A", sections=("s",), nbk_id="n"), 0, 50) == ["gene-filter-drops-all", "broaden-query", "section-filter-drops-all", "nbk-id-filter-drops-all"]


def test_lexical_parts():
    q = lexical.parse('"annual imaging" carriers -excluded')
    assert q.required == [["annual", lexical.stem("imaging")], ["carrier"]] and q.excluded == [["exclud"]]
    near = lexical.rank(q, lexical.lexemes("annual imaging of carriers"))
    far = lexical.rank(q, lexical.lexemes("annual imaging " + "word " * 20 + "carriers"))
    assert near[1] > far[1] > 0
    assert lexical.rank(q, lexical.lexemes("annual imaging of excluded carriers"))[1] == 0
    assert lexical.stem("carriers") == lexical.stem("carrier") and lexical.stem("screening") == lexical.stem("screened")
    assert "**carriers**" in lexical.headline("the screening of carriers is advised", {"carrier"})
    assert lexical.snippet_limits(300) == (1, 42)


def test_python_helpers():
    v = python.made_vector("abc", 40)
    assert len(v) == 40 and all(-1 <= x <= 1 for x in v) and v == python.made_vector("abc", 40)
    assert python.ratio("abcd", "abcf") == 75.0 and python.closeness("BRCA1", "BRCA2") == 80.0


def test_lookups(spark):
    p, _ = corpus(spark)
    got = lookups.by_ids(p, ["NBK2:0000", "x", "NBK2:0000"]).orderBy("position").collect()
    assert [r.missing for r in got] == [False, True, False]
    w = {r.passage_id: r for r in lookups.windows(p, 1, 1, section=None).collect()}
    assert w["NBK1:0001"].before == ["NBK1:0000"] and w["NBK1:0000"].has_more_after and not w["NBK1:0002"].has_more_after
    assert lookups.outline(p).filter("nbk_id = 'NBK2' and chapter_section = 'management'").first().passage_count == 2
    assert lookups.outline(p).count() == 18
    assert lookups.matched_sections(["management", "diagnosis"], "rx, diagnosys") == ["management", "diagnosis"]
    c = spark.createDataFrame([("a", "An overview", ["X", "Y"], [], None), ("b", "The X disorder", ["X", "Z"], [], datetime.date(2020, 1, 1)), ("c", None, ["Q"], [], None)], "nbk_id string, title string, gene_symbols array<string>, primary_gene_symbols array<string>, last_updated_date date")
    assert {r.symbol: r.nbk_id for r in lookups.defining(c).collect()} == {"X": "b", "Q": "c"}


def test_chunks(spark):
    for n in (0, 1, 510, 511, 970, 971, 3000):
        ids = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("t") if n else F.array().cast("array<int>").alias("t"))
        got = chunks.chunked(ids, "t").collect()
        want, k = [], 0
        while n:
            want.append((k, min(k + 510, n)))
            if k + 510 >= n:
                break
            k += 460
        assert [(r["first"], r["first"] + len(r.window)) for r in got] == want
    with pytest.raises(ValueError, match="overlap"):
        chunks.starts(F.lit(3), 5, 5)


def test_quality(spark):
    a = spark.createDataFrame([("x", 100, 60, 10, 10, 0), ("y", 0, 0, 0, 0, 0)], "nbk_id string, body_text_chars long, captured_text_chars long, structural_chars long, skipped_chars long, unknown_chars long")
    assert [round(r.unaccounted_ratio, 2) for r in quality.ledger(a).orderBy("nbk_id").collect()] == [0.2, 0.0]
    assert quality.key_faults(spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int"), ["k"]).count() == 2
    assert quality.outside_domain(a, "nbk_id", ["x"]).first().nbk_id == "y"


def test_strata_of_few(spark):
    few = spark.createDataFrame([(k, datetime.date(2020, 1, 1 + k)) for k in range(3)], "k int, d date")
    assert {r.bucket for r in evaluate.strata(few, "d", "k").collect()} == {"newest_q"}
