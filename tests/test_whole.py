"""Registered queries that rank every document."""

from tessella.functions import lexical
from tessella.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_cover_density_ranks_every_document(spark):
    query = lexical.parse('"that thing" with -idiot')
    want = {r.doc_id: lexical.rank(query, lexical.lexemes(r.text)) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: (r.phrase, r.strict, r.recall, r.overlap) for r in catalogue.queries()["cover_density"](spark, DATA).collect()}
    assert got == want
