"""What the pipeline leaves in an executor's memory beside its heap."""

import corpus_pipeline as cp
import pyarrow as pa
import pytest
from llm_classes import DATA

from tessella.llm import toxicity


def sizes(docs, *_, **__):
    """The bytes of each batch that a Python worker gets."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")


@pytest.fixture
def limit(spark):
    before = spark.conf.get(cp.BATCH_LIMIT, None)
    yield
    spark.conf.set(cp.BATCH_LIMIT, before) if before is not None else spark.conf.unset(cp.BATCH_LIMIT)


@pytest.mark.parametrize("name", ["toxicity", "minhash_near_dedup", "benchmark_decontamination"])
def test_short_batches(spark, documents, monkeypatch, limit, name):
    """8 MB of texts in one task: 2,000 rows, far fewer than a batch may have."""
    docs = documents([(k, f"{k} " + "ab cd " * 700) for k in range(2000)]).coalesce(1)
    for module, f in ((cp.toxicity, "clean"), (cp.nearcopies, "deduplicated"), (cp.contamination, "decontaminate")):
        monkeypatch.setattr(module, f, sizes)
    got = [r.n for r in dict(cp.STAGES)[name](spark, docs, DATA).collect()]
    assert sum(got) > 8_000_000 and max(got) < 2_000_000


def test_short_batches_of_pieces(spark, documents, monkeypatch, limit):
    seen = []
    monkeypatch.setattr(cp.pieces, "tokenized", lambda docs, _: seen.append(spark.conf.get(cp.BATCH_LIMIT)) or docs.selectExpr("doc_id", "0 as n_tokens", "'' as ids_sha256", "'' as decoded_sha256"))
    cp.encoded(spark, documents([(1, "a")]), DATA)
    assert seen == [cp.BATCH]


def test_limit_is_put_back(spark, monkeypatch, limit):
    spark.conf.set(cp.BATCH_LIMIT, "7m")
    monkeypatch.setattr(cp, "STAGES", [("one", cp.in_short_batches(lambda spark, docs, _: docs.select("doc_id")))])
    assert cp.run(spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert spark.conf.get(cp.BATCH_LIMIT) == "7m"


def test_fit_sends_no_lists(spark, monkeypatch):
    """A table made of a Python list starts workers of another kind, which then lie idle."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))

    def refused(*_, **__):
        raise AssertionError("a table from a list")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert toxicity.fit(docs, labels) is not None
