"""Op 11: exact duplicates by content, against groups made in Python, and its SQL."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from tessella.llm import exactcopies, sql
from tessella.llm.queries import op11_exact_dedup

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def expected(rows):
    """(doc_id, keep_id, group_size, sha) of each row, and how many stay of each group."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    least = {t: min((i is None, i or 0) for i in ids) for t, ids in groups.items()}
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    return sorted(((i, None if least[normal(t)][0] else least[normal(t)][1], len(groups[normal(t)]), sha[normal(t)]) for i, t in rows), key=repr)


def check(spark, rows):
    got = exactcopies.copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in got})


ODD = [
    (1, "a  b"), (2, "a b"), (3, "a\tb"), (4, "a\n \r\x0b\x0cb"), (5, "a b"), (6, " a b"), (7, "a b "), (8, None), (9, ""), (10, " "), (11, "\t\n"), (12, "A b"), (13, "é"), (14, "é"), (15, "\U0001f600"),
    (None, "a b"), (None, "only null"), (None, "only null"), (2, "a b"), (-5, "twice"), (-5, "twice"), (-5, "twice"),
]


def test_odd_rows(spark):
    check(spark, ODD)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exactcopies.copies(df).count() == 0 and exactcopies.deduplicated(df).count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_large_groups_over_many_ranges(spark, make, ranges):
    """One text is two thirds of all rows, others share their first characters; ids come in no order."""
    r = random.Random(ranges)
    hot, head = make(30), make(40)
    rows = [hot] * 400 + [head + f" {k % 60}" for k in range(150)] + [make(3) for _ in range(50)] + [None] * 9
    ids = list(range(len(rows)))
    r.shuffle(ids)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        check(spark, list(zip(ids, rows, strict=True)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_texts_of_one_hash(spark, monkeypatch):
    """Even if all hashes and first characters were alike, whole texts decide: runs of both texts in every range."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 9)
        check(spark, [(k, "x" * 100 + "ab"[k % 2]) for k in range(120)] + [(200 + k, "x" * 100 + f"c{k}") for k in range(5)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_very_long_texts(spark):
    long = "word " * 600_000
    check(spark, [(3, long), (1, long.replace(" ", "\n")), (2, long + "x"), (4, long[:-1])])


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(2, "a  b", 1, "x"), (1, "a b", 2, "y"), (3, None, 3, None), (4, "", 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, run int, D string")
    got = exactcopies.deduplicated(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "a b", 2, "y"), (3, None, 3, None)]
    assert sorted(r.doc_id for r in exactcopies.copies(df).filter("kept").collect()) == [1, 3]


def test_the_sql(spark, tmp_path):
    """Query and SQL over the same odd rows."""
    spark.createDataFrame([r for k, r in enumerate(ODD) if r[0] is not None and k < 18], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    documents = duckdb.sql(f"SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")  # noqa: F841
    want = duckdb.sql(sql.COPIES).fetchall()
    assert sorted(map(tuple, op11_exact_dedup(spark, str(tmp_path)).collect())) == sorted(want)


def test_query(spark):
    documents = duckdb.sql(f"SELECT * FROM '{DATA}/documents.parquet'")  # noqa: F841
    assert sorted(map(tuple, op11_exact_dedup(spark, DATA).collect())) == sorted(duckdb.sql(sql.COPIES).fetchall())
