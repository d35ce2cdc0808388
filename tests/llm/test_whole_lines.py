"""Op 5 on very long lines."""

from pyspark.sql import functions as F
from test_lines import check

from tessella.llm import lines


def test_group_of_long_lines(documents, make):
    """Lines of 50,000 characters, more of them under one key than are expanded into pairs."""
    base = make(12_000)[:50_000]
    rows = [base[:100] + c + base[101:] for c in "0123456789ABCDEFGHIJ"]
    longer = [base[:49_990] + c + base[49_990:] for c in "0123456789ABCDEFGHIJ"]
    apart = [base[:200] + c + base[201:300] + c + base[301:] for c in "0123456789ABCDEFGHIJ"]
    check(documents, list(enumerate([base, *rows, *longer, *apart])))


def test_crowds_at_each_cut(documents, make):
    """A crowd of lines that goes down to single characters in some places and not in others."""
    base = make(90)
    n = len(base)
    every = [base[:k] + c + base[k + 1 :] for k in (0, n // 3, n - 1) for c in "0123456789ABCDEFGHIJ"]
    every += [base[:k] + c + base[k:] for k in (0, n // 3, n) for c in "0123456789ABCDEFGHIJ"]
    every += [base[:k] + "##" + base[k + 2 :] for k in range(0, n - 2, 7)]
    check(documents, list(enumerate(every)))


def test_distance_of_very_long_lines(spark):
    df = spark.range(1).select(F.expr("repeat('ab', 2500000)").alias("x"))
    got = df.select(lines.within(F.concat(F.lit("y"), "x"), F.concat(F.lit("z"), "x")), lines.within(F.concat(F.lit("yy"), "x"), F.concat(F.lit("zz"), "x"))).first()
    assert tuple(got) == (True, False)
