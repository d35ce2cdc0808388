"""Token windows of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 510, 50


def starts(n: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """First tokens (from 0) of the windows of a text of n tokens; one window if it fits, the last ends with the text."""
    if overlap >= size:
        raise ValueError("the overlap has to be smaller than the window")
    step = size - overlap
    last = F.ceil((n - size) / F.lit(float(step))).cast("int") * step
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(step)))


def chunked(rows: DataFrame, tokens: str, *, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row for each window of an array of tokens: chunk, first (from 0), window (tokens)."""
    n = F.size(tokens)
    out = rows.select("*", F.posexplode(starts(n, size, overlap)).alias("chunk", "first"))
    return out.withColumn("window", F.slice(tokens, F.col("first") + 1, size))
