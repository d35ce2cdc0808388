"""Bounded groups of sorted rows inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one side of a block pair.
BLOCK = 256


def in_block_pairs(rows: DataFrame, key: str, member: str, size: str, block: int = BLOCK) -> DataFrame:
    """Rows of groups (``key``, of ``size`` rows), dealt so that any two rows of a group meet in one piece.

    A group of up to ``block`` rows is one piece. A larger one is cut by a hash of ``member`` into
    blocks; each two blocks are a piece (``_i``, ``_j``), so that a piece has about two blocks of rows.
    Rows come sorted by piece, with their own block in ``_b``.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    out = rows.withColumn("_n", n).withColumn("_b", F.pmod(F.xxhash64(member), F.col("_n")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    out = out.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_n", "_o")
    return out.repartition(F.col(key), F.col("_i"), F.col("_j")).sortWithinPartitions(key, "_i", "_j")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys (integers) that follow each other."""
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if pending and first != last:
            yield pa.Table.from_batches(pending)
            pending = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin and pending:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(begin, end - begin))
        last = tuple(c[-1] for c in columns)
    if pending:
        yield pa.Table.from_batches(pending)


class Forest:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def whole(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The same rows in tables that cut no group of equal keys; a table is about a batch."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        at = pa.concat_tables(held)
        columns = [at.column(k).to_numpy() for k in keys]
        last = np.ones(at.num_rows, bool)
        for c in columns:
            last &= c == c[-1]
        cut = at.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield at.slice(0, cut)
        held = [at.slice(cut)]
    if held and held[-1].num_rows:
        yield pa.concat_tables(held)
