"""Exact duplicates by sorting content.

Texts are normalised and dealt out by range: Spark samples splitters, and each range is sorted externally,
so that equal texts stand next to each other. Neighbours are compared whole. A splitter holds the first
``PREFIX`` characters of a text, a hash of all of it and the document's id, so that splitters stay small
whatever the texts, and a group that holds a large part of all rows spans as many ranges as it needs.

A range knows the groups inside it. Only those of its first and its last key can go on in another range;
these few (two keys a range) are put together by their whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch

#: Characters of a text that a splitter holds.
PREFIX = 64


def normalised(text: Column | str) -> Column:
    """Each run of white space of ASCII as one space; null as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


class Run:
    """A group of equal neighbours of one range."""

    def __init__(self, number: int, first, text: str):
        self.number, self.first, self.size, self.text = number, first, 0, text
        self.key = text[:PREFIX]


def neighbours(carry: bool):
    """From rows (x, h, d) sorted by the first characters of x, h, x and d: each row with its run, then each run.

    A row has (part, run, d, first), a run (part, run, d of its first row, size, sha) and, where it may go on in another
    range, its text (edge). With ``carry`` only first rows are given, with what else stands in their column row.
    """
    names = ["part", "run", "d", "first", "size", "sha", "edge", *["row"] * carry]

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, open_, number = TaskContext.get().partitionId(), None, -1
        waiting: list[Run] = []  # the runs of the key that was read last
        start_key, at_start, kinds = None, True, None

        def given(done: list[Run], edge: bool) -> pa.RecordBatch:
            n = len(done)
            columns = {
                "part": pa.array([part] * n, pa.int32()), "run": pa.array([r.number for r in done], pa.int64()), "d": pa.array([r.first for r in done], kinds["d"]), "first": pa.array([True] * n),
                "size": pa.array([r.size for r in done], pa.int64()), "sha": pa.array([hashlib.sha256(r.text.encode()).hexdigest() for r in done]), "edge": pa.array([r.text if edge else None for r in done], pa.string()),
            }
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[c]) for c in names], names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kinds = {f.name: f.type for f in batch.schema}
            x, h, d = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "h", "d"))
            fresh = np.ones(n, bool)
            fresh[1:] = pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = open_ is None or x[0].as_py() != open_.text
            numbers = number + np.cumsum(fresh)
            done: list[Run] = []
            starts = np.flatnonzero(fresh)
            if open_:
                open_.size += int(starts[0]) if len(starts) else n
            for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                number += 1
                new = Run(number, d[begin].as_py(), x[begin].as_py())
                new.size, new.key = end - begin, (new.key, h[begin].as_py())
                start_key = start_key or new.key
                if waiting and new.key != waiting[-1].key:
                    if at_start:
                        yield given(waiting, True)
                    else:
                        done += waiting
                    waiting, at_start = [], False
                waiting.append(new)
                open_ = new
            if done:
                yield given(done, False)
            keep = pa.array(fresh) if carry else None
            columns = {"part": pa.array(np.full(n, part, np.int32)), "run": pa.array(numbers), "d": d, "first": pa.array(fresh)}
            if carry:
                columns["row"] = batch.column(batch.schema.get_field_index("row"))
            rows = pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, {"size": pa.int64()}.get(c, pa.string())) for c in names], names=names)
            yield rows.filter(keep) if carry else rows
        if waiting:
            yield given(waiting, True)

    return run


def _found(docs: DataFrame, text: str, doc_id: str, carry: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (part, run, d, first, and row), and runs (part, run, keep_id, group_size, text_sha256, best)."""
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    own = [F.struct("*").alias("row")] if carry else []
    rows = docs.select(F.col(doc_id).alias("d"), normalised(text).alias("x"), *own)
    rows = rows.withColumn("p", F.substring("x", 1, PREFIX)).withColumn("h", F.xxhash64("x"))
    dealt = rows.repartitionByRange("p", "h", F.asc_nulls_last("d")).sortWithinPartitions("p", "h", "x", F.asc_nulls_last("d"))
    schema = f"part int, run long, d {kind}, first boolean, size long, sha string, edge string" + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else "")
    found = scratch.put(dealt.select("d", "x", "h", *["row"] * carry).mapInArrow(neighbours(carry), schema), stay=True)
    runs = found.filter("size is not null")
    inner = runs.filter("edge is null").select("part", "run", F.col("d").alias("keep_id"), F.col("size").alias("group_size"), F.col("sha").alias("text_sha256"), F.lit(True).alias("best"))
    # At most the runs of two keys a range.
    w, order = Window.partitionBy("edge"), F.struct(F.col("d").isNull(), "d", "part", "run")
    edge = runs.filter("edge is not null").withColumn("o", order).withColumn("m", F.min("o").over(w)).withColumn("s", F.sum("size").over(w))
    edge = edge.select("part", "run", F.col("m.d").alias("keep_id"), F.col("s").alias("group_size"), F.col("sha").alias("text_sha256"), (F.col("o") == F.col("m")).alias("best"))
    return found.filter("size is null").drop("size", "sha", "edge"), inner.unionByName(edge)


def copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each document.

    Texts are equal if they are the same after ``normalised``; a null text is an empty one. Of a group the
    row with the smallest id stays, null ids coming last; of rows that share it exactly one stays. Repeated
    rows and ids are rows of their own. Texts of any length are compared whole (one has to fit a task). An
    empty table gives an empty one. Other columns aren't read, so that their names can't clash.

    A row meets its run within its own range, so that a very large group is no single task's.
    """
    rows, runs = _found(docs, text, doc_id, False, Scratch(docs.sparkSession))
    out = rows.join(runs, ["part", "run"])
    # A run's first row can be its group's smallest only if its id is.
    return out.select(F.col("d").alias(doc_id), "keep_id", "group_size", (F.col("first") & F.col("best")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns as they were; cases as in ``copies``."""
    rows, runs = _found(docs, text, doc_id, True, Scratch(docs.sparkSession))
    return rows.join(runs.filter("best").select("part", "run"), ["part", "run"]).select("row.*")
