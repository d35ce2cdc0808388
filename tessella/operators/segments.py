"""Tables that grow by segments: each visible once its mark is written, later ones over earlier ones.

A segment holds the keys (nbk_id, passage_id) of its rows, or tombstones. A reader takes a row if no later
segment has its key. A mark names the batches that a segment holds, so that a replayed batch adds nothing, and
the segments that it replaces. One writer at a time; readers see a segment whole or not at all.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import few
from .files import delete, names, read_text, write_text

KEY = ["nbk_id", "passage_id"]


class Segments:
    """The segments of the table ``data`` under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, data: str):
        self.spark, self.root, self.data = spark, root.rstrip("/"), data

    def marks(self) -> list[dict]:
        """The visible segments in their order."""
        every = [json.loads(read_text(self.spark, f"{self.root}/segments/{n}")) for n in names(self.spark, f"{self.root}/segments") if n.endswith(".json")]
        gone = {n for m in every for n in m["replaces"]}
        return sorted((m for m in every if m["segment"] not in gone), key=lambda m: m["segment"])

    def has(self, batch: int | None) -> bool:
        return batch is not None and any(batch in m["batches"] for m in self.marks())

    def next(self) -> int:
        taken = [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.root}/segments") if n.endswith(".json")]
        return max(taken, default=-1) + 1

    def write_keys(self, rows: DataFrame, number: int, *more: str) -> DataFrame:
        at = f"{self.root}/keys/segment={number}"
        rows.select(*KEY, *more).write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def mark(self, number: int, batches: list[int], replaces: list[int] = (), **more) -> None:
        write_text(self.spark, f"{self.root}/segments/{number}.json", json.dumps({"segment": number, "batches": list(batches), "replaces": list(replaces)} | more))

    def remove(self, keys: DataFrame, batch: int | None = None) -> bool:
        """Tombstones, as a segment of its own; False if the batch is there already."""
        if self.has(batch):
            return False
        number = self.next()
        self.write_keys(keys.distinct(), number)
        self.mark(number, [batch] if batch is not None else [])
        return True

    def replace(self, number: int, marks: list[dict], **more) -> None:
        """Let a segment take the place of others, which are deleted once it can be seen."""
        self.mark(number, sorted({b for m in marks for b in m["batches"]}), [m["segment"] for m in marks], **more)
        for m in marks:
            for part in (self.data, "keys"):
                delete(self.spark, f"{self.root}/{part}/segment={m['segment']}")

    def filled(self) -> list[int]:
        """Visible segments that hold rows, not tombstones only."""
        there = {int(n.removeprefix("segment=")) for n in names(self.spark, f"{self.root}/{self.data}")}
        return [m["segment"] for m in self.marks() if m["segment"] in there]

    def keys(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/keys").parquet(*[f"{self.root}/keys/segment={m['segment']}" for m in self.marks()])

    def live_keys(self, *more: str) -> DataFrame:
        paths = [f"{self.root}/keys/segment={n}" for n in self.filled()]
        return self.alive(self.spark.read.option("basePath", f"{self.root}/keys").parquet(*paths)).select(*KEY, *more)

    def missing(self, rows: DataFrame) -> DataFrame:
        """Keys of rows that no visible segment holds: what a gate on an index has to find empty."""
        wanted = rows.select(*KEY).distinct()
        return wanted.join(self.live_keys(), KEY, "left_anti") if self.filled() else wanted

    def rows(self, schema: T.StructType, folders: list[str] | None = None) -> DataFrame:
        """Rows of the visible segments with their ``segment``, replaced ones too; of some folders only, if these are named."""
        paths = [f"{self.root}/{self.data}/segment={n}" for n in self.filled()]
        if folders is not None:
            paths = [f"{p}/{f}" for p in paths for f in sorted({*folders} & {*names(self.spark, p)})]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{self.data}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def alive(self, rows: DataFrame) -> DataFrame:
        """Rows that no later segment replaces; only the keys of later segments are read."""
        later = [m["segment"] for m in self.marks()][1:]
        if not later:
            return rows
        last = self.keys().filter(F.col("segment").isin(later)).groupBy(*KEY).agg(F.max("segment").alias("_last"))
        return rows.join(few(last), KEY, "left").filter("_last is null or segment >= _last").drop("_last")
