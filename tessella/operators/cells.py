"""A stored index of vectors: a trained coarse quantiser, vectors filed by cell, and scans of the nearest cells.

Cells are clusters by cosine, trained by Spark's k-means on a bounded sample; every vector is filed under its
nearest one, in a folder of its own. A search reads the cells whose centres are nearest to the query, at first
``share`` of them, then twice as many each time; each step reads only cells that weren't read before. It ends when
K (filtered) vectors are found of which ``steady`` were found a step before already, or when all cells are read: where
vectors form clusters that is soon, where they have no structure, or where a filter leaves few, late. Scores are exact
cosines; what can be missing are vectors of cells that weren't read. ``exact`` reads all cells.

Vectors come in segments (see ``segments``), filed by the cells that were trained once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as E
from .files import read_text, write_text
from .segments import KEY, Segments

#: Vectors that cells are trained on for each cell, and all in all at most; rounds of training.
SAMPLE, MOST, ROUNDS = 256, 1 << 18, 10
#: Cells that the nearest ones are chosen from at most, and the share of them that is read at first.
CELLS, SHARE = 4096, 0.04
#: Share of the K best that have to stay when twice as many cells are read.
STEADY = 0.98
#: Vectors that a search may ask for; so many rows pass the driver.
ASKED = 10_000


def cells_for(n: int) -> int:
    """Cells for n vectors: about the square root of it, 32 at least."""
    return int(min(CELLS, max(32, round(math.sqrt(n)))))


@dataclass
class Near:
    """The nearest vectors, and of how many cells how many were read."""

    rows: DataFrame
    cells: int
    read: int


class Cells:
    """The vectors under a folder that all executors share; open one with ``opened``, train one with ``trained``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.segments, self._schema = Segments(spark, root, "vectors"), None
        # As many as cells: bounded by CELLS.
        self.centres = np.array(KMeansModel.load(f"{self.root}/cells").clusterCenters())

    def add(self, vectors: DataFrame, *, batch: int | None = None) -> bool:
        """File vectors (nbk_id, passage_id, embedding) as a new segment; False if the batch is there already.

        Of rows with the same key the greatest embedding counts; later segments take the place of earlier ones. Vectors that are
        null, zero, of another length, or hold null or non-finite components have no cosine and are left out.
        """
        if self.segments.has(batch):
            return False
        number = self.segments.next()
        rows = _sound(vectors, len(self.centres[0])).groupBy(*KEY).agg(F.max("embedding").alias("embedding"))
        model = KMeansModel.load(f"{self.root}/cells").setFeaturesCol("_v").setPredictionCol("cell")
        filed = model.transform(rows.withColumn("_v", array_to_vector("embedding"))).drop("_v")
        # A large cell is dealt to several tasks and files.
        dealt = filed.repartitionByRange("cell", F.xxhash64(*KEY)).sortWithinPartitions("cell", *KEY)
        at = f"{self.root}/vectors/segment={number}"
        dealt.write.mode("overwrite").partitionBy("cell").parquet(at)
        self.segments.write_keys(self.spark.read.parquet(at), number)
        self.segments.mark(number, [batch] if batch is not None else [], sizes={str(r["cell"]): r["n"] for r in self.spark.read.parquet(at).groupBy("cell").agg(F.count("*").alias("n")).collect()})
        return True

    def compact(self) -> None:
        """One segment of all that is visible takes the place of the segments."""
        marks = self.segments.marks()
        if len(marks) > 1:
            number = self.segments.next()
            rows = self.segments.alive(self.segments.rows(self.schema())).select(*KEY, "embedding", "cell")
            at = f"{self.root}/vectors/segment={number}"
            rows.repartitionByRange("cell", F.xxhash64(*KEY)).sortWithinPartitions("cell", *KEY).write.mode("overwrite").partitionBy("cell").parquet(at)
            self.segments.write_keys(self.spark.read.parquet(at), number)
            sizes = {str(r["cell"]): r["n"] for r in self.spark.read.parquet(at).groupBy("cell").agg(F.count("*").alias("n")).collect()}
            self.segments.replace(number, marks, sizes=sizes)

    def schema(self) -> T.StructType:
        if self._schema is None:
            own = self.spark.read.parquet(f"{self.root}/vectors/segment={self.segments.filled()[0]}").schema
            self._schema = T.StructType([*[own[c] for c in (*KEY, "embedding")], T.StructField("segment", T.IntegerType()), T.StructField("cell", T.IntegerType())])
        return self._schema

    def rows_of(self, cells: Sequence[int]) -> DataFrame:
        """The live vectors of some cells; no other folder is opened."""
        return self.segments.alive(self.segments.rows(self.schema(), [f"cell={c}" for c in cells]))

    def order(self, query: Sequence[float]) -> list[int]:
        """All cells, nearest first; those that hold nothing are left out."""
        q = np.asarray(query, np.float64)
        held = {int(c) for m in self.segments.marks() for c in m.get("sizes", {})}
        size = np.linalg.norm(self.centres, axis=1) * max(float(np.linalg.norm(q)), 1e-300)
        near = np.argsort(-(self.centres @ q) / np.maximum(size, 1e-300), kind="stable")
        return [int(c) for c in near if int(c) in held]

    def top(self, query: Sequence[float], k: int, *, within: DataFrame | None = None, share: float = SHARE, steady: float = STEADY, exact: bool = False) -> Near:
        """(nbk_id, passage_id, dense_score) of the ``k`` nearest, ties by passage; ``within`` (nbk_id, passage_id) has the filtered passages.

        A query without a direction, or of another length than the vectors, finds nothing.
        """
        if not 0 < k <= ASKED:
            raise ValueError(f"a search asks for 1 to {ASKED} vectors")
        fits = len(query) == len(self.centres[0]) and np.isfinite(query).all() and np.any(query)
        order = self.order(query) if fits and self.segments.filled() else []
        allowed = within.select(*KEY).distinct() if within is not None else None
        q = F.array(*[F.lit(float(x)) for x in query])
        best: list[tuple] = []
        read, seen = len(order) if exact else max(1, math.floor(share * len(order))), 0
        while order:
            rows = self.rows_of(order[seen:read])
            rows = rows.join(allowed, KEY, "left_semi") if allowed is not None else rows
            # Worked out once a row: an explode keeps filters above it.
            scored = rows.select(*KEY, F.explode(F.array(E.cosine("embedding", q))).alias("dense_score")).filter("dense_score is not null")
            found = {tuple(r) for r in scored.orderBy(F.desc("dense_score"), "passage_id", "nbk_id").limit(k).collect()}
            merged = sorted([*best, *found], key=lambda r: (-r[2], r[1], r[0]))[:k]
            stay = sum(r not in found for r in merged)
            best, first = merged, not seen
            if read == len(order) or not first and len(best) == k and stay >= steady * k:
                break
            seen, read = read, min(2 * read, len(order))
        kinds = {c: f.dataType for c in KEY for f in (self.schema() if self.segments.filled() else within.schema if within is not None else T.StructType()) if f.name == c}
        out = T.StructType([*[T.StructField(c, kinds.get(c, T.StringType())) for c in KEY], T.StructField("dense_score", T.DoubleType())])
        return Near(self.spark.createDataFrame(best, out), len(order), read if order else 0)


def _sound(vectors: DataFrame, size: int | None = None) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    out = vectors.filter(F.col("embedding").isNotNull() & fine & F.col("nbk_id").isNotNull() & F.col("passage_id").isNotNull())
    return out.filter(F.size("embedding") == size) if size else out


def trained(vectors: DataFrame, root: str, *, cells: int | None = None, sample: int = SAMPLE, seed: int = 20) -> Cells:
    """Train cells on a sample of vectors (at most ``sample`` a cell, ``MOST`` in all, by a hash of their keys) and file nothing yet.

    Vectors without a direction are left out of training; if none is left, that is an error.
    """
    spark = vectors.sparkSession
    rows = _sound(vectors)
    counted = rows.agg(F.count("*").alias("n"), F.mode(F.size("embedding")).alias("size")).first()
    if not counted["n"]:
        raise ValueError("no vector to train cells on")
    k = cells or cells_for(counted["n"])
    rows = rows.filter(F.size("embedding") == counted["size"])
    want = min(MOST, sample * k)
    if counted["n"] > want:
        # A little more than is wanted, by hash and without an order of all rows.
        rows = rows.filter(F.pmod(F.xxhash64(*KEY), F.lit(1 << 20)) < max(1, math.ceil((1 << 20) * want / counted["n"])))
    data = rows.select(array_to_vector("embedding").alias("_v"))
    model = KMeans(featuresCol="_v", k=k, distanceMeasure="cosine", initMode="random", maxIter=ROUNDS, seed=seed).fit(data)
    model.write().overwrite().save(f"{root.rstrip('/')}/cells")
    write_text(spark, f"{root.rstrip('/')}/cells.json", json.dumps({"cells": k}))
    return Cells(spark, root)


def opened(spark: SparkSession, root: str) -> Cells:
    json.loads(read_text(spark, f"{root.rstrip('/')}/cells.json"))
    return Cells(spark, root)
