"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessella-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written in the shared checkpoint folder, to cut lineage and to be read several times.

    Used as a context, it deletes them at its end, but for those that were put to stay: results that are
    handed out read these. What a write has shuffled is deleted as soon as it is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.most = spark, f"{checkpoint_dir(spark).rstrip('/')}/tessella-{uuid4().hex}", 0
        self.gone: list[str] = []

    def put(self, df: DataFrame, stay: bool = False) -> DataFrame:
        self.most += 1
        path = f"{self.at}/{self.most}"
        if not stay:
            self.gone.append(path)
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            self.spark.conf.set(_CLEANUP, "true")
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before) if before is not None else self.spark.conf.unset(_CLEANUP)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.gone:
            deleted(self.spark, path)
        self.gone = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a small key and value up to which a table is sent to every task: a few MB.
FEW = 100_000


def few(values: DataFrame) -> DataFrame:
    """A stored table that holds each join key once, marked to be sent to every task if it is small.

    It is counted first. A small one then meets all rows where they are, whatever the keys' shares of the
    rows; beyond that both sides are dealt out raw, so that an adaptive plan can split very frequent keys.
    """
    return F.broadcast(values) if values.count() <= FEW else values


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` but those that clash with an operator's own results."""
    own = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in own]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches so that the texts of a piece take about ``most`` bytes (one longer text stands alone).

    Yields each piece with the column's values as UTF-8 ``bytes`` (or None).
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        start, size, held = 0, 0, []
        for i, text in enumerate(texts):
            value = text.as_py()
            n = len(value) if value is not None else 0
            if held and size + n > most:
                yield batch.slice(start, i - start), held
                start, size, held = i, 0, []
            held.append(value)
            size += n
        if held:
            yield batch.slice(start), held


def extended(batch: pa.RecordBatch, columns: list[str], values: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch followed by new ones."""
    arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
    return pa.RecordBatch.from_arrays([*arrays, *values.values()], names=[*columns, *values])


_HELD: dict = {}


def held(name, make):
    """What a Python worker keeps from task to task: one operator's state, dropped when another operator comes.

    Workers are reused, so that memos of several operators would add up in them.
    """
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


#: 64-bit words of a bitmap, whatever the input: 1 MB.
WORDS = 1 << 17
#: Bytes of the longest text that a memo keeps as a key, so that its entries bound its bytes.
KEY = 64


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(w, bits): at most WORDS rows, with a bit set for every long key of a column.

    Its size is fixed, so that it may travel to every task. It spares shuffling rows that can't match;
    more keys only make it let more rows pass, and the join that follows is exact.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(key, 40), F.lit(64)).cast("int"))
    return keys.groupBy(F.pmod(F.col(key), F.lit(WORDS)).alias("w")).agg(F.bit_or(bit).alias("bits"))


def sifted(rows: DataFrame, key: str, bits: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose long key may be in a bitmap; or else those whose key surely isn't."""
    found = rows.withColumn("_w", F.pmod(F.col(key), F.lit(WORDS))).join(F.broadcast(bits.select(F.col("w").alias("_w"), F.col("bits").alias("_bits"))), "_w", "inner" if inside else "left")
    place = F.pmod(F.shiftrightunsigned(key, 40), F.lit(64)).cast("int")
    bit = F.call_function("shiftright", F.coalesce("_bits", F.lit(0).cast("long")), place).bitwiseAND(F.lit(1).cast("long"))
    return found.filter(bit == int(inside)).drop("_w", "_bits")


def may_contain(words: list[int], key: int) -> bool:
    """``sifted`` for one key, with the bitmap's words in their places."""
    return bool(words[key % WORDS] >> ((key & (1 << 64) - 1) >> 40) % 64 & 1)
