"""Incremental use: passages that arrive get vectors as they come.

The engine's jobs are batches; a stream of new passages goes through the same operators micro-batch by
micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.postings import Index


def backfill(stream: DataFrame, done: Callable[[], DataFrame], encode: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Append vectors of streamed passages (nbk_id, passage_id, text) that have none yet; returns the running query."""

    def each(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["nbk_id", "passage_id"]).join(done().select("nbk_id", "passage_id"), ["nbk_id", "passage_id"], "left_anti")
        encode(new).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_passages(stream: DataFrame, index: Index, checkpoint: str):
    """Index streamed passages, a segment for each micro-batch; returns the running query.

    Nothing stored is read again: a passage that is there already is replaced by the later segment. A micro-batch that is
    run again after a failure finds its number in the index and adds nothing. Compact the index from time to time.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            index.add(batch, batch=number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_vectors(stream: DataFrame, encode: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Append vectors of streamed passages (nbk_id, passage_id, text), the first of each key; returns the running query.

    Keys seen before are kept as the stream's state, so that no stored vector is read. A micro-batch writes its own folder,
    which a replay overwrites.
    """

    def each(batch: DataFrame, number: int) -> None:
        encode(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    fresh = stream.dropDuplicates(["nbk_id", "passage_id"])
    return fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
