"""Product codes of vectors by Lloyd's rounds in whole numbers, pruned by Elkan's bounds.

A vector is cut into parts, each with a codebook of its own. A row keeps, from round to round, the entry
of each part, an upper bound of the distance to it and a lower bound of the distance to every entry. When
entries have moved, bounds are shifted by as much. An entry is left out of a comparison only if a bound
says that it is farther away than the own one, strictly; all that is left is compared by squared distances
in 64-bit integers, so that ties go to the lower index. Bounds are rounded outwards to 16 bits.

Rounds are written tables. A round's sums come from partial sums of batches that stand in the same table;
only codebooks pass the driver: entries x dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, deleted, few

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole-numbered components go up to this, so that squared distances of vectors of up to 4,096 dimensions fit 64 bits.
MOST = 1 << 24
#: Components that are compared at a time.
VALUES = 1 << 19
#: What rounding in double precision may add to a bound, relatively.
SLACK = 2.0**-40


def up(x: np.ndarray) -> np.ndarray:
    """Upper bounds in 16 bits."""
    x = x * (1 + SLACK)
    with np.errstate(over="ignore"):
        out = x.astype(np.float16)
        return np.where(out < x, np.nextafter(out, np.float16(np.inf)), out)


def down(x: np.ndarray) -> np.ndarray:
    """Lower bounds in 16 bits, of 0 at least."""
    x = np.maximum(x * (1 - SLACK), 0)
    with np.errstate(over="ignore"):
        out = x.astype(np.float16)
    return np.where(out > x, np.nextafter(out, np.float16(-np.inf)), out)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


class Assigned:
    """Entries (own) of vectors' parts with upper and lower bounds of their distances."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.own, self.upper, self.lower = own, upper, lower

    @classmethod
    def first(cls, x: np.ndarray, book: np.ndarray) -> Assigned:
        """All distances, computed: x is (rows, parts, width), the codebook (parts, entries, width)."""
        d = np.stack([squares(x, book[:, j]) for j in range(book.shape[1])], 2)
        own = d.argmin(2)
        far = np.sqrt(d.astype(np.float64))
        return cls(own.astype(np.uint8), up(np.take_along_axis(far, own[:, :, None], 2)[:, :, 0]), down(far))

    def moved(self, x: np.ndarray, book: np.ndarray, before: np.ndarray) -> int:
        """Assign to a codebook whose entries have moved since; gives the number of distances computed."""
        part = np.arange(book.shape[0])
        shift = np.sqrt(squares(book, before).astype(np.float64)) * (1 + SLACK)
        upper = self.upper.astype(np.float64) + shift[part, self.own]
        lower = np.maximum(self.lower.astype(np.float64) - shift, 0)
        half = np.sqrt(squares(book[:, :, None], book[:, None, :]).astype(np.float64)) / 2 * (1 - SLACK)
        half[:, np.arange(book.shape[1]), np.arange(book.shape[1])] = np.inf
        nearest = half.min(2)
        rows, parts = np.nonzero(upper >= nearest[part, self.own])
        own = self.own[rows, parts].astype(np.int64)
        exact = squares(x[rows, parts], book[parts, own])
        tight = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
        maybe = (tight[:, None] >= lower[rows, parts]) & (tight[:, None] >= half[parts, own])
        d = np.full(maybe.shape, np.iinfo(np.int64).max)
        at = np.arange(len(rows))
        i, j = np.nonzero(maybe)
        d[i, j] = squares(x[rows[i], parts[i]], book[parts[i], j])
        d[at, own] = exact
        low = lower[rows, parts]
        low[i, j] = np.sqrt(d[i, j].astype(np.float64))
        low[at, own] = np.sqrt(exact.astype(np.float64))
        lower[rows, parts] = low
        best = d.argmin(1)
        upper[rows, parts] = np.sqrt(d[at, best].astype(np.float64))
        self.own[rows, parts] = best
        self.upper, self.lower = up(upper), down(lower)
        return len(rows) + len(i)


def whole_numbers(parts: int, scale: int):
    """(d, g, x, n): id, label, whole-numbered components and their number; null and 0 for a vector that is dropped."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, sizes = [], []
            for value in batch.column(2):
                x = None
                if value.is_valid and len(value.values) and not len(value.values) % parts and not value.values.null_count:
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64) * scale)
                    x = x.astype("<i4") if (np.abs(x) <= MOST).all() else None
                raw.append(None if x is None else x.tobytes())
                sizes.append(0 if x is None else len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(sizes, pa.int32())], names=["d", "g", "x", "n"])

    return run


def _matrix(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1).view(np.uint8)
    return pa.array([r.tobytes() for r in flat], pa.binary())


def assign(book: np.ndarray, before: np.ndarray | None, last: bool):
    """A round: rows with their new entries and bounds, each piece's first one with the sums of the piece; or codes and errors."""
    parts, entries, width = book.shape

    def run(batches) -> Iterator[pa.RecordBatch]:
        # A piece's distances to all entries have to fit a task whatever the vectors' length.
        step = max(1, VALUES // (parts * width))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            n = batch.num_rows
            columns = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            x = _matrix(columns["x"], "<i4", parts, width).astype(np.int64)
            if before is None:
                now = Assigned.first(x, book)
            else:
                now = Assigned(_matrix(columns["a"], "u1", parts).copy(), _matrix(columns["u"], "<f2", parts), _matrix(columns["l"], "<f2", parts, entries))
                now.moved(x, book, before)
            if last:
                errors = squares(x, book[np.arange(parts), now.own]).sum(1)
                codes = pa.array([r.tobytes().hex() for r in now.own])
                yield pa.RecordBatch.from_arrays([columns["d"], columns["g"], codes, pa.array(errors)], names=["d", "g", "code", "error"])
                continue
            sums = np.zeros((parts, entries, width + 1), np.int64)
            for p in range(parts):
                np.add.at(sums[p, :, :width], now.own[:, p], x[:, p])
                sums[p, :, width] = np.bincount(now.own[:, p], minlength=entries)
            sent = pa.array([sums.ravel().tolist(), *[None] * (n - 1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([columns["d"], columns["g"], columns["x"], _binary(now.own), _binary(now.upper.astype("<f2")), _binary(now.lower.astype("<f2")), sent], names=["d", "g", "x", "a", "u", "l", "s"])

    return run


def moved_entries(book: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries as the floor of their parts' means; those without any part stay."""
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), book)


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): a row for each vector that is kept.

    Components are floor(scale * x). Codebooks start from the ``entries`` smallest ids (null ids last, then by
    components; fewer vectors, fewer entries). Dropped are vectors that are null or empty, hold null or non-finite
    components or ones whose whole number passes ``MOST``, whose length can't be cut into ``parts``, or isn't that
    of the smallest id's vector. Repeated rows and ids are vectors of their own, null labels are equal, and a
    label's error that passes 64 bits is null. No kept vector gives an empty table. Other columns aren't read, so
    that their names can't clash. A vector of any length has to fit a task.
    """
    spark = vectors.sparkSession
    ship(spark)
    kinds = {c: vectors.schema[name].dataType.simpleString() for c, name in (("d", vec_id), ("g", label))}
    with Scratch(spark) as scratch:
        data = scratch.put(vectors.select(F.col(vec_id).alias("d"), F.col(label).alias("g"), F.col(embedding).alias("e")).mapInArrow(whole_numbers(parts, scale), f"d {kinds['d']}, g {kinds['g']}, x binary, n int"))
        order = [F.asc_nulls_last("d"), F.col("x")]
        some = data.filter("n > 0").orderBy(*order).limit(1).collect()
        size = some[0]["n"] if some else parts
        rows = data.filter(F.col("n") == size).select("d", "g", "x")
        start = [np.frombuffer(r["x"], "<i4") for r in rows.orderBy(*order).limit(entries).collect()]
        book = np.array(start, np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2)
        if not start:
            book, rounds = np.zeros((parts, 1, size // parts), np.int64), 0
        before, kept = None, None
        for _ in range(rounds):
            rows = scratch.put(rows.mapInArrow(assign(book, before, False), f"d {kinds['d']}, g {kinds['g']}, x binary, a binary, u binary, l binary, s array<long>"))
            if kept:  # the round before
                scratch.gone.remove(kept)
                deleted(spark, kept)
            kept = scratch.gone[-1]
            sums = np.zeros(parts * book.shape[1] * (size // parts + 1), np.int64)
            for r in rows.filter("s is not null").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
                sums[r["i"]] = r["v"]
            before, book = book, moved_entries(book, sums.reshape(parts, book.shape[1], -1))
            rows = rows.drop("s")
        coded = scratch.put(rows.mapInArrow(assign(book, before, True), f"d {kinds['d']}, g {kinds['g']}, code string, error long"), stay=True)
        errors = few(scratch.put(coded.groupBy("g").agg(F.try_sum("error").alias("label_error")), stay=True)).withColumnRenamed("g", "_g")
    out = coded.join(errors, coded["g"].eqNullSafe(errors["_g"]))
    return out.select(F.col("d").alias(vec_id), "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
