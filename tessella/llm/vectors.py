"""Near-duplicate vectors by randomly rotated binary codes.

A unit vector is padded to twice its dimensions or more, rotated at random and kept as the signs of its
coordinates, with the inner product f of the vector and its code as correction factor. <code, q> / f is an
unbiased estimate of <vector, q> for any unit q, with an error of about sqrt((1 - f^2) / f^2 / (D - 1)).
The other vector of a pair enters in 4 bits a coordinate, rounded at random. Codes, factors and 4-bit
parts are stored, and only they travel when candidates are looked for. Pairs whose estimate is more than
``EPSILON`` such errors below the threshold are left. For all others the exact vectors are fetched, and
cosines are computed again in double precision.

Pairs are looked for in buckets of sign-pattern tables (hyperplanes). The number of bits follows the
number of vectors, and the number of tables the bits, so that a pair at the threshold shares a bucket with
probability ``RECALL``, closer pairs with more. A pair counts in the first table it shares only. The signs
of at most ``SIGNS`` hyperplanes travel with a code, and every table's key is read from some of them, so
that a row has the same size however many tables there are. Large buckets are cut into blocks of which
each two meet in a piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, few
from .graph import components
from .runs import Forest, in_block_pairs, whole

LEAST, RECALL, EPSILON = 0.9, 0.999, 4.5
#: Vectors that a bucket of random ones would hold, and those of a block of a large bucket.
OCCUPANCY, BLOCK = 1024, 2048
SEED = 20
#: Tables that the mark of a bucket has room for.
MOST = 1 << 14


#: Hyperplanes of all tables; tables that need more signs than these share them.
SIGNS = 512


def missed(bits: int, count: int, same: float) -> float:
    """How likely a pair, alike in a share ``same`` of all hyperplanes, shares no bucket."""
    if bits * count <= SIGNS:
        return (1 - same**bits) ** count
    # Tables draw from the same signs: over the number of those that are alike, the share of draws that hit only these.
    n = np.arange(bits, SIGNS + 1)
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, SIGNS + 1)))])
    chance = np.exp(log[SIGNS] - log[n] - log[SIGNS - n] + n * math.log(same) + (SIGNS - n) * math.log1p(-same))
    hit = np.exp(log[n] - log[n - bits] + log[SIGNS - bits] - log[SIGNS])
    return float((chance * (1 - hit) ** count).sum() + max(0.0, 1 - chance.sum()))


def tables(n: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    bits = min(30, max(6, round(math.log2(max(n, 1) / OCCUPANCY))))
    same = 1 - math.acos(least) / math.pi
    count = math.ceil(math.log(1 - recall) / math.log(1 - same**bits))
    while missed(bits, count, same) > 1 - recall + 1e-12:
        if count >= MOST:
            raise ValueError(f"a cosine of {least} takes more than {MOST} tables for a recall of {recall}")
        count += max(1, count // 50)
    return bits, count


def padded(dim: int) -> int:
    """Dimensions that codes have: a power of two, twice a vector's at least."""
    return max(64, 1 << (2 * dim - 1).bit_length())


@cache
def flips(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (3, size))


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows padded and rotated at random: three rounds of random signs and a Hadamard transform each."""
    size = padded(x.shape[1])
    out = np.zeros((len(x), size), x.dtype)
    out[:, : x.shape[1]] = x
    for signs in flips(size).astype(x.dtype):
        out *= signs
        half = 1
        while half < size:
            pair = out.reshape(len(x), -1, 2, half)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(x), size)
            half *= 2
        out /= math.sqrt(size)
    return out


@cache
def planes(dim: int, count: int) -> np.ndarray:
    """Whole-numbered normals, so that projections of whole-numbered vectors are exact in double precision."""
    return np.rint(np.random.default_rng(SEED + 1).standard_normal((count, dim)) * 256).clip(-1023, 1023).T.copy()


@cache
def drawn(bits: int, count: int, pool: int) -> np.ndarray:
    """For every table the hyperplanes, of ``pool``, that its key is read from: its own while there are enough."""
    if bits * count <= pool:
        return np.arange(bits * count).reshape(count, bits)
    r = np.random.default_rng(SEED + 3)
    return np.stack([r.permutation(pool)[:bits] for _ in range(count)])


def signs(x: np.ndarray, pool: int) -> np.ndarray:
    """On which side of every hyperplane each vector is, packed; the same for a vector wherever it is computed."""
    _, exponent = np.frexp(np.abs(x).max(1))
    rounded = np.rint(np.ldexp(x, (20 - exponent)[:, None]))
    return np.packbits(rounded @ planes(x.shape[1], pool) > 0, axis=1)


def keys(packed: np.ndarray, bits: int, count: int, pool: int) -> np.ndarray:
    """The bucket of every row of packed signs in every table."""
    sign = np.unpackbits(packed, axis=1)
    out, weight = np.empty((len(packed), count), np.int64), 1 << np.arange(bits, dtype=np.int64)
    for k, own in enumerate(drawn(bits, count, pool)):
        out[:, k] = sign[:, own] @ weight
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Directions; scaled first, so that very large and very small values keep their squares."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


class Codes:
    """Codes, factors and 4-bit coordinates of unit vectors of ``dim`` dimensions."""

    def __init__(self, u: np.ndarray):
        self.dim, self.d = u.shape[1], padded(u.shape[1])
        r = rotated(u)
        self.bits = np.packbits(r > 0, axis=1)
        low = u.min(1)
        step = np.maximum((u.max(1) - low) / 15, 1e-12)
        noise = np.random.default_rng(SEED + 2).random(self.dim)  # rounding at random keeps the estimate unbiased
        self.q = np.minimum(15, np.floor((u - low[:, None]) / step[:, None] + noise)).astype(np.uint8)
        self.numbers = np.stack([np.abs(r).sum(1) / math.sqrt(self.d), low, step], 1).astype(np.float32)
        self.unpack()

    def unpack(self) -> None:
        """What estimates are computed from: the code in signs, and the 4-bit coordinates, rotated."""
        self.factor = self.numbers[:, 0].astype(np.float64)
        self.slack = np.sqrt(np.maximum(0, 1 - self.factor**2) / self.factor**2 / max(1, self.d - 1))
        self.sign = np.unpackbits(self.bits, axis=1).astype(np.float32) * 2 - 1
        self.turned = rotated(self.numbers[:, 1:2] + self.numbers[:, 2:3] * self.q)

    def stored(self) -> np.ndarray:
        """A row of bytes for each vector."""
        even = self.q if self.dim % 2 == 0 else np.pad(self.q, ((0, 0), (0, 1)))
        return np.concatenate([self.bits, even[:, ::2] << 4 | even[:, 1::2], self.numbers.view(np.uint8)], axis=1)

    @classmethod
    def read(cls, rows: np.ndarray, dim: int) -> Codes:
        self = cls.__new__(cls)
        self.dim, self.d = dim, padded(dim)
        a, b = self.d // 8, self.d // 8 + -(-dim // 2)
        self.bits = rows[:, :a]
        self.q = np.stack([rows[:, a:b] >> 4, rows[:, a:b] & 15], 2).reshape(len(rows), -1)[:, :dim]
        self.numbers = rows[:, b : b + 12].copy().view(np.float32)
        self.unpack()
        return self

    def estimate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimates of the inner products of rows a (as codes) and b (in 4 bits), pair by pair."""
        return (self.sign[a] * self.turned[b]).sum(1) / math.sqrt(self.d) / self.factor[a]

    def near(self, rows: np.ndarray, others: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ``rows`` and ``others`` (or of rows among themselves) whose bound reaches ``least``."""
        to = rows if others is None else others
        bound = (least - EPSILON * self.slack[rows]) * self.factor[rows] * math.sqrt(self.d)
        hit = self.sign[rows] @ self.turned[to].T >= bound[:, None].astype(np.float32)
        p, q = np.nonzero(np.triu(hit, 1) if others is None else hit)
        return rows[p], to[q]


def read_vectors(kind: str):
    """(d, t, v, n): id, digest, values and dimensions; nulls for a vector that links with nothing."""

    def run(batches):
        for batch in batches:
            digests, raw, dims = [], [], []
            for value in batch.column(1):
                x = None
                if value.is_valid and len(value.values) and not value.values.null_count:
                    x = np.asarray(value.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                raw.append(None if x is None else x.astype(kind).tobytes())
                digests.append(None if x is None else xxhash.xxh3_128_digest(raw[-1]))
                dims.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], names=["d", "t", "v", "n"])

    return run


def values(raw: list[bytes], n: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), n).astype(np.float64)


def coded(bits: int, count: int, pool: int, kind: str):
    """(r, x, n, keys): the stored code with the signs behind it, and a mark of every bucket."""

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            out, stored = np.zeros((batch.num_rows, count), np.int64), [b""] * batch.num_rows
            raw = batch.column(1).to_pylist()
            for n in np.unique(dims):
                at = np.flatnonzero(dims == n)
                x = values([raw[i] for i in at], n, kind)
                packed = signs(x, pool)
                out[at] = keys(packed, bits, count, pool) | (np.arange(count, dtype=np.int64) << 31 | int(n) << 45)
                rows = np.concatenate([Codes(unit(x)).stored(), packed], axis=1)
                for i, row in zip(at.tolist(), rows, strict=True):
                    stored[i] = row.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, count), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stored, pa.binary()), batch.column(2), lists], names=["r", "x", "n", "keys"])

    return run


def pieces(batches) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray | None]]:
    """A table of whole pieces of buckets, and the rows of each that meet: two blocks, or one in itself."""
    for rows in whole(batches, ["k", "_i", "_j"]):
        k, i, j, b = (rows.column(c).to_numpy() for c in ("k", "_i", "_j", "_b"))
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(k) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0), [True]]))
        for begin, end in zip(cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist(), strict=True):
            at = np.arange(begin, end)
            if i[begin] == j[begin]:
                yield rows, at, None
            elif len(own := at[b[at] == i[begin]]) and len(other := at[b[at] != i[begin]]):
                yield rows, own, other


def first_shared(p: np.ndarray, q: np.ndarray, packed: np.ndarray, bits: int, count: int, pool: int, k: int) -> np.ndarray:
    """Whether the bucket ``k`` is of the first table that two rows share; only rows of pairs are looked at."""
    out, table = np.ones(len(p), bool), k >> 31 & 0x3FFF
    if len(p) and table:
        own = np.flatnonzero(np.bincount(np.concatenate([p, q]), minlength=len(packed)))
        place = np.zeros(len(packed), np.int64)
        place[own] = np.arange(len(own))
        spread = keys(packed[own], bits, count, pool)[:, :table]
        step = max(1, (1 << 21) // table)
        for begin in range(0, len(p), step):
            at = slice(begin, begin + step)
            out[at] = ~(spread[place[p[at]]] == spread[place[q[at]]]).any(1)
    return out


def candidates(bits: int, count: int, pool: int, least: float):
    """The rows of pieces that have a pair whose bound reaches ``least``, from stored codes alone."""

    def run(batches):
        for rows, own, other in pieces(batches):
            at = own if other is None else np.concatenate([own, other])
            k, n = rows.column("k")[int(at[0])].as_py(), rows.column("n")[int(at[0])].as_py()
            raw = rows.column("x").take(pa.array(at)).to_pylist()
            data = np.frombuffer(b"".join(raw), np.uint8).reshape(len(at), -1)
            size = -(-pool // 8)
            codes, packed = Codes.read(data[:, :-size], n), data[:, -size:]
            p, q = codes.near(np.arange(len(own)), None if other is None else np.arange(len(own), len(at)), least)
            first = first_shared(p, q, packed, bits, count, pool, k)
            keep = at[np.unique(np.concatenate([p[first], q[first]]))]
            if len(keep):
                yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(keep)).combine_chunks() for c in ("k", "_i", "_j", "_b", "r")], names=["k", "_i", "_j", "_b", "r"])

    return run


def linked(bits: int, count: int, pool: int, least: float, kind: str):
    """From pieces with exact vectors: for each row its links (copies counted) and a spanning edge."""

    def run(batches):
        for rows, own, other in pieces(batches):
            at = own if other is None else np.concatenate([own, other])
            part = rows.take(pa.array(at))
            k, n = part.column("k")[0].as_py(), part.column("n")[0].as_py()
            x, copies, r = values(part.column("v").to_pylist(), n, kind), part.column("c").to_numpy(), part.column("r").to_numpy()
            u = unit(x)
            p, q = Codes(u).near(np.arange(len(own)), None if other is None else np.arange(len(own), len(at)), least)
            first = first_shared(p, q, signs(x, pool), bits, count, pool, k)
            p, q = p[first], q[first]
            links, forest = np.zeros(len(at), np.int64), Forest(len(at))
            for begin in range(0, len(p), 1 << 16):
                a, b = p[begin : begin + (1 << 16)], q[begin : begin + (1 << 16)]
                true = (u[a] * u[b]).sum(1) >= least
                a, b = a[true], b[true]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for c, d in zip(a.tolist(), b.tolist(), strict=True):
                    forest.join(c, d)
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(r[some]), pa.array(links[some]), pa.array(r[[forest.find(c) for c in some.tolist()]])], names=["u", "links", "v"])

    return run


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each vector.

    Vectors are compared by cosine in double precision within their number of dimensions. A vector that is
    null, empty, zero, or holds null or non-finite components links with nothing and is its own component.
    Equal vectors are copies: they link with each other, and are searched for once. Repeated rows and ids
    are vectors of their own. A null id names no component that has another. An empty table gives an empty
    one. Other columns aren't read, so that their names can't clash. A vector of any length has to fit a task.
    """
    ship(vectors.sparkSession)
    id_type = vectors.schema[vec_id].dataType.simpleString()
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"
    with Scratch(vectors.sparkSession) as scratch:
        data = scratch.put(vectors.select(F.col(vec_id).alias("d"), F.col(embedding).alias("x")).mapInArrow(read_vectors(kind), f"d {id_type}, t binary, v binary, n int"))
        distinct = data.filter("t is not null").groupBy("t").agg(F.first("v").alias("v"), F.count("*").alias("c"), F.first("n").alias("n"))
        distinct = scratch.put(distinct.withColumn("r", F.monotonically_increasing_id()))
        bits, count = tables(distinct.count(), least, recall)
        pool = min(SIGNS, bits * count)
        codes = scratch.put(distinct.select("r", "v", "n").mapInArrow(coded(bits, count, pool, kind), "r long, x binary, n int, keys array<long>"))
        buckets = codes.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count("*").alias("size"))
        large = few(scratch.put(buckets.filter(F.col("size") > BLOCK)))
        rows = codes.select("r", "x", "n", F.explode("keys").alias("k")).join(large, "k", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        dealt = in_block_pairs(rows, "k", "r", "size", BLOCK).select("k", "_i", "_j", "_b", "r", "x", "n")
        some = scratch.put(dealt.mapInArrow(candidates(bits, count, pool, least), "k long, _i int, _j int, _b int, r long"))
        exact = some.join(distinct.select("r", "v", "c", "n"), "r").repartition("k", "_i", "_j").sortWithinPartitions("k", "_i", "_j")
        found = scratch.put(exact.select("k", "_i", "_j", "_b", "r", "v", "c", "n").mapInArrow(linked(bits, count, pool, least, kind), "u long, links long, v long"))
        links = few(scratch.put(found.groupBy(F.col("u").alias("r")).agg(F.sum("links").alias("links"))))
        groups = few(components(found.select("u", "v"), scratch)).select(F.col("node").alias("r"), "component")
        per = distinct.select("r", "t", "c").join(links, "r", "left").join(groups, "r", "left")
        per = few(scratch.put(per.select("t", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component", "r").alias("g"))))
        each = scratch.put(data.filter("t is not null").select("d", "t").join(per, "t").select("d", "n_links", "g"), stay=True)
        least_id = few(scratch.put(each.groupBy("g").agg(F.min("d").alias("component_id")), stay=True))
        alone = scratch.put(data.filter("t is null").select("d"), stay=True)
    out = each.join(least_id, "g").select("d", "n_links", F.coalesce("component_id", "d").alias("component_id"))
    out = out.unionByName(alone.select("d", F.lit(0).cast("long").alias("n_links"), F.col("d").alias("component_id")))
    return out.select(F.col("d").alias(vec_id), "n_links", "component_id", F.col("d").eqNullSafe(F.col("component_id")).alias("kept"))
