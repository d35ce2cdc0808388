"""Near-duplicate documents by ProbMinHash over word shingles, banding and verification.

1. Documents of the same word sequence are one text. Each of a text's shingles (``size`` words; a shorter
   text is one shingle) weighs as much as it occurs. It is a Poisson process of that rate, each of whose
   arrivals falls on a random register; a register keeps the shingle that arrived first, and a shingle
   ends when its next arrival comes after the latest register. Two texts agree on a register with the
   probability Jaccard similarity of their weights. A text with repeated shingles has a second sketch in
   which each weighs 1, which estimates the Jaccard similarity of sets; for all others both are the same.
2. Bands of registers give bucket keys. In a bucket, texts whose registers agree on ``SCREEN`` or more, in
   either sketch, are joined; the joined families are all that exact verification has to look into.
3. Inside a family two texts are linked if the probability Jaccard similarity of their counts or the
   Jaccard similarity of their sets is ``least`` or more, computed on all shingles: a refrain that one
   copy repeats more often parts no copies. A pair that is already in one class by other links isn't
   computed.

Buckets and families of any size are cut into blocks, and each two blocks meet in one bounded piece;
pieces give spanning edges only, so that no group is expanded into its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import KEY, WORDS, Scratch, bitmap, few, held, may_contain, sifted, slices, without
from .contamination import words
from .graph import components
from .runs import Forest, in_block_pairs, runs

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Share of agreeing registers from which a pair is looked at: five standard deviations below LEAST.
SCREEN = LEAST - 5 * (LEAST * (1 - LEAST) / REGISTERS) ** 0.5
SLICE = 4 << 20
MEMO = 300_000
OWN = ["class_id", "kept"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingles of texts as 64-bit hashes, from remembered hashes of words."""

    def __init__(self, size: int):
        self.size = size

        class Known(dict):
            def __missing__(memo, word: bytes) -> int:
                h = xxhash.xxh64_intdigest(word)
                if len(word) <= KEY:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = h
                return h

        self.known = Known()

    def __call__(self, split: list[bytes]) -> np.ndarray:
        """A hash for every place; words shorter than a shingle are one, none are none."""
        h = np.fromiter(map(self.known.__getitem__, split), np.uint64, len(split))
        k = min(self.size, len(h))
        if not k:
            return h
        out = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        return mixed(out + np.uint64(k))


def signatures(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """For each document and register the element that arrives first (0 where a document has none)."""
    time = np.full(docs * registers, np.inf)
    first = np.zeros(docs * registers, np.uint64)
    live, at, turn = np.arange(len(element)), np.zeros(len(element)), 0
    while len(live):
        turn += 1
        x = mixed(element[live] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = at - np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[live]
        whose = doc[live]
        present, back = np.unique(whose, return_inverse=True)
        limit = time.reshape(docs, registers)[present].max(1)[back]
        early = at < limit
        live, at, x, whose = live[early], at[early], x[early], whose[early]
        slot = whose * registers + (mixed(x + np.uint64(0x632BE59BD9B4E019)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, slot, at)
        won = at == time[slot]
        first[slot[won]] = element[live[won]]
    return first.reshape(docs, registers)


def banded(first: np.ndarray) -> np.ndarray:
    """A key for every band of registers."""
    cut = first.reshape(len(first), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for j in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, j])
    return key.view(np.int64)


def weighed(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles once each, in order, and how often each occurs."""
    return np.unique(shingles, return_counts=True)


def probability_jaccard(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Of two texts with shingles x, y (in order, once each) of the weights m, n.

    A common shingle adds 1 / sum(max(m' / m, n' / n)) over all shingles. The first of the two is the larger
    where m' / n' isn't below m / n, so that sorting by that quotient leaves two running sums.
    """
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = np.flatnonzero(y[at] == x)
    p, q = m[both].astype(float), n[at[both]].astype(float)
    quotient = p / q
    order = np.argsort(quotient, kind="stable")
    p, q, quotient = p[order], q[order], quotient[order]
    first = np.searchsorted(quotient, quotient)
    above = m.sum() - np.concatenate([[0.0], np.cumsum(p)])[first]
    below = n.sum() - q.sum() + np.concatenate([[0.0], np.cumsum(q)])[first]
    return float((1 / (above / p + below / q)).sum())


def alike(x: np.ndarray, m: np.ndarray | None, y: np.ndarray, n: np.ndarray | None, least: float) -> bool:
    """Whether two texts are linked; weights are None where all are 1."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    # In whole numbers, so that a similarity of exactly ``least`` counts.
    if both * 1_000_000 >= round(least * 1_000_000) * (len(x) + len(y) - both):
        return True
    if not both or (m is None and n is None):
        return False
    m, n = (np.ones(len(e), np.int64) if w is None else w for e, w in ((x, m), (y, n)))
    return probability_jaccard(x, m, y, n) >= least - 1e-12


def registers(sig: list[bytes]) -> np.ndarray:
    """(texts, sketches, registers): two sketches if any of the texts has a second one."""
    one = 2 * REGISTERS
    if any(len(s) > one for s in sig):
        sig = [s if len(s) > one else s + s for s in sig]
    return np.frombuffer(b"".join(sig), np.uint16).reshape(len(sig), -1, REGISTERS)


def agreement(sig: np.ndarray, a: int) -> np.ndarray:
    """On how many registers each text after ``a`` agrees with it, by the sketch that agrees more."""
    return (sig[a + 1 :] == sig[a]).sum(2).max(1)


def digest(split: list[bytes], text: bytes | None) -> bytes:
    """Of the word sequence; of the text itself if it has no words."""
    return xxhash.xxh3_128_digest(b" ".join(split) if split else b"\0" + (text or b""))


def number(d: bytes) -> int:
    """The leading bytes of a digest as a (signed) long."""
    return int.from_bytes(d[:8], "big", signed=True)


def long_of(column: str):
    """``number`` as a column."""
    high, low = (F.conv(F.substring(F.hex(column), k, 8), 16, 10).cast("long") for k in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def shingler(size: int) -> Shingler:
    return held(("shingles", size), lambda: Shingler(size))


def sketched(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(d, h, t, keys, sig, w): id, hash of the text, digest of the word sequence or of the text (null for none), band keys, registers' low 16 bits (by counts, then by the set if it differs), shingles."""

    def run(batches):
        cut = shingler(size)
        for batch, texts in slices(batches, "x", SLICE):
            elements, weights, owner, digests, has = [], [], [], [], []
            size_of = [0] * len(texts)
            for k, t in enumerate(texts):
                split = words(t)
                digests.append(digest(split, t) if t else None)
                if split:
                    e, w = weighed(cut(split))
                    size_of[k] = len(e)
                    for own in (w, np.ones(len(e))) if len(e) < w.sum() else (w,):
                        elements.append(e)
                        weights.append(own)
                        owner.append(np.full(len(e), len(has), np.int64))
                        has.append(k)
            keys, sig = [None] * len(texts), [None] * len(texts)
            if has:
                first = signatures(np.concatenate(elements), np.concatenate(weights), np.concatenate(owner), len(has))
                for k, b, s in zip(has, banded(first), first.astype(np.uint16), strict=True):
                    again = keys[k] is not None
                    keys[k], sig[k] = (np.union1d(keys[k], b), sig[k] + s.tobytes()) if again else (b, s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(size_of, pa.int64())], names=["d", "h", "t", "keys", "sig", "w"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("x")).mapInArrow(run, f"d {kind}, h long, t binary, keys array<long>, sig binary, w long")


def screened(batches):
    """Spanning edges of the texts of a piece of a bucket whose registers agree often enough."""
    out_u, out_v = [], []
    for piece in runs(batches, ["k", "_i", "_j"]):
        t = piece.column("t").to_pylist()
        if len(t) < 2:
            continue
        sig = registers(piece.column("sig").to_pylist())
        forest = Forest(len(t))
        for a in range(len(t) - 1):
            for b in np.flatnonzero(agreement(sig, a) >= SCREEN * REGISTERS).tolist():
                if forest.join(a, a + 1 + b):
                    out_u.append(t[a])
                    out_v.append(t[a + 1 + b])
        if len(out_u) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.binary()), pa.array(out_v, pa.binary())], names=["u", "v"])
            out_u, out_v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.binary()), pa.array(out_v, pa.binary())], names=["u", "v"])


def linked(least: float):
    """Spanning edges of the texts of a piece of a family that are alike."""

    def run(batches):
        for piece in runs(batches, ["k", "_i", "_j"]):
            t = piece.column("t").to_pylist()
            if len(t) < 2:
                continue
            sig = registers(piece.column("sig").to_pylist())
            sets = [np.frombuffer(s, np.uint64) for s in piece.column("set").to_pylist()]
            counts = [np.frombuffer(c, np.uint32).astype(np.int64) if c else None for c in piece.column("counts").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            repeats = np.array([c is not None for c in counts])
            forest, u, v = Forest(len(t)), [], []
            for a in range(len(t) - 1):
                rest = slice(a + 1, None)
                ratio = np.minimum(sizes[rest], sizes[a]) / np.maximum(sizes[rest], sizes[a])
                agree = agreement(sig, a)
                # Counts may be alike whatever the sizes of the sets.
                near = np.flatnonzero((agree >= SCREEN * REGISTERS) & ((ratio >= least) | repeats[rest] | repeats[a]))
                for b in (near[np.argsort(-agree[near], kind="stable")] + a + 1).tolist():
                    if forest.find(a) != forest.find(b) and alike(sets[a], counts[a], sets[b], counts[b], least):
                        forest.join(a, b)
                        u.append(t[a])
                        v.append(t[b])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(doc_id, t, class_id): each document with its text's digest and the smallest id of its class.

    Words are runs of a-z, 0-9 and all beyond ASCII, A-Z lower-cased. Texts without words are alike only
    if they are equal; null and empty texts are like nothing, each its own class. Repeated rows are
    copies of each other. A null id can't name a class: it is passed over unless a class has no other.
    An empty table gives an empty one. Other columns aren't read, so that their names can't clash. Texts of
    any length that fits a task are read whole.
    """
    member, lead = grouped(docs, doc_id, text, size, least)
    out = member.filter("g is not null").join(few(lead.select("g", "class_id")), "g").select("d", "t", "class_id")
    out = out.unionByName(member.filter("g is null").select("d", "t", F.lit(None).cast(out.schema["class_id"].dataType).alias("class_id")))
    return out.select(F.col("d").alias(doc_id), "t", F.coalesce("class_id", "d").alias("class_id"))


#: Shingles that count as much as a text in blocks of a family, so that a block has a bounded size.
HEAVY = 2000


def grouped(docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (d, h, t, g), with the hash of the text and the group, null for null and empty texts; (g, class_id, n)."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        sketch = scratch.put(sketched(docs, doc_id, text, size))
        texts = sketch.filter("keys is not null").groupBy("t").agg(F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.first("w").alias("w"))
        texts = scratch.put(texts)
        bands = texts.select("t", F.explode("keys").alias("k"))
        buckets = bands.select("k", F.xxhash64("t").alias("x"), F.xxhash64(F.lit(1), "t").alias("y")).groupBy("k").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("n > 1")
        # Bands that gather the same texts are looked at once.
        buckets = scratch.put(buckets.groupBy("n", "x", "y").agg(F.min("k").alias("k")).select("k", "n"))
        rows = sifted(bands, "k", bitmap(buckets, "k")).join(few(buckets), "k").join(texts.select("t", "sig"), "t")
        families = components(in_block_pairs(rows, "k", "t", "n").select("k", "_i", "_j", "t", "sig").mapInArrow(screened, "u binary, v binary"), scratch)
        weight = F.greatest(F.lit(1), F.ceil(F.col("w") / HEAVY)).cast("long")
        families = families.select(F.col("node").alias("t"), F.xxhash64("component").alias("k"))
        families = scratch.put(families.join(texts.select("t", "sig", "w"), "t"))
        sizes = scratch.put(families.groupBy("k").agg(F.sum(weight).alias("n")))

        bits = np.zeros(WORDS, np.int64)
        for r in bitmap(families.select(long_of("t").alias("h")), "h").toLocalIterator():
            bits[r.w] = r.bits
        wanted = spark.sparkContext.broadcast(bits)

        def sets(batches):
            cut, bits, seen = shingler(size), wanted.value.tolist(), set()
            for batch, own in slices(batches, "x", SLICE):
                t, held, often = [], [], []
                for x in own:
                    split = words(x)
                    d = digest(split, x)
                    if split and d not in seen and may_contain(bits, number(d)):
                        if len(seen) >= MEMO:  # it only spares repeated rows
                            seen.clear()
                        seen.add(d)
                        t.append(d)
                        e, w = weighed(cut(split))
                        held.append(e.tobytes())
                        often.append(w.astype(np.uint32).tobytes() if len(e) < w.sum() else b"")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (t, held, often)], names=["t", "set", "counts"])

        held = docs.select(F.col(text).alias("x")).mapInArrow(sets, "t binary, set binary, counts binary")
        rows = families.join(held, "t").dropDuplicates(["t"]).join(few(sizes), "k")
        edges = in_block_pairs(rows, "k", "t", "n").select("k", "_i", "_j", "t", "sig", "set", "counts").mapInArrow(linked(least), "u binary, v binary")
        groups = few(components(edges, scratch))
        member = sketch.filter("t is not null").select("d", "h", "t").join(groups.select(F.col("node").alias("t"), "component"), "t", "left").select("d", "h", "t", F.coalesce("component", "t").alias("g"))
        member = scratch.put(member.unionByName(sketch.filter("t is null").select("d", "h", "t", F.lit(None).cast("binary").alias("g"))), stay=True)
        lead = member.filter("g is not null").groupBy("g").agg(F.min("d").alias("class_id"), F.count("*").alias("n"))
        return member, scratch.put(lead, stay=True)


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, with its own columns: the one of the smallest id, then of the smallest hash of its text.

    Of repeated rows one stays. A null id comes after all others. Documents with a null or empty text all
    stay. An empty table gives an empty one. Only documents of classes of several travel with their texts.
    """
    keep = without(docs, OWN)
    member, lead = grouped(docs, doc_id, text, **options)
    with Scratch(docs.sparkSession) as scratch:
        several = member.filter("g is not null").join(few(lead.filter("n > 1").select("g")), "g")
        several = scratch.put(several.select("d", "h", "g"), stay=True)
    leads = several.groupBy("g").agg(F.min(F.struct(F.col("d").isNull().alias("z"), "d", "h")).alias("l")).select("l.d", "l.h").distinct()
    bits = bitmap(several, "h")
    # A row travels as one column, so that no name of its own meets those that are used here.
    every = docs.select(F.struct(*keep).alias("row"), F.xxhash64(text).alias("x"), (F.coalesce(F.length(text), F.lit(0)) == 0).alias("e"))
    own = [F.col("row")[c].alias(c) for c in keep]
    full = every.filter("not e")
    single = sifted(full, "x", bits, inside=False).select(*own)
    # Texts that only share a bit with those of a class are in none, and stay like them.
    near = sifted(full, "x", bits)
    same = F.col("row")[doc_id].eqNullSafe(F.col("d")) & (F.col("x") == F.col("h"))
    apart = near.join(few(several.select("d", "h").distinct()), same, "left_anti").select(*own)
    once = near.join(leads, same).groupBy("d", "h").agg(F.first("row").alias("row")).select(*own)
    return single.unionByName(apart).unionByName(once).unionByName(every.filter("e").select(*own))
