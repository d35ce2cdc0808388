"""Benchmark decontamination with suffix arrays over the training text.

Every task builds suffix arrays over shards of its training documents, and binary-searches the windows
of every benchmark suffix in each shard; equal windows are searched for once. A suffix array here holds
word positions; words are numbered by the benchmark's vocabulary, so that packed integers compare like
word sequences. A position whose word occurs in no benchmark item can begin no match, and is not sorted.
The sorted suffixes of the benchmark give, for each sorted position of the shard, the longest verbatim
match of any length: it is with one of the two neighbours in that order.

The benchmark travels to the tasks in blocks of at most ``block_bytes`` of text, which are read, sent and
passed over the rows one after another, so that the driver holds one at a time and neither side is ever
joined or shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import Scratch, deleted, extended, held, slices, without

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: A worker holds a block as suffixes and keys, about 60 bytes for each of its own.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
OWN = ["n_words", "n_hit", "n_items", "items", "hits", "longest_match", "contaminated", "longest"]

#: Words are runs of a-z, 0-9 and all beyond ASCII; every other byte becomes a blank.
_BLANK = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased."""
    return text.lower().translate(_BLANK).split() if text else []


class Hashes:
    """Hashes of all stretches of a sequence of numbers, by two primes."""

    PRIMES = ((2147483647, 911382323), (2147483629, 972663749))

    def __init__(self, ids: np.ndarray):
        self.sums = []
        for prime, base in self.PRIMES:
            power = self.powers(prime, base, len(ids))
            self.sums.append(np.concatenate([[0], np.cumsum((ids.astype(np.int64) + 1) * power % prime)]) % prime)

    _power: dict[int, np.ndarray] = {}

    @classmethod
    def powers(cls, prime: int, base: int, n: int) -> np.ndarray:
        known = cls._power.get(prime, np.ones(1, np.int64))
        while len(known) < n:
            known = np.concatenate([known, known * (int(known[-1]) * base % prime) % prime])
        cls._power[prime] = known
        return known[:n]

    def common(self, at: np.ndarray, other: Hashes, to: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far this sequence from ``at`` and the other from ``to`` agree, at most ``most``: binary search over lengths."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        shift = np.abs(at - to)
        while (low < high).any():
            n = (low + high + 1) >> 1
            same = np.ones(len(at), bool)
            for (prime, base), a, b in zip(self.PRIMES, self.sums, other.sums, strict=True):
                power = self.powers(prime, base, int(shift.max()) + 1)[shift]
                x, y = (a[at + n] - a[at]) % prime, (b[to + n] - b[to]) % prime
                same &= np.where(at < to, x * power % prime, x) == np.where(to < at, y * power % prime, y)
            low, high = np.where(same, n, low), np.where(same, high, n - 1)
        return low


class Items:
    """The sorted suffixes and the windows of a block of benchmark items, as packed integers."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        texts: dict[bytes, list[str]] = defaultdict(list)
        for name, text in rows:
            if split := words(text):
                texts[b" ".join(split)].append(name)
        number = self.vocabulary
        self.names: list[list[str]] = []
        parts: list[np.ndarray] = []
        for text, names in texts.items():
            parts.append(np.array([number.setdefault(w, len(number) + 1) for w in text.split()], np.int32))
            self.names.append(sorted(set(names)))
        #: A word of no item; it is above all others, and agrees with none.
        self.unknown = len(number) + 1
        self.bits = max(1, (len(number) + 2).bit_length())
        self.per_key = max(1, 62 // self.bits)
        self.depth = -(-window // self.per_key)
        self.span = self.depth * self.per_key
        size = np.array([len(p) for p in parts], np.int64)
        total = int(size.sum())
        self.flat = np.concatenate([*parts, np.zeros(self.span, np.int32)])
        start = np.arange(total)
        item = np.repeat(np.arange(len(parts)), size)
        end = np.repeat(np.cumsum(size), size)
        first = np.repeat(np.cumsum(size) - size, size)
        order = self.sorted(end)
        self.start, self.item, self.left, self.offset = start[order], item[order], (end - start)[order], (start - first)[order]
        self.hashes = Hashes(self.flat[:total])
        self.head = self.pack(self.start, self.left, self.per_key)[0]
        #: Words of the window that begins at a suffix; 0 where the suffix is too short to be one.
        width = np.where(self.left >= window, window, np.where(self.offset == 0, self.left, 0))
        own = np.flatnonzero(width)
        keys = self.pack(self.start[own], width[own], self.span)
        # Equal windows follow each other in the order of suffixes, but for those of a whole short item.
        rank = np.lexsort([*reversed(keys), width[own]])
        own, keys, width = own[rank], [k[rank] for k in keys], width[own][rank]
        new = np.concatenate([[True], width[1:] != width[:-1]]) if len(own) else np.zeros(0, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = np.flatnonzero(new)
        self.width = width[cuts]
        self.low = [k[cuts] for k in keys]
        #: Above all sequences that begin with the window: all words after it at their most.
        self.high = [k | m for k, m in zip(self.low, self.pack_rest(self.width), strict=True)]
        #: The items of each window, one after another, and where those of a window begin.
        pairs = np.unique((np.cumsum(new) - 1) * max(1, len(parts)) + self.item[own])
        self.members = (pairs % max(1, len(parts))).astype(np.int32)
        self.begin = np.searchsorted(pairs // max(1, len(parts)), np.arange(len(cuts) + 1))

    def sorted(self, end: np.ndarray) -> np.ndarray:
        """All suffixes in order: by ranks of one word, then of twice as many words until no two are alike."""
        n = len(end)
        rank = self.flat[:n].astype(np.int64)
        order, step = np.argsort(rank, kind="stable"), 1
        while n:
            after = np.arange(n) + step
            second = np.where(after < end, rank[np.minimum(after, n - 1)], 0)
            order = np.lexsort((second, rank))
            a, b = rank[order], second[order]
            ranks = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            if ranks[-1] == (rank.max() if step > 1 else 0) or ranks[-1] == n:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = ranks
            step *= 2
        return order

    def pack(self, start: np.ndarray, left: np.ndarray, span: int) -> list[np.ndarray]:
        """Keys of ``per_key`` words each, most significant word first; 0 beyond ``left`` words."""
        keys = []
        for d in range(0, span, self.per_key):
            key = np.zeros(len(start), np.int64)
            for j in range(d, d + self.per_key):
                key = (key << self.bits) | np.where(j < left, self.flat[np.minimum(start + j, len(self.flat) - 1)], 0)
            keys.append(key)
        return keys

    def pack_rest(self, width: np.ndarray) -> list[np.ndarray]:
        keys = []
        for d in range(0, self.span, self.per_key):
            key = np.zeros(len(width), np.int64)
            for j in range(d, d + self.per_key):
                key = (key << self.bits) | np.where(j < width, 0, (1 << self.bits) - 1)
            keys.append(key)
        return keys

    def longest(self, array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """For each sorted position of a shard its longest match with a suffix, and that suffix."""
        n, key = len(self.start), array.keys[0]
        best, whose = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        if not n:
            return best, whose
        low, high = np.searchsorted(self.head, key, "left"), np.searchsorted(self.head, key, "right")
        deep = np.flatnonzero(low < high)
        if len(deep):  # more words than a key agree: find the place by whole matches
            text = Hashes(array.ids)
            a, at = low[deep], array.at[deep]
            b = high[deep]
            while len(open_ := np.flatnonzero(a < b)):
                mid, p = (a[open_] + b[open_]) >> 1, at[open_]
                most = np.minimum(self.left[mid], len(array.ids) - p)
                same = text.common(p, self.hashes, self.start[mid], most)
                ended = same == self.left[mid]
                above = ended | (array.ids[np.minimum(p + same, len(array.ids) - 1)] > self.flat[self.start[mid] + same])
                a[open_], b[open_] = np.where(above, mid + 1, a[open_]), np.where(above, b[open_], mid)
            low[deep] = a
            for near in (a - 1, a):
                ok = (near >= 0) & (near < n)
                s = np.clip(near, 0, n - 1)
                same = text.common(at, self.hashes, self.start[s], np.where(ok, np.minimum(self.left[s], len(array.ids) - at), 0))
                more = same > best[deep]
                best[deep[more]], whose[deep[more]] = same[more], s[more]
        shallow = np.flatnonzero(best == 0)
        for near in (low[shallow] - 1, low[shallow]):
            s = np.clip(near, 0, n - 1)
            differ = np.where((near >= 0) & (near < n), key[shallow] ^ self.head[s], key[shallow])
            same = np.zeros(len(s), np.int64)
            for j in range(1, self.per_key):
                same += differ >> (self.bits * (self.per_key - j)) == 0
            same = np.minimum(same, self.left[s])
            more = same > best[shallow]
            best[shallow[more]], whose[shallow[more]] = same[more], s[more]
        return best, whose


class SuffixArray:
    """The sorted suffixes of a shard: those that begin with a word of the benchmark, to the depth of a window."""

    def __init__(self, ids: np.ndarray, items: Items):
        self.ids = np.concatenate([ids, np.full(items.span, items.unknown, np.int32)])
        at = np.flatnonzero(ids != items.unknown)
        keys = [self.key(at, d, items) for d in range(items.depth)]
        order = np.argsort(keys[0], kind="stable")
        at, keys = at[order], [k[order] for k in keys]
        if items.depth > 1 and len(at):
            same = keys[0][1:] == keys[0][:-1]
            tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
            if len(tied):
                own = tied[np.lexsort([k[tied] for k in reversed(keys)])]
                at[tied] = at[own]
                for k in keys:
                    k[tied] = k[own]
        self.at, self.keys = at, keys

    def key(self, at: np.ndarray, d: int, items: Items) -> np.ndarray:
        key = np.zeros(len(at), np.int64)
        for j in range(items.per_key):
            key = (key << items.bits) | self.ids[at + (d * items.per_key + j)]
        return key

    def bound(self, wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """For each wanted key sequence the first place whose suffix is not below it (``after``: is above it)."""
        low = np.searchsorted(self.keys[0], wanted[0], "left")
        high = np.searchsorted(self.keys[0], wanted[0], "right")
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            below, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for k, w in zip(self.keys, wanted, strict=True):
                below |= equal & (k[mid] < w[open_])
                equal &= k[mid] == w[open_]
            right = below | equal if after else below
            low[open_] = np.where(right, mid + 1, low[open_])
            high[open_] = np.where(right, high[open_], mid)
        return low


def scan(texts: list[bytes | None], items: Items) -> list[tuple[int, list[tuple[int, int]], list[str], int, tuple | None]]:
    """For each text its words, hit spans (word positions, end exclusive), items with occurring windows, words of the
    longest match that begins a window, and the longest match of all (words, place, item, place in the item)."""
    split = [words(t) for t in texts]
    count = [len(w) for w in split]
    offset = np.cumsum([0, *[n + 1 for n in count]])
    ids = np.full(offset[-1], items.unknown, np.int32)
    get = items.vocabulary.get
    for begin, own in zip(offset, split, strict=False):
        ids[begin : begin + len(own)] = np.fromiter(map(get, own, repeat(items.unknown)), np.int32, len(own))
    out: list = [(n, [], [], 0, None) for n in count]
    if not len(items.start) or not (ids != items.unknown).any():
        return out
    array = SuffixArray(ids, items)
    doc = np.searchsorted(offset, array.at, "right") - 1
    same, whose = items.longest(array)
    # Windows of a width are ranges of the array that don't overlap, so that each place is met once for each width.
    low, high = array.bound(items.low, False), array.bound(items.high, True)
    widest = np.zeros(len(array.at), np.int64)
    found: dict[int, set[str]] = defaultdict(set)
    for width in np.unique(items.width[low < high]).tolist():
        own = np.flatnonzero((items.width == width) & (low < high))
        size = high[own] - low[own]
        place = np.repeat(low[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        widest[place] = width
        pairs = np.unique(doc[place] * len(items.width) + np.repeat(own, size))
        for p in pairs.tolist():
            d, w = divmod(p, len(items.width))
            for i in items.members[items.begin[w] : items.begin[w + 1]].tolist():
                found[d].update(items.names[i])
    begins = np.flatnonzero(widest)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, array.at[begins], 1)
    np.add.at(edge, array.at[begins] + widest[begins], -1)
    change = np.diff(np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, b, e in zip((np.searchsorted(offset, begin, "right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
        spans[d].append((b - int(offset[d]), e - int(offset[d])))
    most = np.zeros(len(texts), np.int64)
    # A window of a whole short item goes no further.
    np.maximum.at(most, doc[begins], np.where(widest[begins] < items.window, widest[begins], same[begins]))
    best = np.zeros(len(texts), np.int64)
    np.maximum.at(best, doc, same)
    for k in firsts(doc, array.at, same, best):
        d, s = int(doc[k]), int(whose[k])
        out[d] = (count[d], [], [], 0, (int(same[k]), int(array.at[k] - offset[d]), items.names[items.item[s]][0], int(items.offset[s])))
    for d, names in found.items():
        out[d] = (count[d], spans[d], sorted(names), int(most[d]), out[d][4])
    return out


def firsts(doc: np.ndarray, at: np.ndarray, same: np.ndarray, best: np.ndarray) -> list[int]:
    """For each document with a match the first place whose match is its longest."""
    top = np.flatnonzero((same == best[doc]) & (same > 0))
    top = top[np.argsort(at[top], kind="stable")]
    return top[np.unique(doc[top], return_index=True)[1]].tolist()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The number of blocks of about ``block_bytes`` each, and the items of one after another."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null and t != ''")
    total = rows.agg(F.sum(F.octet_length("t") + F.length("i"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    parts = (rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows for k in range(n))
    return n, ([(r.i, r.t.encode()) for r in p.toLocalIterator()] for p in parts)


def measure(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document with n_words, n_hit, n_items, items, hits (word spans), longest_match, contaminated and longest.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. A document word inside an occurrence of any window is hit. ``longest_match`` is the length of
    the longest match that begins with a window; ``longest`` is the longest verbatim match of any length,
    from one word on, with its place in the document and in the item (null if no word agrees).

    Null and empty texts have no words and no hits. Repeated documents are measured each on its own;
    repeated items count once by their id, an item without an id counts as ``null``. An empty benchmark
    hits nothing, an empty table gives an empty one. Whole texts are read, of any length that fits a task.
    Columns of ``docs`` that clash with the results are replaced by them. A benchmark of several blocks is
    written back between them.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    keep = without(docs, OWN)
    if text not in keep:
        raise ValueError(f"the text column may not be called {text}")
    longest = T.StructType([T.StructField("words", T.LongType()), T.StructField("at", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_at", T.LongType())])
    kinds = {"n_words": T.LongType(), "longest_match": T.LongType(), "hits": T.ArrayType(T.ArrayType(T.LongType())), "items": T.ArrayType(T.StringType()), "longest": longest}
    state = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, k) for c, k in kinds.items()]])
    out, scratch = docs.select(*keep), Scratch(spark)
    n, each = blocks(benchmark, item, item_text, block_bytes)
    for k, block in enumerate(each):
        sent = spark.sparkContext.broadcast(block)
        del block

        def run(batches, sent=sent, name=uuid4().hex, first=k == 0):
            items = held(name, lambda: Items(sent.value, window))
            for batch, texts in slices(batches, text, SHARD_BYTES):
                found = scan(texts, items)
                hits, names, most, best = ([f[i] for f in found] for i in (1, 2, 3, 4))
                if not first:
                    old = batch.to_pydict()
                    hits = [merged([*h, *map(tuple, o)]) for h, o in zip(hits, old["hits"], strict=True)]
                    names = [sorted({*n, *o}) for n, o in zip(names, old["items"], strict=True)]
                    most = [max(m, o) for m, o in zip(most, old["longest_match"], strict=True)]
                    best = [longer(tuple(o.values()) if o else None, b) for b, o in zip(best, old["longest"], strict=True)]
                yield extended(batch, keep, {
                    "n_words": pa.array([f[0] for f in found], pa.int64()),
                    "longest_match": pa.array(most, pa.int64()),
                    "hits": pa.array([[list(s) for s in h] for h in hits], pa.list_(pa.list_(pa.int64()))),
                    "items": pa.array(names, pa.list_(pa.string())),
                    "longest": pa.array([b and dict(zip(("words", "at", "item", "item_at"), b, strict=True)) for b in best], pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())])),
                })

        out = out.mapInArrow(run, state)
        if n > 1:  # the next block comes when this one is done with
            before, scratch.gone = scratch.gone, []
            out = scratch.put(out, stay=k == n - 1)
            for path in before:
                deleted(spark, path)
            sent.destroy()
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    out = out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))
    return out.select(*keep, *OWN)


def longer(a: tuple | None, b: tuple | None) -> tuple | None:
    """The match of more words; of equal ones the earlier, then the one of the smaller item."""
    return min(filter(None, (a, b)), key=lambda m: (-m[0], m[1], m[2], m[3]), default=None)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns only."""
    keep = without(docs, OWN)
    return measure(docs, benchmark, **options).filter(~F.col("contaminated")).select(*keep)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
