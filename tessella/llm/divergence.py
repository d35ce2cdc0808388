"""How the sources of a language differ in their words, from dense blocks of terms.

Every task counts words by source; counts add up to (lang, source, term). A language's kept terms are dealt
into blocks. A block becomes a dense matrix of counts, groups by terms, that also has the zeros; all pairs
of its groups are compared at once by broadcasting, in 64-bit integers. Blocks add up to the sums of pairs,
and each block's best terms of a group to the group's best.

A language of more sources than ``GROUPS`` is cut into bands of sources, each two of which meet in a tile.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, few
from .runs import runs

#: Documents of a language that a term needs; ranks of terms.
DOCUMENTS, RANKS = 3, 200
#: Terms of a block and sources of a band: a tile has 2 bands at most.
TERMS, GROUPS = 1024, 128
#: Counts that a task holds before it gives them away.
HELD = 200_000
#: Cells of a step of all pairs.
CELLS = 1 << 21

#: Letters of ASCII in lower case and all bytes of other characters stay, the rest parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of characters that are letters of ASCII or not of ASCII; A-Z as a-z."""
    return text.translate(_LETTERS).split()


def counted(batches) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df): occurrences and documents; a null term stands for the group itself."""
    groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in groups.items():
            count = len(n) + 1
            columns = [pa.array([lang] * count, pa.binary()), pa.array([source] * count, pa.binary()), pa.array([None, *n], pa.binary())]
            numbers = [pa.array([0, *n.values()], pa.int64()), pa.array([0, *[df[t] for t in n]], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[c.cast(pa.string()) for c in columns], *numbers], names=["lang", "source", "term", "n", "df"])

    for batch in batches:
        lang, source, text = (batch.column(k).cast(pa.binary()) for k in range(3))
        for i in range(batch.num_rows):
            n, df = groups.setdefault((lang[i].as_py(), source[i].as_py()), (Counter(), Counter()))
            words, before = terms(text[i].as_py()), len(n)
            n.update(words)
            df.update(set(words))
            size += len(n) - before + 1
            if size > HELD:
                yield from given()
                groups.clear()
                size = 0
    yield from given()


def share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(1000000000 * (count + 1) / of), divided in steps of a thousand so that no product passes 64 bits."""
    out, left = np.divmod(count + 1, of)
    for _ in range(3):
        more, left = np.divmod(left * 1000, of)
        out = out * 1000 + more
    return out + 1


class Pairs:
    """Sums over blocks for two bands of a language: rows of ``a`` against rows of ``b``."""

    def __init__(self, a: list[str], b: list[str]):
        self.a, self.b, self.sums = a, b, np.zeros((len(a), len(b)), np.int64)

    def add(self, p: np.ndarray, q: np.ndarray, times: int = 1) -> None:
        if not p.shape[1] or not times:
            return
        step = max(1, CELLS // max(1, q.size))
        for at in range(0, len(p), step):
            self.sums[at : at + step] += ((p[at : at + step, None] - q) ** 2 // q).sum(2) * times


def compared(ranks: int):
    """From tiles, sorted by key: sums of pairs (item is a source), and the first terms of each group."""
    names = ["lang", "source", "part", "item", "value"]

    def rows(lang, source, part, item, value) -> pa.RecordBatch:
        n = len(item)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, Pairs] = {}
        best: dict[tuple[str, str], list[tuple[int, str]]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, *_), pairs in sums.items():
                for k, a in enumerate(pairs.a):
                    yield rows(lang, [a] * (len(pairs.b)), "pair", pairs.b, pairs.sums[k])
            for (lang, source), found in best.items():
                yield rows(lang, [source] * len(found), "term", [t for _, t in found], [-v for v, _ in found])

        for tiles in runs(batches, ["k"]):
            for (lang, _, i, j), tile in tiles.drop_columns(["k"]).to_pandas().groupby(["lang", "t", "i", "j"], sort=False):
                head = tile[tile.term.isna()].sort_values("source")
                cells = tile[tile.term.notna()]
                words = np.array(sorted(cells.term.unique()), object)
                at = {s: k for k, s in enumerate(head.source)}
                count = np.zeros((len(head), len(words)), np.int64)
                total = np.zeros(len(words), np.int64)
                column = np.searchsorted(words, cells.term.to_numpy(object)) if len(cells) else np.zeros(0, np.int64)
                count[cells.source.map(at).to_numpy(np.int64), column] = cells.n.to_numpy(np.int64)
                total[column] = cells.total.to_numpy(np.int64)
                of = np.maximum((head.n + head.v).to_numpy(np.int64)[:, None], 1)
                p = share(count, of)
                # Terms of the block that neither band holds: the same shares for all of them.
                none = share(np.zeros((len(head), 1), np.int64), of)
                band = head.b.to_numpy()
                for a, b in {(i, j), (j, i)}:
                    names_a, names_b = head.source[band == a].tolist(), head.source[band == b].tolist()
                    pairs = sums.setdefault((lang, a, b), Pairs(names_a, names_b))
                    pairs.add(p[band == a], p[band == b])
                    pairs.add(none[band == a], none[band == b], int(head.size_.iloc[0]) - len(words))
                if i == j:
                    q = share(total, np.int64(head.total.iloc[0] + head.v.iloc[0]))
                    value = (p - q) ** 2 // q
                    for k, source in enumerate(head.source):
                        some = np.flatnonzero((count[k] > 0) & (p[k] > q))
                        # Terms stand in their order, so that a stable sort settles ties.
                        some = some[np.argsort(-value[k][some], kind="stable")[:ranks]]
                        found = best.get((lang, source), []) + [(-int(value[k][c]), words[c]) for c in some]
                        best[lang, source] = sorted(found)[:ranks]
                if len(sums) > 32 or len(best) > 4 * GROUPS:
                    yield from given()
                    sums.clear()
                    best.clear()
        yield from given()

    return run


def audited(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against every other one of its language, and its own terms.

    A language keeps the terms that ``least`` of its rows hold. With p and q the smoothed shares (in 10^9) of a term,
    part ``pair`` sums floor((p - q)^2 / q) over all kept terms for every other source, part ``term`` has the terms
    of a source that it holds and uses more often than its language does, up to rank ``ranks``. Null texts, languages and
    sources are empty strings. Groups without terms and languages without kept terms have their pairs too. Repeated
    rows count as often as they stand. Texts of any length are read whole (one has to fit a task). Ties go by the
    item's UTF-8. An empty table gives an empty one; other columns aren't read, so that their names can't clash.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    with scratch:
        some = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
        each = some.mapInArrow(counted, "lang string, source string, term string, n long, df long")
        counts = scratch.put(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
        kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).filter(F.col("df") >= least)
        kept = scratch.put(kept.drop("df"))
        cells = scratch.put(counts.drop("df").join(kept, ["lang", "term"]))
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("total"))
        groups = counts.filter("term is null").select("lang", "source")
        langs = groups.groupBy("lang").agg(F.count("*").alias("g")).join(langs, "lang", "left").fillna(0, ["v", "total"])
        langs = langs.withColumn("_t", F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("int")).withColumn("_g", F.ceil(F.col("g") / GROUPS).cast("int"))
        langs = few(scratch.put(langs.drop("g")))
        block = F.pmod(F.xxhash64("term"), F.col("_t")).cast("int")
        sizes = few(scratch.put(kept.join(langs, "lang").groupBy("lang", block.alias("t")).agg(F.count("*").alias("size_"))))
        own = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        head = groups.join(own, ["lang", "source"], "left").fillna(0, ["n"]).join(langs, "lang")
        head = head.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("_t") - 1))).join(sizes, ["lang", "t"], "left").fillna(0, ["size_"]).withColumn("term", F.lit(None).cast("string"))
        body = cells.join(langs.select("lang", "_t", "_g"), "lang").withColumn("t", block).withColumn("v", F.lit(None).cast("long")).withColumn("size_", F.col("v"))
        columns = ["lang", "t", "source", "term", "n", "total", "v", "size_", "_g"]
        tiles = head.select(*columns).unionByName(body.select(*columns)).withColumn("b", F.pmod(F.xxhash64("source"), F.col("_g")).cast("int"))
        tiles = tiles.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1))).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
        tiles = tiles.withColumn("k", F.xxhash64("lang", "t", "i", "j")).repartition("k").sortWithinPartitions("k")
        parts = tiles.select("k", "lang", "t", "i", "j", "b", "source", "term", "n", "total", "v", "size_").mapInArrow(compared(ranks), "lang string, source string, part string, item string, value long")
        parts = scratch.put(parts, stay=True)
    pairs = parts.filter("part = 'pair' and source != item").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
