"""Stored postings: an inverted table in blocks that carry score bounds, read only where a query's best rows can be.

A row of the table is a lexeme's block: up to about ``BLOCK`` passages of one chapter with their places, and how
often the lexeme stands in one of them at most. All lexemes of a segment share their blocks, so that the
bounds of a query's lexemes add up to what any passage of a block can score. The table is cut into folders by a
hash of the lexeme and sorted inside them; a query opens the folders of its lexemes only.

A search first ranks the passages of the few blocks with the highest bounds. Their K-th score is one that the
K-th best passage reaches at least; blocks with a lower bound are never ranked. The result is that of ranking all.

Passages come in segments (see ``segments``): a later one's passage takes the place of an earlier one's, as do
tombstones. Bounds hold for replaced passages too; they only make a block worth looking at.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import expr as E
from ..functions import lexical
from ..functions.batches import sliced
from ..session import few, ship
from .files import read_text, write_text
from .segments import KEY, Segments

BLOCK, BUCKETS = 128, 64
#: Texts that a task cuts at a time, and their bytes (one longer text is cut alone).
TEXTS, BYTES = 256, 1 << 19
#: Blocks that are ranked first for each block's worth of results, and how many times more if the filters leave too few passages.
FIRST, MORE = 3, 8
#: Blocks of a chapter and size.
_PARTS = 1 << 24
#: Blocks of an index of which all are ranked at once: looking for bounds first would take longer.
SMALL = 512
#: Blocks whose bounds the driver may hold, and chapters that a filter names one by one when it is pushed to the files.
KNOWN, NAMED = 10_000, 1000
#: What sums of bounds and scores may differ by in double precision.
SLACK = 1e-6

_PLAIN = re.compile("[a-z0-9]+")


def gathered(cut):
    """From rows (keys, text) to (keys, lexeme, places), a row for each lexeme of a text; ``cut`` gives lexemes with their places.

    Only the lexemes of a few texts are held, however many rows a batch has.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, pc.binary_length(batch.column(batch.num_columns - 1)), BYTES, TEXTS):
                row, words, starts, flat = [], [], [0], array("i")
                for k, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    at: dict[str, list[int]] = {}
                    for word, place in cut(text):
                        at.setdefault(word, []).append(place)
                    row += [k] * len(at)
                    words += at
                    for places in at.values():
                        flat.extend(places)
                        starts.append(len(flat))
                keys = part.select(part.schema.names[:-1]).take(pa.array(row, pa.int64()))
                places = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(words, pa.string()), places], names=[*keys.schema.names, "lexeme", "places"])

    return run


def _plain(text: str | None) -> list[tuple[str, int]]:
    return [(w, k) for k, w in enumerate(_PLAIN.findall(text or ""), 1)]


class English:
    """Full-text ranks: stems, phrases and cover density."""

    def __init__(self, query: str):
        self.q = lexical.parse(query)
        self.terms, self.words = len(self.q.terms), sorted(lexical.wanted(self.q))

    cut = staticmethod(lexical.lexemes)

    @staticmethod
    def text(passages: DataFrame) -> Column:
        return lexical.searchable(*[c if c in passages.columns else F.lit("") for c in ("heading_path", "chapter_section", "text")])

    def overlap(self, most: dict[str, Column]) -> Column:
        return sum(((most[w] > 0).cast("int") for w in self.q.any_of), F.lit(0))

    def bound(self, most: dict[str, Column]) -> Column:
        """What 3 * phrase + 2 * strict + recall can be at most for a passage in which lexemes stand so often at most."""

        def places(phrase: lexical.Phrase) -> Column:
            few_ = [most[w] for w in dict.fromkeys(phrase)]
            return F.least(*few_) if len(few_) > 1 else few_[0]

        phrase = places(self.q.phrase) if self.q.phrase else F.lit(0)
        strict = F.lit(0)
        for required, _ in self.q.clauses:
            if required:
                # Covers begin at different places, each of which is one of a part's.
                every = reduce(lambda a, b: a & b, (places(p) > 0 for p in required))
                strict = strict + F.when(every, sum((places(p) for p in required), F.lit(0))).otherwise(0)
        recall = sum((most[w] for w in dict.fromkeys(self.q.any_of)), F.lit(0))
        return (phrase * 3 + strict * 2 + recall) * 0.1

    def ranked(self, docs: DataFrame) -> DataFrame:
        """From (nbk_id, passage_id, lexeme, places) to the columns of ``search.term_ranks``."""
        flat = F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(F.col("lexeme").alias("lexeme"), p.alias("place")))))
        out = docs.groupBy(*KEY).agg(flat.alias("x")).withColumn("r", lexical.rank_column(self.q, "x"))
        return out.select("nbk_id", "passage_id", F.col("r.phrase").alias("phrase_rank"), F.col("r.strict").alias("strict_rank"), F.col("r.recall").alias("recall_rank"), F.col("r.overlap").alias("recall_overlap_count"))


class Plain:
    """Counts of plain words, as ``search.term_ranks`` has them."""

    def __init__(self, query: str):
        self.named = list(dict.fromkeys(w for w in _PLAIN.findall(query.lower()) if len(w) >= 3 and w not in C.STOP_WORDS))
        self.terms, self.words = len(self.named), sorted(self.named)

    cut = staticmethod(_plain)

    @staticmethod
    def text(passages: DataFrame) -> Column:
        return F.lower("text")

    def overlap(self, most: dict[str, Column]) -> Column:
        return sum(((most[w] > 0).cast("int") for w in self.named), F.lit(0))

    def bound(self, most: dict[str, Column]) -> Column:
        each = [most[w] for w in self.named]
        least = F.least(*each) if len(each) > 1 else each[0] if each else F.lit(0)
        return (least * 5 + sum(each, F.lit(0))) * 0.1

    def ranked(self, docs: DataFrame) -> DataFrame:
        # A passage has one row for each lexeme.
        places = lambda w: F.coalesce(F.max(F.when(F.col("lexeme") == w, F.col("places"))), F.array().cast("array<int>"))
        out = docs.groupBy(*KEY).agg(F.array(*[places(w) for w in self.named]).alias("at"))
        n = [F.size(F.get("at", F.lit(k))) for k in range(self.terms)]
        # Where the first word is followed by all others in order.
        starts = F.get("at", F.lit(0))
        for k in range(1, self.terms):
            starts = F.array_intersect(starts, F.transform(F.get("at", F.lit(k)), lambda p: p - k))  # noqa: B023
        least = F.least(*n) if len(n) > 1 else n[0] if n else F.lit(0)
        return out.select(
            "nbk_id", "passage_id", ((F.size(starts) if n else F.lit(0)) * F.lit(0.1)).alias("phrase_rank"), (least * F.lit(0.1)).alias("strict_rank"),
            (sum(n, F.lit(0)) * F.lit(0.1)).alias("recall_rank"), sum(((x > 0).cast("int") for x in n), F.lit(0)).alias("recall_overlap_count"),
        )


KINDS = {"english": English, "plain": Plain}


@dataclass
class Found:
    """The best passages, and of how many blocks how many were ranked (-1: all, uncounted)."""

    rows: DataFrame
    blocks: int
    ranked: int


class Index:
    """The postings under a folder that all executors share; open one with ``opened``, make one with ``created``."""

    def __init__(self, spark: SparkSession, root: str, kind: str, buckets: int, block: int):
        self.spark, self.root, self.kind, self.buckets, self.block = spark, root.rstrip("/"), kind, buckets, block
        self.segments, self._schema = Segments(spark, root, "postings"), None

    def add(self, passages: DataFrame, *, batch: int | None = None, unique: bool = False) -> bool:
        """Index passages (nbk_id, passage_id and what is searched) as a new segment; False if the batch is there already.

        Passages that are there already are replaced. Of rows with the same key the greatest text counts, unless keys are said to
        be ``unique``. Rows without a key are left out.
        """
        if self.segments.has(batch):
            return False
        ship(self.spark)
        rows = passages.filter("nbk_id is not null and passage_id is not null")
        if not unique:
            searched = [c for c in ("text", "heading_path", "chapter_section") if c in rows.columns]
            rows = rows.groupBy(*KEY).agg(F.max(F.struct(*searched)).alias("_s")).select(*KEY, "_s.*")
        number = self.segments.next()
        # Characters decide the size, so that it is known before lexemes are.
        size = F.length(F.bin(F.coalesce(F.length("text"), F.lit(0)).cast("long"))).cast("int").alias("size")
        keys = self.segments.write_keys(rows.select(*KEY, size), number, "size")
        own = KINDS[self.kind]
        texts = rows.select(*KEY, size, own.text(rows).alias("text"))
        kinds = ", ".join(f"{c} {t}" for c, t in texts.dtypes[:-1])
        self._file(texts.mapInArrow(gathered(own.cut), f"{kinds}, lexeme string, places array<int>"), keys, number)
        self.segments.mark(number, [batch] if batch is not None else [], blocks=self._blocks(keys))
        return True

    def _blocks(self, keys: DataFrame) -> int:
        return keys.groupBy("nbk_id", "size").agg(F.ceil(F.count("*") / self.block).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def compact(self) -> None:
        """One segment of all that is visible takes the place of the segments."""
        marks = self.segments.marks()
        if len(marks) > 1:
            number = self.segments.next()
            keys = self.segments.write_keys(self.segments.live_keys("size"), number, "size")
            rows = self._entries(self.segments.rows(self.schema()), F.floor(F.col("part") / _PARTS).cast("int").alias("size"))
            self._file(rows, keys, number)
            self.segments.replace(number, marks, blocks=self._blocks(keys))

    def _file(self, rows: DataFrame, keys: DataFrame, number: int) -> None:
        """Write (nbk_id, passage_id, size, lexeme, places) as blocks.

        A block holds passages of one chapter and of sizes within a factor of two, so that bounds are close to what its passages
        reach; more of them than a block has are cut by a hash of their ids.
        """
        parts = few(keys.groupBy("nbk_id", "size").agg(F.ceil(F.count("*") / self.block).cast("int").alias("parts")))
        cut = rows.join(parts, ["nbk_id", "size"]).withColumn("part", F.col("size") * _PARTS + F.pmod(F.xxhash64("passage_id"), F.least("parts", F.lit(_PARTS))).cast("int"))
        blocks = cut.groupBy("lexeme", "nbk_id", "part").agg(F.max(F.size("places")).alias("most"), F.sort_array(F.collect_list(F.struct("passage_id", "places"))).alias("entries"))
        blocks = blocks.withColumn("bucket", F.pmod(F.crc32(F.encode("lexeme", "UTF-8")), F.lit(self.buckets)).cast("int"))
        # By range, so that a lexeme of most passages is dealt to several tasks and files.
        dealt = blocks.repartitionByRange("bucket", "lexeme", "nbk_id", "part").sortWithinPartitions("bucket", "lexeme", "nbk_id", "part")
        dealt.write.mode("overwrite").partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{self.root}/postings/segment={number}")

    def schema(self) -> T.StructType:
        """Of the stored rows; ids have the types that they had in the first segment."""
        if self._schema is None:
            own = self.spark.read.parquet(f"{self.root}/keys/segment={self.segments.marks()[0]['segment']}").schema
            entry = T.StructType([own["passage_id"], T.StructField("places", T.ArrayType(T.IntegerType()))])
            kinds = [("lexeme", T.StringType()), ("nbk_id", own["nbk_id"].dataType), ("part", T.IntegerType()), ("most", T.IntegerType()), ("entries", T.ArrayType(entry)), ("segment", T.IntegerType()), ("bucket", T.IntegerType())]
            self._schema = T.StructType([T.StructField(n, t) for n, t in kinds])
        return self._schema

    def _entries(self, rows: DataFrame, *more: Column) -> DataFrame:
        each = rows.select("segment", "lexeme", "nbk_id", *more, F.explode("entries").alias("e"))
        return self.segments.alive(each.select("*", "e.*").drop("e")).drop("segment")

    def lexemes(self) -> DataFrame:
        """(nbk_id, passage_id, lexeme, places) of all that is visible."""
        return self._entries(self.segments.rows(self.schema()))

    def rows_of(self, words: Sequence[str]) -> DataFrame:
        """Blocks of some lexemes; other folders aren't opened, other lexemes of these folders are passed over by the files' statistics."""
        buckets = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        return self.segments.rows(self.schema(), [f"bucket={b}" for b in buckets]).filter(F.col("lexeme").isin(list(words)))

    def bounds(self, asked: English | Plain) -> DataFrame:
        """(segment, nbk_id, part, bound) of the blocks that may hold a passage with enough of the terms."""
        most = self.rows_of(asked.words).groupBy("segment", "nbk_id", "part").agg(*[F.coalesce(F.max(F.when(F.col("lexeme") == w, F.col("most"))), F.lit(0)).alias(f"m{k}") for k, w in enumerate(asked.words)])
        by = {w: F.col(f"m{k}") for k, w in enumerate(asked.words)}
        some = most.filter(E.enough_overlap(asked.overlap(by), F.lit(asked.terms)))
        return some.select("segment", "nbk_id", "part", asked.bound(by).alias("bound"))

    def ranks(self, asked: English | Plain, blocks: DataFrame | None = None, chapters: list | None = None) -> DataFrame:
        """Ranks of the passages of some blocks, or of all that hold one of the lexemes."""
        if not asked.words:
            return self._none(self.segments.live_keys())
        rows = self.rows_of(asked.words)
        if chapters is not None:
            rows = rows.filter(F.col("nbk_id").isin(chapters))
        if blocks is not None:
            rows = rows.join(blocks, ["segment", "nbk_id", "part"], "left_semi")
        return asked.ranked(self._entries(rows))

    def top(self, query: str, within: DataFrame, k: int, *, chapters: DataFrame | None = None) -> Found:
        """The ``k`` best of the passages ``within`` (nbk_id, passage_id, char_count, and more), in the order of ``search.lexical_top``.

        ``chapters`` (nbk_id), if given, are those that the filters leave: blocks of others are passed over.
        """
        asked = KINDS[self.kind](query)
        if not asked.words or not self.segments.filled():
            return Found(self._scored(within.limit(0), self._none(within), asked), 0, 0)
        if sum(m.get("blocks", 0) for m in self.segments.marks()) <= SMALL:
            rows = self._scored(within, self.ranks(asked), asked)
            return Found(rows.orderBy(F.desc("lexical_rank"), "nbk_id", "passage_id").limit(k), -1, -1)
        blocks = self.bounds(asked)
        if chapters is not None:
            blocks = blocks.join(chapters, "nbk_id", "left_semi")
        order = [F.desc("bound"), "segment", "nbk_id", "part"]
        known = blocks.orderBy(*order).limit(KNOWN + 1).collect()
        if len(known) > KNOWN:
            total, highest = blocks.count(), lambda n: blocks.orderBy(*order).limit(n)
        else:
            total, highest = len(known), lambda n: self.spark.createDataFrame(known[:n], blocks.schema)
        most, least = FIRST * -(-k // self.block), None
        while most < total:
            best = self._scored(within, self.ranks(asked, highest(most)), asked).orderBy(F.desc("lexical_rank")).limit(k).agg(F.count("*").alias("n"), F.min("lexical_rank").alias("s")).first()
            if best["n"] == k:
                least = best["s"] - SLACK
                break
            most *= MORE
        if len(known) > KNOWN:
            needed = blocks if least is None else blocks.filter(F.col("bound") >= least)
            ranked, named = needed.count(), None
        else:
            some = [b for b in known if least is None or b["bound"] >= least]
            needed, ranked, named = self.spark.createDataFrame(some, blocks.schema), len(some), {b["nbk_id"] for b in some}
        rows = self._scored(within, self.ranks(asked, needed, list(named) if named and len(named) <= NAMED else None), asked)
        return Found(rows.orderBy(F.desc("lexical_rank"), "nbk_id", "passage_id").limit(k), total, ranked)

    def _none(self, within: DataFrame) -> DataFrame:
        empty = within.select("nbk_id", "passage_id").limit(0)
        return empty.select("*", *[F.lit(0.0).alias(c) for c in ("phrase_rank", "strict_rank", "recall_rank")], F.lit(0).alias("recall_overlap_count"))

    @staticmethod
    def _scored(within: DataFrame, ranks: DataFrame, asked: English | Plain) -> DataFrame:
        rows = within.join(ranks, ["nbk_id", "passage_id"]).filter(E.enough_overlap(F.col("recall_overlap_count"), F.lit(asked.terms)))
        score = E.lexical_score(F.col("phrase_rank"), F.col("strict_rank"), F.col("recall_rank"), F.lit(asked.terms), F.col("recall_overlap_count"), F.col("char_count"))
        return rows.withColumn("lexical_rank", score)


def created(spark: SparkSession, root: str, *, kind: str = "english", buckets: int = BUCKETS, block: int = BLOCK) -> Index:
    """An empty index; ``kind`` is english (stems, cover density) or plain (counts of words)."""
    if kind not in KINDS:
        raise ValueError("an index is english or plain")
    write_text(spark, f"{root.rstrip('/')}/index.json", json.dumps({"kind": kind, "buckets": buckets, "block": block}))
    return Index(spark, root, kind, buckets, block)


def opened(spark: SparkSession, root: str) -> Index:
    return Index(spark, root, **json.loads(read_text(spark, f"{root.rstrip('/')}/index.json")))
