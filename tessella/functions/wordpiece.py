"""WordPiece tokens with their places in the source text.

A text is normalised as uncased models expect it: control characters go, white space becomes a blank, ideographs
stand alone, letters lose case and accents. Every normalised character remembers the source character it came
from, so that a token's place is a span of the source. Words are cut by longest matches in a trie of the vocabulary.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .batches import sliced

#: Characters of a word beyond which it is unknown; entries of a vocabulary that are read.
LONGEST, MOST = 100, 1 << 20
UNKNOWN, CONTINUED = "[UNK]", "##"
#: Texts that a task cuts at a time, and their bytes (one longer text is cut alone).
TEXTS, BYTES = 1024, 1 << 18
#: What stands between blanks is cut once and remembered up to so many characters, the latest so often.
SHORT, REMEMBERED = 40, 1 << 15
_BETWEEN, _PRINTED, _PLAIN = re.compile("[^ \\t\\n\\r]+"), re.compile("[!-~]+"), re.compile("[a-z0-9]+|[^a-z0-9]")

#: Blocks of ideographs that are words of their own.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))

_BLANK, _GONE, _ALONE = 0, 1, 2


@lru_cache(1 << 16)
def _kind(c: str) -> int | str:
    """A blank, a character that goes, one that is a word of its own, or what takes its place."""
    if c in " \t\n\r" or unicodedata.category(c) == "Zs" or c.isspace() and c not in "\x1c\x1d\x1e\x1f\x85  ":
        return _BLANK
    if c in "\0�" or unicodedata.category(c) in ("Cc", "Cf", "Cn", "Co", "Cs"):
        return _GONE
    if c in "  ":
        return _BLANK
    plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()
    point = ord(c)
    if any(a <= point <= b for a, b in IDEOGRAPHS) or point < 128 and not c.isalnum() or unicodedata.category(c).startswith("P"):
        return _ALONE
    return plain


def words(text: str) -> Iterator[tuple[str, list[int]]]:
    """Normalised words with the source place of each of their characters; of one that is longer than any known, its end is kept and what it takes to be unknown."""
    word, places = [], []
    for at, c in enumerate(text):
        kind = _kind(c)
        if kind == _GONE:
            continue
        if kind in (_BLANK, _ALONE):
            if word:
                yield "".join(word), places
                word, places = [], []
            if kind == _ALONE:
                alone = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()
                yield alone, [at] * len(alone)
            continue
        if len(places) > LONGEST:
            if kind:
                places[-1] = at
            continue
        word.append(kind)
        places += [at] * len(kind)
    if word:
        yield "".join(word), places


class Vocabulary:
    """Ids of pieces in their order, as two tries: one for beginnings of words, one for what follows."""

    def __init__(self, pieces: Iterable[str]):
        self.begin: dict = {}
        self.follow: dict = {}
        self.unknown = 0
        for k, piece in enumerate(pieces):
            if piece == UNKNOWN:
                self.unknown = k
                continue
            node, rest = (self.follow, piece[len(CONTINUED) :]) if piece.startswith(CONTINUED) and piece != CONTINUED else (self.begin, piece)
            for c in rest:
                node = node.setdefault(c, {})
            node[""] = k
        self._remembered = lru_cache(REMEMBERED)(self._chunk)

    def cut(self, word: str) -> list[tuple[int, int, int]]:
        """(id, first, end) of a word's pieces by longest matches; the whole word is unknown if some of it matches nothing."""
        out, at, trie = [], 0, self.begin
        if len(word) > LONGEST:
            return [(self.unknown, 0, len(word))]
        while at < len(word):
            node, k, found = trie, at, None
            while k < len(word) and (node := node.get(word[k])) is not None:
                k += 1
                if "" in node:
                    found = (node[""], at, k)
            if found is None:
                return [(self.unknown, 0, len(word))]
            out.append(found)
            at, trie = found[2], self.follow
        return out

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of all pieces; places are characters of the source, the end exclusive."""
        return [(piece, places[a], places[b - 1] + 1) for word, places in words(text) for piece, a, b in self.cut(word)]

    def _parts(self, chunk: str) -> Iterator[tuple[list[int], list[int]]]:
        """Begins and ends of the pieces of each word in a chunk."""
        if _PRINTED.fullmatch(chunk):
            # Letters and digits keep their places, all else stands alone.
            for m in _PLAIN.finditer(chunk.lower()):
                at, cut = m.start(), self.cut(m[0])
                yield [at + a for _, a, _ in cut], [at + b for _, _, b in cut]
        else:
            for word, places in words(chunk):
                cut = self.cut(word)
                yield [places[a] for _, a, _ in cut], [places[b - 1] + 1 for _, _, b in cut]

    def _chunk(self, chunk: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        begins, ends = [], []
        for b, e in self._parts(chunk):
            begins += b
            ends += e
        return tuple(begins), tuple(ends)

    def places(self, text: str) -> Iterator[tuple[int, tuple[int, ...] | list[int], tuple[int, ...] | list[int]]]:
        """Where the pieces of ``encode`` begin and end, from a place of the text on; blanks end words, so that what is between them is cut for itself."""
        for m in _BETWEEN.finditer(text):
            if m.end() - m.start() <= SHORT:
                yield m.start(), *self._remembered(m[0])
            else:
                for begins, ends in self._parts(m[0]):
                    yield m.start(), begins, ends

    def windows(self, text: str, size: int, overlap: int) -> list[tuple[int, int, int, int]]:
        """(first piece, pieces, begin, end) of the windows of a text, as ``chunks.starts`` has them; pieces are counted, not kept."""
        step, n, last = size - overlap, 0, 0
        begins, ends = array("q"), array("q")
        first, end = 0, size - 1
        for at, b, e in self.places(text):
            if not b:
                continue
            beyond = n + len(b)
            while first < beyond:
                begins.append(at + b[first - n])
                first += step
            while end < beyond:
                ends.append(at + e[end - n])
                end += step
            n, last = beyond, at + e[-1]
        count = 0 if not n else 1 if n <= size else -(-(n - size) // step) + 1
        return [(k * step, min(size, n - k * step), begins[k], ends[k] if k < len(ends) else last) for k in range(count)]


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """The pieces of a vocabulary file, one a line; their number is checked, since they go to every task."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    pieces = rows[0][0].rstrip("\n").split("\n") if len(rows) == 1 else []
    if not 0 < len(pieces) <= MOST:
        raise ValueError(f"a vocabulary is one file of 1 to {MOST} pieces")
    return pieces


def _texts(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Small parts of batches with their texts."""
    for batch in batches:
        column = batch.schema.get_field_index(text)
        for part in sliced(batch, pc.binary_length(batch.column(column)), BYTES, TEXTS):
            yield part, part.column(column).to_pylist()


def tokenized(rows: DataFrame, pieces: list[str], text: str = "text", name: str = "pieces") -> DataFrame:
    """Rows with an array of (id, begin, end); null and empty texts have none."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(pieces)
    kept = [c for c in rows.columns if c != name]

    def run(batches):
        vocabulary = Vocabulary(sent.value)
        for part, texts in _texts(batches, text):
            found = [vocabulary.encode(t or "") for t in texts]
            starts = [0]
            for f in found:
                starts.append(starts[-1] + len(f))
            flat = [x for f in found for x in f]
            fields = [pa.array([x[k] for x in flat], pa.int32()) for k in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(fields, names=["id", "begin", "end"]))
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], lists], names=[*kept, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return rows.select(*kept).mapInArrow(run, f"{kinds}, `{name}` array<struct<id:int,begin:int,end:int>>")


def windows(rows: DataFrame, pieces: list[str], text: str = "text", *, size: int, overlap: int) -> DataFrame:
    """A row for each window of tokens of a text: chunk, first (from 0), n_tokens, begin, end, window (cut from the source as it is).

    Windows are cut where the text is, so that its tokens travel nowhere.
    """
    if overlap >= size:
        raise ValueError("the overlap has to be smaller than the window")
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(pieces)
    names, numbers = rows.columns, ["chunk", "first", "n_tokens", "begin", "end"]

    def run(batches):
        vocabulary = Vocabulary(sent.value)
        for part, texts in _texts(batches, text):
            starts, fields, cut = [0], [array("i") for _ in numbers], []
            for t in texts:
                for chunk, found in enumerate(vocabulary.windows(t or "", size, overlap)):
                    for field, x in zip(fields, (chunk, *found), strict=True):
                        field.append(x)
                    cut.append(t[found[2] : found[3]])
                starts.append(len(cut))
            own = pa.StructArray.from_arrays([*[pa.array(f, pa.int32()) for f in fields], pa.array(cut, pa.string())], names=[*numbers, "window"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), own)], names=[*names, "_windows"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    inside = ", ".join(f"{c}: int" for c in numbers)
    out = rows.mapInArrow(run, f"{kinds}, `_windows` array<struct<{inside}, window: string>>")
    return out.select(*names, F.explode("_windows").alias("_w")).select(*names, "_w.*")
