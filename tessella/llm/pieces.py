"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

An Aho-Corasick pass finds the longest piece that begins at each character. Pieces are then laid
greedily from the left; a piece is accepted if re-merging it with the piece before it gives back the
same two pieces, else the next shorter piece is tried, and when none is left the last piece is taken
back and its end marked in a bitfield of failed positions. A sequence all of whose neighbours are
compatible in this sense is the one that merging the whole text would make.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import KEY, extended, held, slices, without

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries of a generation of a worker's memo.
MEMO = 200_000
OWN = ["n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]


class Model:
    """The vocabulary and rules of a serialized model."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto.FromString(serialized)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalization and escaped blanks, none of them dropped, are handled")
        if any(p.type in (USER_DEFINED, UNUSED) for p in m.pieces):
            raise ValueError("models with user-defined or unused pieces are not handled")
        self.prefix = n.add_dummy_prefix
        self.text = [p.piece for p in m.pieces]
        self.kind = [p.type for p in m.pieces]
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.unknown = next((i for i, k in enumerate(self.kind) if k == UNKNOWN), 0)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.raw = {i: b for b, i in self.bytes.items()}
        self.surface = m.trainer_spec.unk_surface or " ⁇ "
        self.letters = {c for p in self.id for c in p}
        #: Whether no piece goes on into a blank: then each blank run begins a part that merges by itself.
        self.apart = not any(BLANK in p.lstrip(BLANK) for p in self.id)
        self.parts = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.size = len(self.text)
        known = {p: i for p, i in self.id.items() if self.merge(p) == [p]}
        #: Characters less one of each piece.
        self.last = [len(p) - 1 for p in self.text]
        self.tree = ahocorasick.Automaton()
        for p, i in known.items():
            if len(p) > 1:
                self.tree.add_word(p, i)
        self.tree.make_automaton()
        #: The longest piece, or else the character, that a piece begins with.
        self.shorter = [-1] * self.size
        for p, i in known.items():
            if len(p) > 1:
                self.shorter[i] = next((known[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in known), self.letter(p[0]))
        self.fits: dict[int, bool] = {}

    def letter(self, c: str) -> int:
        """The number of a single character: its id, or beyond the ids one for a character that is no piece."""
        i = self.id.get(c)
        return self.size + ord(c) if i is None else i

    def name(self, i: int) -> str:
        return self.text[i] if i < self.size else chr(i - self.size)

    def merge(self, text: str) -> list[str]:
        """The definition: join the best-scored neighbours, the leftmost of equals, until none can be joined."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces gives both back."""
        pair = left << 21 | right
        if (known := self.fits.get(pair)) is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            a, b = self.name(left), self.name(right)
            known = self.fits[pair] = self.merge(a + b) == [a, b]
        return known

    def split(self, text: str) -> list[int]:
        """The pieces of an escaped text, characters that are no piece by their number in ``letter``."""
        n, last, size, fits = len(text), self.last, self.size, self.fits
        longest = [-1] * n
        for end, i in self.tree.iter(text):
            longest[end - last[i]] = i
        failed = bytearray((n >> 3) + 1)
        any_failed = False
        out: list[int] = []
        at, before = 0, -1
        i = longest[0]
        if i < 0:
            i = self.letter(text[0])
        while True:
            end = at + 1 + (last[i] if i < size else 0)
            if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                ok = before < 0 or fits.get(before << 21 | i)
                if ok is None:
                    ok = self.compatible(before, i)
                if ok:
                    out.append(i)
                    if end == n:
                        return out
                    at, before = end, i
                    i = longest[at]
                    if i < 0:
                        i = self.letter(text[at])
                    continue
            i = self.shorter[i] if i < size else -1
            if i < 0:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                i = out.pop()
                at -= 1 + (last[i] if i < size else 0)
                before = out[-1] if out else -1

    def numbers(self, pieces: Iterable[int]) -> list[int]:
        """Ids of pieces; characters that are none by their bytes, or as unknown (a run of them once)."""
        out: list[int] = []
        for i in pieces:
            if i < self.size:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(i - self.size).encode("utf-8", "replace")]
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
        return out

    def encode_part(self, part: str) -> list[int]:
        return self.numbers(self.split(part))

    def escape(self, text: str) -> str:
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK) if text else ""

    def encode(self, text: str) -> list[int]:
        escaped = self.escape(text)
        parts = self.parts.findall(escaped) if self.apart else [escaped] if escaped else []
        return [i for p in parts for i in self.encode_part(p)]

    def piece_bytes(self, i: int) -> bytes:
        if i in self.raw:
            return bytes([self.raw[i]])
        if self.kind[i] == CONTROL:
            return b""
        return (self.surface if i == self.unknown else self.text[i].replace(BLANK, " ")).encode()

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces joined, bytes read as UTF-8 (each byte that is none becomes U+FFFD), the first piece's blank dropped."""
        out, run, first = [], bytearray(), True
        for i in [*ids, None]:
            if i is not None and i in self.raw:
                run.append(self.raw[i])
                first = False
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
            if i is None or self.kind[i] == CONTROL:
                continue
            text = self.piece_bytes(i).decode()
            if first and self.prefix and i != self.unknown and text.startswith(" "):
                text = text[1:]
            first = False
            out.append(text)
        return "".join(out)


def utf8(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every single byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Memo(dict):
    """Results of ``make`` in two generations of MEMO entries: what is asked for again outlives the rest. Long keys aren't kept."""

    def __init__(self, make, longest: int = KEY):
        self.make, self.longest, self.old = make, longest, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """A model with memos of the parts of texts it has seen: a part gives its ids as text, those give their bytes."""

    def __init__(self, serialized: bytes):
        self.model = model = Model(serialized)
        #: Lines can be cut off only if no piece holds a line break; then a part may begin with one.
        self.lines = model.apart and model.prefix and "\n" not in model.letters and bool(model.bytes)
        line = model.numbers([model.letter("\n")]) if self.lines else []

        def ids(word: str) -> str:
            if word[:1] == "\n":
                return ",".join(map(str, [*line, *(model.encode_part(word[1:]) if len(word) > 1 else [])]))
            return ",".join(map(str, model.encode_part(BLANK + word)))

        self.ids = Memo(ids)
        self.raw = Memo(lambda ids: b"".join(map(model.piece_bytes, map(int, ids.split(",")))), 4 * KEY)

    def run(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, the text decoded from them."""
        if not text:
            return 0, "", ""
        # One blank before every word and line break, so that blanks cut the text where its parts begin.
        plain = text.replace("\n", " \n")
        if self.lines and BLANK not in text and "  " not in plain and text[0] not in " \n" and text[-1] != " ":
            parts = list(map(self.ids.__getitem__, plain.split(" ")))
            ids = ",".join(parts)
            # All ids come from a text, so that their bytes are UTF-8; the first piece begins with the added blank.
            return ids.count(",") + 1, ids, b"".join(map(self.raw.__getitem__, parts))[1:].decode()
        numbers = self.model.encode(text)
        return len(numbers), ",".join(map(str, numbers)), self.model.decode(numbers)


#: Bytes of text that a task holds at once as Python objects.
SLICE = 4 << 20


def tokenized(docs: DataFrame, model_path: str, *, text: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """Each row with n_tokens, ids_sha256 and decoded_sha256; on demand with the ids and the decoded text.

    The ids are those of the model without begin or end ids; the digests are of the decimal ids joined by
    commas, and of the decoded text in UTF-8. A null text counts as empty: no ids, digests of nothing.
    Every row is handled by itself, so repeated rows and ids give repeated results, an empty table gives an
    empty one, and texts of any length that fits a task are encoded whole. Columns that clash
    with the results are replaced. ``model_path`` is read on the driver; a model is at most 64 MB.
    """
    with open(model_path, "rb") as f:
        serialized = f.read((64 << 20) + 1)
    if len(serialized) > 64 << 20:
        raise ValueError("the model is larger than 64 MB")
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(serialized)
    keep, serialized_name = without(docs, OWN), hashlib.sha256(serialized).hexdigest()
    extra = [("ids", T.StringType())] * ids + [("decoded", T.StringType())] * decoded
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *[T.StructField(*x) for x in extra]])

    def run(batches):
        own = held(serialized_name, lambda: Codec(sent.value))
        for batch, texts in slices(batches, text, SLICE):
            rows = []
            for t in texts:
                n, numbers, back = own.run(t.decode() if t else "")
                rows.append((n, hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), numbers if ids else None, back if decoded else None))
            values = {"n_tokens": pa.array([r[0] for r in rows], pa.int64()), "ids_sha256": pa.array([r[1] for r in rows], pa.string()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string())}
            if ids:
                values["ids"] = pa.array([r[3] for r in rows], pa.string())
            if decoded:
                values["decoded"] = pa.array([r[4] for r in rows], pa.string())
            yield extended(batch, keep, values)

    out = docs.select(*keep).mapInArrow(run, schema)
    return out.withColumn("ids", F.transform(F.filter(F.split("ids", ","), lambda x: x != ""), lambda x: x.cast("int"))) if ids else out
