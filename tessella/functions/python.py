"""What Spark has no expression for: Unicode normalisation, deterministic vectors, string similarity."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def made_vector(text: str, dim: int) -> list[float]:
    """A vector that only depends on the text: bytes of hashes of its digest and a counter, on -1 .. 1."""
    seed = hashlib.sha256(text.encode()).digest()
    raw = b"".join(hashlib.sha256(seed + k.to_bytes(4, "big")).digest() for k in range(-(-dim // 32)))
    return [b / 127.5 - 1.0 for b in raw[:dim]]


def made_vectors(text: Column | str, dim: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else made_vector(t, dim))

    return run(text)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits a character."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & places.get(c, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Similarity of two strings in hundredths: twice the common subsequence over both lengths."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string and a part of the longer one, of its own length or less at either end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 0.0 if long else 100.0
    best = 0.0
    for p in range(1 - n, len(long)):
        best = max(best, ratio(short, long[max(0, p) : p + n]))
        if best == 100.0:
            break
    return max(best, partial_ratio_from(long, short)) if len(long) == n else best


def partial_ratio_from(short: str, long: str) -> float:
    n = len(short)
    return max(ratio(short, long[max(0, p) : p + n]) for p in range(1 - n, len(long)))


def _words(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    """Words that both have, and those that only one has, each in order."""
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), sorted(x - y), sorted(y - x)


def token_ratio(a: str, b: str) -> float:
    """The better of the ratio of sorted words and that of sets of words, in which what is shared counts for itself."""
    if not a.split() or not b.split():
        return 0.0
    both, x, y = _words(a, b)
    if both and not (x and y):
        return 100.0
    shared, one, two = " ".join(both), " ".join([*both, *x]), " ".join([*both, *y])
    best = max(ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), ratio(one, two) if not both else 0.0)
    if both:
        left, right = " ".join(x), " ".join(y)
        # Edits are those of what isn't shared.
        edits = len(left) + len(right) - 2 * common(left, right)
        best = max(best, 100.0 - 100.0 * edits / (len(one) + len(two)))
        best = max(best, *(100.0 - 100.0 * (len(z) - len(shared)) / (len(shared) + len(z)) for z in (one, two)))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, x, y = _words(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(" ".join(x), " ".join(y)))


def closeness(a: str, b: str) -> float:
    """Weighted ratio in hundredths: the plain ratio, or at 0.95 that of words; if lengths are far apart, those of parts at 0.9 (over eight times: 0.6)."""
    if not a or not b:
        return 0.0
    times = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if times < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    part = 0.9 if times <= 8 else 0.6
    return max(best, part * partial_ratio(a, b), 0.95 * part * partial_token_ratio(a, b))


def may_reach(a: str, b: str, least: float) -> bool:
    """Whether the characters of two strings let their closeness reach ``least``; strings that share a word always may.

    A common subsequence has no more characters than both strings share, and a part no more than the shorter one.
    """
    if not a.strip() or not b.strip() or least <= 0 or set(a.split()) & set(b.split()):
        return True
    whole = part = 0.0
    # As they are, their words in order, and each word once.
    for x, y in ((a, b), (" ".join(a.split()), " ".join(b.split())), (" ".join(set(a.split())), " ".join(set(b.split())))):
        shared, short = (Counter(x) & Counter(y)).total(), min(len(x), len(y))
        whole = max(whole, 200.0 * shared / (len(x) + len(y)))
        part = max(part, 200.0 * shared / (short + shared) if shared else 0.0)
    if max(len(a), len(b)) < 1.5 * min(len(a), len(b)):
        part = 0.0
    return max(whole, 0.9 * part) >= least - 1e-9


def closest_column(wanted: list[str], name: Column | str, least: float) -> Column:
    """For a name the wishes (k, score) it is close to; wishes whose characters rule it out aren't compared."""
    kind = T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("score", T.DoubleType())]))

    @F.pandas_udf(kind)
    def run(names: pd.Series) -> pd.Series:
        def near(n: str | None) -> list[dict]:
            scored = ((k, closeness(w, n)) for k, w in enumerate(wanted) if n and may_reach(w, n, least))
            return [{"k": k, "score": x} for k, x in scored if x >= least]

        return names.map(near)

    return run(name)


def closeness_column(wanted: str, name: Column | str) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: closeness(wanted, n or ""))

    return run(name)
