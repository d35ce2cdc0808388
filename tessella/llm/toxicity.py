"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy model is trained from texts confirmed to be toxic and from texts taken as unlabelled,
with the risk pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)), whose second part is kept from going below
zero. The class prior pi is the share of confirmed texts among all labelled ones of the training folds;
that is right if the labelled texts are a random part of all, and else has to be given (``prior``).

A feature is a word's beginning of 3 to 8 characters, or the whole word; its value in a text is
min(3, 100 * count / (words + 100)), so that chance hits in long and in very short texts both weigh little.
Labels, languages, sources and ids are no inputs of a score.

Bounds (parameters of ``fit``): at most ``positives`` confirmed and ``unlabelled`` other texts are used,
each text once however often it is repeated, those with the smallest hash of the text; at most
``candidates`` features are counted, and ``features`` kept. Everything is scored, whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import KEY, Scratch, extended, held, slices, without

FOLDS, HELD_OUT = 3, 1
POSITIVES, UNLABELLED, CANDIDATES, FEATURES = 1500, 3000, 20_000, 512
CUT = 0.7
SLICE = 4 << 20
#: Words that a worker remembers before it starts afresh.
MEMO = 300_000
OWN = ["held_out", "score", "predicted"]


def parts(word: str) -> tuple[str, ...]:
    """The features of a lower-case word: its beginnings, and the whole word with an end mark."""
    w = word.strip(".,;:!?\"'()[]{}|*#%&$<>«»“”-_=+/\\")
    return (*(w[:k] for k in range(3, min(8, len(w)) + 1)), f"{w} ") if len(w) >= 3 else ()


@dataclass
class Linear:
    """Weights by feature; ``shift`` and ``scale`` put the decision at a score of CUT."""

    weights: dict[str, float]
    bias: float
    shift: float
    scale: float

    def prepare(self) -> Linear:
        self.names = {f: i for i, f in enumerate(self.weights)}
        self.vector = np.array([*self.weights.values(), 0.0])
        names = self.names

        class Known(dict):
            def __missing__(memo, word: str) -> tuple[int, ...]:
                found = tuple(i for p in parts(word) if (i := names.get(p)) is not None)
                if len(word) <= KEY:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = found
                return found

        self.known = Known()
        return self

    def margin(self, text: str) -> float:
        words = spread(text)
        count: Counter[int] = Counter()
        for found in filter(None, map(self.known.__getitem__, words)):
            count.update(found)
        return self.bias + sum(self.vector[i] * value(c, len(words)) for i, c in sorted(count.items()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip((self.margin(text) - self.shift) * self.scale + np.log(CUT / (1 - CUT)), -60, 60))))


def spread(text: str) -> list[str]:
    """The lower-case words of a text; a word repeated in a row counts once."""
    words = text.lower().split()
    return [w for w, before in zip(words, ["", *words], strict=False) if w != before]


def value(count, words):
    return np.minimum(3.0, 100.0 * count / (words + 100.0))


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the sigmoid loss, by Adam on whole batches."""
    w, b = np.zeros(positive.shape[1]), 0.0
    w += positive.mean(0) - unlabelled.mean(0)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        lp, lu = 1 / (1 + np.exp(zp.clip(-30, 30))), 1 / (1 + np.exp(-zu.clip(-30, 30)))
        negative = lu.mean() - prior * (1 - lp).mean()
        dp, du = lp * (1 - lp) / len(zp), lu * (1 - lu) / len(zu)
        if negative >= 0:
            gp, gu = -prior * dp - prior * dp, du
        else:  # step back from over-fitting: undo the negative part
            gp, gu = prior * dp, -du
        g = np.append(positive.T @ gp + unlabelled.T @ gu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def decision(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The margin with the best F1 as positive and unlabelled scores give it: 2 pi TPR / (pi + share of the unlabelled)."""
    at = np.unique(np.concatenate([positive, unlabelled]))
    p, u = np.sort(positive), np.sort(unlabelled)
    caught = 1 - np.searchsorted(p, at, "left") / len(p)
    share = 1 - np.searchsorted(u, at, "left") / len(u)
    f1 = 2 * prior * caught / (prior + np.maximum(share, prior * caught))
    k = int(np.argmax(f1))
    return float((at[k] + at[max(k - 1, 0)]) / 2)


def fold(doc_id: str):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, candidates: int = CANDIDATES, features: int = FEATURES, prior: float | None = None) -> Linear | None:
    """Train from the folds that aren't held out; None if they hold no confirmed or no other text.

    Null and empty texts, and labels that are null or of null ids, are passed over. A text counts once
    however often it is repeated, and is confirmed if one of its rows is.
    """
    ship(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        return fitted(docs, labels, scratch, text, doc_id, label, positives, unlabelled, candidates, features, prior)


def fitted(docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str, doc_id: str, label: str, positives: int, unlabelled: int, candidates: int, features: int, prior: float | None) -> Linear | None:
    base = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter((fold(doc_id) != HELD_OUT) & (F.coalesce(F.length(text), F.lit(0)) > 0))
    marks = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("d")).agg(F.max(label).alias("y"))
    texts = scratch.put(base.select("d", F.xxhash64("t").alias("h")).join(marks, "d", "left").groupBy("h").agg(F.min("d").alias("d"), F.max("y").alias("y")))
    known = texts.agg(F.avg(F.when(F.col("y").isNotNull(), (F.col("y") == 1).cast("double")))).first()[0]
    chosen = scratch.put(texts.filter("y = 1 and d is not null").orderBy("h").limit(positives).select("d"))
    other = scratch.put(texts.filter("d is not null").orderBy(F.xxhash64("h")).limit(unlabelled).select("d"))
    confirmed = chosen.distinct().count()
    if not confirmed or other.isEmpty():
        return None
    prior = prior or min(max(float(known or 0), 1e-3), 0.9)
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    # Ids stay in Spark: a list from the driver would start Python workers that then lie idle beside the operators' own.
    wanted = chosen.select("d", F.lit(True).alias("p"), F.lit(False).alias("u")).union(other.select("d", F.lit(False), F.lit(True)))
    wanted = wanted.groupBy("d").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    # A repeated id may carry several texts; its smallest one stands for it.
    sample = scratch.put(base.join(F.broadcast(wanted), "d").groupBy("d", "p", "u").agg(F.min("t").alias("t")))

    def distinct(batches):
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                seen.update({p for w in set(t.lower().split()) for p in parts(w)})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])

    common = sample.filter("p").select("t").mapInArrow(distinct, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    common = common.filter(F.col("n") >= max(2, confirmed // 100)).orderBy(F.desc("n"), "f").limit(candidates)
    names = [r.f for r in common.collect()]
    sent = spark.sparkContext.broadcast(names)

    def counted(batches):
        number = {f: i for i, f in enumerate(sent.value)}
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                words = spread(t)
                c: Counter[int] = Counter()
                for w, n in Counter(words).items():
                    for p in parts(w):
                        if (i := number.get(p)) is not None:
                            c[i] += n
                out.append((len(words), list(c), list(c.values())))
            yield extended(batch, ["d", "p", "u"], {"n": pa.array([x[0] for x in out], pa.int64()), "i": pa.array([x[1] for x in out], pa.list_(pa.int32())), "c": pa.array([x[2] for x in out], pa.list_(pa.int32()))})

    rows = sample.select("d", "t", "p", "u").mapInArrow(counted, f"d {kind}, p boolean, u boolean, n long, i array<int>, c array<int>").toPandas().sort_values("d")
    if not names or not rows.p.any() or not rows.u.any():
        return None
    r = np.repeat(np.arange(len(rows)), rows.i.map(len))
    i = np.concatenate([*rows.i, np.zeros(0, int)]).astype(int)
    x = value(np.concatenate([*rows.c, np.zeros(0, int)]).astype(float), rows.n.to_numpy(float)[r])
    p, u = rows.p.to_numpy(bool), rows.u.to_numpy(bool)

    def moments(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n = int(use.sum())
        ok = use[r]
        mean = np.bincount(i[ok], x[ok], len(names)) / n
        return mean, np.bincount(i[ok], x[ok] ** 2, len(names)) / n - mean**2, n

    (mp, vp, np_), (mu, vu, nu) = moments(p), moments(u)
    apart = (mp - mu) / np.sqrt(vp / np_ + vu / nu + 1e-9)
    keep = np.argsort(-apart, kind="stable")[:features]
    keep = np.sort(keep[apart[keep] > 1.0])
    if not len(keep):
        return None
    place = np.full(len(names), -1)
    place[keep] = np.arange(len(keep))
    dense = np.zeros((len(rows), len(keep)))
    ok = place[i] >= 0
    dense[r[ok], place[i[ok]]] = x[ok]
    half = np.arange(len(rows)) % 2 == 0
    cross = np.zeros(len(rows))
    for part in (half, ~half):
        if (p & ~part).any() and (u & ~part).any():
            w, b = nnpu(dense[p & ~part], dense[u & ~part], prior)
            cross[part] = dense[part] @ w + b
    w, b = nnpu(dense[p], dense[u], prior)
    shift = decision(cross[p], cross[u], prior)
    return Linear({names[k]: float(a) for k, a in zip(keep.tolist(), w.tolist(), strict=True)}, b, shift, 1.0)


def scored(docs: DataFrame, model: Linear | None, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each row with held_out, score and predicted (1 from a score of CUT on).

    Every whole text is scored by itself, of any length that fits a task; null and empty texts get the score
    of a text without words. Repeated rows get the same score; an empty table gives an empty one.
    Without a model all scores are 0. A null id counts as the empty string for the fold. Columns that
    clash with the results are replaced.
    """
    keep = without(docs, OWN)
    fold_mark = (fold(doc_id) == HELD_OUT).alias("held_out")
    if model is None:
        return docs.select(*keep, fold_mark, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())])

    def run(batches, name=uuid4().hex):
        own = held(name, lambda: sent.value.prepare())
        for batch, texts in slices(batches, text, SLICE):
            yield extended(batch, keep, {"score": pa.array([own.score(t.decode() if t else "") for t in texts], pa.float64())})

    out = docs.select(*keep).mapInArrow(run, schema)
    return out.select(*keep, fold_mark, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that a model trained here doesn't take for toxic, with their own columns."""
    keep = without(docs, OWN)
    return scored(docs, fit(docs, labels, **options)).filter("predicted = 0").select(*keep)
