"""Vectors of texts by a model that every worker loads once.

The model is a parameter: a function without arguments that gives an encoder, which takes a list of texts and gives a matrix.
Texts of an Arrow batch are put in order of their lengths, so that a call's texts are of like length and little is
padded; vectors go back to their rows, so that order and batches change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Fixed value: what stands before a query (not before a passage) when it is encoded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
#: Texts and characters of a call at most (one longer text is a call of its own).
TEXTS, CHARACTERS = 64, 1 << 16

Encoder = Callable[[Sequence[str]], object]

_LOADED: dict[str, Encoder] = {}


def loaded(name: str, load: Callable[[], Encoder]) -> Encoder:
    """A worker's encoder, loaded at first use; another name takes its place."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = load()
    return _LOADED[name]


def calls(texts: Sequence[str], most: int = TEXTS, characters: int = CHARACTERS) -> list[list[int]]:
    """Places of texts, shortest first, cut into calls by the room that their longest text takes."""
    out: list[list[int]] = []
    for k in sorted(range(len(texts)), key=lambda k: (len(texts[k]), k)):
        if not out or len(out[-1]) == most or (len(out[-1]) + 1) * len(texts[k]) > characters:
            out.append([])
        out[-1].append(k)
    return out


def encode(texts: Sequence[str], encoder: Encoder, dim: int) -> np.ndarray:
    """Unit vectors of texts, each as if it were encoded alone; another number of dimensions or no direction is an error."""
    out = np.zeros((len(texts), dim), np.float64)
    for at in calls(texts):
        x = np.asarray(encoder([texts[k] for k in at]), np.float64)
        if x.shape != (len(at), dim):
            raise ValueError(f"the model gives {x.shape[1:] or x.shape} instead of {dim} dimensions")
        size = np.linalg.norm(x, axis=1)
        if not np.isfinite(size).all() or not size.all():
            raise ValueError("the model gives a vector without a direction")
        out[at] = x / size[:, None]
    return out


def encoded(rows: DataFrame, load: Callable[[], Encoder], *, model: str, dim: int, text: Column | str = "text", query: bool = False, name: str = "embedding") -> DataFrame:
    """Rows with a unit vector of ``dim`` floats for their text; null texts have none. Queries get their prefix.

    ``model`` names what ``load`` loads, once for each worker.
    """
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c != name]
    value = F.col(text) if isinstance(text, str) else text
    value = F.concat(F.lit(QUERY_PREFIX), value) if query else value

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            some = [k for k, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            if some:
                for k, v in zip(some, encode([texts[k] for k in some], loaded(model, load), dim).astype(np.float32), strict=True):
                    vectors[k] = v
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(vectors, pa.list_(pa.float32()))], names=[*kept, name])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*kept).schema)
    return rows.select(*kept, value.alias("_text")).mapInArrow(run, f"{kinds}`{name}` array<float>")
