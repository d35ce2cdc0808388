"""Arrow batches in small parts: what Python makes of a text takes many times the text's room."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def sliced(rows: pa.RecordBatch | pa.Array, sizes: pa.Array, most: int, count: int) -> Iterator[pa.RecordBatch | pa.Array]:
    """Parts of up to ``count`` rows whose ``sizes`` (null: 0) add up to ``most`` at most; a larger row is a part of its own."""
    first, held = 0, 0
    for k, size in enumerate(sizes.fill_null(0).to_pylist()):
        if k > first and (held + size > most or k - first == count):
            yield rows.slice(first, k - first)
            first, held = k, 0
        held += size
    if len(sizes) > first:
        yield rows.slice(first)
