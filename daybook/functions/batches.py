"""Batches of rows in portions, so that a Python worker holds what it makes of a few texts and not of a whole batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Characters (or bytes) and rows of a portion; a longer text is a portion by itself.
SIZE, ROWS = 1 << 20, 250


def portions(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of the portions of rows with these sizes."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        room = SIZE + (int(ends[at - 1]) if at else 0)
        to = min(max(int(np.searchsorted(ends, room, side="right")), at + 1), at + ROWS)
        to = min(to, len(ends))
        yield at, to
        at = to


def of_arrow(batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
    for at, to in portions(sizes):
        yield batch.slice(at, to - at)


def of_pandas(texts: tuple[pd.Series, ...]) -> Iterator[tuple[int, int]]:
    """(from, to) of the portions of columns of text."""
    yield from portions(np.array([sum(len(t) for t in row if t is not None) for row in zip(*texts, strict=True)], np.int64))
