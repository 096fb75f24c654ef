"""Python functions of a row's values over Arrow columns.

Spark hands a worker up to 10,000 rows at once. They stay as Arrow's bytes; only a small
piece of them at a time becomes Python objects, and its results go back before the next, so
what a worker holds doesn't grow with the rows of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows and bytes of a piece, if it has several rows; a row is never cut.
ROWS, BYTES = 256, 1 << 20


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if len(batch) < 2 or (len(batch) <= ROWS and batch.nbytes <= BYTES):
        yield batch
        return
    half = len(batch) // 2
    yield from _cut(batch.slice(0, half))
    yield from _cut(batch.slice(half))


def pieces(parts: Iterable[pa.Array | tuple[pa.Array, ...]]) -> Iterator[list[pa.Array]]:
    """The columns of the batches, a piece at a time, in order."""
    for some in parts:
        columns = list(some) if isinstance(some, tuple) else [some]
        for piece in _cut(pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])):
            yield piece.columns


def as_lists(vectors: np.ndarray) -> pa.ListArray:
    """A matrix as a column of its rows."""
    n, width = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(np.ascontiguousarray(vectors, np.float32).ravel()))


def as_matrix(lists: pa.ListArray) -> np.ndarray | None:
    """The rows of a column of vectors, if all are there, whole and of one length."""
    values = lists.flatten()
    n, width = len(lists), len(values) // max(1, len(lists))
    if lists.null_count or values.null_count or not (np.diff(lists.offsets.to_numpy()) == width).all():
        return None
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, width)


def by_row(kind: str):
    """Make a column function of type ``kind`` from a function of one row's values."""

    def make(f: Callable):
        made = to_arrow_type(DataType.fromDDL(kind))

        @F.arrow_udf(kind)
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for columns in pieces(parts):
                yield pa.array(list(map(f, *(c.to_pylist() for c in columns))), made)

        return run

    return make
