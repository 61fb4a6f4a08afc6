"""Vectors as integers, floor(scale * component), packed into as few bytes a component as a vector needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a batch that are worked on at once.
ROWS = 4096
PACKED = "dim int, x binary"


def usable(column: str = "embedding") -> Column:
    """Whether the vector is there and all its components are finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in double precision; what a long cannot hold becomes the end of its range."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * scale), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def by_length(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integers) of the vectors of each length."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, integers(flat.reshape(len(rows), d), scale)


def pack(x: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(rows, their bytes) of integer rows, each with the narrowest width that holds it: equal rows, equal bytes."""
    least, most = x.min(axis=1, initial=0), x.max(axis=1, initial=0)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        width[(least >= -(1 << 8 * w - 1)) & (most < 1 << 8 * w - 1)] = w
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(w * x.shape[1])
        yield rows, pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x[rows].astype(f"<i{w}").tobytes())])


def unpack(dims: pa.Array, x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their integers) of packed vectors."""
    dim, size = dims.to_numpy(zero_copy_only=False).astype(np.int64), pc.binary_length(x).to_numpy(zero_copy_only=False)
    for d, s in np.unique(np.stack([dim, size], axis=1), axis=0):
        rows = np.flatnonzero((dim == d) & (size == s))
        if d == 0:
            yield 0, rows, np.zeros((len(rows), 0), np.int64)
            continue
        data = x.take(pa.array(rows)).buffers()[2]
        yield int(d), rows, np.frombuffer(data, f"<i{s // d}", len(rows) * d).reshape(len(rows), d).astype(np.int64)


def packer(scale: int, column: str = "embedding", keep: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over batches to the columns of keep, dim and x."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            for own, x in by_length(part.column(column), scale):
                for rows, data in pack(x):
                    dim = pa.array(np.full(len(rows), x.shape[1], np.int32))
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(own[rows])) for k in keep), dim, data], [*keep, "dim", "x"])

    return packed


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def small(x: np.ndarray) -> bool:
    """Whether squares of differences of such integers can be summed in a long."""
    return x.size == 0 or max(abs(int(x.min())), abs(int(x.max()))) < 1 << 26 and x.shape[-1] <= 512
