"""Embedding whitening by two passes over integer vectors.

Components become integers, floor(scale * c). The first pass sums them exactly, which gives the mean; the second sums outer products of the centred vectors, a matrix product a batch and one
matrix a task, merged by treeAggregate; LAPACK's eigh gives the principal directions, and the rows are projected on them with the model in each task's closure. The model is fitted on the
distinct integer vectors, so that copies do not weigh more. A third pass measures the covariance of what comes out.

What a task and the driver hold is one square matrix a vector length, whatever the number of rows. The distinct vectors are shuffled once, packed into a few bytes a component; a frequent
vector is one row a task before the shuffle.

Vectors that are null or hold null or non-finite components are dropped; vectors of each length have a model of their own; empty ones have no component. Repeated rows each give their rows,
and a null vec_id stays. A direction in which the vectors do not vary (its eigenvalue is below rounding) has null as whitened value and no part in identity_error; where nothing varies, explained is null too.
A deviation that a long cannot hold is null in the query; the operator keeps 38 digits. Integers beyond a long's range become its ends. An empty table gives an empty result. The input's columns are
kept in one column `row`, so that none clashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructType

from . import vectors
from .common import stored

SCALE = 256
COMPONENTS = 4
#: Bits of the pieces in which remainders are multiplied.
LIMB = 24


class Mean(NamedTuple):
    """The mean S/n of n integer vectors, exactly: whole + rest / n with 0 <= rest < n."""

    n: int
    whole: list[int]
    rest: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles; the whole part is taken off in integers, so that a large mean costs no digits."""
        rest = np.array([r / self.n for r in self.rest])
        if vectors.small(x) and all(abs(w) < 1 << 62 for w in self.whole):
            return (x - np.array(self.whole, np.int64)).astype(np.float64) - rest
        return (x.astype(object) - np.array(self.whole, object)).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n*x - S)^2 of each row, exactly: n^2 yy - 2n yr + rr with y = x - whole, r = rest."""
        y = x.astype(object) - np.array(self.whole, object) if not vectors.small(x) or any(abs(w) >= 1 << 25 for w in self.whole) else x - np.array(self.whole, np.int64)
        squares = (y * y).sum(axis=1).tolist()
        products = [0] * len(x)
        for at in range(0, max(self.n.bit_length(), 1), LIMB):
            piece = np.array([r >> at & (1 << LIMB) - 1 for r in self.rest], y.dtype)
            products = [p + (int(q) << at) for p, q in zip(products, (y * piece).sum(axis=1).tolist(), strict=True)]
        rr = sum(r * r for r in self.rest)
        return [self.n * self.n * int(s) - 2 * self.n * p + rr for s, p in zip(squares, products, strict=True)]


class Model(NamedTuple):
    """The principal directions of vectors of one length, with falling variances; `spread` is their sum over all directions."""

    mean: Mean
    variances: np.ndarray
    directions: np.ndarray
    spread: float
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """The whitened coordinates of integer rows; NaN where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.mean.centred(x) @ self.directions / np.where(self.variances > 0, np.sqrt(self.variances), np.nan)

    def explained(self) -> list[float | None]:
        return [float(v / self.spread) if self.spread > 0 else None for v in self.variances]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's exact sums: a row for each dimension of each length."""
    count, total = defaultdict(int), {}
    for part in vectors.parts(batches):
        for d, rows, x in vectors.unpack(part.column("dim"), part.column("x")):
            count[d] += len(rows)
            # two halves, so that no sum of a batch leaves a long
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total[d] = [a + (h << 32) + b for a, h, b in zip(total.get(d, [0] * d), high, low, strict=True)]
    keys = [(d, i) for d in total for i in range(d)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.int32()), pa.array([count[d] for d, _ in keys], pa.int64()), pa.array([Decimal(total[d][i]) for d, i in keys], pa.decimal128(38, 0))], ["dim", "place", "n", "total"]
    )


def means(fitted: DataFrame) -> dict[int, Mean]:
    """The mean of the vectors of each length; the driver gets one row a dimension."""
    rows = fitted.mapInArrow(_sums, "dim int, place int, n long, total decimal(38,0)").groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    found = {}
    for d in {r.dim for r in rows}:
        own = sorted((r.place, r.n, int(r.total)) for r in rows if r.dim == d)
        n = own[0][1]
        found[d] = Mean(n, [s // n for _, _, s in own], [s % n for _, _, s in own])
    return found


def products(fitted: DataFrame, of: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each length, the sum of the outer products of of(length, rows): a matrix product a batch, a matrix a task, merged in a tree."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in vectors.parts(batches):
            for d, _, x in vectors.unpack(part.column("dim"), part.column("x")):
                c = of(d, x)
                total[d] = total.get(d, 0) + c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([g.tobytes() for g in total.values()], pa.binary())], ["dim", "gram"])

    def add(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        return {d: a[d] + b[d] if d in a and d in b else a.get(d, b.get(d)) for d in {*a, *b}}

    def square(row) -> dict[int, np.ndarray]:
        flat = np.frombuffer(row.gram)
        return {row.dim: flat.reshape(int(round(len(flat) ** 0.5)), -1)}

    return fitted.mapInArrow(gram, "dim int, gram binary").rdd.map(square).treeAggregate({}, add, add)


def fit(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> dict[int, Model]:
    """The whitening of the distinct integer vectors of embeddings (embedding), by vector length."""
    valid = embeddings.where(vectors.usable() & (F.size("embedding") > 0)).select("embedding")
    fitted = stored(valid.mapInArrow(vectors.packer(scale), vectors.PACKED).distinct(), "fit")
    mean = means(fitted)
    models = {}
    for d, total in products(fitted, lambda d, x: mean[d].centred(x)).items():
        values, directions = np.linalg.eigh(total / mean[d].n)
        values, directions = values[::-1], directions[:, ::-1]
        spread = float(values.clip(0).sum())
        values, directions = values[:components].copy(), directions[:, :components].copy()
        values[values <= d * np.finfo(float).eps * max(values[0], 0)] = 0
        # either sign will do, but always the same
        directions *= np.where(np.take_along_axis(directions, np.abs(directions).argmax(axis=0)[None], 0) < 0, -1, 1)
        models[d] = Model(mean[d], values, directions, spread)
    return {d: m._replace(identity_error=e) for (d, m), e in zip(models.items(), _identity(fitted, models), strict=True)}


def _identity(fitted: DataFrame, models: dict[int, Model]) -> list[float | None]:
    """How far the covariance of the whitened vectors is from the identity, for each model."""

    def whitened(d: int, x: np.ndarray) -> np.ndarray:
        # a column of ones besides gives the sums, which are zero but for rounding
        return np.column_stack([models[d].project(x)[:, models[d].variances > 0], np.ones(len(x))])

    found = products(fitted, whitened) if models else {}
    out = []
    for d, m in models.items():
        g = found[d] / m.mean.n
        centred = g[:-1, :-1] - np.outer(g[:-1, -1], g[:-1, -1])
        out.append(float(np.abs(centred - np.eye(len(centred))).max()) if len(centred) else None)
    return out


def whiten(embeddings: DataFrame, models: dict[int, Model], scale: int = SCALE) -> DataFrame:
    """row (all columns of embeddings), n, deviation, whitened and explained (a value a component), identity_error of the vectors that have a model."""
    schema = StructType().add("row", embeddings.schema).add("n", LongType()).add("deviation", DecimalType(38, 0)).add("whitened", ArrayType(DoubleType())).add("explained", ArrayType(DoubleType())).add("identity_error", DoubleType())
    valid = embeddings.where(vectors.usable() & F.size("embedding").isin([0, *models])).select(F.struct("*").alias("row"))

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectors.parts(batches):
            for rows, x in vectors.by_length(pc.struct_field(part.column("row"), "embedding"), scale):
                if (m := models.get(x.shape[1])) is None:
                    continue
                n, y = len(rows), m.project(x)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * y.shape[1])
                exact = [Decimal(v) if v < 10**38 else None for v in m.mean.deviations(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row").take(pa.array(rows)), pa.array(np.full(n, m.mean.n)), pa.array(exact, pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(ends, pa.array(y.ravel(), from_pandas=True)), pa.array([m.explained()] * n, pa.list_(pa.float64())), pa.array([m.identity_error] * n, pa.float64()),
                    ],
                    schema.names,
                )

    return valid.mapInArrow(whitened, schema)


def components(rows: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each component of the rows of `whiten`."""
    each = rows.select(F.col("row.vec_id").alias("vec_id"), "n", F.expr("try_cast(deviation as long)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
