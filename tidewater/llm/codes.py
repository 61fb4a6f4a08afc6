"""Vector compression by product codes, with codebooks trained in rounds of nearest entries and floored means.

Components become integers, floor(scale * c); a vector is cut into `parts` pieces, each coded by the nearest entry of that piece's codebook. Every round puts the codebooks' k-d trees into the
tasks' closures; a task finds the nearest entries by branch and bound and adds up the pieces of each entry in exact integers, one row for each entry and component; Spark sums those rows and
the driver replaces the entries by the floored means. A branch is left only if its bound is beyond the best distance: at an equal bound a lower index may lie there, and ties go to the lower index.

What a task and the driver hold is the codebooks and their sums, whatever the number of rows. The integers are stored once, packed into a few bytes a component, and read in every round; nothing
but sums is shuffled.

Vectors that are null or hold null or non-finite components are dropped. Vectors of each length have codebooks of their own; a length that `parts` does not divide is cut as evenly as may be,
earlier pieces shorter. The codebooks start from the vectors of the smallest ids, one an id: of several vectors of an id the least; of fewer ids than entries, so many entries. A null id starts nothing; with
null ids alone there are no entries, and code and error are null. An unused entry stays. Integers beyond a long's range become its ends; distances are exact all the same, and an error that a long
cannot hold is null. Repeated rows are coded each. An empty table gives an empty result. The input's columns are kept in one column `row`, so that none clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, StructType

from . import vectors
from .common import stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Two hex digits a piece: a codebook has at most 256 entries.
MOST_ENTRIES = 256
#: Entries of a leaf of the tree at most.
LEAF = 2
#: A label with more than one of so many rows is joined apart: there are fewer of those than this.
HOT = 1000


class Node(NamedTuple):
    """Of a k-d tree: a leaf's entries, or the dimension and value that part the `low` child's entries (at most value) from the `high` child's; fresh: no node above has that dimension."""

    entries: np.ndarray
    dimension: int = 0
    value: int = 0
    low: int = -1
    high: int = -1
    fresh: bool = True


class Tree:
    """A k-d tree over the rows of a codebook."""

    def __init__(self, codebook: np.ndarray):
        self.codebook, self.nodes = codebook, []
        self._grow(np.arange(len(codebook)), frozenset())

    def _grow(self, own: np.ndarray, cut: frozenset[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(Node(own))
        points = self.codebook[own]
        spread = points.max(axis=0) - points.min(axis=0) if len(own) > LEAF and points.shape[1] else np.zeros(1)
        d = int(spread.argmax())
        if len(own) <= LEAF or not spread[d]:
            return at
        value = sorted(points[:, d].tolist())[(len(own) - 1) // 2]
        if value == points[:, d].max():
            value = max(v for v in points[:, d].tolist() if v < value)
        below = points[:, d] <= value
        low, high = self._grow(own[below], cut | {d}), self._grow(own[~below], cut | {d})
        self.nodes[at] = Node(own, d, int(value), low, high, d not in cut)
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row of x; ties to the lower index. Exact for long and Python integers."""
        best, index = np.full(len(x), -1, x.dtype), np.full(len(x), len(self.codebook))
        # depth first: the child on a row's own side, then the other one where its bound allows
        todo = [(0, np.arange(len(x)), np.zeros(len(x), x.dtype))]
        while todo:
            at, rows, bound = todo.pop()
            near = (best[rows] < 0) | (bound <= best[rows])
            rows, bound = rows[near], bound[near]
            if not len(rows):
                continue
            node = self.nodes[at]
            if node.low < 0:
                for e in node.entries.tolist():
                    gap = x[rows] - self.codebook[e]
                    distance = (gap * gap).sum(axis=1)
                    won = (best[rows] < 0) | (distance < best[rows]) | (distance == best[rows]) & (e < index[rows])
                    best[rows[won]], index[rows[won]] = distance[won], e
                continue
            gap = x[rows, node.dimension] - node.value
            # entries of the high child are beyond the value by 1 at least
            below, far = gap <= 0, np.where(gap <= 0, gap - 1, gap)
            beyond = bound + far * far if node.fresh else np.maximum(bound, far * far)
            for side, own, other in ((below, node.low, node.high), (~below, node.high, node.low)):
                todo += [(other, rows[side], beyond[side]), (own, rows[side], bound[side])]
        return index, best


class Codebooks(NamedTuple):
    """The codebooks of vectors of one length: for each piece its entries, and their trees."""

    books: list[np.ndarray]
    trees: list[Tree]

    @classmethod
    def of(cls, books: list[np.ndarray]) -> Codebooks:
        fit = [b if vectors.small(b) else b.astype(object) for b in books]
        return cls(fit, [Tree(b) for b in fit])

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pieces, index, squared distance) of integer rows for each codebook."""
        for piece, tree in zip(cut(x, len(self.books)), self.trees, strict=True):
            # int64 where no square can leave it, else Python integers
            exact = vectors.small(piece) and tree.codebook.dtype != object
            index, distance = (tree if exact else Tree(tree.codebook.astype(object))).nearest(piece if exact else piece.astype(object))
            yield piece, index, distance

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """x in consecutive pieces of columns, equal ones where parts divides them."""
    ends = [x.shape[1] * p // parts for p in range(parts + 1)]
    return [x[:, a:b] for a, b in zip(ends, ends[1:])]


def _totals(x: np.ndarray, index: np.ndarray, entries: int) -> tuple[np.ndarray, list[list[int]]]:
    """(count, exact component sums) of the rows of each entry; halves of the integers go through a matrix product that is exact in doubles."""
    hot = (index == np.arange(entries)[:, None]).astype(np.float64)
    high, low = hot @ (x >> 31).astype(np.float64), hot @ (x & 0x7FFFFFFF).astype(np.float64)
    return hot.sum(axis=1).astype(np.int64), [[(int(h) << 31) + int(v) for h, v in zip(a, b, strict=True)] for a, b in zip(high, low, strict=True)]


SEEDS = "dim int, vec_id long, x array<long>"


def _least(entries: int):
    """A task's smallest ids, each with its least vector."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, list[int]]] = {}
        for part in vectors.parts(batches):
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)
            for d, rows, x in vectors.unpack(part.column("dim"), part.column("x")):
                own = found.setdefault(d, {})
                for i in np.unique(ids[rows])[:entries].tolist():
                    vector = min(x[ids[rows] == i].tolist())
                    own[i] = min(own.get(i, vector), vector)
                found[d] = {i: own[i] for i in sorted(own)[:entries]}
        flat = [(d, i, v) for d, own in found.items() for i, v in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], pa.int64()), pa.array([r[2] for r in flat], pa.list_(pa.int64()))], ["dim", "vec_id", "x"])

    return least


def _start(table: DataFrame, parts: int, entries: int) -> dict[int, Codebooks]:
    """The first codebooks; a task sends as many rows as there are entries."""
    seeds = table.where("vec_id is not null").mapInArrow(_least(entries), SEEDS).groupBy("dim", "vec_id").agg(F.min("x").alias("x"))
    best: dict[int, list[tuple[int, list[int]]]] = {}
    for r in seeds.toLocalIterator():
        best[r.dim] = sorted([*best.get(r.dim, []), (r.vec_id, list(r.x))])[:entries]
    return {d: Codebooks.of(cut(np.array([x for _, x in rows], np.int64).reshape(len(rows), d), parts)) for d, rows in best.items()}


def _sums(books: dict[int, Codebooks]):
    """A task's sums: a row for each length, piece, entry in use and component."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list[int]] = {}
        for part in vectors.parts(batches):
            for d, _, x in vectors.unpack(part.column("dim"), part.column("x")):
                for p, (piece, index, _) in enumerate(books[d].assign(x) if d in books else ()):
                    count, values = _totals(piece, index, len(books[d].books[p]))
                    for e in np.flatnonzero(count).tolist():
                        before = total.get((d, p, e), [0] * (piece.shape[1] + 1))
                        total[d, p, e] = [a + b for a, b in zip(before, [int(count[e]), *values[e]], strict=True)]
        flat = [(*key, place, row[0], Decimal(v)) for key, row in total.items() for place, v in enumerate(row[1:])]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(types)], ["dim", "part", "entry", "place", "n", "total"])

    return sums


def fit(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> dict[int, Codebooks]:
    """The codebooks of embeddings (vec_id, embedding) by vector length."""
    if not 1 <= entries <= MOST_ENTRIES:
        raise ValueError(f"entries must be 1 to {MOST_ENTRIES}")
    valid = embeddings.where(vectors.usable()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    table = stored(valid.mapInArrow(vectors.packer(scale, keep=("vec_id",)), f"vec_id long, {vectors.PACKED}"), "pieces")
    books = _start(table, parts, entries)
    for _ in range(rounds if books else 0):
        # entries times components of a length: as many rows as the codebooks hold numbers
        found = table.select("dim", "x").mapInArrow(_sums(books), "dim int, part int, entry int, place int, n long, total decimal(38,0)").groupBy("dim", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        new = {d: [b.astype(object) for b in own.books] for d, own in books.items()}
        for r in found:
            new[r.dim][r.part][r.entry, r.place] = int(r.total) // r.n
        books = {d: Codebooks.of([b.astype(np.int64) for b in own]) for d, own in new.items()}
    return books


def compress(embeddings: DataFrame, books: dict[int, Codebooks], scale: int = SCALE) -> DataFrame:
    """row (all columns of embeddings), code (two hex digits a piece), error (squared distance to what the code stands for), codebooks_sha256 of the usable vectors."""
    schema = StructType().add("row", embeddings.schema).add("code", StringType()).add("error", DecimalType(38, 0)).add("codebooks_sha256", StringType())
    digest = {d: own.sha256() for d, own in books.items()}

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in vectors.parts(batches):
            for rows, x in vectors.by_length(pc.struct_field(part.column("row"), "embedding"), scale):
                n, d = len(rows), x.shape[1]
                code, error = [None] * n, [None] * n
                if d in books:
                    found = list(books[d].assign(x))
                    digits = np.stack([index for _, index, _ in found], axis=1).astype(np.uint8)
                    code = [row.tobytes().hex() for row in digits]
                    total = sum(distance.astype(object) for _, _, distance in found)
                    error = [Decimal(int(v)) if v < 10**38 else None for v in total]
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(rows)), pa.array(code, pa.string()), pa.array(error, pa.decimal128(38, 0)), pa.array([digest.get(d)] * n, pa.string())], schema.names)

    return embeddings.where(vectors.usable()).select(F.struct("*").alias("row")).mapInArrow(coded, schema)


def restore(codes: list[str], books: Codebooks) -> np.ndarray:
    """The integer vectors that codes stand for."""
    digits = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), -1)
    return np.concatenate([b[digits[:, p]] for p, b in enumerate(books.books)], axis=1)


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows (label, error) with label_error, the sum of error over the rows of a label; null labels are one.

    A label of more than one in HOT rows meets its sum by a broadcast of at most HOT rows; the others by a join on the label.
    """
    table = stored(rows.select("*", F.col("label").isNull().alias("unlabelled"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("group")), "codes")
    keys = ["unlabelled", "group"]
    sums = stored(table.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    total = sums.agg(F.sum("n")).head()[0] or 0
    hot = sums.where(F.col("n") * HOT > total).drop("n")
    rest = sums.where(F.col("n") * HOT <= total).drop("n")
    often = table.join(F.broadcast(hot), keys)
    seldom = table.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return often.unionByName(seldom).drop(*keys)


def _sql() -> str:
    """The same as DuckDB SQL for op13: the rounds one after the other, plain search of the nearest."""
    steps = [
        f"""v as (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"p as (select vec_id, label, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] as y from v, range({PARTS}) r(part))",
        f"k0 as (select part, rank - 1 as entry, y from (select part, y, row_number() over (partition by part order by vec_id) as rank from p) where rank <= {ENTRIES})",
    ]
    near = "select p.vec_id, p.label, p.part, p.y, min((list_sum(list_transform(list_zip(p.y, k.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, k.entry)) as best from p join k{} k on p.part = k.part group by all"
    for i in range(ROUNDS):
        steps.append(f"a{i} as materialized ({near.format(i)})")
        steps.append(f"m{i} as (select part, entry, list(mean order by place) as y from (select part, best[2] as entry, place, ((sum(y[place]) - (sum(y[place]) % count(*) + count(*)) % count(*)) // count(*))::bigint as mean from a{i}, range(1, len(y) + 1) r(place) group by all) group by all)")
        steps.append(f"k{i + 1} as materialized (select k.part, k.entry, coalesce(m.y, k.y) as y from k{i} k left join m{i} m on k.part = m.part and k.entry = m.entry)")
    steps.append(f"z as (select vec_id, label, string_agg(lpad(lower(to_hex(best[2])), 2, '0'), '' order by part) as code, sum(best[1])::bigint as error from ({near.format(ROUNDS)}) group by vec_id, label)")
    steps.append(f"s as (select sha256(string_agg(array_to_string(y, ','), ',' order by part, entry)) as codebooks_sha256 from k{ROUNDS})")
    return "with " + ",\n".join(steps) + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from z, s"


SQL = _sql()
