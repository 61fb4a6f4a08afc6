"""Approximate nearest neighbours by cosine over balanced posting lists.

Centroids come from balanced bisection of a bounded sample (`SAMPLE` distinct vectors by hash of id; parameter). Every distinct vector
goes to its nearest list and, near a boundary, to others too (at most `REPLICAS`, diverse ones). The centroids are the nodes of an
in-memory neighbour graph; a search walks it from fixed entries as long as a node is within `ratio` times the best distance, and the
lists within that ratio are read. The ratio is calibrated on the true neighbours, in the whole table, of `ASKED` vectors of the sample: the smallest that finds `RECALL`
of them, however few or many lists there are. Of the `BOUNDARIES` within which vectors are replicated, that with the fewest distances is taken. Postings and the queries
that read them meet by list in blocks of bounded size; the found vectors are scored in double precision on the original vectors.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; those of each length are searched among their own. Equal vectors are
indexed once with their smallest ids, which is exact: only so many can be among the nearest. A score is the cosine in extended precision, rounded to a double once at the end, so that it is
the same wherever a pair meets and vectors of one direction tie; ties go to the smaller id. Rows that repeat an id and vector
count once; an id with several vectors is searched with each, and counts with its best. Empty tables give an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, stored

SAMPLE = 20_000
LIST_ROWS = 512
MOST_LISTS = 2048
REPLICAS = 3
BOUNDARIES = (1.02, 1.05, 1.15)
DEGREE = 16
ENTRIES = 4
RECALL = 0.95
ASKED = 64
#: Products in double precision are within this of the cosine.
SLACK = 1e-9
#: Distinct postings and queries of a block at most, on average.
BLOCK_POSTINGS, BLOCK_QUERIES = 4096, 1024
FOUND = "query_id long, vec_id long, score double"


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows or vanishes."""
    return np.ldexp(x.astype(np.float64), -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None].astype(np.int64))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a and the row of b beside it, rounded to a double once."""
    a, b = scaled(a).astype(np.longdouble), scaled(b).astype(np.longdouble)
    return np.clip(((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))).astype(np.float64), -1, 1)


def bisect(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of `lists` equally filled cells of x (unit rows)."""
    rng = np.random.default_rng(seed)
    out = []
    todo = [(np.arange(len(x)), lists)]
    while todo:
        own, k = todo.pop()
        if k == 1 or len(own) < 2:
            out.append(x[own].mean(axis=0))
            continue
        a, b = x[rng.choice(own, 2, replace=False)]
        for _ in range(4):
            side = x[own] @ (b - a) > (b @ b - a @ a) / 2
            if side.all() or not side.any():
                break
            a, b = x[own[~side]].mean(axis=0), x[own[side]].mean(axis=0)
        order = own[np.argsort(x[own] @ (b - a), kind="stable")]
        cut = len(own) * (k // 2) // k
        todo += [(order[:cut], k // 2), (order[cut:], k - k // 2)]
    c = np.array(out)
    norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-12, c / np.maximum(norm, 1e-12), np.eye(1, c.shape[1]))


class Graph:
    """Centroids, each linked to its nearest ones and, for reach, to two others of a fixed permutation."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.float32)
        k = len(centroids)
        near = np.argsort(2 - 2 * self.c @ self.c.T, axis=1, kind="stable")[:, 1 : DEGREE + 1]
        order = np.random.default_rng(11).permutation(k)
        place = np.argsort(order)
        ring = np.stack([order[(place + 1) % k], order[(place - 1) % k]], axis=1)
        self.links = np.concatenate([near, ring], axis=1)
        self.entries = order[:ENTRIES]
        self.between = np.sqrt(np.maximum(2 - 2 * self.c @ self.c.T, 0))

    def walk(self, x: np.ndarray, ratio: float, width: int = 4) -> np.ndarray:
        """Distances of unit rows x to the centroids that the walk has met; infinite to others."""
        x, n = x.astype(np.float32), len(x)
        dist = np.full((n, len(self.c)), np.inf, np.float32)
        done = np.zeros(dist.shape, bool)
        dist[:, self.entries] = np.sqrt(np.maximum(2 - 2 * x @ self.c[self.entries].T, 0))
        active = np.arange(n)
        width = min(width, len(self.c))
        while len(active):
            open_ = np.where(done[active], np.inf, dist[active])
            pick = np.argpartition(open_, width - 1, axis=1)[:, :width]
            good = np.take_along_axis(open_, pick, 1) <= ratio * dist[active].min(axis=1, keepdims=True)
            keep = good.any(axis=1)
            active, pick, good = active[keep], pick[keep], good[keep]
            if not len(active):
                break
            done[active[:, None], np.where(good, pick, pick[np.arange(len(pick)), good.argmax(axis=1)][:, None])] = True
            r, w = np.nonzero(good)
            rows = np.repeat(active[r], self.links.shape[1])
            nodes = self.links[pick[r, w]].ravel()
            new = np.isinf(dist[rows, nodes])
            rows, nodes = rows[new], nodes[new]
            dist[rows, nodes] = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x[rows], self.c[nodes]), 0))
        return dist

    def full(self, x: np.ndarray) -> np.ndarray:
        """Distances of unit rows x to all centroids."""
        return np.sqrt(np.maximum(2 - 2 * x.astype(np.float32) @ self.c.T, 0))

    def probes(self, dist: np.ndarray, ratio: float) -> np.ndarray:
        """Which lists a search reads: those within ratio of the best distance."""
        return np.isfinite(dist) & (dist <= ratio * dist.min(axis=1, keepdims=True))

    def homes(self, dist: np.ndarray, boundary: float) -> np.ndarray:
        """Which lists a vector is stored in: the nearest, and near ones that are not closer to a chosen list than to it."""
        n, k = dist.shape
        order = np.argsort(dist, axis=1, kind="stable")[:, : min(k, 4 * REPLICAS)]
        chosen = np.zeros((n, k), bool)
        rows = np.arange(n)
        chosen[rows, order[:, 0]] = True
        count = np.ones(n, int)
        limit = dist[rows, order[:, 0]] * boundary
        for j in range(1, order.shape[1]):
            at = order[:, j]
            d = dist[rows, at]
            nearest_chosen = np.where(chosen, self.between[at], np.inf).min(axis=1)
            take = (d <= limit) & np.isfinite(d) & (count < REPLICAS) & (nearest_chosen >= d)
            chosen[rows[take], at[take]] = True
            count += take
        return chosen


def fit(sample: np.ndarray, total: int, asked: np.ndarray, near: np.ndarray, seed: int = 7) -> tuple[Graph, float, float]:
    """(the graph of centroids, the pruning ratio, the boundary) of an index of total vectors; near: for each of asked its true neighbours."""
    x = unit(sample)
    graph = Graph(bisect(x, int(min(MOST_LISTS, max(1, total // LIST_ROWS), len(x))), seed))
    if len(graph.c) == 1 or not near.size:
        return graph, 1.0, 1.0
    q, found = unit(asked), graph.full(unit(near.reshape(-1, near.shape[2])))
    dist = graph.full(q)
    choices = []
    for boundary in BOUNDARIES:
        homes = graph.homes(found, boundary).reshape(*near.shape[:2], -1)
        least = np.where(homes, dist[:, None, :], np.inf).min(axis=2) / np.maximum(dist.min(axis=1, keepdims=True), 1e-6)
        ratio = max(1.0, float(np.quantile(least, RECALL, method="higher"))) * (1 + 1e-6)
        while ratio < 10 and (homes & graph.probes(graph.walk(q, ratio), ratio)[:, None, :]).any(axis=2).mean() < RECALL:
            ratio *= 1.02  # the walk may miss lists
        rows = sum(graph.homes(graph.full(x[at : at + 1024]), boundary).sum(axis=0) for at in range(0, len(x), 1024))
        choices.append(((graph.probes(graph.walk(q, ratio), ratio) @ rows).mean(), ratio, boundary))
    _, ratio, boundary = min(choices)
    return graph, ratio, boundary


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _place(batches: Iterator[pa.RecordBatch], graph: Graph, choose: Callable[[np.ndarray], np.ndarray], ratio: float) -> Iterator[pa.RecordBatch]:
    """Each row once for each list that choose gives, `list` before its columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            x = unit(_matrix(part.column("embedding")))
            row, lists = np.nonzero(choose(graph.walk(x, ratio)))
            rows = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *rows.columns], ["list", *part.schema.names])


def nearest(queries: np.ndarray, ids: np.ndarray, postings: np.ndarray, posting_ids: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, score) of each query's k nearest postings, in order; all that tie with the last are looked at."""
    q, p = unit(queries), unit(postings)
    some = min(len(p), k + 1)
    rough = q @ p.T
    least = np.partition(rough, len(p) - some, axis=1)[:, len(p) - some]
    row, at = np.nonzero(rough >= least[:, None] - SLACK)
    score = np.concatenate([cosines(queries[row[i : i + 65536]], postings[at[i : i + 65536]]) for i in range(0, len(row), 65536)])
    many = np.fromiter(map(len, posting_ids), np.int64, len(posting_ids))
    own = np.concatenate([np.asarray(x, np.int64) for x in posting_ids])
    found = own[ragged((np.cumsum(many) - many)[at], many[at])]
    row, score = np.repeat(row, many[at]), np.repeat(score, many[at])
    ok = found != ids[row]
    row, found, score = row[ok], found[ok], score[ok]
    order = np.lexsort((found, -score, row))
    row, found, score = row[order], found[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], found[keep], score[keep]


def _truth(batches: Iterator[pa.RecordBatch], asked: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Of each task, the k nearest of each asked vector that are not its own direction."""
    q = unit(asked)
    score, kept = np.full((len(q), k), -2.0), np.zeros((len(q), k, q.shape[1]))
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            raw = _matrix(batch.column("embedding").slice(start, 2048))
            own = q @ unit(raw).T
            own[own > 1 - 1e-9] = -2
            every = np.concatenate([score, own], axis=1)
            top = np.argpartition(-every, k - 1, axis=1)[:, :k]
            fresh = np.maximum(top - k, 0)
            kept = np.where((top < k)[:, :, None], np.take_along_axis(kept, np.minimum(top, k - 1)[:, :, None], 1), raw[fresh])
            score = np.take_along_axis(every, top, 1)
    row, nth = np.nonzero(score > -2)
    yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(score[row, nth]), pa.array(list(kept[row, nth]), pa.list_(pa.float64()))], ["asked", "score", "embedding"])


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(postings: pa.Table, queries: pa.Table) -> pa.Table:
        if not postings.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids = queries.column("query_id").to_numpy()
        x, p, own = _matrix(queries.column("embedding")), _matrix(postings.column("embedding")), postings.column("ids").to_pylist()
        parts = []
        for at in range(0, len(ids), 256):
            row, found, score = nearest(x[at : at + 256], ids[at : at + 256], p, own, k)
            parts.append(pa.table([ids[at + row], found, score], schema=schema))
        return pa.concat_tables(parts)

    return search


class Index(NamedTuple):
    """Postings (list, embedding, ids) and how they are searched."""

    postings: DataFrame
    graph: Graph
    ratio: float

    def probes(self, asked: DataFrame) -> DataFrame:
        """list, embedding, query_id: the lists that each of asked (embedding, query_id) reads."""
        graph, ratio, array = self.graph, self.ratio, asked.schema["embedding"].dataType.simpleString()
        return asked.mapInArrow(lambda b: _place(b, graph, lambda d: graph.probes(d, ratio), ratio), f"list int, embedding {array}, query_id long")


def build(valid: DataFrame, k: int = 5, sample: int = SAMPLE) -> Index | None:
    """The index of vectors of one length (vec_id, embedding); None if there are none."""
    # row_number() <= n is cut before the shuffle too: a very frequent vector sends k + 1 rows a task
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = stored(valid.distinct().withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    total = distinct.count()
    if not total:
        return None
    rows = _matrix(distinct.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("embedding").toArrow().column("embedding"))
    asked = rows[:ASKED]
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "embedding")
    truth = distinct.select("embedding").mapInArrow(lambda b: _truth(b, asked, k), "asked int, score double, embedding array<double>").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).orderBy("asked", "nth").toArrow()
    of = truth.column("asked").to_numpy()
    whole = np.flatnonzero(np.bincount(of, minlength=len(asked)) == k)
    near = _matrix(truth.column("embedding")).reshape(truth.num_rows, rows.shape[1])[np.isin(of, whole)]
    graph, ratio, boundary = fit(rows, total, asked[whole], near.reshape(len(whole), k, rows.shape[1]))
    array = distinct.schema["embedding"].dataType.simpleString()
    postings = distinct.mapInArrow(lambda b: _place(b, graph, lambda d: graph.homes(d, boundary), max(BOUNDARIES)), f"list int, embedding {array}, ids array<long>")
    return Index(stored(postings, "postings"), graph, ratio)


def read(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """list, postings, queries of the lists that are read: their products are the distances computed."""
    return postings.groupBy("list").agg(F.count("*").alias("postings")).join(probes.groupBy("list").agg(F.count("*").alias("queries")), "list")


def _among(valid: DataFrame, is_query: str, k: int, sample: int) -> DataFrame | None:
    """query_id, vec_id, score of candidates of vectors of one length."""
    index = build(valid, k, sample)
    if index is None:
        return None
    probes = stored(index.probes(valid.distinct().where(is_query).select("embedding", F.col("vec_id").alias("query_id"))), "probes")
    # at most MOST_LISTS rows: in how many blocks the postings and the queries of each list are dealt
    blocks = read(index.postings, probes).select("list", F.ceil(F.col("postings") / BLOCK_POSTINGS).cast("int").alias("p"), F.ceil(F.col("queries") / BLOCK_QUERIES).cast("int").alias("q"))
    blocks = valid.sparkSession.createDataFrame(blocks.collect(), "list int, p int, q int")
    keys = ["list", "pb", "qb"]
    left = index.postings.join(F.broadcast(blocks), "list").withColumn("pb", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("p")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    right = probes.join(F.broadcast(blocks), "list").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("q")).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    return left.select(*keys, "embedding", "ids").groupBy(*keys).cogroup(right.select(*keys, "embedding", "query_id").groupBy(*keys)).applyInArrow(_search(k), FOUND)


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def search(embeddings: DataFrame, is_query: str = "vec_id % 50 = 0", k: int = 5, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row of embeddings (vec_id, embedding) for which is_query holds."""
    valid = valid_vectors(embeddings)
    lengths = sorted(r["d"] for r in valid.select(F.size("embedding").alias("d")).distinct().collect())
    every = [part for d in lengths if (part := _among(valid.where(F.size("embedding") == d), is_query, k, sample)) is not None]
    if not every:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, every)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
