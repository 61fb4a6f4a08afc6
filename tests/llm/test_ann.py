import numpy as np
import pytest

from tidewater.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, list int, ids int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 0, 0, 0, 0) for i, e in rows], SCHEMA)


def brute(rows, k=5):
    """Sorted by the cosine in extended precision, rounded once."""
    x = np.array([e for _, e in rows], np.float32).astype(np.longdouble)
    x /= np.abs(x).max(axis=1, keepdims=True)
    lengths, ids = (x * x).sum(axis=1), np.array([i for i, _ in rows])
    out = {}
    for row, i in enumerate(ids):
        if i % 50 == 0:
            s = ((x * x[row]).sum(axis=1) / np.sqrt(lengths * lengths[row])).astype(np.float64)
            best = [(j, min(v, 1.0)) for j, v in zip(ids, s, strict=True) if j != i]
            out[int(i)] = [(int(j), float(v)) for j, v in sorted(set(best), key=lambda p: (-p[1], p[0]))[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_edge_rows(spark):
    bad = [(50, None), (100, [0.0, 0.0, 0.0]), (150, [1.0, None, 0.0]), (200, [float("nan"), 1.0, 0.0]), (250, [float("inf"), 1, 1]), (300, []), (350, [1.0, 2.0]), (None, [1, 2, 3])]
    good = [(0, [1, 0, 0]), (1, [1, 0, 0]), (2, [2, 0, 0]), (3, [-1, 0, 0]), (4, [1e-30, 1e-30, 0]), (400, [1, 0, 0]), (5, [3e38, 1, 2]), (6, [0, 1, 0])]
    assert got(ann.search(frame(spark, bad + good + good[:2]))) == brute([(i, e) for i, e in good])


def test_one_vector_and_empty(spark):
    assert ann.search(frame(spark, [(0, [1, 2])])).count() == 0
    assert ann.search(frame(spark, [])).count() == 0
    assert ann.search(frame(spark, [(0, None)])).count() == 0


@pytest.fixture
def small_lists(monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    monkeypatch.setattr(ann, "BLOCK_POSTINGS", 16)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)


def test_recall_and_a_frequent_vector(spark, small_lists):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.6 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(2000)]
    rows += [(i, rows[0][1]) for i in range(2000, 3000)]  # a third of all are one vector
    want, have = brute(rows), got(ann.search(frame(spark, rows)))
    assert have.keys() == want.keys()
    assert have[0] == want[0] and have[2500] == want[2500]
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_recall_on_table(spark, small_lists):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, have = brute(rows), got(ann.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert have == got(ann.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")))


def test_lists_are_balanced():
    x = ann.unit(np.random.default_rng(1).normal(size=(4000, 8)) + np.array([3, 0, 0, 0, 0, 0, 0, 0]))
    c = ann.bisect(x, 37)
    assert c.shape == (37, 8)
    graph = ann.Graph(c)
    homes = graph.homes(graph.walk(x, 1.15), 1.15)
    assert homes.any(axis=1).all() and homes.sum(axis=1).max() <= ann.REPLICAS
    assert homes.sum(axis=0).max() < 6 * homes.sum() / 37


def test_vectors_of_one_direction_tie(spark):
    """40 multiples of one vector, and others: the smaller ids come first."""
    rows = [(i, [i * 3, i * 7, i * -11]) for i in range(1, 41)] + [(50, [3, 7, -11]), (0, [0, 1, 0]), (100, [0, 0, 1])]
    have = got(ann.search(frame(spark, rows)))
    assert have[50] == [(i, 1.0) for i in range(1, 6)] and have == brute(rows)


def test_nearly_equal_scores_keep_their_order(spark):
    """Cosines that differ in the 14th digit: the larger comes first, whatever the ids."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1e-7]), (2, [1.0, 0.0]), (3, [1.0, -2e-7]), (4, [2.0, 0.0]), (5, [1.0, 4e-7])]
    have = got(ann.search(frame(spark, rows)))[0]
    assert [i for i, _ in have] == [2, 4, 1, 3, 5] and have[:2] == [(2, 1.0), (4, 1.0)] and 1 > have[2][1] > have[3][1] > have[4][1]


def test_each_length_is_searched_among_its_own(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 + i % 2).astype(np.float32).tolist()) for i in range(0, 200, 5)]
    have = got(ann.search(frame(spark, rows)))
    assert have == {**brute([r for r in rows if len(r[1]) == 3]), **brute([r for r in rows if len(r[1]) == 4])}


@pytest.mark.parametrize("size", [1200, 4000, 12_000])
def test_fewer_distances_than_brute_force(spark, size):
    """Clustered vectors, 2 to 23 lists: the same rule prunes at every size."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.15 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(size)]
    valid = ann.valid_vectors(frame(spark, rows))
    index = ann.build(valid)
    probes = index.probes(valid.where("vec_id % 50 = 0").selectExpr("embedding", "vec_id as query_id"))
    distances = sum(r.postings * r.queries for r in ann.read(index.postings, probes).collect())
    assert len(index.graph.c) == size // ann.LIST_ROWS
    assert distances < 0.75 * size * (size // 50)
    want, have = brute(rows), got(ann.search(frame(spark, rows)))
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in have[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_walk_finds_the_nearest_centroid():
    rng = np.random.default_rng(2)
    graph = ann.Graph(ann.unit(rng.normal(size=(300, 8))))
    x = ann.unit(rng.normal(size=(500, 8)))
    full = np.sqrt(2 - 2 * x @ graph.c.T)
    assert (graph.walk(x, 1.15).argmin(axis=1) == full.argmin(axis=1)).mean() > 0.95
