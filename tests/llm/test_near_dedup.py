import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, node int, row int, stay int"


def sets_of(rows, size):
    out = []
    for doc_id, text, *_ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append((doc_id, frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()))
    return out


def brute(rows, size=2, percent=80):
    sets = sets_of(rows, size)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), low.get(root(i)) if s else d) for i, (d, s) in enumerate(sets)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def near_copies(n, edits, words=120, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield (1000 + i, " ".join(own), 0, 0, 0)


EDGE = [(9, None, 0, 0, 0), (8, "", 0, 0, 0), (7, " \t\x0b", 0, 0, 0), (6, "One", 0, 0, 0), (5, "oNE\n", 0, 0, 0), (5, "oNE\n", 0, 0, 0), (None, "one", 0, 0, 0), (4, "É a", 0, 0, 0), (3, "é a", 0, 0, 0), (None, "alone null", 0, 0, 0), (2, "w " * 30_000, 0, 0, 0), (1, "w w", 0, 0, 0), (0, "a b c d e f", 0, 0, 0), (-1, "a b c d e f g", 0, 0, 0), (10, "b c", 0, 0, 0)]


@pytest.mark.parametrize("size", [2, 5])
def test_edge_rows(spark, size):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    assert got(nd.find(docs, size)) == brute(EDGE, size)
    kept = nd.deduplicate(docs, size)
    assert kept.columns == docs.columns
    want = {d for d, _, c in brute(EDGE, size) if d == c}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, want - {None})) + ["None"] * (None in want)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert nd.find(docs).count() == 0 and nd.deduplicate(docs).count() == 0


def test_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "VERIFIED", 8)
    rows = [*near_copies(150, 16), *near_copies(60, 30, seed=2), *[(i, "same text here and there again", 0, 0, 0) for i in range(200)]]
    assert got(nd.find(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(nd.find(docs)) == brute([tuple(r)[:2] for r in docs.collect()])


def test_shingles_of_slices():
    texts = ["a b c", None, "", "one", "a b a b a b", "x y " * 500]
    at, key = nd.shingles(pa.array(texts))
    assert np.diff(at).tolist() == [2, 0, 0, 1, 2, 2]
    for i, t in enumerate(texts):
        own = nd.shingles(pa.array([t], pa.string()))[1]
        assert (own == key[at[i] : at[i + 1]]).all()
    assert nd.shingles(pa.array(["p q r s t"]), 5)[1].size == 1 and nd.shingles(pa.array(["p q r s"]), 5)[1].size == 1


def test_pruning_keeps_what_is_similar():
    for n in range(nd.BATCH, nd.BANDS * nd.ROWS + 1, nd.BATCH):
        assert 0.5 * n < nd.least_matches(n, 80) < 0.8 * n
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(2000):
        equal = rng.random(nd.BANDS * nd.ROWS) < 0.8
        lost += any(equal[:n].sum() < nd.least_matches(n, 80) for n in range(nd.BATCH, len(equal) + 1, nd.BATCH))
    assert lost <= 4


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = nd.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {x: root(x) for a, b in edges if a != b for x in (a, b)}
