"""Product codes held against plain rounds over all vectors, with rows of every odd kind."""

import hashlib
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from tidewater.llm import codes, queries

SCHEMA = "vec_id long, embedding array<double>, label int, code int, error string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if c is None else float(c) for c in e], label, 0, "e", 1) for i, e, label in rows], SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6):
    """{row: (code, error, sha256)} of rows of one length, in Python integers."""
    kept = [(i, [floor(4096 * Fraction(c)) for c in e], label) for i, e, label in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    d = len(kept[0][1])
    ends = [d * p // parts for p in range(parts + 1)]
    pieces = [[tuple(x[ends[p] : ends[p + 1]]) for _, x, _ in kept] for p in range(parts)]
    seeds = {}
    for i, x, _ in kept:
        if i is not None:
            seeds[i] = min(x, seeds.get(i, x))
    books = [[tuple(seeds[i][ends[p] : ends[p + 1]]) for i in sorted(seeds)[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for x in pieces[p]:
                own.setdefault(nearest(books[p], x)[1], []).append(x)
            books[p] = [tuple(sum(c) // len(own[e]) for c in zip(*own[e])) if e in own else y for e, y in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(v) for b in books for y in b for v in y).encode()).hexdigest()
    out, by_label = [], Counter()
    for row, (i, _, label) in enumerate(kept):
        found = [nearest(books[p], pieces[p][row]) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for _, e in found), sum(s for s, _ in found), label])
        by_label[label] += out[-1][2]
    return sorted(((i, code, error, by_label[label], sha) for i, code, error, label in out), key=repr)


def run(df, **options):
    coded = codes.compress(df, codes.fit(df, **options)).select("row.vec_id", "row.label", "code", "error", "codebooks_sha256")
    return sorted(((r.vec_id, r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in codes.with_label_error(coded).collect()), key=repr)


def test_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    have = sorted(map(tuple, queries.op13_codes(spark, "/root/testdata/sf0.001").select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)
    assert have == brute(rows)


def test_ties_edge_rows_and_a_frequent_vector(spark):
    """Components of few values: many pieces lie as near to several entries."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, 16) / 4096).tolist(), (0, 1, None)[i % 3]) for i in range(400, 0, -1)]
    rows += [(i, rows[3][1], 7) for i in range(500, 700)] + rows[:2] + [(1, [0.0] * 16, 9), (None, rows[9][1], None)]
    bad = [(0, None, 1), (0, [None] * 16, 1), (0, [float("nan")] * 16, 1), (0, [float("-inf")] * 16, 2)]
    df = frame(spark, bad + rows).repartition(5)
    assert run(df) == brute(rows)
    kept = codes.compress(df, codes.fit(df))
    assert kept.select("row.*").columns == df.columns


@pytest.mark.parametrize("size, parts, entries", [(11, 4, 5), (3, 8, 16), (64, 2, 40)])
def test_other_shapes(spark, size, parts, entries):
    rng = np.random.default_rng(size)
    rows = [(i, rng.normal(size=size).tolist(), i % 2) for i in range(90)]
    assert run(frame(spark, rows), parts=parts, entries=entries, rounds=3) == brute(rows, parts, entries, 3)


def test_few_ids_wide_integers_lengths_and_empty(spark):
    wide = [(i, [(-1) ** i * 2.0**30 * i, i / 7, -i, 2.0**31 + i], i % 2) for i in range(6)]
    assert run(frame(spark, wide), parts=2) == brute(wide, parts=2)
    short = [(i, [i / 3] * 8, 0) for i in range(20)]
    own = {r[0]: r for r in run(frame(spark, short + [(100 + i, [i / 5] * 16, 5) for i in range(20)]))}
    assert [own[i] for i in range(20)] == sorted(brute(short), key=lambda r: r[0])
    nameless = frame(spark, [(None, [1.0] * 8, 1)])
    assert [(r.code, r.error) for r in codes.compress(nameless, codes.fit(nameless)).collect()] == [(None, None)]
    assert run(frame(spark, [])) == [] and run(frame(spark, [(1, None, 2)])) == []
    assert [r.code for r in codes.compress(frame(spark, [(1, [], 2)]), codes.fit(frame(spark, [(1, [], 2)]))).collect()] == ["00" * 8]


def test_an_error_beyond_a_long_is_null(spark, tmp_path):
    frame(spark, [(i, [(i - 12) * 2.0**47 * (i > 15), 0.0] * 4, i) for i in range(20)]).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = queries.op13_codes(spark, str(tmp_path)).collect()
    assert len(rows) == 20 and any(r.error is None for r in rows) and all(r.code for r in rows)


def test_frequent_labels_meet_their_sum(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id as vec_id", "cast(case when id % 3 = 0 then null when id % 3 = 1 then 1 else id end as int) as label", "cast(id as decimal(38,0)) as error")
    monkeypatch.setattr(codes, "HOT", 5)
    want = Counter()
    for r in rows.collect():
        want[r.label] += r.error
    assert all(r.label_error == want[r.label] for r in codes.with_label_error(rows).collect())


def test_tree_equals_plain_search():
    rng = np.random.default_rng(9)
    for width, span in ((1, 3), (2, 5), (8, 2), (8, 1000)):
        book, x = rng.integers(-span, span + 1, (40, width)), rng.integers(-span, span + 1, (500, width))
        gaps = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = codes.Tree(book).nearest(x)
        assert (index == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()


def test_tree_leaves_branches_out():
    """In two dimensions most leaves are not visited."""
    rng = np.random.default_rng(2)
    book = rng.integers(0, 10_000, (256, 2))
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            got = super().__getitem__(at)
            if isinstance(at, np.ndarray) and at.dtype.kind == "i":
                looked.append(len(at))
            return got

    codes.Tree(book).nearest(rng.integers(0, 10_000, (1000, 2)).view(Counted))
    assert sum(looked) < 0.1 * 256 * 1000


def test_codes_restore(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    books = codes.fit(df)
    rows = codes.compress(df, books).collect()
    back = codes.restore([r.code for r in rows], books[64])
    exact = np.floor(np.array([r.row.embedding for r in rows]) * 4096).astype(int)
    assert ((exact - back) ** 2).sum(axis=1).tolist() == [int(r.error) for r in rows]
