"""Whitening held against a plain version over all vectors at once, with rows of every odd kind."""

import numpy as np
import pytest

from tidewater.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, n int, row string, whitened int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if c is None else float(c) for c in e], 1, "r", 2) for i, e in rows], SCHEMA)


def brute(rows, k=4):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} in Python integers and one covariance."""
    kept = [(i, tuple(int(np.floor(256 * c)) for c in e)) for i, e in rows if e and all(c is not None and np.isfinite(c) for c in e)]
    fitted = sorted({x for _, x in kept})
    n, d = len(fitted), len(fitted[0])
    s = [sum(x[j] for x in fitted) for j in range(d)]
    centred = np.array([[(n * x[j] - s[j]) / n for j in range(d)] for x in fitted])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, x in kept:
        deviation = sum((n * x[j] - s[j]) ** 2 for j in range(d))
        y = np.array([(n * x[j] - s[j]) / n for j in range(d)]) @ directions[:, ::-1]
        out += [(i, c + 1, n, deviation, abs(y[c]) / values[-1 - c] ** 0.5, values[-1 - c] / values.sum()) for c in range(min(k, d))]
    return sorted(out, key=repr)


def check(df, rows):
    have, want = sorted(df.collect(), key=lambda r: repr((r.vec_id, r.component, r.n, r.deviation))), brute(rows)
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in have] == [w[:4] for w in want]
    assert [abs(r.whitened) for r in have] == pytest.approx([w[4] for w in want], abs=1e-7)
    assert [r.explained for r in have] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(r.identity_error < 1e-9 for r in have)


def run(df, **options):
    return whitening.components(whitening.whiten(df, whitening.fit(df, **options)))


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(queries.op11_whitening(spark, "/root/testdata/sf0.01"), [(r.vec_id, r.embedding) for r in df.collect()])


def test_edge_rows_and_a_frequent_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 1] + 4000).tolist()) for i in range(300)]  # a large mean
    rows += [(i, rows[0][1]) for i in range(300, 450)] + rows[7:9] + [(None, rows[5][1]), (3, rows[4][1])]
    bad = [(900, None), (901, [None, 1, 2, 3, 4, 5]), (902, [float("nan")] * 6), (903, [float("inf")] + [1] * 5), (904, [])]
    df = frame(spark, bad + rows).repartition(5)
    check(run(df), rows)
    kept = whitening.whiten(df, whitening.fit(df))
    assert kept.columns == ["row", "n", "deviation", "whitened", "explained", "identity_error"] and kept.select("row.*").columns == df.columns
    # the same sign for all rows, and in every run
    first = {(r.vec_id, r.component): r.whitened for r in run(df).collect()}
    assert {(r.vec_id, r.component): pytest.approx(r.whitened, abs=1e-9) for r in run(df.repartition(2)).collect()} == first


def test_lengths_without_variance_and_empty(spark):
    rows = [(i, [i, 2 * i, 7]) for i in range(5)] + [(10, [1, 2]), (11, [1, 2])] + [(i, [i * i]) for i in range(20, 24)]
    found = {(r.vec_id, r.component): r for r in run(frame(spark, rows)).collect()}
    assert set(found) == {(i, c) for i, e in rows for c in range(1, len(e) + 1)}
    line = found[4, 1]
    assert line.n == 5 and abs(line.whitened) == pytest.approx(2**0.5) and line.explained == pytest.approx(1) and line.identity_error < 1e-9
    assert found[4, 2].whitened is None and found[4, 2].explained == 0
    # one vector alone
    assert (found[10, 1].n, found[10, 1].deviation, found[10, 1].whitened, found[10, 1].explained, found[10, 1].identity_error) == (1, 0, None, None, None)
    assert found[23, 1].n == 4 and found[23, 1].identity_error < 1e-9
    assert run(frame(spark, [])).count() == 0 and run(frame(spark, [(1, None), (2, [])])).count() == 0


def test_wide_integers_are_exact(spark):
    rows = [(i, [float(v) * 2**40, i]) for i, v in enumerate((3, -5, 11, 2**10, -(2**9), 7))]
    df = frame(spark, rows)
    have = {r.row.vec_id: int(r.deviation) for r in whitening.whiten(df, whitening.fit(df)).collect()}
    assert have == {w[0]: w[3] for w in brute(rows, 1)}
    assert {r.deviation for r in run(df).collect() if have[r.vec_id] >= 2**63} == {None}
    # beyond a long: no crash, and the ends of its range
    assert all(r.n == 2 for r in run(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 1.0])])).collect())


def test_deviations_in_limbs():
    rng = np.random.default_rng(5)
    n, x = 10**13 + 7, rng.integers(-(1 << 20), 1 << 20, (50, 8))
    total = [int(v) for v in rng.integers(-(10**17), 10**17, 8)]
    mean = whitening.Mean(n, [s // n for s in total], [s % n for s in total])
    assert mean.deviations(x) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]
