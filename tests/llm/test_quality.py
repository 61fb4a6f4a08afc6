import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import quality as q
from tidewater.llm.common import remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score int"
LABELS = "doc_id long, quality int, toxic int"


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    x, w, v = rng.normal(size=6), rng.normal(size=6), rng.normal(size=(6, 3))
    z = 0.2 + w @ x + sum(v[i] @ v[j] * x[i] * x[j] for i in range(6) for j in range(i + 1, 6))
    got = q.Machine(0.2, w, v).score(np.zeros(6, int), np.arange(6), x, 1)
    assert got[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_vectors_do_not_depend_on_the_batch():
    texts = ["One two, two THREE!\n7 é", None, "", " \n ", "x" * 50_000, "w " * 30_000]
    whole = q.vectors(pa.array(texts), pa.array([1.0, None, 0.0, 3.0, 5e4, None]))
    for i, (t, n) in enumerate(zip(texts, [1.0, None, 0.0, 3.0, 5e4, None], strict=True)):
        row, feature, value = q.vectors(pa.array([t], pa.string()), pa.array([n], pa.float64()))
        own = whole[0] == i
        assert (whole[1][own] == feature).all() and np.allclose(whole[2][own], value) and len(row) >= q.STATISTICS
    sliced = q.vectors(pa.array(texts).slice(2, 3), pa.array([0.0, 3.0, 5e4]))
    assert (sliced[1] == whole[1][(whole[0] >= 2) & (whole[0] < 5)]).all()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 0, 0), (2, "", "en", "s", 0, 0, 0), (None, "no id", None, None, 5, 0, 0), (3, "w " * 40_000, "en", "s", None, 0, 0), (3, "w " * 40_000, "en", "s", None, 0, 0)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, None), (None, 1, 0), (3, None, 1), (99, 1, 1)], LABELS)
    machine = q.fit(docs, labels)
    rows = q.score(docs, machine).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert q.keep(docs, machine, 0.0).columns == docs.columns and q.keep(docs, machine, 0.0).count() == 5
    assert q.keep(docs, machine, 1.1).count() == 0
    nothing = q.fit(docs, labels.limit(0))
    assert {r.score for r in q.score(docs, nothing).collect()} == {0.5}
    assert q.score(docs.limit(0), machine).count() == 0 and q.score(docs.limit(0), q.fit(docs.limit(0), labels)).count() == 0
    assert q.score(docs.select("doc_id", "text"), machine).count() == 5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = q.score(docs, q.fit(docs, labels)).join(labels, "doc_id").where(remainder("doc_id") == 0).collect()
    for label in (0, 1):
        own = [(r.score >= q.THRESHOLD) == bool(label) for r in rows if r.quality == label]
        assert len(own) > 50 and sum(own) >= (0.9 if label == 0 else 0.99) * len(own)


def test_fold_is_never_learned(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.selectExpr("doc_id", "if(coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5, 0) = 0, 1 - quality, quality) as quality")
    a, b = q.fit(docs, labels), q.fit(docs, changed)
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()


def test_learns_from_all_labels_up_to_the_bound(spark, monkeypatch):
    docs = spark.range(10_600).selectExpr("id as doc_id", "concat('word ', id % 50) as text", "cast(8 as int) as n_chars")
    labels = spark.range(10_600).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    seen = []
    monkeypatch.setattr(q, "train", lambda row, feature, value, label, seed=5: seen.append(len(label)))
    q.fit(docs, labels.where("doc_id < 9000"))
    q.fit(docs, labels)
    known = labels.where("doc_id < 9000 and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").count()
    assert 4000 < known < 8000 and seen == [known, 8000]
