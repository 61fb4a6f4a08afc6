import numpy as np
import pyarrow as pa

from tidewater.llm import langid
from tidewater.llm.common import remainder

SCHEMA = "doc_id long, text string, lang string, score int, rejected int"


def test_counts_are_those_of_each_text():
    texts = ["Ab c", None, "", "1 2 3", "é", "long text " * 3000, "a"]
    whole = langid.counts(pa.array(texts))
    for i, t in enumerate(texts):
        assert (langid.counts(pa.array([t], pa.string()))[0] == whole[i]).all()
    assert (langid.counts(pa.array(texts).slice(3, 3)) == whole[3:6]).all()
    letters = {x for x in "ab c".encode() if x != 32}
    assert all(whole[0][x % langid.WIDTH] >= 1 for x in letters)
    assert whole[1].sum() == whole[2].sum() == whole[3].sum() == 0


def brute(model, texts):
    for t in texts:
        x = np.log1p(langid.counts(pa.array([t]))[0]) * model.idf
        n = np.linalg.norm(x)
        cosines = [float(c @ x / n) if n else 0.0 for c in model.centroids]
        yield model.languages[model.of[int(np.argmax(cosines))]], max(cosines)


def test_table(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").withColumn("held_out", remainder("doc_id") == 0).collect()
    for r, (name, cosine) in zip(rows[:200], brute(model, [r.text for r in rows[:200]]), strict=True):
        assert r.lang_pred == name and abs(r.score - cosine) < 1e-4
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 100 and sum(held) >= 0.97 * len(held)
    assert len(model.centroids) > len(model.languages)


def test_edge_rows(spark, sf_dir):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = spark.createDataFrame([(1, None, "en", 0, 0), (2, "", "en", 0, 0), (3, "12 !? \n", None, 0, 0), (4, "z", None, 0, 0), (5, "the and of " * 20_000, None, 0, 0), (None, "und der die", None, 0, 0), (6, "日本語", None, 0, 0)], SCHEMA)
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [rows[i].score for i in (1, 2, 3)] == [0] * 3
    assert rows[4].lang_pred in model.languages and rows[5].lang_pred == "en" and rows[None].lang_pred == "de"
    assert rows[6].rejected and {r.doc_id: r.lang for r in langid.identify(docs, model).collect()}[6] == "und"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None, 0, 0)], SCHEMA)
    assert langid.fit(docs) is None and langid.fit(docs.limit(0)) is None
    assert langid.predict(docs, None).first().lang_pred == "und"
