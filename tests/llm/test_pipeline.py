import duckdb

import corpus_pipeline as p
from tidewater.llm import mixing, quality, secrets

from .test_near_dedup import brute
from .test_packing import brute as pieces_of
from .test_packing import whole


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]

    before, after = seen["quality"]
    scores = {r.doc_id: r.score for r in quality.score(before, quality.fit(before, labels)).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, s in scores.items() if s >= quality.THRESHOLD}

    before, after = seen["near-dedup"]
    want = {d for d, _, c in brute([(r.doc_id, r.text) for r in before.collect()], 5) if d == c}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)

    before, after = seen["secrets"]
    texts = {r.doc_id: r for r in before.collect()}
    assert after.count() == len(texts)
    found = secrets.scan(before, secrets.fit(secrets.labelled_findings(spark))).collect()
    for r in found:
        t = texts[r.doc_id].text
        assert secrets.MASK in {x.doc_id: x.text for x in after.collect()}[r.doc_id]
        assert t[r.start - 1 : r.start - 1 + r.length] not in {x.doc_id: x.text for x in after.collect()}[r.doc_id]
    changed = {r.doc_id for r in found}
    assert all(r.text == texts[r.doc_id].text for r in after.collect() if r.doc_id not in changed)

    before, after = seen["mixing"]
    con = duckdb.connect()
    frame = before.toPandas()
    con.register("documents", frame)
    con.execute(f"create view labels as select * from '{sf_dir}/labels.parquet'")
    taken = {d: t for d, t in con.execute(f"select doc_id, taken from ({mixing.SQL})").fetchall()}
    words = {}
    for r in after.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {d: t for d, t in taken.items() if t}

    before, after = seen["packing"]
    rows = after.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(pieces_of([(r.doc_id, r.text) for r in before.collect()]))
    whole(rows)

    run = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in p.run(spark, sf_dir).collect())
    assert run == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


EXTRA = "row int, tie int, score string, component_id int"
EDGE = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, "w " * 9_000, None, "a", 18_000),
    (None, "an id is lacking here but the words are plain", "de", "b", 45),
    (4, "one and the same text of some more words than five", "en", "b", 50),
    (4, "one and the same text of some more words than five", "en", "b", 50),
    (5, "one and the same text of some more words than five", "en", None, 50),
    (6, "export GITHUB_TOKEN=ghp_9aZ3kQ7xT1mB5vR8wL2nC6yD4pF0sG1hJ3uE for the build", "en", "a", 75),
]


def tables(spark, path, docs, labels):
    spark.createDataFrame([(*r, 1, 2, "x", 3) for r in docs], f"doc_id long, text string, lang string, source string, n_chars int, {EXTRA}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_edge_rows_through_all_stages(spark, tmp_path):
    """Without labels of both kinds no document is rejected; nulls, repeats and clashing names go through every stage."""
    path = tables(spark, tmp_path, EDGE, [(1, None, 0), (None, 0, 0)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, path)
        assert name == p.STAGES[-1][0] or out.columns == docs.columns
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen[name] = sorted(docs.collect(), key=repr)
    assert len(seen["quality"]) == len(EDGE)
    kept = {d for d, _, c in brute([r[:2] for r in EDGE], 5) if d == c}
    assert {r.doc_id for r in seen["near-dedup"]} >= kept - {None} and sum(r.doc_id in (4, 5) for r in seen["near-dedup"]) == 1
    assert all((r.row, r.tie, r.score, r.component_id) == (1, 2, "x", 3) for name in ("quality", "near-dedup", "secrets", "mixing") for r in seen[name])
    masked = next(r.text for r in seen["secrets"] if r.doc_id == 6)
    assert secrets.MASK in masked and "ghp_" not in masked
    assert all(r.text for r in seen["mixing"])
    assert len(whole_rows := seen["packing"]) and whole(whole_rows)


def test_empty_documents_and_labels(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "some").mkdir()
    assert p.run(spark, tables(spark, tmp_path / "none", [], [])).count() == 0
    assert p.run(spark, tables(spark, tmp_path / "some", EDGE[:2], [])).count() == 0  # without words, nothing is drawn
