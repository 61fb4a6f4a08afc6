"""What the search writes and makes on its way."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import graph
from tidewater.plans.storage import stored


def _written(monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "stored", lambda df, name: tables.append((name, out := stored(df, name))) or out)
    return tables


def test_rounds_write_only_what_moved(spark, monkeypatch):
    """Blocks of two links, so that chains need rounds; links that have come to their origin are not written again, and the chains are those of one block."""
    links = spark.createDataFrame([*[(i, i + 1) for i in range(200)], *[(i, 1000 + i) for i in range(0, 200, 40)], *[(0, 2000 + i) for i in range(300)], (5000, 5001), (5001, 5002), (5002, 5000)], "src long, dst long")
    root = spark.createDataFrame([(0,)], "key long")
    want = sorted(tuple(r) for r in graph.chains(links, root).collect())
    tables = _written(monkeypatch)
    found = sorted(tuple(r) for r in graph.chains(links, root, 2).collect())
    rounds = [t for name, t in tables if name == "jumped"]
    assert found == want and len(rounds) > 4
    assert all(later.count() <= sooner.where("at is not null").count() for sooner, later in zip(rounds, rounds[1:], strict=False))


def test_loops_and_nulls_lead_nowhere(spark, monkeypatch):
    """The ends of links are made once: no condition on them moves below the step that makes them."""
    made = spark.createDataFrame([("1", "1"), ("1", "2"), ("1", "2"), ("2", None), (None, "3"), ("2", "4"), ("4", "4"), ("4", "1"), ("7", "8")], "a string, b string")
    edges = made.select(F.conv("a", 10, 10).cast("long").alias("src"), F.conv("b", 10, 10).cast("long").alias("dst"))
    plans = []
    monkeypatch.setattr(graph, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or stored(df, name))
    assert {r.key: r.depth for r in graph.spider(edges, 1).collect()} == {1: 0, 2: 1, 4: 2}
    assert plans[0][0] == "links" and plans[0][1].count("conv(") == 2


@pytest.mark.parametrize(("kind", "seed"), [("long", 7), ("string", "x"), ("long", None)])
def test_a_seed_without_links(spark, kind, seed):
    found = graph.spider(spark.createDataFrame([], f"src {kind}, dst {kind}"), seed)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [("key", {"long": "bigint"}.get(kind, kind)), ("depth", "int")]
    assert [tuple(r) for r in found.collect()] == [(seed, 0)]
