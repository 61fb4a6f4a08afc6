"""Robots rules by their prefixes, held against every rule tried on every address."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import robots


def asked(rule, place):
    rule = rule or "/"
    end = rule.endswith("$")
    return re.match(".*".join(map(re.escape, (rule[:-1] if end else rule).split("*"))) + ("$" if end else ""), place) is not None


def wins(groups, agent, place):
    """(kind, path) of the winning rule."""
    own = [(len(t), -g) for g, (tokens, _) in enumerate(groups) for t in tokens if t != "*" and t in agent.lower()]
    common = [g for g, (tokens, _) in enumerate(groups) if "*" in tokens]
    if not own and not common:
        return None
    rules = groups[-max(own)[1] if own else common[-1]][1]
    met = [(-len(p.replace("*", "").removesuffix("$")), kind == "disallow", k, kind, p) for k, (kind, p) in enumerate(rules) if asked(p, place)]
    return min(met)[3:] if met else None


@pytest.mark.parametrize("seed", range(3))
def test_as_every_rule_tried(spark, seed):
    rng = np.random.default_rng(seed)
    piece = lambda n: "".join(rng.choice(list("ab/*.?"), n))
    files = {}
    for source in ("x", "y"):
        files[source] = [(sorted({str(t) for t in rng.choice(["*", "bot", "goodbot", "other"], 2)}), [(str(rng.choice(["allow", "disallow"])), "/" + piece(rng.integers(0, 5)) + str(rng.choice(["", "", "$"]))) for _ in range(12)]) for _ in range(3)]
    content = {s: "\n".join("\n".join([*(f"User-agent: {t}" for t in tokens), *(f"{k}: {p}" for k, p in rules)]) for tokens, rules in own) for s, own in files.items()}
    places = sorted({"/" + piece(6).replace("*", "a") for _ in range(150)} | {"/"})
    places = [p for p in places if not p.endswith("?")]  # an empty query is none
    tests = [(s, "https://h.example" + p, a) for s in (*files, "none") for p in places for a in ("GoodBot/1.0", "Unknown")]
    parsed = robots.parse(spark.createDataFrame(list(content.items()), "source string, content string"))
    found = robots.match(parsed, spark.createDataFrame(tests, "source string, url string, agent string")).collect()
    assert len(found) == len(set(tests))
    for r in found:
        won = wins(files[r.source], r.agent, r.url.removeprefix("https://h.example")) if r.source in files else None
        assert ((r.kind, r.path) if r.kind else None) == won and r.allowed == (won is None or won[0] == "allow")


def test_many_rules_meet_few_addresses(spark):
    """5,000 rules and 50,000 addresses: an address costs a row a length, not a row a rule."""
    content = "User-agent: *\n" + "\n".join(f"Disallow: /d{i:05}/" for i in range(5000)) + "\nDisallow: /*/x\n"
    parsed = robots.parse(spark.createDataFrame([("s", content)], "source string, content string")).cache()
    tests = spark.range(50_000).select(F.lit("s").alias("source"), F.format_string("https://h.example/d%05d/x", F.col("id") % 10_000).alias("url"), F.lit("bot").alias("agent"))
    cases = tests.withColumn("grp", F.lit(0)).withColumn("place", F.regexp_extract("url", "example(.*)$", 1))
    assert robots.candidates(robots.index(parsed), cases).count() == 50_000 + 25_000
    found = robots.match(parsed, tests)
    assert found.groupBy("path").count().orderBy("path").collect()[0].asDict() == {"path": "/*/x", "count": 5000} and found.where("allowed").count() == 0
    parsed.unpersist()
