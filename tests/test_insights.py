"""What redirects, links and depths say of pages, from links that are resolved once."""

from pyspark.sql import functions as F

from tidewater.operators import rules
from tidewater.plans.queries import QUERIES

CRAWL = "ord long, url string, initial_url string, final_url string, redirected_url string, status_code int, redirect_chain array<struct<url:string,status:int,type:string>>"


def test_insights_of_odd_rows(spark):
    """Rows that come twice stay twice, a key that two lists name is one hit, null keys and chains are none."""
    hop = lambda *urls: [(u, 301, "http") for u in urls]
    page = lambda k, code, chain: (k, f"http://x.example/{k}", None, f"http://y.example/{k}", None, code, chain)
    crawl = spark.createDataFrame([page(0, 200, []), page(1, 404, hop("http://a/", "http://a/")), page(2, 200, hop("http://a/")), page(3, 200, None), page(3, 200, None), page(4, None, hop("http://a/", "http://b/"))], CRAWL)
    keys = spark.createDataFrame([(0, 0, 200, None), (1, 1, 404, ""), (2, 2, 200, "noindex"), (3, 3, 200, ""), (None, 4, 200, "")], "key long, ord long, status_code int, robots string")
    edges = spark.createDataFrame([(3, 0, "a", True), (3, 1, "a", True), (0, 1, "b", True), (2, 1, None, True), (0, 3, "a", False), (0, None, "a", True)], "src long, dst long, anchor string, is_internal boolean")
    depths = spark.createDataFrame([(0, 4), (3, 4), (3, 5), (1, 3), (None, 9)], "key long, depth int")
    found = rules.insights(crawl, keys, edges, depths)
    assert sorted((r.ord, r.rule_id.removeprefix("insight-")) for r in found.collect()) == [
        (0, "deep-pages"), (0, "low-link-pages"), (1, "redirect-broken-end"), (1, "redirect-chains"), (1, "redirect-loops"), (3, "deep-pages"), (3, "deep-pages"), (3, "orphan-pages"), (3, "orphan-pages"), (4, "redirect-chains"),
    ]
    assert rules.insights(crawl, keys, edges.where("not is_internal"), depths).where(~F.col("rule_id").contains("redirect")).count() == 0


def test_links_are_resolved_once(spark, sf_dir):
    plan = QUERIES["insight_issues"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("Generate explode(") == 1
