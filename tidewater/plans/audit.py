"""An audit of a crawl in one call: links, click depths, rule hits and scores, each worked out once and shared by all reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import graph, links, report, rules
from ..sources import pages as page_source
from .storage import stored


class Audit(NamedTuple):
    """crawl: the records; edges, keys, depths and hits: stored tables that the reports read."""

    crawl: DataFrame
    edges: DataFrame
    keys: DataFrame
    depths: DataFrame
    hits: DataFrame
    flags: set[str] | None

    def issues(self) -> DataFrame:
        """Rules with hits, their share of the pages and their priority."""
        return rules.prioritised(self.hits, self.crawl.count())

    def categories(self) -> DataFrame:
        return rules.categories(self.issues(), self.flags)

    def overall(self) -> DataFrame:
        return rules.overall(self.categories())

    def directories(self) -> DataFrame:
        return report.directories(self.crawl, self.depths)

    def equity(self) -> DataFrame:
        return links.equity(self.keys, self.edges)

    def unreachable(self) -> DataFrame:
        return graph.unreachable(self.keys, self.depths)

    def pages(self) -> DataFrame:
        """ord, url, status_code, depth (null if no click leads there), incoming, score, issues, critical of each page."""
        severity = F.broadcast(rules.dimension(self.crawl.sparkSession).select("rule_id", "severity"))
        found = self.hits.join(severity, "rule_id").groupBy("ord").agg(F.count("*").alias("issues"), F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"))
        rows = self.crawl.select("ord", "url", "status_code", urls.analysis_key(F.col("url")).alias("key"))
        rows = rows.join(self.depths, "key", "left").join(self.equity().select("key", "incoming", "score"), "key", "left").join(found, "ord", "left")
        return rows.select("ord", "url", "status_code", "depth", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("critical", F.lit(0)).alias("critical"))


def crawled(fetched: DataFrame, links: str = "main") -> DataFrame:
    """Crawl records of fetched pages (ord, url, html and what `sources.pages.follow` says of the answers)."""
    page = fetched.select(F.col("ord").alias("page_id"), F.coalesce("final_url", "url").alias("url"), "html")
    records = page_source.extract(page, links).drop("url")
    return fetched.drop("html").join(records, "ord", "left")


def audit(crawl: DataFrame, flags: set[str] | None = None) -> Audit:
    """The audit of crawl records; depths count from the homepage of each site. flags: the fields that were extracted, all if None."""
    edges = stored(links.edges(crawl), "edges")
    path = F.regexp_extract("url", "^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    keys = stored(links.pages(crawl).select("key", "ord", urls.host(F.col("url")).alias("site"), "status_code", "robots", path.alias("path")), "keys")
    depths = stored(graph.click_depth(keys, edges, site="site"), "depths")
    hits = stored(rules.hits(crawl, flags).unionByName(rules.insights(crawl, keys, edges, depths, flags)), "hits")
    return Audit(crawl, edges, keys, depths, hits, flags)
