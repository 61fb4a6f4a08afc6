"""The link graph: equity, anchors, attributes, orphans. Edges are (src, dst, anchor, pos, is_internal, rel, nofollow, sponsored, ugc)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.scalars import count_if, equity_score, equity_strength, indexable, link_status, text


def edges(crawl: DataFrame) -> DataFrame:
    """One row a link; keys by the analysis key, relative links as seen from their page."""
    own = urls.with_analysis_key(crawl.select("ord", "url", "internal_links"), "page_key", F.col("url"))
    rows = own.select("ord", "url", "page_key", F.posexplode("internal_links").alias("pos", "link")).select("ord", "url", "page_key", "pos", "link.*")
    # only links that need it go to Python
    rows = rows.withColumn("plain", F.when(urls.is_absolute(F.col("href")), F.col("href")).otherwise(urls.join_plain(F.col("url"), F.col("href"))))
    others = [F.when(F.col("plain").isNull(), F.col(c)) for c in ("url", "href")]
    rows = urls.with_analysis_key(rows, "dst", F.coalesce("plain", urls.join(*others), "href"))
    return rows.select("ord", F.col("page_key").alias("src"), "dst", F.col("anchor_text").alias("anchor"), "pos", F.coalesce("is_internal", F.lit(False)).alias("is_internal"), text("rel").alias("rel"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("nofollow", "sponsored", "ugc")), F.col("href"), F.col("url").alias("page_url"))


def pages(crawl: DataFrame) -> DataFrame:
    """One row a key: the last crawled page wins."""
    last = Window.partitionBy("key").orderBy(F.desc("ord"))
    return crawl.withColumn("key", urls.analysis_key(F.col("url"))).withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def inbound(links: DataFrame, keys: DataFrame) -> DataFrame:
    """key, incoming, unique_anchors of crawled pages (key) with internal links to them."""
    anchor = F.lower(F.trim(text("anchor")))
    return links.where("is_internal").join(keys.select(F.col("key").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("incoming"), F.countDistinct(F.when(anchor != "", anchor)).alias("unique_anchors"))


def top_anchor(links: DataFrame) -> DataFrame:
    """key, top_anchor: the most frequent anchor, the first seen of equals."""
    anchor = F.lower(F.trim(text("anchor")))
    counted = links.where("is_internal").select("dst", anchor.alias("anchor"), F.struct("ord", "pos").alias("seen")).where("anchor <> ''").groupBy("dst", "anchor").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    order = Window.partitionBy("dst").orderBy(F.desc("n"), "first")
    return counted.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(F.col("dst").alias("key"), F.col("anchor").alias("top_anchor"))


def equity(keys: DataFrame, links: DataFrame) -> DataFrame:
    """key, incoming, outgoing, unique_anchors, diversity, score, strength, overlinked, top_anchor of each page."""
    outgoing = links.where("is_internal").groupBy(F.col("src").alias("key")).agg(F.count("*").alias("outgoing"))
    joined = keys.select("key").join(inbound(links, keys), "key", "left").join(outgoing, "key", "left").join(top_anchor(links), "key", "left")
    n = F.coalesce("incoming", F.lit(0))
    unique = F.coalesce("unique_anchors", F.lit(0))
    return joined.select("key", n.alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"), unique.alias("unique_anchors"), F.when(n > 0, unique / n).otherwise(0.0).alias("diversity"), equity_score(n).alias("score"), equity_strength(n).alias("strength"), (F.coalesce("outgoing", F.lit(0)) > 100).alias("overlinked"), F.when(n > 0, F.col("top_anchor")).alias("top_anchor"))


def equity_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("pages"), count_if(F.col("strength") == "strong").alias("strong"), count_if(F.col("strength") == "weak").alias("weak"), count_if(F.col("strength") == "orphan").alias("orphan"), count_if(F.col("overlinked")).alias("overlinked"), count_if((F.col("incoming") >= 5) & (F.col("diversity") < 0.3)).alias("low_diversity"), F.coalesce(F.max("incoming"), F.lit(0)).alias("max_incoming"))


def equity_top(report: DataFrame, by: str = "score", n: int = 500) -> DataFrame:
    return report.orderBy(F.desc(by), "key").limit(n)


def orphans(keys: DataFrame, links: DataFrame) -> DataFrame:
    """key, status_code, indexable of pages without an internal link to them."""
    return keys.join(links.where("is_internal").select(F.col("dst").alias("key")), "key", "left_anti").select("key", "status_code", indexable().alias("indexable"))


def low_links(keys: DataFrame, links: DataFrame, most: int = 2) -> DataFrame:
    return keys.select("key").join(inbound(links, keys), "key").where(F.col("incoming") <= most).select("key", F.col("incoming").alias("inbound"))


def audit(links: DataFrame) -> DataFrame:
    """Each link with its status and whether an external one lacks a rel."""
    rel = ~F.col("is_internal") & ~F.col("nofollow") & ~F.col("sponsored") & ~F.col("ugc")
    return links.select("src", "dst", "anchor", "pos", "rel", "is_internal", "nofollow", "sponsored", "ugc", link_status(F.col("rel"), F.col("nofollow"), F.col("sponsored"), F.col("ugc")).alias("status"), rel.alias("missing_rel"))


def attribute_counts(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count("*").alias("links"), count_if(~F.col("is_internal")).alias("external"), count_if(F.col("missing_rel")).alias("missing_rel"), *(count_if(F.col(c)).alias(c) for c in ("nofollow", "sponsored", "ugc")))


def to_redirects(links: DataFrame, redirecting: DataFrame) -> DataFrame:
    """src, dst of internal links to pages (key) that redirect."""
    return links.where("is_internal and src <> dst").join(redirecting.select(F.col("key").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def graph_edges(links: DataFrame) -> DataFrame:
    """src, dst, links, anchors of the distinct internal edges without loops; anchors in the order first seen."""
    rows = links.where("is_internal and src <> dst").withColumn("anchor", F.trim(text("anchor")))
    first = rows.groupBy("src", "dst", "anchor").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    named = F.filter(F.array_sort(F.collect_list(F.struct("pos", "anchor"))), lambda x: x["anchor"] != "")
    return first.groupBy("src", "dst").agg(F.sum("n").alias("links"), F.array_join(F.transform(named, lambda x: x["anchor"]), " | ").alias("anchors"))


def graph_nodes(keys: DataFrame, graph: DataFrame) -> DataFrame:
    """key, in_degree, out_degree, crawled, is_orphan, size of pages and of what they link to."""
    crawled = keys.select("key").withColumn("crawled", F.lit(True))
    ins = graph.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("in_degree"))
    outs = graph.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("out_degree"))
    nodes = crawled.join(ins, "key", "full").join(outs, "key", "full")
    n = F.coalesce("in_degree", F.lit(0))
    return nodes.select("key", n.alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("crawled", F.lit(False)).alias("crawled"), (n == 0).alias("is_orphan"), F.least(F.lit(12.0), 2 + 2 * F.log2(n + 1)).alias("size"))


def capped(nodes: DataFrame, graph: DataFrame, by: list, n: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first n nodes in an order, and the edges between them."""
    kept = nodes.orderBy(*by).limit(n)
    ends = kept.select("key")
    inside = graph.join(ends.withColumnRenamed("key", "src"), "src", "left_semi").join(ends.withColumnRenamed("key", "dst"), "dst", "left_semi")
    return kept, inside


def neighbourhood(graph: DataFrame, key) -> DataFrame:
    """key, direction, anchors of the pages one link from a page."""
    ins = graph.where(F.col("dst") == F.lit(key)).select(F.col("src").alias("key"), F.lit("in").alias("direction"), "anchors")
    return ins.unionByName(graph.where(F.col("src") == F.lit(key)).select(F.col("dst").alias("key"), F.lit("out").alias("direction"), "anchors"))
