"""The issue rules: a registry of predicates, evaluated in one scan, and what becomes of their hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import links, redirects
from ..functions.scalars import blank, js_round, leading_number, mentions, ok, text

WEIGHTS = {"critical": 55, "warning": 25, "info": 8}
FLAGS = ("title", "description", "h1", "h2", "h3", "images", "robots", "canonical", "schemas", "social", "links", "hreflang")


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    group: str
    flag: str
    title: str
    test: Callable[[], Column]


def _size(c: str) -> Column:
    return F.size(F.coalesce(F.col(c), F.array()))


def _shared(name: str) -> Column:
    """Whether another 2xx row has the same text; `hits` puts the column there."""
    return F.col(f"_shared_{name}")


#: The rules that look at other pages, by the text they compare.
SHARED = {"title": "title-duplicate", "description": "desc-duplicate", "h1": "h1-duplicate"}


def shared_keys() -> dict[str, Column]:
    """What pages of one text have in common, null for pages that are not counted."""
    texts = {"title": text("title"), "description": text("description"), "h1": text(F.get("h1s", F.lit(0)))}
    return {name: F.when(ok() & (F.lower(F.trim(c)) != ""), F.lower(F.trim(c))) for name, c in texts.items()}


def with_shared(crawl: DataFrame) -> DataFrame:
    """Flags for texts that several 2xx rows have: counted by text, so that a very frequent one is a sum, not a group."""
    for name, key in shared_keys().items():
        counts = crawl.groupBy(key.alias("_key")).agg(F.count("*").alias("_n")).where("_key is not null and _n > 1").select("_key", F.lit(True).alias(f"_shared_{name}"))
        crawl = crawl.withColumn("_own", key).join(counts, F.col("_own") == F.col("_key"), "left").drop("_own", "_key").withColumn(f"_shared_{name}", F.coalesce(f"_shared_{name}", F.lit(False)))
    return crawl


def _length(c: str, low: int, high: int = 1 << 30) -> Column:
    return F.length(text(c)).between(low, high)


_any = lambda c, test: F.coalesce(F.exists(c, test), F.lit(False))

RULES = [
    Rule("title-missing", "critical", "Meta Titles", "title", "No title", lambda: ok() & blank("title")),
    Rule("title-too-long", "warning", "Meta Titles", "title", "Title over 60 characters", lambda: ok() & _length("title", 61)),
    Rule("title-too-short", "warning", "Meta Titles", "title", "Title under 30 characters", lambda: ok() & _length("title", 1, 29)),
    Rule("title-duplicate", "warning", "Meta Titles", "title", "Title on several pages", lambda: ok() & _shared("title")),
    Rule("desc-missing", "critical", "Meta Descriptions", "description", "No description", lambda: ok() & blank("description")),
    Rule("desc-too-long", "warning", "Meta Descriptions", "description", "Description over 160 characters", lambda: ok() & _length("description", 161)),
    Rule("desc-too-short", "info", "Meta Descriptions", "description", "Description under 70 characters", lambda: ok() & _length("description", 1, 69)),
    Rule("desc-duplicate", "warning", "Meta Descriptions", "description", "Description on several pages", lambda: ok() & _shared("description")),
    Rule("h1-missing", "critical", "H1 Tags", "h1", "No h1", lambda: ok() & (_size("h1s") == 0)),
    Rule("h1-multiple", "warning", "H1 Tags", "h1", "Several h1", lambda: ok() & (_size("h1s") > 1)),
    Rule("h1-duplicate", "warning", "H1 Tags", "h1", "First h1 on several pages", lambda: ok() & _shared("h1")),
    Rule("h2-missing", "info", "H2 Tags", "h2", "No h2", lambda: ok() & (_size("h2s") == 0)),
    Rule("img-alt-missing", "warning", "Images", "images", "Images without alt text", lambda: ok() & _any("images", lambda i: blank(i["alt"]))),
    Rule("robots-noindex", "critical", "Meta Robots", "robots", "Kept out of indexes", lambda: ok() & mentions("robots", "noindex")),
    Rule("canonical-missing", "warning", "Canonicals", "canonical", "No canonical", lambda: ok() & (F.col("canonical_status") == "Missing")),
    Rule("canonical-away", "info", "Canonicals", "canonical", "Canonical is another page", lambda: ok() & (F.col("canonical_status") == "Canonicalised")),
    Rule("schema-missing", "info", "Schema Markup", "schemas", "No structured data", lambda: ok() & (_size("schemas") == 0)),
    Rule("social-missing", "warning", "Open Graph & Twitter", "social", "No social tags", lambda: ok() & (_size("social_tags") == 0)),
    Rule("internal-orphan", "warning", "Internal Links", "links", "No links on the page", lambda: ok() & (_size("internal_links") == 0)),
    Rule("links-missing-rel", "info", "Internal Links", "links", "External links without rel", lambda: ok() & _any("internal_links", lambda x: ~x["is_internal"] & ~F.coalesce(x["nofollow"], F.lit(False)) & ~F.coalesce(x["sponsored"], F.lit(False)) & ~F.coalesce(x["ugc"], F.lit(False)))),
    Rule("status-4xx", "critical", "Response Codes", "", "Client error", lambda: F.col("status_code").between(400, 499)),
    Rule("status-5xx", "critical", "Response Codes", "", "Server error", lambda: F.col("status_code").between(500, 599)),
    Rule("redirect-temporary", "warning", "Redirects", "", "Temporary redirect", lambda: _any("redirect_chain", lambda h: (h["type"] == "http") & h["status"].isin(302, 307))),
    Rule("perf-slow", "warning", "Performance", "", "Slower than 3 seconds", lambda: ok() & (leading_number(F.col("fetch_time")) > 3)),
]
INSIGHTS = [
    ("insight-redirect-chains", "warning", "Redirects", "Several redirects in a row"),
    ("insight-redirect-loops", "critical", "Redirects", "Redirect loop"),
    ("insight-redirect-broken-end", "critical", "Redirects", "Redirect to an error"),
    ("insight-orphan-pages", "critical", "Internal Links", "Indexable page without links to it"),
    ("insight-low-link-pages", "info", "Internal Links", "One or two links to the page"),
    ("insight-deep-pages", "warning", "Internal Links", "More than three clicks deep"),
]
#: What each group counts towards.
CATEGORIES = {
    "Response Codes": "Indexability", "Redirects": "Indexability", "Canonicals": "Indexability", "Meta Robots": "Indexability",
    "Meta Titles": "On-page Meta", "Meta Descriptions": "On-page Meta", "H1 Tags": "Headings", "H2 Tags": "Headings", "H3 Tags": "Headings",
    "Images": "Content & Media", "Performance": "Content & Media", "Internal Links": "Internal Links", "Schema Markup": "Structured Data", "Open Graph & Twitter": "Social Sharing",
}
CATEGORY_FLAGS = {"Indexability": None, "On-page Meta": {"title", "description"}, "Headings": {"h1", "h2", "h3"}, "Content & Media": {"images"}, "Internal Links": {"links"}, "Structured Data": {"schemas"}, "Social Sharing": {"social"}}


def active(flags: set[str] | None = None) -> list[Rule]:
    return [r for r in RULES if not r.flag or flags is None or r.flag in flags]


def hits(crawl: DataFrame, flags: set[str] | None = None) -> DataFrame:
    """ord, url, rule_id of every rule that holds: all rules in one projection, then one row a hit."""
    found = F.array_compact(F.array(*(F.when(r.test(), F.lit(r.id)) for r in active(flags))))
    return with_shared(crawl).select("ord", "url", found.alias("found")).select("ord", "url", F.explode("found").alias("rule_id"))


def insights(crawl: DataFrame, keys: DataFrame, edges: DataFrame, depths: DataFrame, flags: set[str] | None = None) -> DataFrame:
    """ord, url, rule_id of the INSIGHTS: redirects of two hops and more, in loops, to errors; and, if links were crawled, what links and depths (key, depth) say.

    keys: key, ord, status_code, robots of each page; edges between keys.
    """
    hops = redirects.chains(crawl)
    held = {"insight-redirect-chains": F.col("hop_count") >= 2, "insight-redirect-loops": F.col("is_loop"), "insight-redirect-broken-end": F.col("ends_in_error")}
    found = hops.select("ord", "url", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(rule)) for rule, c in held.items())))).alias("rule_id"))
    if flags is not None and "links" not in flags or edges.where("is_internal").isEmpty():
        return found
    pages = keys.select("key", "ord").join(crawl.select("ord", "url"), "ord")
    said = lambda rows, rule: rows.select("key", F.lit(rule).alias("rule_id"))
    of_keys = said(links.orphans(keys, edges).where("indexable"), "insight-orphan-pages").unionByName(said(links.low_links(keys, edges), "insight-low-link-pages")).unionByName(said(depths.where("depth > 3"), "insight-deep-pages"))
    return found.unionByName(pages.join(of_keys.distinct(), "key").select("ord", "url", "rule_id"))


def dimension(spark) -> DataFrame:
    """rule_id, severity, grp, category, title, rule_ord, flag; rules of every crawl stand with the title flag."""
    rows = [(r.id, r.severity, r.group, CATEGORIES[r.group], r.title, k, r.flag or "title") for k, r in enumerate(RULES)]
    rows += [(i, s, g, CATEGORIES[g], t, len(RULES) + k, "canonical" if g == "Redirects" else "links") for k, (i, s, g, t) in enumerate(INSIGHTS)]
    return spark.createDataFrame(rows, "rule_id string, severity string, grp string, category string, title string, rule_ord int, flag string")


def issues(found: DataFrame) -> DataFrame:
    """rule_id, severity, grp, category, title, rule_ord, flag, count of rules with hits."""
    return described(found.groupBy("rule_id").agg(F.count("*").alias("count")))


def described(counted: DataFrame) -> DataFrame:
    return counted.join(F.broadcast(dimension(counted.sparkSession)), "rule_id")


def ranked(found: DataFrame) -> DataFrame:
    """Issues with rank: by severity, then by count, then in the order of the rules."""
    weight = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues(found).withColumn("rank", F.row_number().over(Window.orderBy(weight, F.desc("count"), "rule_ord")))


def prioritised(found: DataFrame, pages: int) -> DataFrame:
    """Issues with share of the pages and priority (0 to 100)."""
    return rated(issues(found), pages)


def rated(issues: DataFrame, pages: int) -> DataFrame:
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("severity"))
    share = F.least(F.lit(1.0), F.col("count") / max(1, pages))
    return issues.withColumn("weight", weight).withColumn("share", share).withColumn("priority", js_round(F.col("weight") * (0.35 + 0.65 * F.col("share")) * (100 / 55)).cast("int"))


def categories(rated: DataFrame, flags: set[str] | None = None) -> DataFrame:
    """category, score, issues, critical, audited of all seven categories."""
    spark = rated.sparkSession
    rows = [(c, need is None or flags is None or bool(need & flags)) for c, need in CATEGORY_FLAGS.items()]
    dim = spark.createDataFrame(rows, "category string, audited boolean")
    sums = rated.groupBy("category").agg(F.sum(F.col("weight") * F.col("share")).alias("penalty"), F.count("*").alias("issues"), F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), js_round(100 - F.coalesce("penalty", F.lit(0.0)))))
    return F.broadcast(dim).join(sums, "category", "left").select("category", score.cast("int").alias("score"), F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("critical", F.lit(0)).alias("critical"), "audited")


def overall(scored: DataFrame) -> DataFrame:
    """The mean score of the audited categories, 100 if there are none."""
    return scored.agg(F.coalesce(js_round(F.avg(F.when(F.col("audited"), F.col("score")))), F.lit(100)).cast("int").alias("overall_score"))
