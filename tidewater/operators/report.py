"""Roll-ups for reports: directories, status codes, field health, section buckets, cards, response times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.scalars import blank, count_if, js_round, leading_number, mentions, ok, one_decimal, status_bucket, status_label, text


def _size(c: str) -> Column:
    return F.size(F.coalesce(F.col(c), F.array()))


def _any(c: str, test) -> Column:
    return F.coalesce(F.exists(c, test), F.lit(False))


def redirected() -> Column:
    return (_size("redirect_chain") > 0) | F.col("status_code").between(300, 399)


def directories(crawl: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """segment, urls, ok, redirects, errors, noindex, missing_title, avg_depth; depths: key, depth."""
    rows = crawl.withColumn("segment", urls.segment(F.col("url")))
    if depths is not None:
        rows = rows.withColumn("key", urls.analysis_key(F.col("url"))).join(depths.select("key", "depth"), "key", "left")
    else:
        rows = rows.withColumn("depth", F.lit(None).cast("int"))
    return rows.groupBy("segment").agg(F.count("*").alias("urls"), count_if(ok()).alias("ok"), count_if(redirected()).alias("redirects"), count_if(F.col("status_code") >= 400).alias("errors"), count_if(mentions("robots", "noindex")).alias("noindex"), count_if(ok() & blank("title")).alias("missing_title"), one_decimal(F.avg("depth")).alias("avg_depth"))


def status_distribution(crawl: DataFrame) -> DataFrame:
    return crawl.groupBy(status_bucket(F.col("status_code")).alias("bucket")).agg(F.count("*").alias("count"))


def unpivot(df: DataFrame, counts: dict[str, Column], name: str, value: str = "count", where: Column | None = None) -> DataFrame:
    """One scan for all counts, then a row each."""
    rows = df.where(where) if where is not None else df
    row = rows.agg(*(c.alias(k) for k, c in counts.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias(name), F.col(f"`{k}`").cast("long").alias(value)) for k in counts)))
    return row.select(pairs.alias("p")).select(f"p.{name}", f"p.{value}")


def _field_counts() -> dict[str, Column]:
    n = lambda c: F.length(text(c))
    some = {"hreflang": "hreflangs", "schema": "schemas", "social": "social_tags", "links": "internal_links", "h2": "h2s", "h3": "h3s"}
    alt = lambda has: F.sum(F.size(F.filter(F.coalesce("images", F.array().cast("array<struct<src:string,alt:string>>")), lambda i: blank(i["alt"]) != has)))
    return {
        "title:optimal": count_if(~blank("title") & n("title").between(30, 60)), "title:long": count_if(n("title") > 60), "title:short": count_if(~blank("title") & n("title").between(1, 29)), "title:missing": count_if(blank("title")),
        "description:optimal": count_if(~blank("description") & n("description").between(70, 160)), "description:long": count_if(n("description") > 160), "description:short": count_if(~blank("description") & n("description").between(1, 69)), "description:missing": count_if(blank("description")),
        "h1:single": count_if(_size("h1s") == 1), "h1:multiple": count_if(_size("h1s") > 1), "h1:missing": count_if(_size("h1s") == 0),
        "images:with alt": F.coalesce(alt(True), F.lit(0)), "images:missing alt": F.coalesce(alt(False), F.lit(0)),
        "robots:indexable": count_if(~mentions("robots", "noindex")), "robots:noindex": count_if(mentions("robots", "noindex")), "robots:nofollow": count_if(mentions("robots", "nofollow")),
        "canonical:self": count_if(F.col("canonical_status") == "Self Referencing"), "canonical:canonicalised": count_if(F.col("canonical_status") == "Canonicalised"), "canonical:missing": count_if(F.col("canonical_status") == "Missing"),
    } | {f"{k}:{s}": count_if((_size(c) > 0) == (s == "has")) for k, c in some.items() for s in ("has", "none")}


def field_health(crawl: DataFrame) -> DataFrame:
    """field, segment, count over the 2xx rows."""
    return unpivot(crawl, _field_counts(), "name", where=ok()).select(F.split("name", ":")[0].alias("field"), F.split("name", ":")[1].alias("segment"), "count")


def section_buckets(crawl: DataFrame) -> DataFrame:
    """section, bucket, count: charts of the sections, with their own rules (mixed grains, overlaps)."""
    og, tw = _any("social_tags", lambda t: t["network"] == "og"), _any("social_tags", lambda t: t["network"] == "twitter")
    inner, outer = _any("internal_links", lambda x: x["is_internal"]), _any("internal_links", lambda x: ~x["is_internal"])
    alts = lambda has: F.coalesce(F.sum(F.size(F.filter("images", lambda i: i["alt"].isNull() != has))), F.lit(0))
    live = {
        "images:with alt": alts(True), "images:missing alt": alts(False), "images:pages with images": count_if(_size("images") > 0), "images:pages without": count_if(_size("images") == 0),
        "robots:has tag": count_if(~blank("robots")), "robots:noindex": count_if(mentions("robots", "noindex")), "robots:nofollow": count_if(mentions("robots", "nofollow")), "robots:no tag": count_if(blank("robots")),
        "canonicals:missing": count_if(blank("canonical")), "canonicals:other": count_if(~blank("canonical") & (F.col("canonical_status") == "Canonicalised")), "canonicals:self": count_if(~blank("canonical") & (F.coalesce("canonical_status", F.lit("")) != "Canonicalised")),
        "hreflang:has": count_if(_size("hreflangs") > 0), "hreflang:x-default": count_if(_any("hreflangs", lambda h: F.lower(h["hreflang"]) == "x-default")), "hreflang:none": count_if(_size("hreflangs") == 0),
        "links:internal": count_if(inner), "links:external": count_if(outer), "links:none": count_if(~inner),
        "social:both": count_if(og & tw), "social:og only": count_if(og & ~tw), "social:twitter only": count_if(tw & ~og), "social:none": count_if(~og & ~tw),
    }
    code = F.col("status_code")
    every = {"response:2xx": count_if(ok()), "response:3xx": count_if(code.between(300, 399)), "response:4xx": count_if(code.between(400, 499)), "response:5xx": count_if(code >= 500), "response:network": count_if(F.col("status") == "Error"), "all:urls": F.count("*")}
    both = unpivot(crawl, live, "name", where=ok()).unionByName(unpivot(crawl, every, "name"))
    return both.select(F.split("name", ":")[0].alias("section"), F.split("name", ":")[1].alias("bucket"), "count")


def stats_cards(crawl: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(js_round(F.avg(F.when(~blank(c), F.length(text(c))))), F.lit(0)).cast("long")
    return crawl.agg(F.count("*").alias("total"), count_if(F.col("status") == "OK").alias("answered"), count_if(F.col("status") == "Error").alias("errors"), F.coalesce(one_decimal(100 * count_if(F.col("status") == "Error") / F.count("*")), F.lit(0.0)).alias("error_rate"), mean("title").alias("avg_title"), mean("description").alias("avg_description"), *(F.coalesce(F.sum(_size(c)), F.lit(0)).alias(c) for c in ("h1s", "h2s", "h3s", "images", "schemas", "hreflangs")), count_if(~blank("robots")).alias("with_robots"))


def response_breakdown(crawl: DataFrame) -> DataFrame:
    code = F.col("status_code")
    return unpivot(crawl, {"2xx Success": count_if(ok()), "3xx Redirects": count_if(redirected()), "4xx Client errors": count_if(code.between(400, 499)), "5xx Server errors": count_if(code >= 500)}, "label")


def indexability(crawl: DataFrame) -> DataFrame:
    noindex = count_if(mentions("robots", "noindex"))
    return unpivot(crawl, {"Indexable pages": F.greatest(F.lit(0), count_if(ok()) - noindex), "Noindex": noindex, "Nofollow": count_if(mentions("robots", "nofollow")), "Canonicalised away": count_if(F.col("canonical_status") == "Canonicalised"), "Missing canonical": count_if(F.col("canonical_status") == "Missing")}, "label")


def summary(crawl: DataFrame) -> DataFrame:
    """The counts of the overview, and its sentence."""
    code = F.col("status_code")
    row = crawl.agg(F.count("*").alias("total"), count_if(ok()).alias("ok"), count_if(redirected()).alias("redirects"), count_if(code.between(400, 499)).alias("client_errors"), count_if(code >= 500).alias("server_errors"), count_if(code == 0).alias("blocked"), count_if(ok() & blank("title")).alias("missing_title"), count_if(ok() & blank("description")).alias("missing_description"), count_if(ok() & (_size("h1s") == 0)).alias("missing_h1"), count_if(mentions("robots", "noindex")).alias("noindex"), F.floor(F.avg(leading_number(F.col("fetch_time"))) * 100 + 0.5).alias("_t"))
    say = F.concat_ws(" ", F.concat(F.col("total").cast("string"), F.lit(" URLs:")), F.concat(F.col("ok").cast("string"), F.lit(" answered,")), F.concat(F.col("redirects").cast("string"), F.lit(" redirected,")), F.concat((F.col("client_errors") + F.col("server_errors")).cast("string"), F.lit(" failed.")))
    return row.withColumn("avg_fetch", F.col("_t") / 100).drop("_t").withColumn("sentence", say)


def response_times(crawl: DataFrame, most: int = 60, parts: int = 50) -> DataFrame:
    """chunk, avg_fetch, pages: single pages if they are few, else averages of equal runs in crawl order."""
    total = crawl.count()
    size = 1 if total <= most else -(-total // parts)
    return crawl.groupBy(F.floor(F.col("ord") / size).alias("chunk")).agg(F.floor(F.avg(leading_number(F.col("fetch_time"))) * 100 + 0.5).alias("_t"), F.count("*").alias("pages")).select("chunk", (F.col("_t") / 100).alias("avg_fetch"), "pages")


def ai_summary(crawl: DataFrame, sample: int = 25) -> DataFrame:
    """One row of JSON: status buckets, counters and a sample of the first pages."""
    buckets = crawl.groupBy(status_label(F.col("status_code")).alias("k")).agg(F.count("*").alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("statuses"))
    first = crawl.orderBy("ord").limit(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url", "title", "status_code"))), lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"), r["status_code"].alias("status"))).alias("sample"))
    counts = summary(crawl).drop("sentence")
    return counts.join(buckets).join(first).select(F.to_json(F.struct("*")).alias("summary"))


def inferred_flags(crawl: DataFrame) -> DataFrame:
    """Which fields a stored crawl has any value of."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return crawl.agg(*(some(~blank(c)).alias(c) for c in ("title", "description", "robots", "canonical")), *(some(_size(c) > 0).alias(c) for c in ("h1s", "h2s", "h3s", "images", "schemas", "hreflangs", "internal_links", "social_tags")))
