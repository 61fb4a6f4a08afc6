"""What an audit gives out: sitemap, tag blocks and their checks, flat export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.scalars import blank, csv_if_needed, csv_quoted, escape_attribute, escape_xml, hreflang_code, iso_date, ok, text, tsv_clean
from ..sources import exports


def permanent() -> Column:
    """Not redirected, or by permanent HTTP redirects alone."""
    only = F.coalesce(F.forall(F.filter("redirect_chain", lambda h: (h["type"] == "http") & h["status"].between(300, 399)), lambda h: h["status"].isin(301, 308)), F.lit(True))
    kind = F.coalesce("redirect_type", F.lit("none"))
    return (kind == "none") | (kind == "http") & only


def _live() -> Column:
    return (F.col("status") == "OK") & ok()


def sitemap_entries(crawl: DataFrame, today: str | None = None) -> DataFrame:
    """loc, lastmod of the eligible pages, the first page of each address."""
    loc = urls.without_fragment(F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url")))
    rows = crawl.where(_live() & permanent()).select("ord", loc.alias("loc"), F.coalesce(iso_date(F.col("last_modified")), F.lit(today)).alias("lastmod")).where(urls.is_absolute(F.col("loc")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("loc").orderBy("ord"))).where("n = 1").select("loc", "lastmod")


def sitemap_stats(crawl: DataFrame) -> DataFrame:
    counts = crawl.agg(F.count("*").alias("total"), F.count(F.when(~_live(), 1)).alias("dropped_non_2xx"), F.count(F.when(_live() & ~permanent(), 1)).alias("dropped_temporary"))
    included = sitemap_entries(crawl).agg(F.count("*").alias("included"))
    return counts.join(included).withColumn("dropped_duplicate", F.greatest(F.lit(0), F.col("total") - F.col("dropped_non_2xx") - F.col("dropped_temporary") - F.col("included")))


def sitemap_lines(entries: DataFrame) -> DataFrame:
    """loc, xml: the element of each entry; a writer orders them by loc between the document's first and last line."""
    return entries.select("loc", F.concat(F.lit("<url><loc>"), escape_xml(F.col("loc")), F.lit("</loc>"), F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>")).alias("xml"))


SITEMAP_LINES, SITEMAP_BYTES = exports.SITEMAP_LINES, exports.SITEMAP_BYTES


def write_sitemaps(entries: DataFrame, path: str, base: str | None = None, compressed: bool = False, mode: str = "error") -> None:
    """Sitemap files of at most SITEMAP_LINES entries and SITEMAP_BYTES bytes each, in the order of loc, under path; with base (the address of path) an index of them, sitemap_index.xml."""
    lines = sitemap_lines(entries).repartitionByRange("loc").sortWithinPartitions("loc").select("xml")
    exports.write_lines(lines, path, mode, suffix=".xml.gz" if compressed else ".xml", head=exports.SITEMAP_HEAD, tail="</urlset>", lines=SITEMAP_LINES, bytes=SITEMAP_BYTES, index=base)


#: Languages and countries that one page can name.
MOST_ALTERNATES = 1000
SOCIAL = ["og:title", "og:description", "og:image", "twitter:title", "twitter:description", "twitter:image"]


def social_block(value: dict[str, Column]) -> Column:
    """Meta tags of the values that are there, one a line."""
    kind = lambda k: "property" if k.startswith("og:") else "name"
    return F.concat_ws("\n", *(F.when(~blank(v), F.concat(F.lit(f'<meta {kind(k)}="{k}" content="'), escape_attribute(text(v)), F.lit('" />'))) for k, v in value.items()))


def social_warnings(rows: DataFrame) -> DataFrame:
    """url, warning of social entries (url, og_title, og_description, og_image, twitter_title, twitter_description, twitter_image, card)."""
    n = lambda c: F.length(text(c))
    web = lambda c: blank(c) | text(c).rlike("(?i)^https?://")
    checks = {
        "url is missing": blank("url"), "og:title is missing": blank("og_title"), "og:title is over 60 characters": n("og_title") > 60, "og:description is missing": blank("og_description"),
        "og:description is over 200 characters": n("og_description") > 200, "og:image is missing": blank("og_image"), "og:image is no absolute address": ~web("og_image"), "twitter:title is over 70 characters": n("twitter_title") > 70,
    }
    return rows.select("url", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))).alias("warning"))


def hreflang_warnings(clusters: DataFrame) -> DataFrame:
    """cluster, warning of clusters (cluster, canonical, x_default, alternates array of language, country, href)."""
    codes = F.transform("alternates", lambda a: hreflang_code(a["language"], a["country"]))
    web = lambda c: text(c).rlike("(?i)^https?://")
    hrefs = F.filter(F.transform("alternates", lambda a: F.trim(text(a["href"]))), lambda h: h != "")
    checks = {
        "canonical is missing": blank("canonical"), "canonical is no absolute address": ~blank("canonical") & ~web("canonical"), "fewer than two alternates": F.size("alternates") < 2,
        "an alternate has no language": F.exists("alternates", lambda a: blank(a["language"])), "a code is not valid": F.exists(codes, lambda c: (c != "") & ~c.rlike("^[a-z]{2,3}(-[A-Z]{2})?$")),
        "a code is there twice": F.size(F.array_distinct(codes)) < F.size(codes), "an alternate is no absolute address": F.exists("alternates", lambda a: ~web(a["href"])), "an address is there twice": F.size(F.array_distinct(hrefs)) < F.size(hrefs),
        "x-default is no absolute address": ~blank("x_default") & ~web("x_default"),
    }
    return clusters.select("cluster", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))).alias("warning"))


def hreflang_block(as_xml: bool = False) -> Column:
    """Link elements of a cluster's alternates and x-default, one a line."""
    line = (lambda code, href: F.concat(F.lit('<xhtml:link rel="alternate" hreflang="'), code, F.lit('" href="'), escape_xml(href), F.lit('" />'))) if as_xml else (lambda code, href: F.concat(F.lit('<link rel="alternate" hreflang="'), code, F.lit('" href="'), escape_attribute(href), F.lit('" />')))
    own = F.transform(F.filter("alternates", lambda a: ~blank(a["href"])), lambda a: line(hreflang_code(a["language"], a["country"]), text(a["href"])))
    return F.concat_ws("\n", F.array_join(own, "\n"), F.when(~blank("x_default"), line(F.lit("x-default"), F.col("x_default"))))


def hreflang_bulk(addresses: DataFrame, alternates: DataFrame) -> DataFrame:
    """The rows of addresses, with all their columns, each with every shared alternate as code and href (a form's list: at most MOST_ALTERNATES, more are refused)."""
    rows = alternates.select(hreflang_code(F.col("language"), F.col("country")).alias("code"), "href").limit(MOST_ALTERNATES + 1).collect()
    if len(rows) > MOST_ALTERNATES:
        raise ValueError(f"more than {MOST_ALTERNATES} shared alternates")
    shared = F.array(*(F.struct(F.lit(r["code"]).alias("code"), F.lit(r["href"]).alias("href")) for r in rows)).cast("array<struct<code:string,href:string>>")
    return addresses.select("*", F.explode(shared).alias("shared alternate")).select(*addresses.columns, F.col("shared alternate.code"), F.col("shared alternate.href"))


def image_rows(crawl: DataFrame) -> DataFrame:
    """url, src, alt, images: a row an image, a placeholder for pages without."""
    rows = crawl.select("url", F.size(F.coalesce("images", F.array())).alias("images"), F.explode_outer("images").alias("i"))
    return rows.select("url", F.coalesce(F.col("i.src"), F.lit("No images")).alias("src"), text(F.col("i.alt")).alias("alt"), "images")


def issue_rows(found: DataFrame, crawl: DataFrame, dimension: DataFrame) -> DataFrame:
    """url, status_code, severity, category, grp, title of every hit."""
    last = crawl.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("ord")))).where("n = 1").select("url", "status_code")
    return found.select("url", "rule_id").join(last, "url", "left").join(F.broadcast(dimension), "rule_id").select("url", "status_code", "severity", "category", "grp", "title")


def page_rows(crawl: DataFrame) -> DataFrame:
    """The flat summary of each page."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    missing = F.size(F.filter(F.coalesce("images", F.array().cast("array<struct<src:string,alt:string>>")), lambda i: blank(i["alt"])))
    inner = F.size(F.filter("internal_links", lambda x: x["is_internal"]))
    return crawl.select("url", "status_code", text("title").alias("title"), F.length(text("title")).alias("title_length"), text("description").alias("description"), F.length(text("description")).alias("description_length"), F.array_join("h1s", " | ").alias("h1"), size("h1s").alias("h1_count"), text("canonical").alias("canonical"), text("canonical_status").alias("canonical_status"), text("robots").alias("robots"), size("images").alias("images"), missing.alias("images_without_alt"), F.coalesce(inner, F.lit(0)).alias("internal_links"), size("schemas").alias("schemas"), size("hreflangs").alias("hreflangs"), F.coalesce("hop_count", F.lit(0)).alias("hops"), text("final_url").alias("final_url"))


def meta_rows(crawl: DataFrame, flags: set[str]) -> DataFrame:
    """The meta table with the columns of the fields that were asked for."""
    many = lambda c: [F.array_join(F.coalesce(c, F.array().cast("array<string>")), " | ").alias(c), F.size(F.coalesce(c, F.array())).alias(c + "_count")]
    parts = {"title": [text("title").alias("title")], "description": [text("description").alias("description")], "h1": many("h1s"), "h2": many("h2s"), "h3": many("h3s"), "robots": [text("robots").alias("robots")], "canonical": [text("canonical").alias("canonical"), F.coalesce("canonical_status", F.lit("Missing")).alias("canonical_status")]}
    return crawl.select("url", *(c for k, own in parts.items() if k in flags for c in own), "status", "status_code", "fetch_time")


def nested_rows(crawl: DataFrame, column: str, placeholder: str) -> DataFrame:
    """url and the fields of a nested column, a row an element; a placeholder in the first field of answered pages without."""
    rows = crawl.where("status = 'OK'").select("url", F.explode_outer(column).alias("x"))
    element = crawl.schema[column].dataType.elementType
    if element.typeName() != "struct":
        return rows.select("url", F.coalesce("x", F.lit(placeholder)).alias("value"))
    first, *rest = element.names
    return rows.select("url", F.coalesce(F.col(f"x.{first}").cast("string"), F.lit(placeholder)).alias(first), *(text(F.col(f"x.{c}").cast("string")).alias(c) for c in rest))


def preview(crawl: DataFrame) -> DataFrame:
    """url, title, description, image as a shared link shows them: social tags first, then the page's own."""
    tag = lambda name: F.get(F.filter(F.coalesce("social_tags", F.array().cast("array<struct<network:string,property:string,content:string>>")), lambda t: t["property"] == name), F.lit(0))["content"]
    full = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))
    return crawl.select("url", full(tag("og:title"), tag("twitter:title"), F.col("title")).alias("title"), full(tag("og:description"), tag("twitter:description"), F.col("description")).alias("description"), full(tag("og:image"), tag("twitter:image"), F.get(F.coalesce("images", F.array().cast("array<struct<src:string,alt:string>>")), F.lit(0))["src"]).alias("image"))


def graph_json(nodes: DataFrame, edges: DataFrame, by: list, n: int = 500) -> DataFrame:
    """One row: the first n nodes in an order and the edges between them, as JSON for a viewer."""
    from .links import capped

    kept, inside = capped(nodes, edges, by, n)
    lists = kept.agg(F.collect_list(F.struct("*")).alias("nodes")).join(inside.agg(F.collect_list(F.struct("*")).alias("links")))
    return lists.select(F.to_json(F.struct("nodes", "links")).alias("graph"))


def messages(summary: DataFrame, turns: DataFrame, question: str, system: str) -> DataFrame:
    """One row: the chat messages of a question about a crawl, as JSON; turns (ord, role, content). Nothing is sent."""
    past = turns.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("past"))
    say = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    return summary.select("summary").join(past).select(F.to_json(F.concat(say("system", F.concat(F.lit(system + "\n"), F.col("summary"))), F.coalesce("past", F.array().cast("array<struct<role:string,content:string>>")), say("user", F.lit(question)))).alias("messages"))


def csv_lines(df: DataFrame, quote_all: bool = True, columns: list[str] | None = None, keep: list[str | Column] = ()) -> DataFrame:
    """line: columns of the rows as CSV text, quoted always or only where needed; then what else is to be kept, to sort by, as key0, key1, ..."""
    quote, types = csv_quoted if quote_all else csv_if_needed, dict(df.dtypes)
    return df.select(F.concat_ws(",", *(quote(F.col(c).cast("string")) if types[c] == "string" else text(F.col(c).cast("string")) for c in columns or df.columns)).alias("line"), *_keys(keep))


def tsv_lines(df: DataFrame, columns: list[str] | None = None, keep: list[str | Column] = ()) -> DataFrame:
    return df.select(F.concat_ws("\t", *(tsv_clean(F.col(c).cast("string")) for c in columns or df.columns)).alias("line"), *_keys(keep))


def _keys(keep: list[str | Column]) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).alias(f"key{i}") for i, c in enumerate(keep)]
