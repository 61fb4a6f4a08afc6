"""A crawl of the table `pages`: records, links and keys are extracted from its HTML; only answers, redirect hops and times, which HTML does not hold, are derived from the page_id.

The pages have titles, headings and links to addresses that are no pages. What they lack (descriptions, robots, canonicals, alternates, images, social tags, JSON-LD, links to one another) is
written into their HTML first, by `marked`; everything is then read back out of the whole HTML, by the extractors here and by patterns in the SQL. Links lead through each site as a tree, with a link to its first page and one to the next, so depths, orphans and redirects have something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import links as link_operators
from ..sources import pages as page_source
from .storage import exists, scratch, stored

#: Not in HTML: the answer, the hops and the time of each page, by its id. The same expressions in Spark and in DuckDB.
ANSWERS = {
    "status_code": "cast(case when page_id % 23 = 22 then 404 when page_id % 29 = 28 then 503 when page_id % 31 = 30 then 0 else 200 end as int)",
    "first_hop": "cast(case when page_id % 7 = 6 then 301 when page_id % 11 = 10 then 302 end as int)",
    "hop_count": "cast(case when page_id % 7 = 6 or page_id % 11 = 10 then 1 + page_id % 3 else 0 end as int)",
    "loops": "(page_id % 7 = 6 or page_id % 11 = 10) and page_id % 5 = 1",
    "tenths": "(page_id * 37) % 60",
}
#: What is written into heads and articles. The same expressions in Spark and in DuckDB.
HEAD = " || ".join([
    "'<meta name=\"description\" content=\"' || repeat('d', cast((page_id * 13) % 200 as int)) || '\">'",
    "case when page_id % 13 = 12 then '<meta name=\"robots\" content=\"noindex, follow\">' when page_id % 17 = 16 then '<meta content=\"index, nofollow\" name=\"robots\">' else '' end",
    "case when page_id % 5 = 4 then '' when page_id % 9 = 8 then '<link rel=\"canonical\" href=\"https://elsewhere.example/\">' else '<link rel=\"canonical\" href=\"' || url || '\">' end",
    "case when page_id % 8 = 1 then '<link rel=\"alternate\" hreflang=\"en\" href=\"a\"><link rel=\"alternate\" hreflang=\"x-default\" href=\"b\">' when page_id % 4 = 1 then '<link rel=\"alternate\" hreflang=\"en\" href=\"a\"><link rel=\"alternate\" hreflang=\"fr\" href=\"b\">' else '' end",
    "case when page_id % 2 = 0 then '<meta property=\"og:title\" content=\"x\">' else '' end", "case when page_id % 3 = 0 then '<meta name=\"twitter:card\" content=\"x\">' else '' end",
    "case when page_id % 3 = 0 then '<script type=\"application/ld+json\">{\"@type\":\"Page\"}</script>' else '' end",
])
BODY = " || ".join([
    "case when page_id % 3 = 2 then '<h1>Heading ' || cast(page_id % 40 as string) || '</h1>' else '' end", "repeat('<h2>part</h2>', cast(page_id % 5 as int))", "repeat('<h3>point</h3>', cast(page_id % 2 as int))",
    *(f"case when page_id % 4 >= {i} then '<img src=\"/img{i}.png\"' || case when (page_id + {i - 1}) % 3 = 0 then '' else ' alt=\"alt\"' end || '>' else '' end" for i in (1, 2, 3)),
])
#: Links of the page of rank r among the m of its site: number, rank of the target, when, text, rel.
LINKS = [
    (0, "0", "true", "Home", ""), (1, "4 * r + 1", "page_id % 4 <> 3 and (4 * r + 1) % 10 <> 7", "read more", ""), (2, "4 * r + 2", "page_id % 4 <> 3 and (4 * r + 2) % 10 <> 7", "guide", "nofollow"),
    (3, "4 * r + 3", "page_id % 4 <> 3 and (4 * r + 3) % 10 <> 7", "Read more ", "sponsored"), (4, "4 * r + 4", "page_id % 4 <> 3 and (4 * r + 4) % 10 <> 7", "news", "ugc"), (5, "case when r + 1 < m then r + 1 when m % 3 = 0 then r - r % 5 else m end", "page_id % 5 <> 2 and r % 10 <> 6", "next", "next"),
]
_LINK = "'<a href=\"' || target || '\"' || case when rel = '' then '' else ' rel=\"' || rel || '\"' end || '>' || said || '</a>'"

_HOST = "regexp_replace(lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '')"
KEY_SQL = "lower(regexp_extract({0}, '^([A-Za-z]+)://', 1)) || '://' || " + _HOST + " || case when regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) in ('', '/') then '/' else regexp_replace(regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/$', '') end || regexp_extract({0}, '^[^?#]*([?][^#]*)', 1)"
_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#039;', ''''), '\\s+', ' ', 'g'))"
_ALL = "regexp_extract_all(t, '(?is){0}', 1)"
#: The HTML with what is written into it, as `marked`; the crawl read from it by patterns, as `c`; its links, as `e`.
C_SQL = f"""site_pages as (select page_id, url, html, {_HOST.format('url')} as host, row_number() over (partition by {_HOST.format('url')} order by page_id) - 1 as r, count(*) over (partition by {_HOST.format('url')}) as m from pages),
site_links as (select s.page_id, string_agg({_LINK.replace('target', 'b.url')}, '' order by k) as links from (select s.*, k, rel, said, case k {' '.join(f'when {k} then {to}' for k, to, *_ in LINKS)} end as to_r from site_pages s, (values {', '.join(f"({k}, '{said}', '{rel}')" for k, _, _, said, rel in LINKS)}) v(k, said, rel)
    where case k {' '.join(f'when {k} then {when}' for k, _, when, *_ in LINKS)} end) s join site_pages b on b.host = s.host and b.r = s.to_r group by s.page_id),
site_away as (select s.page_id, '<a href="' || b.url || '"' || case when s.page_id % 2 = 0 then ' rel="nofollow"' else '' end || '>partner</a>' as away from site_pages s join site_pages b on b.page_id = s.page_id + 1 where s.page_id % 6 = 5),
marked as (select s.page_id, s.url, regexp_replace(replace(replace(html, '<head>', '<head>' || {HEAD.replace('page_id', 's.page_id').replace('|| url ||', '|| s.url ||')}), '<article>', '<article>' || {BODY.replace('page_id', 's.page_id')} || coalesce(k.links, '') || coalesce(w.away, '')), '(?s)<!--.*?-->', '', 'g') as t from site_pages s left join site_links k on k.page_id = s.page_id left join site_away w on w.page_id = s.page_id),
found_links as (select page_id, url, unnest(a) as a, generate_subscripts(a, 1) - 1 as pos from (select page_id, url, list_filter(regexp_extract_all(t, '(?is)<a href="[^"]*"[^>]*>.*?</a>'), lambda z: {_TEXT.format('z')} <> '') as a from marked)),
links_of as (select page_id, pos, case when href like 'http%' then href else regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href end as address, anchor, rel, not (href like 'http%') or {_HOST.format('href')} = {_HOST.format('url')} as is_internal from (select page_id, url, pos, regexp_extract(a, '(?i)href="([^"]*)"', 1) as href, {_TEXT.format('a')} as anchor, regexp_extract(a, '^<a [^>]*rel="([^"]*)"', 1) as rel from found_links)),
c as (select *, status_code between 200 and 299 as ok from (select page_id as ord, x.url, {_TEXT.format("regexp_extract(t, '(?is)<title>(.*?)</title>', 1)")} as title, regexp_extract(t, '<meta name="description" content="([^"]*)">', 1) as description,
    {_TEXT.format(_ALL.format('<h1>(.*?)</h1>') + '[1]')} as first_h1, cast(len({_ALL.format('<h1>(.*?)</h1>')}) as int) as n_h1, cast(len({_ALL.format('(<h2>)')}) as int) as n_h2, cast(len({_ALL.format('(<h3>)')}) as int) as n_h3,
    cast(len({_ALL.format('(<img )')}) as int) as n_img, cast(len({_ALL.format('(<img src="[^"]*">)')}) as int) as n_no_alt, cast(len({_ALL.format('(ld.json">)')}) as int) as n_schema, cast(len({_ALL.format('(hreflang=)')}) as int) as n_hreflang, contains(t, 'x-default') as has_default,
    contains(t, '"og:') as has_og, contains(t, '"twitter:') as has_twitter, coalesce(nullif(regexp_extract(t, '<meta name="robots" content="([^"]*)">', 1), ''), regexp_extract(t, '<meta content="([^"]*)" name="robots">', 1)) as robots,
    regexp_extract(t, '<link rel="canonical" href="([^"]*)">', 1) as canonical, case when canonical = '' then 'Missing' when canonical = x.url then 'Self Referencing' else 'Canonicalised' end as canonical_status, {', '.join(f'{v} as {n}' for n, v in ANSWERS.items())} from marked x) y
    left join (select page_id as p, cast(count(*) as int) as n_links, cast(count(*) filter (where not is_internal) as int) as n_external, count(*) filter (where not is_internal and rel not in ('nofollow', 'sponsored', 'ugc')) as n_missing_rel from links_of group by 1) on p = ord)"""
E_SQL = f"""ids_of as (select {KEY_SQL.format('url')} as key, min(page_id) as id from pages group by 1),
e as (select page_id as src, coalesce(ids_of.id, -1 - ('0x' || substr(md5(d), 1, 12))::bigint) as dst, anchor, cast(pos as int) as pos, rel, is_internal from (select *, {KEY_SQL.format('address')} as d from links_of) left join ids_of on ids_of.key = d)"""


def marked(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with what they lack written into their HTML."""
    # rank within the site, by ranges of all sites: no task holds a site
    ordered = pages.select("page_id", "url", F.expr(_HOST.format("url")).alias("host")).repartitionByRange("host", "page_id").sortWithinPartitions("host", "page_id")
    ordered = stored(ordered.select("*", F.spark_partition_id().alias("range"), (F.monotonically_increasing_id() % (1 << 33)).alias("place")), "sites")
    parts = ordered.groupBy("host", "range").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    site = Window.partitionBy("host")
    earlier = F.coalesce(F.sum("n").over(site.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("host", "range", (earlier - F.col("low")).alias("shift"), F.sum("n").over(site).alias("m"))
    ranked = ordered.join(parts, ["host", "range"]).select("page_id", "url", "host", (F.col("place") + F.col("shift")).alias("r"), "m")
    each = F.array(*(F.when(F.expr(when), F.struct(F.lit(k).alias("k"), F.expr(to).cast("long").alias("r"), F.lit(said).alias("said"), F.lit(rel).alias("rel"))) for k, to, when, said, rel in LINKS))
    asked = ranked.select("page_id", "host", F.explode(F.array_compact(each)).alias("l")).select("page_id", "host", "l.*")
    found = asked.join(ranked.select("host", "r", F.col("url").alias("target")), ["host", "r"]).select("page_id", F.struct("k", F.expr(_LINK).alias("a")).alias("a"))
    away = pages.where("page_id % 6 = 5").select("page_id").join(pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("target")), "page_id")
    away = away.select("page_id", F.struct(F.lit(9).alias("k"), F.expr("'<a href=\"' || target || '\"' || case when page_id % 2 = 0 then ' rel=\"nofollow\"' else '' end || '>partner</a>'").alias("a")).alias("a"))
    written = found.unionByName(away).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["a"]), "").alias("links"))
    html = F.expr(f"replace(replace(html, '<head>', '<head>' || {HEAD}), '<article>', '<article>' || {BODY} || coalesce(links, ''))")
    return pages.join(written, "page_id", "left").select("page_id", "url", html.alias("html"))


#: (application, folder of the tables, folder of the work): the crawl's table.
_CRAWLS: dict[tuple[str, str, str], str] = {}


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl records with nested columns, extracted once a session and kept as a table, as a crawl is."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, spark.conf.get("spark.checkpoint.dir", None) or "")
    records = _records(pages)
    if key not in _CRAWLS or not exists(spark, _CRAWLS[key]):
        path = scratch(spark, "crawl")
        records.write.parquet(path)
        _CRAWLS[key] = path
    return spark.read.schema(records.schema).parquet(_CRAWLS[key])


def _records(pages: DataFrame) -> DataFrame:
    records = page_source.extract(marked(pages), links="all").withColumn("page_id", F.col("ord"))
    c = records.select("*", *(F.expr(v).alias(k) for k, v in ANSWERS.items())).drop("page_id")
    hop = "named_struct('url', concat('https://hop.example/', cast(ord as string), '/', cast(if(loops, 1, i) as string)), 'status', first_hop, 'type', 'http')"
    final = F.when(F.col("hop_count") > 0, F.when(F.col("loops"), F.col("url")).otherwise(F.concat(F.lit("https://end.example/"), F.col("ord").cast("string"))))
    return c.select(
        *records.drop("page_id").columns, F.when((F.col("status_code") == 0) | (F.col("status_code") >= 400), "Error").otherwise("OK").alias("status"), "status_code", F.col("first_hop").alias("redirect_status_code"),
        final.alias("redirected_url"), F.when(F.col("hop_count") > 0, "http").otherwise("none").alias("redirect_type"), F.expr(f"if(hop_count > 0, transform(sequence(1, hop_count), i -> {hop}), array())").cast("array<struct<url:string,status:int,type:string>>").alias("redirect_chain"),
        F.col("url").alias("initial_url"), F.coalesce(final, F.col("url")).alias("final_url"), "hop_count", F.lit(None).cast("string").alias("last_modified"), F.concat((F.col("tenths") / 10).cast("string"), F.lit("s")).alias("fetch_time"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, anchor, pos, is_internal, rel flags between page ids; an address that is no page has a negative id, from its key."""
    found = link_operators.edges(crawl(spark, sf_dir))
    ids = crawl(spark, sf_dir).groupBy(urls.analysis_key(F.col("url")).alias("dst")).agg(F.min("ord").alias("id"))
    other = -1 - F.conv(F.substring(F.md5(F.col("dst").cast("binary")), 1, 12), 16, 10).cast("long")
    return found.join(ids, "dst", "left").select("ord", F.col("ord").alias("src"), F.coalesce("id", other).alias("dst"), "anchor", "pos", "is_internal", "rel", "nofollow", "sponsored", "ugc")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (the page id), site, path and what rules need of each page."""
    return crawl(spark, sf_dir).select(F.col("ord").alias("key"), "ord", urls.host(F.col("url")).alias("site"), "status_code", "robots", F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
