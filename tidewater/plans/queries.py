"""Queries over the tables, each with the SQL that gives the same rows (none where SQL cannot say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions.scalars import grade, length_badge
from ..operators import access, dedupe, filters, generators, graph, incremental, links, merge, redirects, report, robots, rules
from ..operators.filters import Condition
from ..sources import exports, lists
from ..sources import pages as page_source
from . import fixtures as fx
from .audit import audit
from .storage import scratch, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C, E = fx.C_SQL, fx.E_SQL


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def _pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet")


# Extraction from raw HTML.
_CLEAN = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|svg|noscript)\\b[^>]*>.*?</(script|svg|noscript)>', ' ', 'g')"
_DECODE = "replace(replace(replace(replace(replace(replace(replace({0}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#039;', ''''), '&#39;', ''''), '&#x27;', '''')"


@query(f"select page_id, trim(regexp_replace({_DECODE.format(f'''regexp_extract({_CLEAN}, '(?is)<title\\b[^>]*>(.*?)</title>', 1)''')}, '\\s+', ' ', 'g')) as title from pages")
def extract_title(s, d):
    return _pages(s, d).select("page_id", html.title(F.col("html")).alias("title"))


@query(f"select page_id, coalesce(trim(regexp_replace({_DECODE.format(f'''regexp_replace(regexp_extract({_CLEAN}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', ' ', 'g')''')}, '\\s+', ' ', 'g')), '') as h1 from pages")
def extract_h1(s, d):
    return _pages(s, d).select("page_id", F.coalesce(F.get(html.headings(F.col("html"), "h1"), F.lit(0)), F.lit("")).alias("h1"))


@query("select page_id, cast(len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<a\\b[^>]*>.*?</a>')) as bigint) as links from pages")
def page_links_count(s, d):
    found = F.regexp_extract_all(html.without_comments(F.col("html")), F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    return _pages(s, d).select("page_id", F.size(found).cast("long").alias("links"))


@query("select page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) as digest from pages")
def strip_markup_text(s, d):
    c = html.without_blocks(html.without_comments(F.col("html")), "script", "style")
    return _pages(s, d).select("page_id", F.md5(html.collapse(html.without_tags(c)).cast("binary")).alias("digest"))


@query("select page_id, md5(" + _DECODE.format("html") + ") as digest from pages")
def entity_decode_basic(s, d):
    return _pages(s, d).select("page_id", F.md5(html.decode(F.col("html")).cast("binary")).alias("digest"))


_HOST = "regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', ''), ':[0-9]*$', '')"
_ANCHORS = "a as (select page_id, url, t, trim(regexp_extract(t, '(?is)^<a\\b[^>]*\\bhref\\s*=\\s*\"([^\"]*)\"', 1)) as href, trim(regexp_replace(regexp_replace(t, '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as said from (select page_id, url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<a\\b[^>]*>.*?</a>')) as t from pages)), l as (select page_id, count(*) as links, count(*) filter (where not regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') or " + _HOST.format("href") + " = " + _HOST.format("url") + ") as internal from a where href <> '' and said <> '' and not regexp_matches(href, '(?i)^(#|javascript:|mailto:|tel:)') group by 1)"


@query(f"with {_ANCHORS} select p.page_id as ord, trim(regexp_replace({_DECODE.format(f'''regexp_extract({_CLEAN}, '(?is)<title\\b[^>]*>(.*?)</title>', 1)''')}, '\\s+', ' ', 'g')) as title, '' as description, cast(len(regexp_extract_all({_CLEAN}, '(?is)<h1\\b[^>]*>.*?</h1>')) as int) as h1, cast(len(regexp_extract_all(html, '(?is)<img\\b[^>]*>')) as int) as images, 'Missing' as canonical_status, cast(coalesce(links, 0) as int) as links, cast(coalesce(internal, 0) as int) as internal, cast(0 as int) as social from pages p left join l on l.page_id = p.page_id")
def page_records(s, d):
    """Every extractor over raw pages, all links of the page."""
    r = page_source.extract(_pages(s, d), links="all")
    return r.select("ord", "title", "description", F.size("h1s").alias("h1"), F.size("images").alias("images"), "canonical_status", F.size("internal_links").alias("links"), F.size(F.filter("internal_links", lambda x: x["is_internal"])).alias("internal"), F.size("social_tags").alias("social"))


@query("select page_id as ord, cast(0 as int) as links from pages")  # all links of these pages are in their nav
def main_content_links(s, d):
    return page_source.extract(_pages(s, d)).select("ord", F.size("internal_links").alias("links"))


@query("select page_id, coalesce(nullif(regexp_extract(html, '<script>location.href=.([^;]*).;</script>', 1), ''), 'none') as target from pages")
def script_redirects(s, d):
    return _pages(s, d).select("page_id", F.coalesce(html.script_redirect(F.col("html")), F.lit("none")).alias("target"))


# URLs.
_URL_SQL = "lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) as protocol, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '') as host, case when regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) end as path, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) as query"


@query(f"select page_id, {_URL_SQL} from pages")
def url_parts(s, d):
    u = F.col("url")
    return _pages(s, d).select("page_id", urls.protocol(u).alias("protocol"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"))


@query(f"select page_id, protocol || '://' || host || case when path = '/' then '/' else regexp_replace(path, '/$', '') end || query as key from (select page_id, {_URL_SQL} from pages)")
def url_normalise_key(s, d):
    return _pages(s, d).select("page_id", urls.analysis_key(F.col("url")).alias("key"))


@query("select page_id, regexp_replace(lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1), '/+$', '') as key from pages")
def url_normalise_crawl(s, d):
    return _pages(s, d).select("page_id", urls.crawl_key(F.col("url")).alias("key"))


@query("select page_id, '/' || regexp_extract(url, '^[A-Za-z]+://[^/?#]*/+([^/?#]+)', 1) as segment from pages")
def url_segment(s, d):
    return _pages(s, d).select("page_id", urls.segment(F.col("url")).alias("segment"))


# Roll-ups.
@query(f"with {C} select case when length(title) = 0 then 'missing' when length(title) < 30 then 'short' when length(title) > 60 then 'long' else 'ideal' end as badge, count(*) as pages from c where ok group by 1")
def title_health(s, d):
    c = fx.crawl(s, d).where("status_code between 200 and 299")
    return c.groupBy(length_badge(F.length("title"), 30, 60).alias("badge")).agg(F.count("*").alias("pages"))


def _union(field: str, parts: dict[str, str], names: tuple[str, str], where: str = "ok") -> str:
    return " union all ".join(f"select '{field}' as {names[0]}, '{k}' as {names[1]}, cast(coalesce({v}, 0) as bigint) as count from c where {where}" for k, v in parts.items())


_n = lambda test: f"count(*) filter (where {test})"
_HAS = lambda c: {"has": _n(f"{c} > 0"), "none": _n(f"{c} = 0")}
_FIELDS = {
    "title": {"optimal": _n("length(title) between 30 and 60"), "long": _n("length(title) > 60"), "short": _n("length(title) between 1 and 29"), "missing": _n("title = ''")},
    "description": {"optimal": _n("length(description) between 70 and 160"), "long": _n("length(description) > 160"), "short": _n("length(description) between 1 and 69"), "missing": _n("description = ''")},
    "h1": {"single": _n("n_h1 = 1"), "multiple": _n("n_h1 > 1"), "missing": _n("n_h1 = 0")},
    "images": {"with alt": "sum(n_img - n_no_alt)", "missing alt": "sum(n_no_alt)"},
    "robots": {"indexable": _n("robots not like '%noindex%'"), "noindex": _n("robots like '%noindex%'"), "nofollow": _n("robots like '%nofollow%'")},
    "canonical": {"self": _n("canonical_status = 'Self Referencing'"), "canonicalised": _n("canonical_status = 'Canonicalised'"), "missing": _n("canonical_status = 'Missing'")},
    "hreflang": _HAS("n_hreflang"), "schema": _HAS("n_schema"), "links": _HAS("n_links"), "h2": _HAS("n_h2"), "h3": _HAS("n_h3"), "social": {"has": _n("has_og or has_twitter"), "none": _n("not has_og and not has_twitter")},
}
query(f"with {C} " + " union all ".join(_union(f, p, ("field", "segment")) for f, p in _FIELDS.items()), "field_health")(lambda s, d: report.field_health(fx.crawl(s, d)))

_SECTIONS = {
    "images": {"with alt": "sum(n_img - n_no_alt)", "missing alt": "sum(n_no_alt)", "pages with images": _n("n_img > 0"), "pages without": _n("n_img = 0")},
    "robots": {"has tag": _n("robots <> ''"), "noindex": _n("robots like '%noindex%'"), "nofollow": _n("robots like '%nofollow%'"), "no tag": _n("robots = ''")},
    "canonicals": {"missing": _n("canonical_status = 'Missing'"), "other": _n("canonical_status = 'Canonicalised'"), "self": _n("canonical_status = 'Self Referencing'")},
    "hreflang": {"has": _n("n_hreflang > 0"), "x-default": _n("n_hreflang > 0 and has_default"), "none": _n("n_hreflang = 0")},
    "links": {"internal": _n("n_links - n_external > 0"), "external": _n("n_external > 0"), "none": _n("n_links - n_external = 0")},
    "social": {"both": _n("has_og and has_twitter"), "og only": _n("has_og and not has_twitter"), "twitter only": _n("has_twitter and not has_og"), "none": _n("not has_og and not has_twitter")},
}
_EVERY = {"response": {"2xx": _n("ok"), "3xx": _n("status_code between 300 and 399"), "4xx": _n("status_code between 400 and 499"), "5xx": _n("status_code >= 500"), "network": _n("status_code = 0 or status_code >= 400")}, "all": {"urls": "count(*)"}}
query(f"with {C} " + " union all ".join([*(_union(f, p, ("section", "bucket")) for f, p in _SECTIONS.items()), *(_union(f, p, ("section", "bucket"), "true") for f, p in _EVERY.items())]), "section_buckets")(lambda s, d: report.section_buckets(fx.crawl(s, d)))
query(f"with {C} select count(*) as total, {_n('not (status_code = 0 or status_code >= 400)')} as answered, {_n('status_code = 0 or status_code >= 400')} as errors, floor(1000.0 * {_n('status_code = 0 or status_code >= 400')} / count(*) + 0.5) / 10 as error_rate, cast(floor(avg(case when title <> '' then length(title) end) + 0.5) as bigint) as avg_title, cast(floor(avg(case when description <> '' then length(description) end) + 0.5) as bigint) as avg_description, cast(sum(n_h1) as bigint) as h1s, cast(sum(n_h2) as bigint) as h2s, cast(sum(n_h3) as bigint) as h3s, cast(sum(n_img) as bigint) as images, cast(sum(n_schema) as bigint) as schemas, cast(sum(n_hreflang) as bigint) as hreflangs, {_n(chr(114) + 'obots <> ' + chr(39) * 2)} as with_robots from c", "stats_cards")(lambda s, d: report.stats_cards(fx.crawl(s, d)))
query(f"with {C} select case when status_code between 200 and 299 then '2xx' when status_code between 300 and 399 then '3xx' when status_code between 400 and 499 then '4xx' when status_code >= 500 then '5xx' else 'blocked' end as bucket, count(*) as count from c group by 1", "status_distribution")(lambda s, d: report.status_distribution(fx.crawl(s, d)))
query(f"with {C} select count(*) as total, {_n('ok')} as ok, {_n('hop_count > 0')} as redirects, {_n('status_code between 400 and 499')} as client_errors, {_n('status_code >= 500')} as server_errors, {_n('status_code = 0')} as blocked, {_n('ok and title = ' + chr(39) * 2)} as missing_title, {_n('ok and description = ' + chr(39) * 2)} as missing_description, {_n('ok and n_h1 = 0')} as missing_h1, {_n('robots like ' + chr(39) + '%noindex%' + chr(39))} as noindex, floor(avg(tenths / 10.0) * 100 + 0.5) / 100 as avg_fetch from c", "overview_summary")(lambda s, d: report.summary(fx.crawl(s, d)).drop("sentence"))
query(f"with {C} select cast(floor(ord / size) as bigint) as chunk, floor(avg(tenths / 10.0) * 100 + 0.5) / 100 as avg_fetch, count(*) as pages from c, (select case when count(*) <= 60 then 1 else ceil(count(*) / 50.0) end as size from c) group by 1", "response_time_buckets")(lambda s, d: report.response_times(fx.crawl(s, d)))
query(f"with {C} " + " union all ".join(f"select '{k}' as label, {v} as count from c" for k, v in {"2xx Success": _n("ok"), "3xx Redirects": _n("hop_count > 0"), "4xx Client errors": _n("status_code between 400 and 499"), "5xx Server errors": _n("status_code >= 500")}.items()), "response_breakdown")(lambda s, d: report.response_breakdown(fx.crawl(s, d)))
query(f"with {C} " + " union all ".join(f"select '{k}' as label, {v} as count from c" for k, v in {"Indexable pages": f"greatest(0, {_n('ok')} - {_n(chr(114) + 'obots like ' + chr(39) + '%noindex%' + chr(39))})", "Noindex": _n("robots like '%noindex%'"), "Nofollow": _n("robots like '%nofollow%'"), "Canonicalised away": _n("canonical_status = 'Canonicalised'"), "Missing canonical": _n("canonical_status = 'Missing'")}.items()), "indexability")(lambda s, d: report.indexability(fx.crawl(s, d)))
query(
    f"""with {C}, o as ({SQL['overview_summary']}) select '{{"total":' || total || ',"ok":' || ok || ',"redirects":' || redirects || ',"client_errors":' || client_errors || ',"server_errors":' || server_errors || ',"blocked":' || blocked || ',"missing_title":' || missing_title || ',"missing_description":' || missing_description || ',"missing_h1":' || missing_h1 || ',"noindex":' || noindex || ',"avg_fetch":' || avg_fetch
    || ',"statuses":{{' || (select string_agg('"' || k || 'xx":' || v, ',' order by k) from (select status_code // 100 as k, count(*) as v from c group by 1)) || '}},"sample":[' || (select string_agg(to_json({{'url': url, 'title': title, 'status': status_code}})::varchar, ',' order by ord) from (select * from c order by ord limit 25)) || ']}}' as summary from o""",
    "ai_crawl_summary",
)(lambda s, d: report.ai_summary(fx.crawl(s, d)))
query(f"with {C} select bool_or(title <> '') as title, bool_or(description <> '') as description, bool_or(robots <> '') as robots, bool_or(canonical_status <> 'Missing') as canonical, bool_or(n_h1 > 0) as h1s, bool_or(n_h2 > 0) as h2s, bool_or(n_h3 > 0) as h3s, bool_or(n_img > 0) as images, bool_or(n_schema > 0) as schemas, bool_or(n_hreflang > 0) as hreflangs, bool_or(n_links > 0) as internal_links, bool_or(has_og or has_twitter) as social_tags from c", "inferred_flags")(lambda s, d: report.inferred_flags(fx.crawl(s, d)))

# Links.
_IN = "i as (select dst as key, count(*) as incoming, count(distinct nullif(lower(trim(anchor)), '')) as unique_anchors from e where is_internal group by dst), o as (select src as key, count(*) as outgoing from e where is_internal group by src), t as (select dst as key, arg_min(a, (-n, f)) as top_anchor from (select dst, lower(trim(anchor)) as a, count(*) as n, min((src, pos)) as f from e where is_internal group by 1, 2) group by dst)"
_EQ = "q as (select c.ord as key, coalesce(incoming, 0) as incoming, coalesce(outgoing, 0) as outgoing, coalesce(unique_anchors, 0) as unique_anchors, case when incoming > 0 then unique_anchors * 1.0::double / incoming else 0.0::double end as diversity, cast(least(100, floor(log2(1 + coalesce(incoming, 0)) * 25 + 0.5)) as int) as score, top_anchor from c left join i on i.key = c.ord left join o on o.key = c.ord left join t on t.key = c.ord), r as (select *, case when incoming = 0 then 'orphan' when score >= 60 then 'strong' when score >= 30 then 'average' else 'weak' end as strength, outgoing > 100 as overlinked from q)"


def _equity(s, d):
    return links.equity(fx.keys(s, d), fx.edges(s, d))


query(f"with {C}, {E}, {_IN}, {_EQ} select key, incoming, outgoing, unique_anchors, diversity, score, strength, overlinked, top_anchor from r", "link_equity")(_equity)
query(f"with {C}, {E}, {_IN}, {_EQ} select count(*) as pages, {_n('strength = ' + repr('strong'))} as strong, {_n('strength = ' + repr('weak'))} as weak, {_n('strength = ' + repr('orphan'))} as orphan, {_n('overlinked')} as overlinked, {_n('incoming >= 5 and diversity < 0.3')} as low_diversity, max(incoming) as max_incoming from r", "link_equity_summary")(lambda s, d: links.equity_summary(_equity(s, d)))
query(f"with {C}, {E}, {_IN}, {_EQ} select key, incoming, outgoing, unique_anchors, diversity, score, strength, overlinked, top_anchor, cast(row_number() over (order by score desc, key) as int) as rank from r order by score desc, key limit 500", "link_equity_top")(lambda s, d: links.equity_top(_equity(s, d)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key"))))  # 500 rows
query(f"with {C}, {E}, {_IN} select key, top_anchor from t", "top_anchor")(lambda s, d: links.top_anchor(fx.edges(s, d)))
_AUDIT = "a as (select src, dst, anchor, pos, rel, is_internal, rel = 'nofollow' as nofollow, rel = 'sponsored' as sponsored, rel = 'ugc' as ugc, case when rel = 'sponsored' then 'Sponsored' when rel = 'ugc' then 'UGC' when rel = 'nofollow' then 'Nofollow' when rel <> '' then 'Followed' else 'No rel' end as status, not is_internal and rel not in ('nofollow', 'sponsored', 'ugc') as missing_rel from e)"
query(f"with {C}, {E}, {_AUDIT} select * from a", "link_attribute_audit")(lambda s, d: links.audit(fx.edges(s, d)))
query(f"with {C}, {E}, {_AUDIT} select count(*) as links, {_n('not is_internal')} as external, {_n('missing_rel')} as missing_rel, {_n('nofollow')} as nofollow, {_n('sponsored')} as sponsored, {_n('ugc')} as ugc from a", "link_attribute_counts")(lambda s, d: links.attribute_counts(links.audit(fx.edges(s, d))))
_ORPHAN = "select ord as key, status_code, ok and robots not like '%noindex%' as indexable from c where not exists (select 1 from e where is_internal and dst = ord)"
query(f"with {C}, {E} {_ORPHAN}", "orphans")(lambda s, d: links.orphans(fx.keys(s, d), fx.edges(s, d)))
query(f"with {C}, {E} select * from ({_ORPHAN}) where indexable", "critical_orphans")(lambda s, d: links.orphans(fx.keys(s, d), fx.edges(s, d)).where("indexable"))
query(f"with {C}, {E} select dst as key, count(*) as inbound from e join c on c.ord = e.dst where is_internal group by dst having count(*) <= 2", "low_link_pages")(lambda s, d: links.low_links(fx.keys(s, d), fx.edges(s, d)))
_G = "g as (select src, dst, cast(sum(n) as bigint) as links, coalesce(string_agg(a, ' | ' order by first, a) filter (where a <> ''), '') as anchors from (select src, dst, trim(anchor) as a, count(*) as n, min(pos) as first from e where is_internal and src <> dst group by 1, 2, 3) group by src, dst)"
query(f"with {C}, {E}, {_G} select src, dst, cast(links as bigint) as links, anchors from g", "link_graph_edges")(lambda s, d: links.graph_edges(fx.edges(s, d)))
query(f"with {C}, {E}, {_G}, n as (select ord as key, true as crawled from c union all select distinct dst, false from g where dst not in (select ord from c)), i as (select dst as key, count(*) as v from g group by 1), o as (select src as key, count(*) as v from g group by 1) select n.key, coalesce(i.v, 0) as in_degree, coalesce(o.v, 0) as out_degree, n.crawled, coalesce(i.v, 0) = 0 as is_orphan, least(12.0::double, 2 + 2 * log2(1 + coalesce(i.v, 0))) as size from n left join i on i.key = n.key left join o on o.key = n.key", "link_graph_nodes")(lambda s, d: links.graph_nodes(fx.keys(s, d), links.graph_edges(fx.edges(s, d))))
query(f"with {C}, {E}, {_G} select src as key, 'in' as direction, anchors from g where dst = 5 union all select dst, 'out', anchors from g where src = 5", "neighbourhood")(lambda s, d: links.neighbourhood(links.graph_edges(fx.edges(s, d)), 5))
query(f"with {C}, {E} select src, dst from e where is_internal and src <> dst and dst in (select ord from c where hop_count > 0)", "links_to_redirects")(lambda s, d: links.to_redirects(fx.edges(s, d), fx.crawl(s, d).where("hop_count > 0").select(F.col("ord").alias("key"))))

# Depth.
_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', '')"
_BFS = f"root as (select ord from (select ord, row_number() over (partition by regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www[.]', '') order by length({_PATH}), ord) as nth from c where ok) where nth = 1), recursive_edges as (select distinct src, dst from e join c on c.ord = e.dst where is_internal and src <> dst), depths(key, depth) using key (key) as (select ord, 0 from root union select r.dst, w.depth + 1 from depths w join recursive_edges r on r.src = w.key left join recurring.depths d on d.key = r.dst where d.key is null)"


def _depths(s, d, edges=None):
    return graph.click_depth(fx.keys(s, d), fx.edges(s, d) if edges is None else edges, site="site")


query(f"with recursive {C}, {E}, {_BFS} select key, depth from depths", "click_depth")(_depths)
query(f"with recursive {C}, {E}, {_BFS} select depth, count(*) as pages from depths group by depth", "depth_distribution")(lambda s, d: _depths(s, d).groupBy("depth").agg(F.count("*").alias("pages")))
query(f"with recursive {C}, {E}, {_BFS} select count(*) as reached, floor(avg(depth) * 10 + 0.5) / 10 as average, max(depth) as deepest from depths", "depth_summary")(lambda s, d: graph.depth_summary(_depths(s, d)))
query(f"with recursive {C}, {E}, {_BFS} select key, depth from depths where depth > 3", "deep_pages")(lambda s, d: _depths(s, d).where("depth > 3"))
query(f"with recursive {C}, {E}, {_BFS} select ord as key from c where ok and ord not in (select key from depths)", "unreachable")(lambda s, d: graph.unreachable(fx.keys(s, d), _depths(s, d)))
query(f"with recursive {C}, {E}, walk(key, depth) using key (key) as (select cast(0 as bigint), 0 union select e.dst, w.depth + 1 from walk w join e on e.src = w.key left join recurring.walk d on d.key = e.dst where d.key is null) select key, depth from walk", "spider_bfs")(lambda s, d: graph.spider(fx.edges(s, d), 0))


def _directories(s, d):
    c = fx.crawl(s, d)
    by_page = _depths(s, d).join(c.select(F.col("ord").alias("key"), "url"), "key").select(urls.analysis_key(F.col("url")).alias("key"), "depth")
    return report.directories(c, merge.first_of(by_page, F.col("key"), "depth"))


_SEG = "'/' || regexp_extract(url, '^[a-z]+://[^/?#]*/+([^/?#]+)', 1)"
_KEY = "regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www[.]', '') || case when regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) in ('', '/') then '/' else regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/$', '') end || regexp_extract(url, '^[^?#]*([?][^#]*)', 1)"
query(f"with recursive {C}, {E}, {_BFS}, u as (select {_KEY} as k, min(depth) as depth from depths join c on c.ord = depths.key group by 1) select {_SEG} as segment, count(*) as urls, {_n('ok')} as ok, {_n('hop_count > 0')} as redirects, {_n('status_code >= 400')} as errors, {_n('robots like ' + chr(39) + '%noindex%' + chr(39))} as noindex, {_n('ok and title = ' + chr(39) * 2)} as missing_title, floor(avg(depth) * 10 + 0.5) / 10 as avg_depth from c left join u on u.k = {_KEY} group by 1", "directory_rollup")(_directories)
_TREE = "t as (select distinct regexp_extract(url, '^([a-z]+)://', 1) || '://' || host as origin, host, string_split(trim(path, '/'), '/') as parts from (select url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www[.]', '') as host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages)), n as (select distinct origin || '/' || array_to_string(parts[1:d], '/') as id, case when d = 0 then host else parts[d] end as label, case when d = 0 then host else host || '/' || parts[1] end as grp, cast(d as int) as depth, case when d > 0 then origin || '/' || array_to_string(parts[1:d-1], '/') end as parent, cast(case when d = 0 then 8 else greatest(1, 4 - d) end as int) as size from t, range(4) r(d) where d <= (case when parts[1] = '' then 0 else len(parts) end))"
query(f"with {_TREE} select * from n", "path_tree_nodes")(lambda s, d: graph.path_nodes(_pages(s, d)))
query(f"with {_TREE} select distinct parent as source, id as target from n where parent is not null", "path_tree_links")(lambda s, d: graph.path_links(graph.path_nodes(_pages(s, d))))
query(f"with {_TREE}, f as (select grp, cast((row_number() over (order by min(id)) - 1) % 12 as int) as colour from n group by grp) select id, colour from n join f using (grp)", "path_tree_colours")(lambda s, d: graph.colours(graph.path_nodes(_pages(s, d))))

# Filters.
_DNF = [[Condition("title", "contains", "the"), Condition("status_code", "equals", "200")], [Condition("url", "regex", "/(fr|de)/"), Condition("robots", "not_contains", "noindex")], [Condition("title", "not_regex", "[a-z]"), Condition("absent", "equals", "x")]]
query(f"with {C} select ord from c where (lower(title) like '%the%' and status_code = 200) or (regexp_matches(url, '(?i)/(fr|de)/') and robots not like '%noindex%') or not regexp_matches(title, '(?i)[a-z]')", "advanced_filter_dnf")(lambda s, d: filters.apply(fx.crawl(s, d), _DNF, "ignored", filters.meta_fields()).select("ord"))
query(f"with {C} select ord from c where lower(url) like '%thon%' or lower(title) like '%thon%'", "universal_search")(lambda s, d: filters.apply(fx.crawl(s, d), [], " THon ", {k: filters.meta_fields()[k] for k in ("url", "title")}).select("ord"))
_ERR = "(status_code = 0 or status_code >= 400)"
_QUICK = {
    "all": "true", "errors": _ERR, "missing-title": f"not {_ERR} and title = ''", "missing-desc": f"not {_ERR} and description = ''", "title-long": "length(title) > 60", "multi-h1": "n_h1 > 1", "missing-h1": f"not {_ERR} and n_h1 = 0", "has-robots": "robots <> ''", "no-robots": f"not {_ERR} and robots = ''", "noindex": "robots like '%noindex%'", "nofollow": "robots like '%nofollow%'", "2xx": "ok", "3xx": "status_code between 300 and 399 or first_hop between 300 and 399", "4xx": "status_code between 400 and 499", "5xx": "status_code between 500 and 599",
    "images-missing-alt": f"not {_ERR} and (n_no_alt > 0)", "images-none": f"not {_ERR} and (n_img = 0)", "images-some": f"not {_ERR} and (n_img > 0)", "schema-some": f"not {_ERR} and (n_schema > 0)", "schema-none": f"not {_ERR} and (n_schema = 0)", "canonical-self": f"not {_ERR} and (canonical_status = 'Self Referencing')", "canonical-away": f"not {_ERR} and (canonical_status = 'Canonicalised')", "canonical-missing": f"not {_ERR} and (canonical_status = 'Missing')", "hreflang-some": f"not {_ERR} and (n_hreflang > 0)", "hreflang-none": f"not {_ERR} and (n_hreflang = 0)", "hreflang-default": f"not {_ERR} and (n_hreflang > 0 and has_default)", "links-internal": f"not {_ERR} and (n_links - n_external > 0)", "links-external": f"not {_ERR} and (n_external > 0)", "links-none": f"not {_ERR} and (n_links = 0)",
    "social-some": "has_og or has_twitter", "social-none": "not has_og and not has_twitter", "social-og": "has_og", "social-twitter": "has_twitter", "social-no-og": "not has_og", "social-no-twitter": "not has_twitter",
}


def _quick(s, d):
    c = fx.crawl(s, d)
    names = F.array_compact(F.array(*(F.when(filters.QUICK[k](), F.lit(k)) for k in _QUICK)))
    return c.select("ord", F.explode(names).alias("filter"))


query(f"with {C} " + " union all ".join(f"select ord, '{k}' as filter from c where {v}" for k, v in _QUICK.items()), "quick_filters")(_quick)
query(f"with {C} select ord, title from c", "sort_meta_locale")(lambda s, d: filters.sort_meta(fx.crawl(s, d), "title").select("ord", "title"))

# Rules and reports.
_shared = lambda c: f"ok and lower(trim({c})) <> '' and (select count(*) from c x where x.ok and lower(trim(x.{c})) = lower(trim(c.{c}))) > 1"
_RULES = {
    "title-missing": "ok and title = ''", "title-too-long": "ok and length(title) > 60", "title-too-short": "ok and length(title) between 1 and 29", "title-duplicate": _shared("title"), "desc-missing": "ok and description = ''", "desc-too-long": "ok and length(description) > 160", "desc-too-short": "ok and length(description) between 1 and 69", "desc-duplicate": _shared("description"),
    "h1-missing": "ok and n_h1 = 0", "h1-multiple": "ok and n_h1 > 1", "h1-duplicate": _shared("first_h1"), "h2-missing": "ok and n_h2 = 0", "img-alt-missing": "ok and n_no_alt > 0", "robots-noindex": "ok and robots like '%noindex%'", "canonical-missing": "ok and canonical_status = 'Missing'", "canonical-away": "ok and canonical_status = 'Canonicalised'", "schema-missing": "ok and n_schema = 0", "social-missing": "ok and not has_og and not has_twitter", "internal-orphan": "ok and n_links = 0", "links-missing-rel": "ok and n_missing_rel > 0",
    "status-4xx": "status_code between 400 and 499", "status-5xx": "status_code between 500 and 599", "redirect-temporary": "hop_count > 0 and first_hop = 302", "perf-slow": "ok and tenths > 30",
}
_HITS = "h as (" + " union all ".join(f"select ord, '{k}' as rule_id from c where {v}" for k, v in _RULES.items()) + ")"
_DIM = "dim(rule_id, severity, grp, category, rule_ord) as (values " + ", ".join(f"('{r.id}', '{r.severity}', '{r.group}', '{rules.CATEGORIES[r.group]}', {k})" for k, r in enumerate(rules.RULES)) + ", " + ", ".join(f"('{i}', '{v}', '{g}', '{rules.CATEGORIES[g]}', {len(rules.RULES) + k})" for k, (i, v, g, _) in enumerate(rules.INSIGHTS)) + ")"
_ISSUES = f"{_HITS}, {_DIM}, s as (select rule_id, count(*) as count from h group by 1), w as (select s.rule_id, severity, grp, category, rule_ord, count, case severity when 'critical' then 55 when 'warning' then 25 else 8 end as weight, least(1.0::double, count * 1.0::double / (select count(*) from c)) as share from s join dim on dim.rule_id = s.rule_id), p as (select *, cast(floor(weight * (0.35::double + 0.65::double * share) * (100::double / 55) + 0.5) as int) as priority from w)"

# What redirects, links and depths say, and all hits with it.
_SAID = f"v as (select ord, 'insight-redirect-chains' as rule_id from c where hop_count >= 2 union all select ord, 'insight-redirect-loops' from c where hop_count > 0 and loops union all select ord, 'insight-redirect-broken-end' from c where hop_count > 0 and status_code >= 400 union all select key, 'insight-orphan-pages' from ({_ORPHAN}) where indexable union all select dst, 'insight-low-link-pages' from e join c on c.ord = e.dst where is_internal group by dst having count(*) <= 2 union all select key, 'insight-deep-pages' from depths where depth > 3)"
_EVERY_HIT = _HITS.replace("h as (", "own as (", 1) + f", {_SAID}, h as (select ord, rule_id from own union all select ord, rule_id from v)"
_REPORT = f"{E}, {_BFS}, " + _ISSUES.replace(_HITS, _EVERY_HIT)


def _hits(s, d):
    return rules.hits(fx.crawl(s, d))


def _insights(s, d):
    # the links are resolved once, for depths, orphans and inbound counts
    edges = stored(fx.edges(s, d).where("is_internal").select("src", "dst", "anchor", "is_internal"), "edges")
    return rules.insights(fx.crawl(s, d), fx.keys(s, d), edges, _depths(s, d, edges))


def _every_hit(s, d):
    return stored(_hits(s, d).unionByName(_insights(s, d)), "hits")


def _rated(s, d):
    c = fx.crawl(s, d)
    return rules.prioritised(_every_hit(s, d), c.count())


query(f"with {C}, {_HITS} select ord, rule_id from h", "rule_hits")(lambda s, d: _hits(s, d).select("ord", "rule_id"))
query(f"with {C}, {_ISSUES} select rule_id, severity, grp, count, cast(row_number() over (order by case severity when 'critical' then 0 when 'warning' then 1 else 2 end, count desc, rule_ord) as int) as rank from p", "seo_issues_ranked")(lambda s, d: rules.ranked(_hits(s, d)).select("rule_id", "severity", "grp", "count", "rank"))
query(f"with {C}, {_ISSUES} select severity, count(*) as issues from p group by 1", "severity_counts")(lambda s, d: rules.issues(_hits(s, d)).groupBy("severity").agg(F.count("*").alias("issues")))
query(f"with {C}, {_ISSUES} select rule_id, count from p where grp = 'Meta Titles' or rule_id in ('status-4xx', 'status-5xx', 'redirect-temporary', 'perf-slow')", "section_issues")(lambda s, d: rules.issues(_hits(s, d)).where("flag = 'title'").select("rule_id", "count"))
query(f"with recursive {C}, {E}, {_BFS}, {_SAID} select ord, rule_id from v", "insight_issues")(lambda s, d: _insights(s, d).select("ord", "rule_id"))
query(f"with recursive {C}, {_REPORT} select rule_id, category, count, share, priority from p order by priority desc, count desc, rule_id limit 10", "audit_priorities")(lambda s, d: _rated(s, d).orderBy(F.desc("priority"), F.desc("count"), "rule_id").limit(10).select("rule_id", "category", "count", "share", "priority"))
_CAT = "k(category) as (values " + ", ".join(f"('{c}')" for c in rules.CATEGORY_FLAGS) + "), x as (select k.category, cast(greatest(0, least(100, floor(100 - coalesce(sum(weight * share), 0) + 0.5))) as int) as score, count(p.rule_id) as issues, count(p.rule_id) filter (where severity = 'critical') as critical from k left join p on p.category = k.category group by 1)"
query(f"with recursive {C}, {_REPORT}, {_CAT} select category, score, case when score >= 90 then 'Excellent' when score >= 75 then 'Good' when score >= 50 then 'Needs work' else 'Critical' end as grade, issues, critical from x", "category_scores")(lambda s, d: rules.categories(_rated(s, d)).select("category", "score", grade(F.col("score")).alias("grade"), "issues", "critical"))
query(f"with recursive {C}, {_REPORT}, {_CAT} select cast(floor(avg(score) + 0.5) as int) as overall_score from x", "overall_score")(lambda s, d: rules.overall(rules.categories(_rated(s, d))))
query(f"with recursive {C}, {_REPORT} select c.url, c.status_code, severity, category, grp from h join c on c.ord = h.ord join dim on dim.rule_id = h.rule_id", "issue_url_export")(lambda s, d: generators.issue_rows(_every_hit(s, d), fx.crawl(s, d), rules.dimension(s)).drop("title"))
query(f"with {C} select url, status_code, title, cast(length(title) as int) as title_length, cast(length(description) as int) as description_length, n_h1 as h1_count, canonical_status, robots, n_img as images, n_no_alt as images_without_alt, cast(n_links - n_external as int) as internal_links, n_schema as schemas, n_hreflang as hreflangs, hop_count as hops, case when hop_count > 0 and not loops then 'https://end.example/' || ord else url end as final_url from c", "page_summary_export")(lambda s, d: generators.page_rows(fx.crawl(s, d)).drop("description", "h1", "canonical"))
query(f"with {C} select url, coalesce(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/img' || i || '.png', 'No images') as src, case when i is null or (ord + i - 1) % 3 = 0 then '' else 'alt' end as alt, n_img as images from c left join (values (1), (2), (3)) v(i) on i <= n_img", "images_unnest")(lambda s, d: generators.image_rows(fx.crawl(s, d)))

# One audit by keys: of the pages of one key the last stands for all, so its links count from that page and its depth and inbound links are those of all of them.
_LAST = E.replace("min(page_id) as id", "max(page_id) as id").replace("e as (select page_id as src", "by_page as (select page_id as src") + f", e as (select own.id as src, dst, anchor, pos, rel, is_internal from by_page join pages p on p.page_id = by_page.src join ids_of own on own.key = {fx.KEY_SQL.format('p.url')}), last as (select * from c where ord in (select id from ids_of))"
_BY_KEY = _REPORT.replace(E, _LAST).replace("from c where ok) where nth = 1", "from last where ok) where nth = 1").replace("join c on c.ord = e.dst", "join last on last.ord = e.dst").replace(_ORPHAN, _ORPHAN.replace("from c where", "from last where"))
query(
    f"with recursive {C}, {_BY_KEY}, {_IN} select c.ord, c.url, c.status_code, cast(depth as int) as depth, coalesce(incoming, 0) as incoming, cast(least(100, floor(log2(1 + coalesce(incoming, 0)) * 25 + 0.5)) as int) as score, coalesce(n, 0) as issues, coalesce(critical, 0) as critical from c join ids_of own on own.key = {fx.KEY_SQL.format('c.url')} left join depths on depths.key = own.id left join i on i.key = own.id left join (select ord, count(*) as n, count(*) filter (where severity = 'critical') as critical from h join dim on dim.rule_id = h.rule_id group by 1) f on f.ord = c.ord",
    "page_audit",
)(lambda s, d: audit(fx.crawl(s, d)).pages())
query(f"with recursive {C}, {_BY_KEY}, {_CAT} select category, score, issues, critical from x", "audit_categories")(lambda s, d: audit(fx.crawl(s, d)).categories().drop("audited"))

# Duplicates.
_NORM = "lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))"
query(f"with {C} select {_NORM} as norm, arg_min(title, ord) as value, count(*) as size from c where ok and title <> '' group by 1 having count(*) > 1", "duplicate_titles_exact")(lambda s, d: dedupe.exact_groups(fx.crawl(s, d).where("status_code between 200 and 299"), F.col("title")))
query(f"with {C}, n as (select ord, lower(trim(title)) as norm from c where ok) select ord, norm, copies from n join (select norm, count(*) as copies from n group by 1 having count(*) > 1) using (norm) where norm <> ''", "duplicate_rule_urls")(lambda s, d: dedupe.repeated(fx.crawl(s, d).where("status_code between 200 and 299"), F.col("title")).select("ord", "norm", "copies"))


def _near_items(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("ord"), "text")
    return dedupe.near_candidates(docs, F.col("text"))


_STOP = ", ".join(f"'{w}'" for w in dedupe.token_set.__globals__["STOP_WORDS"])
_TOKENS = f"t as (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as norm, list_distinct(list_filter(string_split_regex(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 and w not in ({_STOP}))) as tokens from documents), u as (select t.* from t join (select norm from t group by norm having count(*) = 1) using (norm) where len(tokens) >= 4 and norm <> '')"
query(f"with {_TOKENS} select a.doc_id as a, b.doc_id as b, len(list_intersect(a.tokens, b.tokens)) * 1.0::double / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) as similarity from u a join u b on a.doc_id < b.doc_id and least(len(a.tokens), len(b.tokens)) >= 0.85 * greatest(len(a.tokens), len(b.tokens)) - 1e-9 where len(list_intersect(a.tokens, b.tokens)) * 1.0::double / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) >= 0.85", "near_duplicate_pairs")(lambda s, d: dedupe.near_pairs(_near_items(s, d)))
query(None, "duplicate_group_rows")(lambda s, d: dedupe.group_members(fx.crawl(s, d)).drop("grp", "ord"))
_BESIDE = "p as ({pairs}), b as (select ord, row_number() over (order by ord) as k, coalesce(e, []) as earlier from (select a as ord from p union select b from p) left join (select b as ord, list(a) as e from p group by b) using (ord))"
_GREEDY = "r(k, ord, leader, leaders) as (select 0::bigint, null::bigint, null::bigint, []::bigint[] union all select b.k, b.ord, list_min(list_intersect(b.earlier, r.leaders)), case when len(list_intersect(b.earlier, r.leaders)) = 0 then list_append(r.leaders, b.ord) else r.leaders end from r join b on b.k = r.k + 1)"
query(f"with recursive {_BESIDE.format(pairs=SQL['near_duplicate_pairs'])}, {_GREEDY} select ord, leader from r where leader is not null union select leader, leader from r where leader is not null", "near_duplicate_groups")(lambda s, d: dedupe.near_groups(_near_items(s, d)))

# Redirects, sitemap, robots.
query(f"with {C} select ord, hop_count, loops and hop_count > 0 as is_loop, status_code >= 400 as ends_in_error, status_code as final_status, 'http' as kind from c where hop_count > 0", "redirect_chains")(lambda s, d: redirects.chains(fx.crawl(s, d)).select("ord", "hop_count", "is_loop", "ends_in_error", "final_status", "kind"))
query(f"with {C} select ord from c where hop_count > 0 and loops", "redirect_loops")(lambda s, d: redirects.chains(fx.crawl(s, d)).where("is_loop").select("ord"))
query(f"with {C} select ord, case when hop_count > 0 then 'http' else 'none' end as kind from c", "redirect_type")(lambda s, d: fx.crawl(s, d).select("ord", redirects.kind(F.col("redirect_chain")).alias("kind")))
query(f"with recursive {C}, {E}, w(key, cur, path, ended) as (select ord, ord, [ord], '' from c union all select w.key, coalesce(e.dst, w.cur), case when e.dst is null then w.path else list_append(w.path, e.dst) end, case when e.dst is null then 'end' when list_contains(w.path, e.dst) then 'loop' else '' end from w left join (select src, dst from e where anchor = 'next') e on e.src = w.cur where w.ended = '' and len(w.path) <= 10) select key, cast(len(path) - 1 as int) as hop_count, cur as final_key, case when ended = '' then 'most' else ended end as ended from w where ended <> '' or len(path) = 11", "redirect_walk")(lambda s, d: redirects.walk(fx.keys(s, d).select("key"), fx.edges(s, d).where("anchor = 'next'").select("src", "dst"), ask_last=False))
_MAP = "m as (select ord, regexp_replace(case when hop_count > 0 and not loops then 'https://end.example/' || ord else url end, '#.*$', '') as loc from c where ok and (hop_count = 0 or first_hop = 301))"
query(f"with {C}, {_MAP} select distinct loc, cast(null as varchar) as lastmod from m", "sitemap_entries")(lambda s, d: generators.sitemap_entries(fx.crawl(s, d)))
query(f"with {C}, {_MAP} select count(*) as total, {_n('not ok')} as dropped_non_2xx, {_n('ok and hop_count > 0 and first_hop <> 301')} as dropped_temporary, (select count(distinct loc) from m) as included, cast(count(*) - {_n('not ok')} - {_n('ok and hop_count > 0 and first_hop <> 301')} - (select count(distinct loc) from m) as bigint) as dropped_duplicate from c", "sitemap_stats")(lambda s, d: generators.sitemap_stats(fx.crawl(s, d)))
query(f"with {C}, {_MAP} select distinct loc, '<url><loc>' || replace(replace(replace(replace(replace(loc, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</loc></url>' as xml from m", "sitemap_xml")(lambda s, d: generators.sitemap_lines(generators.sitemap_entries(fx.crawl(s, d))))
query(f"with {C} select {_SEG} || '/' as prefix, count(*) as errors from c where status_code in (401, 403, 404, 410) and {_SEG} <> '/' group by 1 having count(*) >= 2", "robots_suggest")(lambda s, d: robots.suggested(fx.crawl(s, d)))
#: The robots.txt of a site, by the length of its name: HTML does not hold them.
ROBOTS = [
    "User-agent: *\nDisallow: /private/\nAllow: /private/open\nCrawl-delay: 2\n\nUser-agent: Googlebot\nUser-agent: Bingbot\nDisallow: /*.html$\nDisallow: /fr/\nAllow: /fr/2\nSitemap: https://x.example/sitemap.xml\nnonsense\n",
    "User-agent: *\nDisallow: /\nAllow: /en/\nAllow: /*/1\n",
    "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nDisallow: /*?page=\n",
    "",
]
_SITE = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www[.]', '')"


def _files(s, d):
    sites = _pages(s, d).select(urls.host(F.col("url")).alias("source")).distinct()
    return sites.withColumn("content", F.element_at(F.array(*map(F.lit, ROBOTS)), (F.length("source") % len(ROBOTS) + 1).cast("int")))


_PARSED = """r(variant, kind, grp, agents, rule, line, path, value) as (values
    (0, 'group', 0, '*', null, null, null, null), (0, 'disallow', 0, '*', 0, 2, '/private/', null), (0, 'allow', 0, '*', 1, 3, '/private/open', null), (0, 'crawl-delay', 0, '*', null, 4, null, 2.0::double),
    (0, 'group', 1, 'googlebot,bingbot', null, null, null, null), (0, 'disallow', 1, 'googlebot,bingbot', 0, 8, '/*.html$', null), (0, 'disallow', 1, 'googlebot,bingbot', 1, 9, '/fr/', null), (0, 'allow', 1, 'googlebot,bingbot', 2, 10, '/fr/2', null),
    (0, 'sitemap', null, null, null, 11, 'https://x.example/sitemap.xml', null), (0, 'warning', null, null, null, 12, 'Malformed line: nonsense', null),
    (1, 'group', 0, '*', null, null, null, null), (1, 'disallow', 0, '*', 0, 2, '/', null), (1, 'allow', 0, '*', 1, 3, '/en/', null), (1, 'allow', 0, '*', 2, 4, '/*/1', null),
    (2, 'group', 0, 'gptbot', null, null, null, null), (2, 'disallow', 0, 'gptbot', 0, 2, '/', null), (2, 'group', 1, '*', null, null, null, null), (2, 'disallow', 1, '*', 0, 5, '/*?page=', null))"""
query(f"with {_PARSED} select source, kind, grp, agents, rule, line, path, value from (select distinct {_SITE} as source from pages) join r on r.variant = length(source) % {len(ROBOTS)}", "robots_parse")(lambda s, d: robots.parse(_files(s, d)).withColumn("agents", F.array_join("agents", ",")))
_AGENTS = "a(agent) as (values " + ", ".join(f"('{x}')" for own in robots.BOTS.values() for x in own) + ")"
#: Every page for every agent of the catalogue: which rule of its site's file wins, rules tried one by one in the SQL.
_WON = f"""t as (select distinct source, url, agent, length(source) % {len(ROBOTS)} as variant, path || query as place from (select {_SITE} as source, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) as query from pages), a),
g as (select *, case when variant = 0 then case when contains(lower(agent), 'googlebot') or contains(lower(agent), 'bingbot') then 1 else 0 end when variant = 2 then case when contains(lower(agent), 'gptbot') then 0 else 1 end else 0 end as grp from t),
m as (select g.source, g.url, g.agent, r.kind, r.path, r.line, row_number() over (partition by g.source, g.url, g.agent order by length(replace(replace(r.path, '*', ''), '$', '')) desc, r.kind = 'disallow', r.rule) as k from g join r on r.variant = g.variant and r.grp = g.grp and r.kind in ('allow', 'disallow') and regexp_matches(place, '^' || replace(replace(replace(r.path, '.', '[.]'), '?', '[?]'), '*', '.*')))"""
query(f"with {_AGENTS}, {_PARSED}, {_WON} select t.source, t.url, t.agent, coalesce(m.kind, 'allow') = 'allow' as allowed, m.kind, m.path, m.line from t left join m on m.source = t.source and m.url = t.url and m.agent = t.agent and m.k = 1", "robots_match")(
    lambda s, d: robots.match(robots.parse(_files(s, d)), _pages(s, d).select(urls.host(F.col("url")).alias("source"), "url").crossJoin(F.broadcast(robots.bots(s).select("agent"))))
)


# Elements that the pages lack are set into every page's head by rule, so that these run over whole pages; the SQL says what is found.
def _quoted(x: str | None) -> str:
    return "cast(null as varchar)" if x is None else "replace('" + x.replace("'", "''") + "', '{}', cast(page_id as varchar))"


def _by_page(*wants: str | None) -> str:
    """SQL: what is wanted of a page, dealt by page_id; {} is the page_id."""
    return f"case page_id % {len(wants)} " + " ".join(f"when {k} then {_quoted(w)}" for k, w in enumerate(wants)) + " end"


def _dealt(*texts: str) -> F.Column:
    own = F.array(*(F.replace(F.lit(t), F.lit("{}"), F.col("page_id").cast("string")) for t in texts))
    return F.element_at(own, (F.col("page_id") % len(texts) + 1).cast("int"))


def _marked(name: str, cases: list[tuple[str, str | None]], expression: Callable[[], F.Column], sql: str | None = None) -> None:
    """A query over every page with an element of `cases` in its head; sql: the result's expression over html and {own}, what is wanted of the element."""
    own = _by_page(*(w for _, w in cases))
    query(f"select page_id, {(sql or '{own}').replace('{own}', own)} as result from pages", name)(
        lambda s, d: _pages(s, d).withColumn("c", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), _dealt(*(t for t, _ in cases))))).select("page_id", expression().alias("result"))
    )


def _rows(name: str, cases: list[tuple[str, str | None]], expression: Callable[[], F.Column], sql: str | None = None) -> None:
    """A query over a text of each page: one of `cases`, where %u is the page's address."""
    own = "replace(" + _by_page(*(w for _, w in cases)) + ", '%u', url)"
    query(f"select page_id, {own} as result from pages", name)(lambda s, d: _pages(s, d).withColumn("c", F.replace(_dealt(*(t for t, _ in cases)), F.lit("%u"), F.col("url"))).select("page_id", expression().alias("result")))


_each = lambda c, f: F.array_join(F.transform(c, f), "; ")
_LONG = "this text describes the thing of page {} in full and " * 2
_ANCHORS = f"array_to_string(list_prepend({{own}}, list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda x: trim(regexp_replace({_DECODE.format('x')}, '\\s+', ' ', 'g')))), '; ')"
_marked("anchor_text_cascade", [("<a href='/a'><h2>A &amp; {}</h2><p>x</p></a>", "A & {}"), ("<a href='/b'><div><p>label {}</p> more</div></a>", "label {}"), ('<a href="/c"><img alt="picture {}" src="x"></a>', "picture {}"), ("<a href='/d'>" + "words " * 30 + "</a>", "words " * 15 + "words…")], lambda: _each(html.anchors(F.col("c")), lambda a: html.anchor_text(a["inner"])), _ANCHORS)
_marked("card_context", [(f"<a href='/a'><h3>Name</h3><p>{_LONG}</p></a>", f"Name — {_LONG.strip()}"), ("<a href='/b'><h3>Name</h3><p>from $20 and more, inclusive of everything that there is</p></a>", None), ("<a href='/c'><p>no heading but a text that would be long enough to be one</p></a>", None)], lambda: html.card_text(F.get(html.anchors(F.col("c")), F.lit(0))["inner"]))
_marked("js_redirect", [("<script>window.location.href='/a/{}'</script>", "/a/{}"), ("<script>x.onclick=function(){location='/b'}</script>", None), ('<script>location.replace("/c/{}")</script>', "/c/{}"), ("<p>location='/d'</p>", None), ("<!-- <script>location='/x'</script> -->", None), ("<script>a.onclick=()=>go(); location='/e/{}'; if(x){y()}</script>", "/e/{}"), ("<script>x.onclick=function(){var r=/}/; location='/b'}</script>", None), ("<script>x.onclick=function(){s=`}${f({a:1})}`; location='/b'}; location='/t/{}'</script>", "/t/{}"), ("<script>location=page; location.href='%u'; location='/s/{}'</script>", "/s/{}")], lambda: html.script_redirect(F.replace("c", F.lit("%u"), F.col("url")), F.col("url")))
_marked("meta_refresh", [('<meta http-equiv="refresh" content="5;url=/a/{}">', "/a/{}"), ('<meta http-equiv="refresh" content="6;url=/a">', None), ("<!-- <meta http-equiv='refresh' content='0;url=/a'> -->", None)], lambda: html.meta_refresh(F.col("c"))["target"])
_marked("meta_description", [('<meta name="description" content=""><meta name="description" content="two &amp; {}">', "two & {}"), ("<!-- <meta name=description content=x> -->", ""), ('<meta content="about {}" name="description">', "about {}")], lambda: html.description(F.col("c")))
_LD = '<script type="application/ld+json">%s</script>'
_marked("jsonld_types", [(_LD % '{"@type":"A{}"}', "A{}"), (_LD % '{"@type":["A","B{}"]}', "A, B{}"), (_LD % '{"@graph":[{"@type":"A"},{"@type":"B"}]}', "A + B"), (_LD % "[", "Raw"), (_LD % '{"a":1}', "Schema")], lambda: html.schema_label(F.get(html.json_ld(F.col("c")), F.lit(0))))
_marked("social_tags_dedup", [('<meta property="og:title" content="T{}"><meta property="OG:title" content="T{}"><meta name="twitter:card" content="s">', "og:title=T{}; twitter:card=s"), ("", "")], lambda: _each(html.social_tags(F.col("c")), lambda t: F.concat(t["property"], F.lit("="), t["content"])))
_marked("hreflang_extract", [('<link rel="alternate" hreflang="de" href="/de/{}"><link rel="alternate" href="/f"><link rel="alternate" hreflang="fr" href="/fr/{}">', "de=/de/{}; fr=/fr/{}"), ('<link rel="alternate" hreflang="de">', "")], lambda: _each(html.hreflangs(F.col("c")), lambda t: F.concat(t["hreflang"], F.lit("="), t["href"])))
_marked("image_alt_audit", [('<img src="a{}.png" alt=""><img src="data:x"><img src=\'b.png\' alt="b &amp; {}">', "a{}.png:none; b.png:b & {}"), ("<img alt='x'>", "")], lambda: _each(html.images(F.col("c")), lambda i: F.concat(i["src"], F.lit(":"), F.coalesce(i["alt"], F.lit("none")))))
_marked("entity_numbers", [("&#233;&#x41;{}", "éA{}"), ("&eacute;&#{};", None)], lambda: html.decode_numbers(F.col("c")), "case when page_id % 2 = 0 then replace(html, '<head>', '<head>' || {own}) else replace(html, '<head>', '<head>&eacute;' || chr(cast(page_id as int))) end")
_GONE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)</?(html|head|meta|title|body|nav|article|footer|header|main|section|aside)\\b[^>]*>', '', 'g')"
_marked("sanitise_html", [('<p onclick="x">a{}<script>b</script><a href="javascript:c" class="d">e</a></p>', '<p>a{}<a class="d">e</a></p>'), ('<form><table><tr><td colspan="2" style="x">{}<sup>2</sup></td></tr></table><hr></form>', '<table><tr><td colspan="2">{}<sup>2</sup></td></tr></table><hr>')], lambda: html.sanitise(F.col("c")), "'<!DOCTYPE html>' || {own} || substr(" + _GONE + ", 16)")
_rows("sitemap_locations", [("<urlset><url><loc><![CDATA[http://a/?x={}&amp;y]]></loc></url><url><lastmod>1</lastmod></url><url><loc> %u\n</loc></url></urlset>", "http://a/?x={}&y; %u")], lambda: F.array_join(lists.locations(F.col("c"), "url"), "; "))
_rows("robots_sitemaps", [("User-agent: *\n sitemap : http://a/{}.xml\nSitemap: %u", "http://a/{}.xml; %u"), ("Disallow: /{}", "")], lambda: F.array_join(lists.declared_sitemaps(F.col("c")), "; "))
_rows("url_safety", [("http://10.1.1.1/{}", "false"), ("%u", "true"), ("http://[::1]/{}", "false"), ("ftp://x.example/{}", "false")], lambda: urls.is_safe(F.col("c")).cast("string"))
query("select distinct url from pages where url like 'http%' and page_id % 3 <> 1", "url_list_text")(lambda s, d: lists.from_text(_pages(s, d).select(F.col("page_id").alias("ord"), F.concat(F.lit(" "), F.when(F.col("page_id") % 3 == 1, F.lit("x")).otherwise(F.col("url")), F.lit(" ")).alias("value")).transform(lambda t: t.union(t.withColumn("ord", F.col("ord") + 1_000_000_000)))).select("url"))
query("select distinct url from pages where page_id % 3 <> 1", "url_list_rows")(lambda s, d: lists.from_rows(_pages(s, d).select(F.col("page_id").alias("ord"), F.when(F.col("page_id") % 3 == 1, F.lit("x,y")).when(F.col("page_id") % 3 == 2, F.concat(F.lit('"'), F.col("url"), F.lit('",1'))).otherwise(F.concat(F.lit("x,"), F.col("url"), F.lit(",http://b"))).alias("value"))).select("url"))
_ALTERNATES = "array(named_struct('language', 'en', 'country', 'gb', 'href', url), named_struct('language', if(page_id % 2 = 0, 'EN', 'fr'), 'country', 'GB', 'href', if(page_id % 3 = 0, 'b', url || '/b')))"
query("select page_id as cluster, w as warning from pages, (values ('a code is there twice', 2, 0), ('an alternate is no absolute address', 3, 0), ('canonical is missing', 5, 1)) v(w, m, r) where page_id % m = r", "hreflang_validate")(lambda s, d: generators.hreflang_warnings(_pages(s, d).selectExpr("page_id as cluster", "if(page_id % 5 = 1, '', url) as canonical", "cast(null as string) as x_default", f"{_ALTERNATES} as alternates")))
query("select page_id, code, 'https://x.example/' || code as href from pages, (values ('en-GB'), ('de')) v(code)", "hreflang_bulk")(lambda s, d: generators.hreflang_bulk(_pages(s, d).select("page_id", "url"), s.createDataFrame([("en", "gb", "https://x.example/en-GB"), ("de", "", "https://x.example/de")], "language string, country string, href string")).drop("url"))
query("select url, w as warning from pages, (values ('og:description is missing', 2), ('og:image is no absolute address', 3)) v(w, m) where page_id % m = 0", "social_validate")(lambda s, d: generators.social_warnings(_pages(s, d).selectExpr("url", "'title' as og_title", "if(page_id % 2 = 0, '', 'about') as og_description", "if(page_id % 3 = 0, '/rel', url) as og_image", "cast(null as string) as twitter_title", "cast(null as string) as twitter_description", "cast(null as string) as twitter_image", "cast(null as string) as card")))
query(f"with {C}, {E}, l as (select ord as k from c), w as (select distinct dst as k from e) select cast(k as varchar) as url, 'spider' as origin from w union all select cast(k as varchar), 'sitemap' from l where k not in (select k from w)", "spider_union_sitemap")(lambda s, d: lists.with_sitemap(fx.edges(s, d).select(F.col("dst").cast("string").alias("url")).distinct(), fx.keys(s, d).select(F.col("key").cast("string").alias("url"))))
query("with x as (select conv_id, count(*) as turns, string_agg(role, ',' order by turn) as roles from conversations group by 1) select conv_id, turns, roles from x", "conversation_turns_nested")(lambda s, d: s.read.parquet(f"{d}/conversations.parquet").transform(lambda t: merge.nested(t.select("conv_id").distinct(), t, "conv_id", "conv_id", "turn", "items")).select("conv_id", F.size("items").cast("long").alias("turns"), F.array_join(F.transform("items", lambda i: i["role"]), ",").alias("roles")))
query(f"with {C} select url, title, n_h1 as h1s_count, canonical, canonical_status, status_code from c", "meta_export")(lambda s, d: generators.meta_rows(fx.crawl(s, d), {"title", "h1", "canonical"}).drop("h1s", "status", "fetch_time"))
query(f"with {C} select url, case when n_hreflang = 0 then 'No hreflang' else k.h end as href, case when n_hreflang = 0 then '' when k.h = 'a' then 'en' when has_default then 'x-default' else 'fr' end as hreflang from c left join (values ('a'), ('b')) k(h) on n_hreflang > 0 where not (status_code = 0 or status_code >= 400)", "hreflang_export")(lambda s, d: generators.nested_rows(fx.crawl(s, d), "hreflangs", "No hreflang"))
query(f"with {C} select url, case when n_schema > 0 then '{{' || chr(10) || '  ' || chr(34) || '@type' || chr(34) || ': ' || chr(34) || 'Page' || chr(34) || chr(10) || '}}' else 'No schema' end as value from c where not (status_code = 0 or status_code >= 400)", "schema_export")(lambda s, d: generators.nested_rows(fx.crawl(s, d), "schemas", "No schema"))
query(f"with {C} select '\"' || replace(url, '\"', '\"\"') || '\",\"' || replace(title, '\"', '\"\"') || '\",' || status_code as line from c", "csv_lines")(lambda s, d: generators.csv_lines(fx.crawl(s, d).select("url", "title", "status_code")))
query(f"with {C} select url || chr(9) || title || chr(9) || status_code as line from c", "tsv_lines")(lambda s, d: generators.tsv_lines(fx.crawl(s, d).select("url", "title", "status_code")))
query(f"with {C} select url, case when has_og then 'x' else title end as title, description, case when n_img > 0 then regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/img1.png' else '' end as image from c", "social_preview")(lambda s, d: generators.preview(fx.crawl(s, d)))


# Filters, access, graph cuts and file texts over whole tables.
_KINDS = {"all": "true", "external": "not is_internal", "missing-rel": "missing_rel", "nofollow": "nofollow", "sponsored": "sponsored", "ugc": "ugc"}


@query(f"with {C}, {E}, {_AUDIT} " + " union all ".join(f"select '{k}' as filter, src, dst, pos from a where {w}" for k, w in _KINDS.items()))
def link_filters(s, d):
    audited = links.audit(fx.edges(s, d))
    held = F.array_compact(F.array(*(F.when(c(), F.lit(k)) for k, c in filters.LINKS.items())))
    return audited.select(F.explode(held).alias("filter"), "src", "dst", "pos")


query(f"select rule_id, grp from ({SQL['seo_issues_ranked']}) where severity = 'warning' and grp ilike '%meta%'", "issue_filter")(lambda s, d: filters.issues(rules.ranked(_hits(s, d)).withColumn("title", F.lit("")), "warning", "META").select("rule_id", "grp"))


@query(f"with k as ({SQL['url_normalise_crawl']}) select min(page_id) as ord from k where key not in (select key from k where page_id % 4 = 0) group by key")
def unseen_batch(s, d):
    """Each page comes twice in the batch; every fourth was crawled before."""
    rows = _pages(s, d).select(F.col("page_id").alias("ord"), "url")
    again = rows.select((F.col("ord") + 1_000_000_000).alias("ord"), "url")
    return merge.unseen(rows.union(again), rows.where("ord % 4 = 0").select("url", F.lit(None).cast("string").alias("final_url"))).select("ord")


_CUT = f"n as ({SQL['link_graph_nodes']}), top as (select key from n order by in_degree desc, key limit 100)"


@query(f"with {_CUT}, g as ({SQL['link_graph_edges']}) select src, dst, links from g where src in (select key from top) and dst in (select key from top)")
def link_graph_cut(s, d):
    """Edges between the 100 pages that most others link to, as a viewer shows them."""
    edges = links.graph_edges(fx.edges(s, d))
    return links.capped(links.graph_nodes(fx.keys(s, d), edges), edges, [F.desc("in_degree"), "key"], 100)[1].select("src", "dst", "links")


@query("select distinct page_id as row_id, user_id, event_type from events join pages on page_id = user_id % 50 where page_id % 3 = 0 or user_id % 2 = 0")
def access_visible(s, d):
    """Every user asks for a page with each type of event; a third of the pages is public, even users are admins."""
    events = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_type").distinct()
    rows = _pages(s, d).select(F.col("page_id").alias("row_id"), (F.col("page_id") % 3 == 0).alias("is_public"))
    roles = events.select("user_id", F.when(F.col("user_id") % 2 == 0, "admin").otherwise("user").alias("role"))
    return access.visible(rows, events.withColumn("row_id", F.col("user_id") % 50), roles).select("row_id", "user_id", "event_type")


query("select distinct user_id from events where user_id % 2 = 0", "access_admins")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("user_id").distinct().transform(lambda u: access.having_role(u, u.select("user_id", F.when(F.col("user_id") % 2 == 0, "admin").otherwise("user").alias("role")))))
query(f"with b as ({SQL['robots_suggest']}) select concat_ws(chr(10), 'User-agent: *', 'Allow: /', (select string_agg('Disallow: ' || prefix, chr(10) order by prefix) from b), '', 'Sitemap: https://x.example/sitemap.xml', '') as content", "robots_generate")(lambda s, d: robots.generate(fx.crawl(s, d), "x.example"))
query(f"select (select count(*) from ({SQL['duplicate_titles_exact']})) as exact_groups, (select cast(coalesce(sum(size), 0) as bigint) from ({SQL['duplicate_titles_exact']})) as exact_pages, count(distinct leader) as near_groups, count(*) as near_pages from ({SQL['near_duplicate_groups']})", "duplicate_summary")(lambda s, d: dedupe.summary(dedupe.exact_groups(fx.crawl(s, d).where("status_code between 200 and 299"), F.col("title")), dedupe.near_groups(_near_items(s, d))))
query("select distinct page_id, unnest(list_transform(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a href=\"([^\"]*)\"', 1), lambda x: trim(x))) as href from pages", "page_hrefs")(lambda s, d: _pages(s, d).select("page_id", F.explode(html.hrefs(F.col("html"))).alias("href")).distinct())


# Files written and read back.
@query("select distinct url, 'url' as kind from pages where url <> ''")
def sitemap_files(s, d):
    """Every address, from compressed sitemap files that name it."""
    path = scratch(s, "sitemaps")
    generators.write_sitemaps(_pages(s, d).select(F.col("url").alias("loc"), F.lit(None).cast("string").alias("lastmod")).distinct(), path, "https://files.example", compressed=True)
    return lists.scan(s, path).where("kind = 'url'").select(F.replace(F.replace(F.replace(F.replace("url", F.lit("&apos;"), F.lit("'")), F.lit("&quot;"), F.lit('"')), F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")).alias("url"), "kind")


@query(f"with {C} select url, status_code, title, description, canonical from c")
def csv_files(s, d):
    """The rows of CSV files for spreadsheets, of a hundred lines each."""
    path = scratch(s, "csv")
    rows = fx.crawl(s, d).select("url", "status_code", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description", "canonical")), "ord")
    exports.write_csv(rows, path, ["ord"], rows.drop("ord").columns, lines=100)
    return s.read.schema("url string, status_code int, title string, description string, canonical string").option("header", True).option("multiLine", True).option("escape", '"').csv(path).fillna("")


# An audit kept up to date.
def _kept(s, d):
    """The kept counts of two thirds of the pages with other titles, after the rest came and the titles went back."""
    path, crawl = scratch(s, "kept"), fx.crawl(s, d)
    old = crawl.where("ord % 3 <> 0").withColumn("title", F.concat(F.lit("old "), F.col("ord") % 5))
    incremental.create(old, path)
    incremental.update(path, old.limit(0), crawl.where("ord % 3 = 0"))
    incremental.update(path, old, crawl.where("ord % 3 <> 0"))
    return path


query(f"select rule_id, count(*) as pages from ({SQL['rule_hits']}) group by 1", "incremental_issues")(lambda s, d: incremental.issues(s, _kept(s, d)).select("rule_id", F.col("count").alias("pages")))
query(f"with {C} select 'title' as kind, lower(trim(title)) as key, count(*) as size from c where ok and trim(title) <> '' group by 2 having count(*) > 1 union all select 'description', lower(trim(description)), count(*) from c where ok and trim(description) <> '' group by 2 having count(*) > 1 union all select 'h1', lower(trim(first_h1)), count(*) from c where ok and trim(first_h1) <> '' group by 2 having count(*) > 1", "incremental_duplicates")(lambda s, d: incremental.duplicates(s, _kept(s, d)))


# Incremental crawls, history, streams.
def _fresh(s, d):
    return fx.crawl(s, d).where("status = 'OK'").withColumn("title", F.concat(F.lit("new "), F.col("title"))).withColumn("robots", F.lit("none"))


query(f"with {C}, u as (select url, arg_max(title, ord) as title from c where not (status_code = 0 or status_code >= 400) group by url) select c.ord, case when u.url is not null then 'new ' || u.title else c.title end as title, c.robots from c left join u on u.url = c.url", "incremental_merge")(lambda s, d: merge.overlay(fx.crawl(s, d), _fresh(s, d), ["title"]).select("ord", "title", "robots"))
query("select conv_id, turn, role from (select *, row_number() over (partition by role order by conv_id desc, turn desc) as n from conversations) where n <= 50", "history_last_50")(lambda s, d: s.read.parquet(f"{d}/conversations.parquet").withColumn("at", F.struct("conv_id", "turn")).transform(lambda t: merge.newest(t, "role", "at")).select("conv_id", "turn", "role"))
query("select conv_id, turn from conversations where turn < 1 + conv_id % 3", "history_truncated")(lambda s, d: s.read.parquet(f"{d}/conversations.parquet").transform(lambda t: merge.truncated(t, "conv_id", "turn", t.select("conv_id", (1 + F.col("conv_id") % 3).alias("cut")).distinct())).select("conv_id", "turn"))


def _answer(url: str, attempt: int) -> page_source.Answer:
    """Answers by the length of an address: pages, redirects, errors, and a busy server that answers the second time."""
    n = len(url) % 7
    if n == 0 and attempt == 1:
        return page_source.Answer(503, {"retry-after": "0"}, "")
    return page_source.Answer(301, {"location": url + "/on"}, "") if n == 1 else page_source.Answer(404, {}, "") if n == 2 else page_source.Answer(200, {}, url)


@query("select page_id as ord, url, case when length(url) % 7 = 2 then 'Error' else 'OK' end as status, cast(case length(url) % 7 when 1 then 301 when 2 then 404 else 200 end as int) as status_code, case when length(url) % 7 in (1, 2) then '' else url end as html, case when length(url) % 7 = 1 then url || '/on' else '' end as location from pages")
def fetched_stream(s: SparkSession, d: str) -> DataFrame:
    """Every page's address fetched, host by host, in a stream over the table."""
    from ..streaming.crawl import append_fetched

    stream = s.readStream.schema(_pages(s, d).schema).parquet(f"{d}/pages.parquet*").select(F.col("page_id").alias("ord"), "url")
    out = scratch(s, "fetched")
    append_fetched(stream, _answer, out, scratch(s, "fetched-state"), deadline=None).awaitTermination()
    return s.read.schema(page_source.FETCHED).parquet(f"{out}/batch=*").select("ord", "url", "status", "status_code", "html", "location")


def event_dedup_stream(s: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type, from a stream over the events table."""
    from ..streaming.crawl import distinct_events

    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out, mark = scratch(s, "stream"), scratch(s, "stream-state")
    done = distinct_events(stream, ["user_id", "event_type"]).select("user_id", "event_type").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    done.awaitTermination()
    return s.read.schema("user_id long, event_type string").parquet(out)


query("select distinct user_id, event_type from events", "event_dedup_stream")(event_dedup_stream)

