"""The steps that links go through: the same keys as address by address, with less work a link."""

from pyspark.sql import functions as F

from tidewater.functions import urls
from tidewater.operators import incremental, links

BASES = ["https://x.example/a/b?q#f", "http://X.Example:80", "https://x.example:8443/ü/", "http://x.example.", "HTTPS://x.example/a", "https://u:p@x.example/a", "https://[::1]/a", "ftp://x.example/a", "//x.example/a", "http://exämple/", "http://x.example\n/a", "http://x.example\n", " http://x.example/", "http://", "/a", "", None]
LINKS = ["/", "/a", "/a/", "/a//b", "//y.example/b", "/osóciónta", "/no.", "/.", "/..", "/./a", "/a/../b", "/a/..", "/a/..b", "/...", "/.a", "/a?b=/../c", "/a?", "/a?b?c", "/a/.?b", "/a;b", "/a;", "/a#f", "/a#", "/a b", " /a ", "/a\n", "/a ", "/a\tb", "/a:b@c", "/%zz%20", "/a[1]", "/\U0001f600", "a/b", "../a", "?q", "#f", "", "https://y.example/z", "HTTP://www.Y.example:80/z/?", "https://y.example:443", "https://u@y.example/a/b/?x#y", "https:///a", "mailto:a@x.example", "javascript:void(0)", "https://y.example/a\n", "https://y.example/\n", None]
LINK = "array<struct<anchor_text:string,href:string,is_internal:boolean,rel:string,nofollow:boolean,sponsored:boolean,ugc:boolean,address:string>>"


def _crawl(spark):
    rows = [(i, b, [(f"Said {k % 3}", x, None if k % 7 == 0 else k % 5 > 0, None if k % 2 else "next", None, False, True, "") for k, x in enumerate(LINKS)]) for i, b in enumerate(BASES)]
    return spark.createDataFrame([*rows, (98, BASES[0], []), (99, BASES[0], None), rows[0]], f"ord long, url string, internal_links {LINK}")


def test_plain_links_are_joined_as_all_others(spark):
    rows = spark.createDataFrame([(b, x) for b in BASES for x in LINKS], "b string, x string")
    found = rows.select("b", "x", urls.join_plain(F.col("b"), F.col("x")).alias("plain"), urls.join("b", "x").alias("joined")).collect()
    assert not [r for r in found if r.plain is not None and r.plain != r.joined]
    assert {r.x for r in found if r.plain is not None and r.b == BASES[0]} == {"/", "/a", "/a/", "/a//b", "/osóciónta", "/no.", "/a/..b", "/...", "/.a", "/a?b=/../c", "/a:b@c", "/%zz%20"}


def test_keys_of_links_are_those_of_their_addresses(spark):
    absolute = F.when(urls.is_absolute(F.col("href")), F.col("href")).otherwise(F.coalesce(urls.join(F.col("page_url"), F.col("href")), F.col("href")))
    found = links.edges(_crawl(spark))
    rows = found.select("src", "dst", urls.analysis_key(F.col("page_url")).alias("page"), urls.analysis_key(absolute).alias("address")).collect()
    assert len(rows) == (len(BASES) + 1) * len(LINKS)
    assert [(r.src, r.dst) for r in rows] == [(r.page, r.address) for r in rows]
    assert [r[0] for r in found.where("anchor = 'Said 0' and not is_internal").select(F.count("*")).collect()] == [r[0] for r in _crawl(spark).select(F.explode("internal_links").alias("l")).where("l.anchor_text = 'Said 0' and not coalesce(l.is_internal, false)").select(F.count("*")).collect()]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_address_is_taken_apart_once(spark):
    plan = _plan(links.edges(_crawl(spark)).select("dst"))
    assert plan.count("regexp_extract(") <= 7 and plan.count("ArrowEvalPython") == 1


def test_kept_keys_resolve_each_link_once(spark, tmp_path):
    """Null keys count for nothing, and leaving them out resolves no address twice."""
    c = F.col("ord") % 2
    crawl = _crawl(spark).withColumns({"title": F.when(c == 0, "T "), "description": F.lit(None).cast("string"), "h1s": F.array(F.lit(None).cast("string"), F.lit("a")), "status_code": F.lit(200)})
    kept = incremental._summed(incremental._keys(crawl).unionByName(incremental._keys(crawl.where("ord = 99"), -1)))
    assert _plan(kept).count("ArrowEvalPython") == 2
    want = links.edges(crawl).where("is_internal and dst is not null").groupBy(F.col("dst").alias("key"), F.lower(F.trim(F.coalesce("anchor", F.lit("")))).alias("item")).agg(F.count("*").alias("n"))
    rows = lambda df: sorted(tuple(r) for r in df.select("key", "item", "n").collect())
    assert rows(kept.where("kind = 'link'")) == rows(want)
    assert rows(kept.where("kind <> 'link'")) == [("t", "", crawl.where("title is not null").count())]
