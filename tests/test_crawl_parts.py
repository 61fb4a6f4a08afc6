"""Redirects followed by the fetcher, spidered links, sitemap files, duplicate groups by field, fixed values."""

import re
from itertools import combinations
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewater.functions import html, urls
from tidewater.operators import dedupe, generators, graph, rules
from tidewater.plans import storage
from tidewater.sources import pages
from tidewater.sources.pages import Answer


def _send(url, attempt):
    """A site with chains of all kinds, a loop, and a chain of more than ten hops."""
    kind, _, n = url.rpartition("/")[2].partition("-")
    if kind == "hop":
        return Answer(301, {"location": f"/hop-{int(n) - 1}" if int(n) else "/end"}, "")
    if kind == "loop":
        return Answer(302, {"location": f"/loop-{1 - int(n)}"}, "")
    if kind == "meta":
        return Answer(200, {}, '<head><meta http-equiv="refresh" content="0;url=/hop-0"></head>')
    if kind == "script":
        return Answer(200, {}, "<script>location.href = '/end'</script>")
    if kind == "header":
        return Answer(200, {"refresh": "1; url=/end"}, "<p>x</p>")
    if kind == "inside":
        return Answer(301, {"location": "http://10.0.0.1/secret"}, "")
    return Answer(404 if kind == "gone" else 200, {}, f"<title>{kind}</title>")


def test_follow(spark):
    paths = ["end", "hop-0", "hop-2", "hop-30", "loop-0", "meta", "script", "header", "gone", "inside"]
    rows = pages.follow(spark.createDataFrame([(i, f"https://x.example/{p}") for i, p in enumerate(paths)], "ord long, url string"), _send).collect()
    got = {r.url.rpartition("/")[2]: (r.hop_count, (r.final_url or "").rpartition("/")[2], r.redirect_type, r.status_code) for r in rows}
    assert got == {
        "end": (0, "end", "none", 200), "hop-0": (1, "end", "http", 200), "hop-2": (3, "end", "http", 200), "hop-30": (10, "hop-20", "http", 301), "loop-0": (2, "loop-0", "http", 302),
        "meta": (2, "end", "mixed", 200), "script": (1, "end", "javascript", 200), "header": (1, "end", "meta-refresh", 200), "gone": (0, "gone", "none", 404), "inside": (1, "secret", "http", 0),
    }
    assert {r.redirect_status_code for r in rows if r.hop_count == 0} == {None}


def test_retry_after():
    assert pages.retry_after("7") == 7 and pages.retry_after("soon") is None
    assert pages.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", lambda: 20.0) == 40 and pages.retry_after("Thu, 01 Jan 1970 00:01:00 GMT", lambda: 90.0) == 0


def test_spidered_links(spark):
    page = '<a href="/b#x">b</a> <a href="https://www.x.example/c?q=1">c</a> <a href="http://other.example/">o</a> <a href="/f.PDF">f</a> <a href="mailto:a@b">m</a> <a href="ftp://x.example/d">d</a> <a href="e.tar">e</a>'
    links = graph.page_links(spark.createDataFrame([("https://x.example/a/", page), ("https://x.example/b", '<a href="g">g</a>')], "url string, html string"), "https://x.example/a/")
    assert {(r.src, r.dst) for r in links.collect()} == {("https://x.example/a/", "https://x.example/b"), ("https://x.example/a/", "https://www.x.example/c?q=1"), ("https://x.example/b", "https://x.example/g")}
    assert {r.key: r.depth for r in graph.spider(links, "https://x.example/a/").collect()} == {"https://x.example/a/": 0, "https://x.example/b": 1, "https://www.x.example/c?q=1": 1, "https://x.example/g": 2}


def test_depth_beyond_a_hundred(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)], "src long, dst long")
    assert graph.spider(edges, 0).agg(F.max("depth")).first()[0] == 120


def test_sitemap_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generators, "SITEMAP_LINES", 40)
    want = sorted(f"https://x.example/{i}?a=1&b" for i in range(300))
    generators.write_sitemaps(spark.createDataFrame([(u, None) for u in want], "loc string, lastmod string"), str(tmp_path / "out"))
    files = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert len(files) >= 8 and all(f.startswith('<?xml version="1.0"') and f.rstrip().endswith("</urlset>") and f.count("<url>") <= 40 for f in files)
    assert sorted(u for f in files for u in re.findall("<loc>(.*?)</loc>", f)) == [u.replace("&", "&amp;") for u in want]


def test_duplicate_groups_by_field(spark):
    words = "alpha beta gamma delta epsilon zeta theta kappa"
    values = [words, words.upper(), words + " lambda", words + " mu", "short text", words.replace("kappa", "sigma tau"), None, "", words + " lambda nu"]
    crawl = spark.createDataFrame([(i, f"u{i}", v, v if i % 2 else None, [v] if v else [], 200 if i != 3 else 404) for i, v in enumerate(values)], "ord long, url string, title string, description string, h1s array<string>, status_code int")
    groups = dedupe.field_groups(crawl)
    got = {(r.field, r.kind): (r.value, r.urls) for r in groups.collect()}
    assert got["title", "exact"] == (words, ["u0", "u1"]) and got["h1", "exact"] == got["title", "exact"] and ("description", "exact") not in got

    # greedy near groups over what is in no exact group
    rest = [(i, set(v.lower().split())) for i, v in enumerate(values) if v and i not in (0, 1, 3, 4)]
    alike = [(a, b) for (a, x), (b, y) in combinations(rest, 2) if len(x & y) / len(x | y) >= dedupe.NEAR]
    assert alike == [(2, 8)] and got["title", "near"] == (values[2], ["u2", "u8"])
    assert dedupe.group_rows(groups).where("field = 'title'").count() == 4
    assert [r["rank"] for r in dedupe.largest(groups, 1).where("field = 'title'").collect()] == [1]


def test_insights_need_links(spark):
    chain = "array<struct<url:string,status:int,type:string>>"
    crawl = spark.createDataFrame([(0, "http://a/", [("http://a/", 301, "http"), ("http://b/", 301, "http")], 200, None, None, None)], f"ord long, url string, redirect_chain {chain}, status_code int, final_url string, redirected_url string, initial_url string")
    keys = spark.createDataFrame([(0, 0, 200, "")], "key long, ord long, status_code int, robots string")
    edges = spark.createDataFrame([], "src long, dst long, anchor string, pos int, is_internal boolean")
    found = rules.insights(crawl, keys, edges, spark.createDataFrame([], "key long, depth int")).collect()
    assert {r.rule_id for r in found} == {"insight-redirect-chains"}


@pytest.mark.parametrize("word", ["advert", "popup", "dock", "topbar"])
def test_furniture_words(spark, word):
    page = f'<body><p>keep</p><div class="x {word} y"><a href="/z">z</a></div></body>'
    assert spark.range(1).select(html.without_furniture(html.main_content(F.lit(page)))).first()[0].strip() == "<p>keep</p>"


def test_assets_and_graph_keys(spark):
    row = spark.range(1).select(*(urls.is_asset(F.lit(f"http://a/x.{e}")) for e in ("bmp", "7z", "otf", "html")), urls.graph_key(F.lit("http://me@www.a:80/x/#f")), urls.analysis_key(F.lit("http://me@www.a:80/x/#f"))).first()
    assert tuple(row) == (True, True, True, False, "http://me@a/x", "http://a/x")


@pytest.mark.parametrize("master, refused", [("local[4]", False), ("local", False), ("spark://host:7077", True), ("local-cluster[2,1,1024]", True), ("yarn", True)])
def test_no_local_folder_on_a_cluster(master, refused):
    """Executors elsewhere do not see the driver's own folder: without spark.checkpoint.dir a cluster's job stops at once."""
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    session = SimpleNamespace(conf={}, sparkContext=context)
    if refused:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.scratch(session, "x")
        assert not made
    else:
        assert storage.scratch(session, "x").startswith(made[0])
