"""Fields of pages from the element pass: what tag patterns get wrong, and every extractor's own cases."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.functions import elements as el
from tidewater.sources import pages

URL = "https://www.x.example/a/b.html?q=1"


def first(html, name):
    return next(e for e in el.read(html, URL) if e["name"] == name)


def test_tags():
    page = '<head><title>A</title></head><body><a title="x > y" href=\'/p?a=1&amp;b=2\' REL=nofollow>one</a><!-- <a href="/no">no</a> --><a href=/bare>two<a href="/three">three</a></body>'
    links = [e for e in el.read(page, URL) if e["name"] == "a"]
    assert [(dict(e["attributes"]).get("href"), e["said"], e["closed"], e["address"]) for e in links] == [
        ("/p?a=1&b=2", "one", True, "https://www.x.example/p?a=1&b=2"), ("/bare", "two", True, "https://www.x.example/bare"), ("/three", "three", True, "https://www.x.example/three"),
    ]
    assert page[links[0]["start"] : links[0]["end"]].startswith("<a title") and page[: links[0]["end"]].endswith("one</a>")
    # an end tag ends what was open inside; stray end tags and quotes do no harm
    assert first("<div><h1>a</div></h1>", "h1")["closed"] is False
    assert first('<p a=b">c</p><h1 class=x">d</h1>', "h1")["said"] == "d"
    assert el.read("", URL) == [] and el.read("< a <1> <!-- never closed <h1>x</h1>", URL)[0]["said"] == "x"
    assert len(el.read("<a href=x " * 3000, URL)) == 0
    assert len(el.read("<div>" * 20_000 + "<h2>deep</h2>", URL)) == 1


@pytest.mark.parametrize(
    "page, place",
    [
        ("<nav><a href=/x>x</a></nav>", True), ("<header><ul><li><a href=/x>x</a></ul></header>", True), ("<div class='main menu'><div><a href=/x>x</a></div></div>", True), ("<section id=\"cookie\"><a href=/x>x</a></section>", True),
        ("<div class='menu'><div>a</div></div><a href=/x>x</a>", False), ("<div class='menubar'><a href=/x>x</a></div>", False), ("<p class='menu'><a href=/x>x</a></p>", False), ("<nav><a href=/x>x</a>", False), ("<div class='nav'><aside id='share'>y</aside><a href=/x>x</a></div>", True),
    ],
)
def test_furniture(page, place):
    assert first(page, "a")["furniture"] is place


def test_scripts_hold_no_tags():
    page = "<script>var t='<h1>no</h1><a href=/n>n</a>';</script><style>h1{}</style><svg><title>icon</title></svg><noscript><h1>off</h1></noscript><h1>yes</h1>"
    found = [(e["name"], e["said"], e["hidden"]) for e in el.read(page, URL)]
    assert found == [("script", None, False), ("title", "icon", True), ("h1", "off", True), ("h1", "yes", False)]
    assert first("<script>if (a < b) c()", "script")["closed"] is False


PAGE = """<html><head><title>One &amp; two</title><title>Other</title><meta name=description content=''><meta NAME='Description' content='About &quot;it&quot; &#233;'>
<meta name="robots" content="noindex,  follow"><link rel="canonical" href="https://www.x.example/a/b.html?q=1"><link rel=alternate hreflang=de href="/de"><link rel=alternate href=/no>
<meta property="og:image" content="/i.png"><meta property="OG:image" content="/i.png"><meta name="twitter:image" content="//cdn.example/t.png"><meta property="og:title" content="T"><meta property="og:url" content="c.html">
<script type="application/ld+json">{"b": 1.0, "a": ["x", {}], "c": 1.5}</script><script type='application/ld+json'>[</script></head>
<body><nav><a href="/nav">Nav</a></nav><h1>A<b>B</b></h1><h1> </h1><h2>c &lt; d</h2><img src="a.png" alt=" An  image "><img src="/b.png"><img src="//cdn.example/c.png" alt=''><img src="data:x"><img alt=x>
<a href="d.html" rel="nofollow  UGC">go</a><a href="https://x.example/e">e e</a><a href="http://other.example/">out</a><a href="#top">t</a><a href="mailto:a@b">m</a><a href="/f"> </a><a href="/g"><img src=x alt="Picture"></a></body></html>"""


def test_record(spark):
    df = spark.createDataFrame([(1, URL, PAGE), (2, None, None), (3, "no address", "<a href='x y'>z</a>")], "page_id long, url string, html string")
    rows = {r.ord: r for r in pages.extract(df, links="all").collect()}
    r = rows[1]
    assert (r.title, r.description, r.robots, r.canonical_status) == ("One & two", 'About "it" é', "noindex, follow", "Self Referencing")
    assert (r.h1s, r.h2s, r.h3s) == (["AB"], ["c < d"], [])
    assert [(i.src, i.alt) for i in r.images] == [("https://www.x.example/a/a.png", "An image"), ("https://www.x.example/b.png", None), ("https://cdn.example/c.png", None), ("https://www.x.example/a/x", "Picture")]
    assert r.schemas == ['{\n  "b": 1,\n  "a": [\n    "x",\n    {}\n  ],\n  "c": 1.5\n}', "["]
    assert [(t.href, t.hreflang) for t in r.hreflangs] == [("/de", "de")]
    assert [(t.property, t.content) for t in r.social_tags] == [("og:image", "https://www.x.example/i.png"), ("twitter:image", "https://cdn.example/t.png"), ("og:title", "T"), ("og:url", "https://www.x.example/a/c.html")]
    assert [(x.anchor_text, x.href, x.is_internal, x.nofollow, x.ugc) for x in r.internal_links] == [("Nav", "/nav", True, False, False), ("go", "d.html", True, True, True), ("e e", "https://x.example/e", True, False, False), ("out", "http://other.example/", False, False, False), ("Picture", "/g", True, False, False)]
    assert (rows[2].title, rows[2].internal_links, rows[2].canonical_status) == ("", [], "Missing") and rows[3].internal_links[0].anchor_text == "z"
    main = {r.ord: r for r in pages.extract(df).collect()}[1]
    assert [x.anchor_text for x in main.internal_links] == ["go", "e e", "out", "Picture"]


LONG = "this text describes the thing in full and " * 3


@pytest.mark.parametrize(
    "inner, want",
    [
        ("a <i>b</i>", "a b"), ("<h2>Head</h2><p>text</p>", "Head"), ("<span>Label</span> and more", "Label"), ("<em>x</em>" + "w " * 60, ("x" + "w " * 60)[:100].rsplit(None, 1)[0] + "…"), ("<img alt='Al &amp; Bo'>", "Al & Bo"), ("word " * 30, "word " * 19 + "word…"),
        (f"<h3>Name</h3><p>{LONG}</p>", "Name — " + LONG[:120].rsplit(" ", 1)[0] + "…"), ("<h3>Name®</h3><div>Name is a thing that does a thing for people</div>", "Name® — is a thing that does a thing for people"), ("<h3>Name</h3><p>from $20 and more, inclusive of everything that is</p>", "Name"),
        ("<h3>Name</h3> a tail that is long enough to say what the thing is $20", "Name — a tail that is long enough to say what the thing is"),
    ],
)
def test_link_text(inner, want):
    assert el.link_text(inner) == want


def test_one_python_pass(spark):
    df = spark.createDataFrame([(1, URL, PAGE)], "page_id long, url string, html string")
    plan = pages.extract(df, links="all").drop("schemas")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert pages.extract(df).select(F.size("schemas")).head()[0] == 2


def test_a_batch_is_read_in_slices(spark):
    batch = pa.array(["<h1>a</h1>" + " " * 500_000] * 5 + [None, "<h2>b</h2>" + " " * 3_000_000, ""])
    assert list(el.cuts(batch)) == [(0, 2), (2, 2), (4, 2), (6, 1), (7, 1)] and list(el.cuts(batch[:0])) == []
    slices = list(el.elements.func(iter([(batch, pa.array([URL] * 8))])))
    assert [len(s) for s in slices] == [2, 2, 2, 1, 1]
    rows = spark.createDataFrame([(i, URL, p) for i, p in enumerate(batch.to_pylist())], "i int, u string, p string").coalesce(1)
    got = rows.select("i", F.transform(el.elements(F.col("p"), F.col("u")), lambda x: x["said"]).alias("said")).collect()
    assert {r.i: r.said for r in got} == {0: ["a"], 1: ["a"], 2: ["a"], 3: ["a"], 4: ["a"], 5: [], 6: ["b"], 7: []}
