"""One case a row: what an extractor takes from a snippet."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import html as h


def one(spark, expression, *values, names=("c",)):
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("page", "title"),
    [
        ("<head><!-- <title>old</title> --><title> A  &amp;lt; B </title></head>", "A < B"),
        ("<svg><title>icon</title></svg><body><title>late</title></body>", "late"),
        ("<head><TITLE lang='en'>x\ny</TITLE></head>", "x y"),
        ("<p>none</p>", ""),
        (None, ""),
    ],
)
def test_title(spark, page, title):
    assert one(spark, h.title(F.col("c")), page) == title


def test_description_skips_empty_and_commented_tags(spark):
    page = '<!-- <meta name="description" content="no"> --><meta name="description" content=""><meta content=\'it&#39;s  me\' name=description>'
    assert one(spark, h.description(F.col("c")), page) == "it's me"
    assert one(spark, h.robots(F.col("c")), '<meta name="ROBOTS" content="noindex">') == "noindex"


def test_headings(spark):
    page = "<h1>One <b>two</b></h1><!--<h1>no</h1>--><h1> </h1><h1>" + "x" * 300 + "</h1>"
    assert one(spark, h.headings(F.col("c"), "h1"), page) == ["One two", "x" * 200]


def test_structured_data(spark):
    assert one(spark, h.json_ld(F.col("c")), '<!--<script type="application/ld+json">{"@type":"A"}</script>--><script type="application/ld+json"> </script>') == ['{"@type":"A"}']
    for text, label in (('{"@type":"A"}', "A"), ('{"@type":["A","B"]}', "A, B"), ('{"@graph":[{"@type":"A"},{"x":1},{"@type":["B","C"]}]}', "A + B, C"), ('[{"@type":"A"},{"@type":"B"}]', "A + B"), ('{"x":1}', "Schema"), ("{x", "Raw")):
        assert one(spark, h.schema_label(F.col("c")), text) == label


def test_canonical(spark):
    assert one(spark, h.canonical(F.col("c")), '<!-- <link rel="canonical" href="/c"> --><link rel="canonical" href="/d">') == "/c"
    status = h.canonical_status(F.col("a"), F.col("b"))
    for a, b, want in (("http://x.y/a/", "http://x.y/a", "Self Referencing"), ("http://x.y", "http://x.y/", "Self Referencing"), ("http://www.x.y/a", "http://x.y/a", "Canonicalised"), ("http://x.y/a", "/a", "Canonicalised"), ("http://x.y/a", "", "Missing"), ("http://x.y/a", None, "Missing")):
        assert one(spark, status, a, b, names=("a", "b")) == want


def test_alternates_images_and_social(spark):
    assert [tuple(x) for x in one(spark, h.hreflangs(F.col("c")), '<link rel="alternate" hreflang="de" href="/de"><link rel=alternate href="/x"><link rel="alternate" hreflang="x-default" href="/">')] == [("/de", "de"), ("/", "x-default")]
    assert [tuple(x) for x in one(spark, h.images(F.col("c")), '<img data-src="lazy.png" src="a.png" alt=""><img src="data:x"><img alt="b &amp; c" src=b.png>')] == [("lazy.png", None), ("b.png", "b & c")]
    page = '<head><meta property="OG:Title" content="T"><meta name="twitter:card" content="s"><meta property="og:title" content="T"><meta property="og:x" content=""></head>'
    assert [tuple(x) for x in one(spark, h.social_tags(F.col("c")), page)] == [("og", "og:title", "T"), ("twitter", "twitter:card", "s")]
    assert one(spark, h.social_map(F.col("c")), page.replace("</head>", '<meta property="og:title" content="U"></head>')) == {"og:title": "U", "twitter:card": "s"}


def test_main_content(spark):
    page = '<body><nav><a href="/n">n</a></nav><div class="x sidebar"><div>in</div>more</div><p>keep</p><footer>f</footer><div id="menu">m</div></body>'
    assert one(spark, h.without_furniture(h.main_content(F.col("c"))), page).split() == ["<p>keep</p>"]


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<h3>Head &amp; more</h3><p>para</p>", "Head & more"),
        ("<div><span>label</span> tail</div>", "label"),
        ('<img src="a" alt="picture">', "picture"),
        ("plain text", "plain text"),
        ("word " * 40, ("word " * 20).strip() + "…"),
        ("<h3>Name</h3><p>" + "A long description of the thing here. " * 2 + "</p>", "Name — " + ("A long description of the thing here. " * 2).strip()),
        ("<h3>Name</h3><p>Save 20 off MRP with this very long text about it</p>", "Name"),
    ],
)
def test_link_text(spark, inner, text):
    assert one(spark, h.link_text(F.col("c")), inner) == text


def test_generic_links(spark):
    assert one(spark, h.is_generic(F.col("c")), " Read More ") and not one(spark, h.is_generic(F.col("c")), "Read more books")


def test_anchors_and_hrefs(spark):
    page = "<a href=\"/a\" rel='NoFollow ugc'>x</a><a href='#t'>y</a><a href=mailto:z>z</a><!--<a href='/c'>c</a>--><a href=/b>b</a>"
    assert [(x.href, x.rel) for x in one(spark, h.anchors(F.col("c")), page)] == [("/a", "nofollow ugc"), ("/c", ""), ("/b", "")]
    assert one(spark, h.hrefs(F.col("c")), page) == ["/a", "#t", "/b"]


@pytest.mark.parametrize(("content", "target"), [("5; url=/a", "/a"), ("6; url=/a", None), ("0;URL='http://x/y'", "http://x/y"), ("3", None), ("soon; url=/a", None)])
def test_meta_refresh(spark, content, target):
    page = f'<head><meta http-equiv="Refresh" content="{content}"></head>'
    assert one(spark, h.meta_refresh(F.col("c"))["target"], page) == target


@pytest.mark.parametrize(
    ("script", "target"),
    [
        ("window.location.href = '/a';", "/a"),
        ("location.replace(\"/b\")", "/b"),
        ("// location = '/no'\n/* location = '/no' */ document.location='/c'", "/c"),
        ("b.addEventListener('click', function () { if (x) { location = '/no'; } });", None),
        ("b.onclick = () => { location = '/no' }; location = '/d'", "/d"),
        ("location = `/x/${id}`", None),
        ("location = '#top'; location.href='javascript:void(0)'", None),
        ("if (location == '/x') {}", None),
        ("s = '}'; location.assign('/e')", "/e"),
    ],
)
def test_script_redirect(spark, script, target):
    assert one(spark, h.script_redirect(F.col("c")), f"<script src='x'></script><script>{script}</script>") == target


def test_entities(spark):
    assert one(spark, h.decode(F.col("c")), "&amp;lt;&nbsp;&#39;") == "<&nbsp;'"
    assert one(spark, h.decode_numbers(F.col("c")), "&#233;&#x41;&#65601;&eacute;") == "éAA&eacute;"
