"""Small cases of extractors and lists whose queries run over whole tables."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import html, urls
from tidewater.operators import dedupe
from tidewater.sources import lists

LONG = "this text describes the thing in full " * 2
CASES = [
    (html.anchor_text, "<h2>A &amp; B</h2><p>x</p>", "A & B"),
    (html.anchor_text, "<div><p>label here</p> more</div>", "label here"),
    (html.anchor_text, '<img alt="picture" src="x">', "picture"),
    (html.anchor_text, "words " * 30, "words " * 15 + "words…"),
    (html.anchor_text, "", ""),
    (html.card_text, f"<h3>Name</h3><p>{LONG}</p>", f"Name — {LONG.strip()}"),
    (html.card_text, "<h3>Name</h3><p>from $20 and more, inclusive of everything that there is</p>", None),
    (html.card_text, "<p>no heading but a text that would be long enough to be one</p>", None),
    (html.script_redirect, "<script>window.location.href='/a'</script>", "/a"),
    (html.script_redirect, "<script>x.onclick=function(){location='/b'}</script>", None),
    (html.script_redirect, '<script>location.replace("/c")</script>', "/c"),
    (html.script_redirect, "<p>location='/d'</p>", None),
    (lambda c: html.meta_refresh(c)["target"], '<meta http-equiv="refresh" content="5;url=/a">', "/a"),
    (lambda c: html.meta_refresh(c)["target"], '<meta http-equiv="refresh" content="6;url=/a">', None),
    (html.description, "<meta content='it''s' name='description'>", "it"),
    (html.sanitise, '<p onclick="x">a<script>b</script><a href="javascript:c" class="d">e</a></p>', '<p>a<a class="d">e</a></p>'),
    (html.sanitise, '<form><table><tr><td colspan="2" style="x">a<sup>2</sup></td></tr></table><hr></form>', '<table><tr><td colspan="2">a<sup>2</sup></td></tr></table><hr>'),
    (html.decode_numbers, "&#233;&#x41;&eacute;", "éA&eacute;"),
    (lambda c: F.array_join(lists.locations(c, "url"), "; "), "<urlset><url><loc><![CDATA[http://a/?x=1&amp;y]]></loc></url><url><lastmod>1</lastmod></url><url><loc> http://b\n</loc></url></urlset>", "http://a/?x=1&y; http://b"),
    (lambda c: F.array_join(lists.declared_sitemaps(c), "; "), "User-agent: *\n sitemap : http://a/1.xml\nSitemap: http://a/2.xml", "http://a/1.xml; http://a/2.xml"),
    (lambda c: urls.is_safe(c).cast("string"), "http://10.1.1.1/", "false"),
    (lambda c: urls.is_safe(c).cast("string"), "https://x.example/", "true"),
    (lambda c: urls.is_safe(c).cast("string"), "http://[::1]/", "false"),
    (lambda c: urls.is_safe(c).cast("string"), "ftp://x.example/", "false"),
]


@pytest.mark.parametrize(("function", "text", "want"), CASES)
def test_case(spark, function, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(function(F.col("c")).alias("x")).first().x == want


def test_lists(spark):
    rows = spark.createDataFrame([(0, " http://a "), (1, "x"), (2, "https://b"), (3, "http://a")], "ord int, value string")
    assert sorted(r.url for r in lists.from_text(rows).collect()) == ["http://a", "https://b"]
    rows = spark.createDataFrame([(0, "x,http://a,http://b"), (1, "y"), (2, '"http://c",1')], "ord int, value string")
    assert sorted(r.url for r in lists.from_rows(rows).collect()) == ["http://a", "http://c"]


def test_near_pairs_meet_in_blocks_of_any_size(spark):
    """A word that many sets share is dealt to several blocks; the pairs are the same, and those of brute force."""
    sets = {k: {"shared", *(f"w{k // 6}-{j}" for j in range(9)), *([f"own{k}"] if k % 2 else [])} for k in range(30)}
    items = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "ord long, tokens array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want
    for block in (1, 4, 1000):
        assert {(r.a, r.b) for r in dedupe.near_pairs(items, 0.8, block).collect()} == want
