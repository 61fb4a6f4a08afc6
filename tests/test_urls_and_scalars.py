import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import scalars as sc
from tidewater.functions import urls


def values(spark, rows, **columns):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], ", ".join(f"c{i} string" for i in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return df.select(*(c.alias(k) for k, c in columns.items())).collect()


KEYS = [
    ("HTTP://u:p@WWW.X.Y:80/a/?q=1#f", "http://x.y/a?q=1"),
    ("https://x.y", "https://x.y/"),
    ("https://x.y/", "https://x.y/"),
    ("https://x.y:8080/a//", "https://x.y:8080/a/"),
    ("/relative", "/relative"),
    ("mailto:a@b", "mailto:a@b"),
]


def test_analysis_key(spark):
    got = [r.k for r in values(spark, [a for a, _ in KEYS], k=urls.analysis_key(F.col("c0")))]
    assert got == [b for _, b in KEYS]
    assert [r.k for r in values(spark, got, k=urls.analysis_key(F.col("c0")))][:3] == got[:3]


def test_other_keys(spark):
    r = values(spark, ["https://WWW.x.y/A//?q#f"], crawl=urls.crawl_key(F.col("c0")), tree=urls.tree_key(F.col("c0")), graph=urls.graph_key(F.lit("no url")), label=urls.short_label(F.col("c0")), seg=urls.segment(F.col("c0")))[0]
    assert (r.crawl, r.tree, r.graph, r.label, r.seg) == ("https://www.x.y/A//?q", "https://x.y/A/", None, "/A//", "/A")


def test_sites(spark):
    r = values(spark, [("https://www.a.b:1/x", "http://a.b/y")], same=urls.same_site(F.col("c0"), F.col("c1")), sub=urls.within_domain(F.lit("https://q.a.b/"), "a.b"), no=urls.within_domain(F.lit("https://xa.b/"), "a.b"), asset=urls.is_asset(F.lit("http://x/a.JPG?x=1")))[0]
    assert r.same and r.sub and not r.no and r.asset


@pytest.mark.parametrize(("url", "safe"), [("http://10.0.0.1/", False), ("http://172.20.1.1/", False), ("http://172.32.1.1/", True), ("http://localhost:8/", False), ("http://[::1]/", False), ("http://[fd00::1]/", False), ("ftp://x.y/", False), ("https://x.y/", True), ("http://a.local/", False), ("x.y", False)])
def test_safety(spark, url, safe):
    assert values(spark, [url], ok=urls.is_safe(F.col("c0")))[0].ok is safe


def test_join(spark):
    rows = [("http://a.b/c/d?x", "../e"), ("http://a.b/c", "//X.y/z"), ("http://a.b/c", "?q=1"), ("http://a.b/c", "mailto:x"), ("http://a.b", "f g"), ("http://a.b/", None)]
    assert [r.u for r in values(spark, rows, u=urls.join(F.col("c0"), F.col("c1")))] == ["http://a.b/e", "http://x.y/z", "http://a.b/c?q=1", None, "http://a.b/f%20g", "http://a.b/"]


def test_scalars(spark):
    r = values(
        spark, ["1.25s"],
        n=sc.leading_number(F.col("c0")), none=sc.leading_number(F.lit("skipped")), half=sc.js_round(F.lit(-2.5)), score=sc.equity_score(F.lit(4)), strong=sc.equity_strength(F.lit(5)),
        xml=sc.escape_xml(F.lit("<a&'\">")), csv=sc.csv_if_needed(F.lit('a"b')), plain=sc.csv_if_needed(F.lit("ab")), tsv=sc.tsv_clean(F.lit("a\tb\n")),
        bucket=sc.status_bucket(F.lit(0)), label=sc.status_label(F.lit(0)), five=sc.status_bucket(F.lit(503)), code=sc.hreflang_code(F.lit("EN"), F.lit("gb")), date=sc.http_date(F.lit("Tue, 15 Nov 1994 12:45:26 GMT")),
        wait=sc.retry_after_ms(F.lit("120"), F.current_timestamp()), cut=sc.cut_at_word(F.lit("one two three"), 9), tokens=F.array_join(sc.token_set(F.lit("The naïve  Cat, a cat & Ü1!")), " "), jaccard=sc.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))),
        period=sc.period_label(F.lit("2020-01-05").cast("date"), F.lit(None).cast("date"), F.lit(True)), ago=sc.relative_time(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 05:30:00").cast("timestamp")),
    )[0]
    assert (r.n, r.none, r.half, r.score, r.strong) == (1.25, None, -2, 58, "strong")
    assert (r.xml, r.csv, r.plain, r.tsv) == ("&lt;a&amp;&apos;&quot;&gt;", '"a""b"', "ab", "a b ")
    assert (r.bucket, r.label, r.five, r.code, r.date) == ("blocked", "0xx", "5xx", "en-GB", "1994-11-15T12:45:26.000Z")
    assert (r.wait, r.cut, r.tokens, r.jaccard) == (15000, "one two…", "naïve cat ü1", 0.5)
    assert (r.period, r.ago) == ("January 2020 – Present", "5h ago")
    assert sc.file_stem("https://X.y/a b") == "x.y-a-b"


@settings(max_examples=30, deadline=None)
@given(st.floats(-1e6, 1e6))
def test_rounding_rule(x):
    import math

    assert math.floor(x + 0.5) - x <= 0.5
