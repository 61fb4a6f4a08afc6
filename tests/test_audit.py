"""From addresses to scores in one call, over a site that an injected transport serves."""

from tidewater.plans.audit import audit, crawled
from tidewater.sources import pages

BODY = "<html><head><title>{t}</title></head><body><h1>{t}</h1>{links}</body></html>"
SITE = {
    "https://x.example/": (200, "", BODY.format(t="Home", links="<a href='/a'>first</a><a href='/old'>old one</a>")),
    "https://x.example/a": (200, "", BODY.format(t="A page", links="<a href='/b'>second</a>")),
    "https://x.example/b": (200, "", BODY.format(t="A page", links="<a href='https://y.example/'>away</a>")),
    "https://x.example/old": (301, "/older", ""),
    "https://x.example/older": (302, "/a", ""),
    "https://x.example/alone": (200, "", "<script>b.onclick=()=>{location='/no'}; location='/b'</script>"),
}


def send(url, attempt):
    status, location, body = SITE.get(url, (404, "", ""))
    return pages.Answer(status, {"location": location} if location else {}, body)


def test_from_addresses_to_scores(spark):
    addresses = spark.createDataFrame([(i, u) for i, u in enumerate(["https://x.example/", "https://x.example/a", "https://x.example/b", "https://x.example/old", "https://x.example/alone", "https://x.example/gone"])], "ord long, url string")
    found = audit(crawled(pages.follow(addresses, send)))
    rows = {r.url.removeprefix("https://x.example"): r for r in found.pages().collect()}
    assert {k: r.depth for k, r in rows.items()} == {"/": 0, "/a": 1, "/old": 1, "/b": 2, "/alone": None, "/gone": None}
    assert (rows["/old"].status_code, rows["/a"].incoming, rows["/b"].incoming, rows["/gone"].status_code) == (200, 1, 2, 404)  # /old shows /a, which links to /b too
    hits = {(r.url.removeprefix("https://x.example"), r.rule_id) for r in found.hits.collect()}
    assert {("/old", "insight-redirect-chains"), ("/a", "title-duplicate"), ("/b", "title-duplicate"), ("/gone", "status-4xx"), ("/alone", "insight-orphan-pages")} <= hits
    assert {r.key for r in found.unreachable().collect()} == {"https://x.example/alone"}
    scores = {r.category: r.score for r in found.categories().collect()}
    assert len(scores) == 7 and found.overall().head()[0] == int(sum(scores.values()) / 7 + 0.5)
    assert sum(r.urls for r in found.directories().collect()) == 6


def test_an_empty_crawl(spark):
    addresses = spark.createDataFrame([], "ord long, url string")
    found = audit(crawled(pages.follow(addresses, send)))
    assert found.pages().count() == 0 and found.overall().head()[0] == 100
