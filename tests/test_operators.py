"""Operators on small rows, where the tables have no such cases."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.operators import dedupe, filters, generators, graph, links, merge, redirects, robots, rules
from tidewater.operators.filters import Condition
from tidewater.plans import fixtures as fx
from tidewater.plans.queries import QUERIES
from tidewater.sources import lists, pages


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_filter_tree(spark):
    fields = {"a": F.col("a")}
    rows = df(spark, [(1, "Alpha"), (2, None), (3, "beta")], "ord int, a string")
    take = lambda groups: sorted(r.ord for r in filters.apply(rows, groups, "", fields).collect())
    assert take([[Condition("a", "contains", "ALPH")]]) == [1]
    assert take([[Condition("a", "not_contains", "alph")]]) == [2, 3]
    assert take([[Condition("a", "regex", "(")]]) == [] and take([[Condition("a", "not_regex", "(")]]) == [1, 2, 3]
    assert take([[Condition("a", "equals", " ")], []]) == [1, 2, 3]
    assert take([[Condition("b", "equals", "x")], [Condition("a", "equals", "BETA")]]) == [3]
    assert sorted(r.ord for r in filters.apply(rows, [], " eta", fields).collect()) == [3]


def test_link_edges_and_equity(spark):
    crawl = df(spark, [(0, "http://x.y/", [("Home", "/a/", True, "", False, False, False), ("go", "http://www.x.y/a#t", True, "", False, False, False), ("out", "http://z/", False, "", False, False, False)]), (1, "http://x.y/a", [("me", "/a", True, "", False, False, False)])], "ord long, url string, internal_links array<struct<anchor_text:string,href:string,is_internal:boolean,rel:string,nofollow:boolean,sponsored:boolean,ugc:boolean>>")
    e = links.edges(crawl)
    keys = crawl.withColumn("key", F.col("url")).withColumn("status_code", F.lit(200)).withColumn("robots", F.lit("")).withColumn("path", F.lit("/"))
    got = {r.key: r for r in links.equity(keys, e).collect()}
    assert (got["http://x.y/a"].incoming, got["http://x.y/a"].unique_anchors, got["http://x.y/a"].top_anchor) == (3, 3, "home")
    assert (got["http://x.y/"].incoming, got["http://x.y/"].outgoing, got["http://x.y/"].strength) == (0, 2, "orphan")
    g = links.graph_edges(e).collect()
    assert [(r.src, r.dst, r.links, r.anchors) for r in g] == [("http://x.y/", "http://x.y/a", 2, "Home | go")]
    assert [r.missing_rel for r in links.audit(e).where("not is_internal").collect()] == [True]


def test_breadth_first_search(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    want, level, depth = {0: 0}, {0}, 0
    while level:
        depth += 1
        level = {b for a, b in pairs if a in level and b not in want}
        want |= dict.fromkeys(level, depth)
    got = graph.bfs(df(spark, pairs, "src long, dst long"), df(spark, [(0,)], "key long")).collect()
    assert {r.key: r.depth for r in got} == want and len(got) == len(want)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(120):
        base = rows[rng.randrange(len(rows))][1].split() if rows and rng.random() < 0.6 else rng.sample(words, rng.randrange(4, 14))
        own = list(base)
        if rng.random() < 0.8:
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    items = dedupe.near_candidates(df(spark, rows, "ord long, text string"), F.col("text"))
    sets = {r.ord: frozenset(r.tokens) for r in items.collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])
    assert {(r.a, r.b) for r in dedupe.near_pairs(items).collect()} == {(a, b) for a in sets for b in sets if a < b and alike(a, b)}
    leaders, want = [], {}
    for i in sorted(sets):
        lead = next((x for x in leaders if alike(x, i)), None)
        if lead is None:
            leaders.append(i)
        else:
            want[i] = lead
    got = {r.ord: r.leader for r in dedupe.near_groups(items).collect()}
    assert got == want | {x: x for x in want.values()}


def test_robots(spark):
    text = "Disallow: /early\nUser-agent: a\nUser-agent: *\nDisallow:\nAllow:\nDisallow: /x*y$\nCrawl-delay: 1.5\nUser-agent: *\nDisallow: /all\nAllow: /all/ok\nFoo: 1\nbad line # c\nSitemap: http://s/1\n"
    parsed = robots.parse(df(spark, [("s", text), ("e", None)], "source string, content string"))
    rows = parsed.collect()
    assert sorted((r.kind, r.line) for r in rows if r.kind in ("warning", "sitemap", "crawl-delay")) == [("crawl-delay", 7), ("sitemap", 13), ("warning", 1), ("warning", 11), ("warning", 12)]
    cases = [("s", "http://h/all/x", "zz", False), ("s", "http://h/all/ok", "zz", True), ("s", "http://h/x1y", "my A bot", False), ("s", "http://h/x1yz", "A", True), ("s", "http://h/all", "a", True), ("e", "http://h/all", "a", True), ("s", "no url", "zz", True)]
    got = robots.match(parsed, df(spark, [c[:3] for c in cases], "source string, url string, agent string")).collect()
    assert {(r.source, r.url, r.agent): r.allowed for r in got} == {c[:3]: c[3] for c in cases}
    assert robots.bots(spark).count() == 37


def test_robots_patterns(spark):
    for path in ("/a*b", "/a.b$", "/", "", "/x?y=(1)[2]{3}", "*.pdf$"):
        own = path or "/"
        end = own.endswith("$")
        want = "^" + re.escape(own[:-1] if end else own).replace(r"\*", ".*") + ("$" if end else "")
        made = df(spark, [(path,)], "p string").select(robots.pattern(F.col("p")).alias("x")).first().x
        for probe in ("/a1b", "/a.b", "/a.bc", "/axb", "/x?y=(1)[2]{3}", "/q.pdf", "/q.pdf?1", "/"):
            assert bool(re.match(made, probe)) == bool(re.match(want, probe)), (path, probe)


def test_redirects(spark):
    chain = lambda *hops: [(u, s, t) for u, s, t in hops]
    rows = [
        (0, "http://x/a", 200, chain(("http://x/a", 301, "http")), "http://x/b", "http", False),
        (1, "http://x/a", 200, chain(("http://x/a", 301, "http"), ("http://x/b", 200, "meta-refresh")), "http://x/c", "mixed", False),
        (2, "http://x/a", 0, chain(("http://x/a", 0, "http")), "http://x/a", "none", True),
        (3, "http://x/a", 404, chain(("http://x/a", 301, "http"), ("http://www.x/a/", 301, "http")), "http://x/z", "http", True),
    ]
    crawl = df(spark, [(*r[:4], r[4]) for r in rows], "ord long, url string, status_code int, redirect_chain array<struct<url:string,status:int,type:string>>, final_url string").withColumn("initial_url", F.lit(None).cast("string")).withColumn("redirected_url", F.lit(None).cast("string"))
    got = {r.ord: r for r in redirects.chains(crawl).collect()}
    assert [(got[r[0]].kind, got[r[0]].is_loop) for r in rows] == [r[5:] for r in rows] and got[3].ends_in_error


def test_walk(spark):
    hops = df(spark, [(1, 2), (2, 3), (10, 11), (11, 10), *[(100 + i, 101 + i) for i in range(20)]], "src long, dst long")
    got = {r.key: (r.hop_count, r.final_key, r.ended) for r in redirects.walk(df(spark, [(1,), (5,), (10,), (100,)], "key long"), hops).collect()}
    assert got == {1: (2, 3, "end"), 5: (0, 5, "end"), 10: (2, 10, "loop"), 100: (10, 110, "most")}


def test_next_hop(spark):
    rows = [(301, "/a", None, ""), (200, None, "0; url=/b", ""), (200, None, None, '<meta http-equiv="refresh" content="0;url=/c">'), (200, None, None, "<script>location='/d'</script>"), (301, None, None, "")]
    got = df(spark, rows, "s int, l string, r string, p string").select(redirects.next_hop(F.col("s"), F.col("l"), F.col("r"), F.col("p")).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in got] == [("http", "/a"), ("meta-refresh", "/b"), ("meta-refresh", "/c"), ("javascript", "/d"), None]


def test_overlay_and_unseen(spark):
    old = df(spark, [(0, "u", "a", "x"), (1, "v", "b", "y")], "ord int, url string, title string, robots string")
    fresh = df(spark, [(0, "u", "c", "z"), (1, "u", None, "q"), (2, "w", "d", "r")], "ord int, url string, title string, robots string")
    assert [tuple(r) for r in merge.overlay(old, fresh, ["title"]).orderBy("ord").collect()] == [(0, "u", None, "x"), (1, "v", "b", "y")]
    batch = df(spark, [(0, "http://x/a/"), (1, "http://x/a"), (2, "http://x/b"), (3, "http://x/c")], "ord int, url string")
    seen = df(spark, [("http://x/q", "http://X/b#f"), ("http://x/c/", None)], "url string, final_url string")
    assert [r.ord for r in merge.unseen(batch, seen).collect()] == [0]


def test_nested(spark):
    rows = merge.nested(df(spark, [(1,), (2,)], "id int"), df(spark, [(1, 2, "b"), (1, 1, "a")], "parent int, ord int, text string"), "id", "parent", "ord", "items").orderBy("id").collect()
    assert [[i.text for i in r["items"]] for r in rows] == [["a", "b"], []]


def test_lists(spark):
    text = df(spark, [(0, " http://a "), (1, "x"), (2, "https://b"), (3, "http://a")], "ord int, value string")
    assert [r.url for r in lists.from_text(text).collect()] == ["http://a", "https://b"]
    rows = df(spark, [(0, 'x,"http://a",http://b'), (1, "y"), (2, "http://a,z")], "ord int, value string")
    assert [r.url for r in lists.from_rows(rows).collect()] == ["http://a"]


def test_sitemaps(spark):
    files = [("http://s/i.xml", "<sitemapindex><sitemap><loc>http://s/1.xml</loc></sitemap><sitemap><loc>http://s/i.xml</loc></sitemap></sitemapindex>"), ("http://s/1.xml", "<urlset><url><loc><![CDATA[http://a.s/x?a=1&amp;b=2]]></loc><loc>http://s/second</loc></url><url><loc> http://s/\n y </loc></url><url><loc>http://other/</loc></url></urlset>")]
    got = lists.sitemap(df(spark, files, "url string, xml string"), ["http://s/i.xml"], "s")
    assert [r.url for r in got.collect()] == ["http://a.s/x?a=1&b=2", "http://s/y"]
    assert df(spark, [files[1]], "url string, xml string").select(F.size(lists.all_locations(F.col("xml"))).alias("n")).first().n == 4
    assert df(spark, [("a\n Sitemap: http://s/q.xml\n",)], "c string").select(lists.sitemap_candidates(F.lit("http://s"), F.col("c")).alias("x")).first().x[:2] == ["http://s/q.xml", "http://s/sitemap_index.xml"]


def test_checks_and_blocks(spark):
    entries = df(spark, [("u", "t" * 61, "", "/rel", None, None, None, None)], "url string, og_title string, og_description string, og_image string, twitter_title string, twitter_description string, twitter_image string, card string")
    assert {r.warning for r in generators.social_warnings(entries).collect()} == {"og:title is over 60 characters", "og:description is missing", "og:image is no absolute address"}
    clusters = df(spark, [(1, "http://c/", None, [("en", "gb", "http://a/"), ("EN", "GB", "b")]), (2, "", "x", [])], "cluster int, canonical string, x_default string, alternates array<struct<language:string,country:string,href:string>>")
    got = generators.hreflang_warnings(clusters).collect()
    assert {r.warning for r in got if r.cluster == 1} == {"a code is there twice", "an alternate is no absolute address"}
    assert {r.warning for r in got if r.cluster == 2} == {"canonical is missing", "fewer than two alternates", "x-default is no absolute address"}
    block = clusters.where("cluster = 1").select(generators.hreflang_block().alias("x")).first().x
    assert block.splitlines()[0] == '<link rel="alternate" hreflang="en-GB" href="http://a/" />'
    made = df(spark, [('a"<', "")], "t string, d string").select(generators.social_block({"og:title": F.col("t"), "og:description": F.col("d"), "twitter:title": F.col("t")}).alias("x")).first().x
    assert made == '<meta property="og:title" content="a&quot;&lt;" />\n<meta name="twitter:title" content="a&quot;&lt;" />'


def test_exports(spark, sf_dir):
    crawl = fx.crawl(spark, sf_dir)
    assert generators.meta_rows(crawl, {"title", "h1"}).columns == ["url", "title", "h1s", "h1s_count", "status", "status_code", "fetch_time"]
    assert generators.nested_rows(crawl, "hreflangs", "none").columns == ["url", "href", "hreflang"]
    assert generators.nested_rows(crawl, "schemas", "none").where("value = 'none'").count() > 0
    assert generators.preview(crawl).count() == crawl.count()
    line = generators.csv_lines(crawl.select("url", "title", "status_code").orderBy("ord").limit(1)).first().line
    assert line.startswith('"http') and line.endswith(",200")
    nodes, edges = links.graph_nodes(fx.keys(spark, sf_dir), links.graph_edges(fx.edges(spark, sf_dir))), links.graph_edges(fx.edges(spark, sf_dir))
    assert '"nodes":' in generators.graph_json(nodes, edges, [F.desc("in_degree"), "key"], 5).first().graph


def test_fetch_with_a_transport(spark):
    calls = []

    def send(url, attempt):
        calls.append((url, attempt))
        return pages.Answer(503 if attempt < 3 else 200, {"retry-after": "7"} if attempt == 1 else {}, "<html>")

    waits = []
    answer, tries = pages.fetch_one("u", send, waits.append)
    assert (answer.status, tries, waits) == (200, 3, [7.0, 3.0])
    blocked = pages.fetch_one("u", lambda u, a: pages.Answer(403, {"cf-mitigated": "challenge"}, ""), waits.append)
    assert blocked[1] == 1

    def failing(url, attempt):
        raise OSError

    assert pages.fetch_one("u", failing, lambda s: None) == (None, 4)
    got = pages.fetch(df(spark, [(0, "https://x.y/a"), (1, "http://127.0.0.1/"), (2, "https://x.y/b")], "ord long, url string"), lambda u, a: pages.Answer(404 if u.endswith("b") else 200, {"content-type": "text/html"}, "<p>")).orderBy("ord").collect()
    assert [(r.ord, r.status, r.status_code, r.html) for r in got] == [(0, "OK", 200, "<p>"), (2, "Error", 404, "")]


def test_rules_by_flag(spark, sf_dir):
    found = rules.hits(fx.crawl(spark, sf_dir), {"title"})
    assert {r.rule_id for r in found.collect()} <= {r.id for r in rules.RULES if r.flag in ("title", "")}
    scored = {r.category: r.audited for r in rules.categories(rules.prioritised(found, 50), {"title"}).collect()}
    assert scored["On-page Meta"] and not scored["Headings"] and scored["Indexability"]


def test_streams(spark, tmp_path):
    from tidewater.streaming import crawl as stream

    rows = [(0, "http://x/a", None), (1, "http://x/b", "http://x/c")], [(2, "http://x/a/", None), (3, "http://x/c", None), (4, "http://x/d", None)]
    schema, table = "ord int, url string, final_url string", str(tmp_path / "table")
    for k, part in enumerate(rows):
        df(spark, list(part), schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream.append_unseen(spark.readStream.schema(schema).json(str(tmp_path / "in")), table, str(tmp_path / "mark")).awaitTermination()
        assert sorted(r.ord for r in spark.read.parquet(table).collect()) == [[0, 1], [0, 1, 4]][k]


@pytest.mark.parametrize("depth", [1, 3])
def test_path_tree(spark, depth):
    nodes = graph.path_nodes(df(spark, [("https://www.x.y/a/b/c/d",), ("https://x.y/a/",), ("no",)], "url string"), depth)
    ids = {r.id: r for r in nodes.collect()}
    assert len(ids) == depth + 1 and ids["https://x.y/"].size == 8 and ids["https://x.y/a"].parent == "https://x.y/"
    assert graph.path_links(nodes).count() == depth and graph.colours(nodes).count() == depth + 1


def test_click_depth_of_a_long_chain(spark):
    n = 104
    keys = df(spark, [(i, i, 200, f"/{'x' * i}") for i in range(n)], "key long, ord long, status_code int, path string")
    edges = df(spark, [(i, i + 1, True) for i in range(n - 1)], "src long, dst long, is_internal boolean")
    depths = graph.click_depth(keys, edges)
    assert {r.key: r.depth for r in depths.collect()} == {i: i for i in range(n)}
    assert graph.unreachable(keys, depths).count() == 0


def test_spider_and_sitemap_keep_every_page(spark):
    n = 50_010
    edges = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert graph.spider(edges, 0).count() == n + 1 and graph.spider(edges, 0, 7).count() == 7
    listed = spark.range(n).select(F.col("id").cast("string").alias("url"))
    assert lists.with_sitemap(listed.limit(5), listed).count() == n and lists.with_sitemap(listed.limit(5), listed, 7).count() == 7


def test_repeated_addresses_have_each_alternate_once_a_row(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://a/", "y"), (3, None, "z")]
    df(spark, rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in QUERIES["hreflang_bulk"](spark, str(tmp_path)).select("page_id", "code").collect())
    assert got == [(i, c) for i in (1, 2, 3) for c in ("de", "en-GB")]
    shared = df(spark, [("de", "", "h")], "language string, country string, href string")
    assert [tuple(r) for r in generators.hreflang_bulk(df(spark, [("u", 1)], "url string, other int"), shared).collect()] == [("u", 1, "de", "h")]


@pytest.mark.parametrize("side", [500, 3])
def test_pairs_of_near_copies_are_compared_in_cells(spark, side):
    rng = random.Random(side)
    sets = [(i, rng.sample(range(i // 20 * 40, i // 20 * 40 + 40), 30)) for i in range(60)] + [(7, list(range(40)))]
    items = df(spark, sets, "ord long, tokens array<long>")
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.3]
    got = sorted(tuple(r) for r in dedupe._compared(df(spark, pairs, "a long, b long"), items, side).collect())
    assert got == sorted((a, b, len(x), len(y), len(set(x) & set(y))) for a, b in pairs for o, x in sets if o == a for p, y in sets if p == b)


def test_a_dense_cell_is_compared_by_slices():
    n = 400
    sets = pa.table({"ord": pa.array(range(n)), "tokens": pa.array([[i, n + i % 7, 2 * n] for i in range(n)])})
    a, b = np.triu_indices(n, 1)
    tracemalloc.start()
    got = dedupe._common(pa.table({"a": a, "b": b}), sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == len(a) and got.column("both").to_pylist() == (1 + (a % 7 == b % 7)).tolist()
    assert peak < 8 << 20  # as many tuples as there are pairs took over 12 MB


def test_slices_of_pairs_keep_sets_of_one_ord_and_pairs_without_any():
    sets = pa.table({"ord": pa.array([1, 2, 2, 3]), "tokens": pa.array([[1, 2], [2], [3], [1, 3]])})
    pairs = pa.table({"a": pa.array([1, 1, 2]), "b": pa.array([3, 2, 9])})
    whole, sliced = (sorted(zip(*dedupe._common(pairs, sets, n).to_pydict().values(), strict=True)) for n in (100, 1))
    assert whole == sliced == [(1, 2, 2, 1, 0), (1, 2, 2, 1, 1), (1, 3, 2, 2, 1)]
    assert dedupe._common(pairs.slice(0, 0), sets).num_rows == 0


def test_pairs_whose_outlines_tell_them_apart_are_not_compared(spark, monkeypatch):
    """Sets that share a rare word and little else are candidates; before, both were shuffled whole for each of them."""
    rng = random.Random(5)
    sets = {i: {f"rare{i // 10}", *rng.sample([f"w{j}" for j in range(600)], rng.choice([30, 100, 140, 300]))} for i in range(60)}
    for i in range(0, 60, 7):  # and some that are near, of sizes on both sides of an outline's length
        sets[100 + i] = {*list(sets[i])[3:], "other"}
    sets[200] = {f"v{j}" for j in range(125)}
    sets[201] = sets[200] | {f"u{j}" for j in range(10)}
    seen = []
    compared = dedupe._compared
    monkeypatch.setattr(dedupe, "_compared", lambda pairs, items: seen.append(pairs.count()) or compared(pairs, items))
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])
    want = {(a, b) for a in sets for b in sets if a < b and alike(a, b)}
    items = df(spark, [(k, sorted(v)) for k, v in sets.items()], "ord long, tokens array<string>")
    assert {(r.a, r.b) for r in dedupe.near_pairs(items).collect()} == want and (200, 201) in want
    assert len(want) <= seen[0] <= len(want) + 9


def test_rounds_of_leaders_read_the_pairs_of_undecided_items_alone(spark, monkeypatch):
    """A chain (each item is like the next) takes a round for each leader; before, each round read every pair."""
    n, read = 12, []
    pairs = df(spark, [(i, i + 1) for i in range(n)] + [(100, 101), (100, 102), (101, 102)], "a long, b long")
    monkeypatch.setattr(dedupe, "near_pairs", lambda *_: pairs)
    monkeypatch.setattr(dedupe, "ROUNDS", 3)
    store = dedupe.stored
    monkeypatch.setattr(dedupe, "stored", lambda d, name: (t := store(d, name), read.append((name, t.count())))[0])
    got = {r.ord: r.leader for r in dedupe.near_groups(None).collect()}
    assert got == {i: i - i % 2 for i in range(n)} | {100: 100, 101: 100, 102: 100}
    left = [c for name, c in read if name == "rest"]
    assert left == sorted(left, reverse=True) and left[0] == n - 2 and left[-1] == 0


def test_near_candidates_are_not_written_with_their_texts(spark, monkeypatch):
    """Before, texts and their tokens were a table of more than twice the input."""
    monkeypatch.setattr(dedupe, "stored", lambda d, name: pytest.fail(name))
    rows = [(1, "one two three four five"), (2, "One two three four  five"), (3, "one two three four six"), (4, "too short"), (5, None), (6, " ")]
    assert [r.ord for r in dedupe.near_candidates(df(spark, rows, "ord long, text string"), F.col("text")).collect()] == [3]
