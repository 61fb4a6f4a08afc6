"""Breadth-first search over edges, and the tree of URL paths."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..plans.storage import stored


def homepage(keys: DataFrame, path: str = "path", site: str | None = None) -> DataFrame:
    """key of the 2xx page with the shortest path, the first of equals; with site, one of each site."""
    length = F.length(F.regexp_replace(path, "/$", ""))
    pages = keys.where("status_code between 200 and 299")
    return pages.groupBy(*([site] if site else [])).agg(F.min_by("key", F.struct(length.alias("length"), F.col("ord").alias("ord"))).alias("key")).where("key is not null").select("key")


#: Levels that are searched one by one before what is left is contracted.
PLAIN_LEVELS = 1


def bfs(edges: DataFrame, roots: DataFrame, most: int | None = None, limit: int | None = None) -> DataFrame:
    """key, depth of what is reached from roots (key) over edges (src, dst).

    The first levels are searched one by one, each a stored table. What is reached by then leaves the graph; of the rest, chains are contracted (`chains`), so that the number of jobs grows with the
    branchings on a path and the logarithm of its length, not with the depth. most: stop after so many levels. limit: stop after the level with which so many are reached; both search level by level.
    """
    # loops go after the distinct: a condition on src and dst would move below the step that makes them, and they would be made twice
    links = stored(edges.select("src", "dst").distinct(), "links").where("src <> dst")
    frontier = stored(roots.select("key", F.lit(0).alias("depth")).distinct(), "level")
    seen, count = frontier, frontier.count() if limit else 0
    for depth in numbers(1) if most is None else range(1, most + 1):
        if most is None and limit is None and depth > PLAIN_LEVELS:
            return seen.unionByName(_beyond(links, seen, frontier))
        found = links.join(frontier.select(F.col("key").alias("src")), "src").select(F.col("dst").alias("key"), F.lit(True).alias("new"))
        new = found.unionByName(seen.select("key", F.lit(False).alias("new"))).groupBy("key").agg(F.min("new").alias("new")).where("new")
        frontier = stored(new.select("key", F.lit(depth).alias("depth")), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 32 == 0:
            seen = stored(seen, "reached")
        if limit and (count := count + frontier.count()) >= limit:
            break
    return seen


def _beyond(links: DataFrame, seen: DataFrame, frontier: DataFrame) -> DataFrame:
    """key, depth of what is reached beyond the frontier (key, depth), through nothing that was seen."""
    arcs = chains(links.join(seen.select(F.col("key").alias("dst")), "dst", "left_anti"), frontier.select("key"))
    branchings = arcs.select(F.col("origin").alias("dst")).distinct()
    between = stored(arcs.join(branchings, "dst").groupBy("origin", "dst").agg(F.min("length").alias("length")), "between")
    known = front = frontier.select("key", F.col("depth").cast("long").alias("depth"))
    for turn in numbers(1):
        found = between.join(front.withColumnRenamed("key", "origin"), "origin").select(F.col("dst").alias("key"), (F.col("depth") + F.col("length")).alias("depth"), F.lit(None).cast("long").alias("best"))
        nearer = found.unionByName(known.select("key", F.lit(None).cast("long").alias("depth"), F.col("depth").alias("best"))).groupBy("key").agg(F.min("depth").alias("depth"), F.min("best").alias("best"))
        front = stored(nearer.where("depth < coalesce(best, depth + 1)").select("key", "depth"), "nearer")
        if front.isEmpty():
            break
        known = known.unionByName(front)
        if turn % 16 == 0:
            known = stored(known.groupBy("key").agg(F.min("depth").alias("depth")), "known")
    best = known.groupBy(F.col("key").alias("origin")).agg(F.min("depth").alias("depth"))
    return arcs.join(best, "origin").groupBy(F.col("dst").alias("key")).agg(F.min(F.col("depth") + F.col("length")).cast("int").alias("depth"))


#: Links that a task looks at together: its memory does not grow with its range.
BLOCK = 1 << 18


def chains(links: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """origin, dst, length: for each link (src, dst) that a shortest path from roots (key) may take, where its chain begins and how many links there are from there to dst.

    A shortest path never turns back, so it comes to the link v -> b from a page that links to v and is not b. If there is one such page, the link before is certain, and the two are one chain; with
    several v is a branching, where chains begin, as they do at the roots; with none the link is on no shortest path and is dropped. So pages of a list, each with links to the page before and after it
    and to its own items, are one chain. The links before are found by jumping: within blocks of a range of src, where neighbours mostly lie, then between them, each round over twice the distance.
    """
    flagged = roots.select(F.col("key").alias("src"), F.lit(True).alias("is_root"))
    arcs = links.join(roots.select(F.col("key").alias("dst")), "dst", "left_anti").join(flagged, "src", "left").select("src", "dst", F.coalesce("is_root", F.lit(False)).alias("is_root"))
    # links that turn back are dropped first: their ends have fewer pages before them then
    arcs = stored(_with_before(arcs).where("branching or before is not null").select("src", "dst", "is_root"), "arcs")
    state = _with_before(arcs).where("branching or before is not null")
    kind = links.schema["src"].dataType.simpleString()
    local = state.select("src", "dst", F.when(~F.col("branching"), F.col("before")).alias("before")).repartitionByRange("src").sortWithinPartitions("src").mapInArrow(lambda batches: _jump_within(batches, block), f"src {kind}, dst {kind}, at {kind}, via {kind}, origin {kind}, length long")
    jumped, most = stored(local, "jumped"), 64
    done, left = jumped.where("at is null"), jumped.where("at is not null")
    for turn in range(64):
        state = done.unionByName(left)
        if turn == 6:
            # a circle of certain links has no beginning and is never reached: it is left when a chain of all links would have ended
            most = state.count().bit_length()
        if turn > most or left.isEmpty():
            break
        there = state.select(F.col("src").alias("at"), F.col("dst").alias("via"), F.col("at").alias("next_at"), F.col("via").alias("next_via"), F.col("origin").alias("next_origin"), F.col("length").alias("more"))
        moved = left.join(there, ["at", "via"]).select("src", "dst", F.col("next_at").alias("at"), F.col("next_via").alias("via"), F.col("next_origin").alias("origin"), (F.col("length") + F.col("more")).alias("length"))
        # only what moved is written; what has come to its origin stays in the table of its round
        moved = stored(moved, "jumped")
        done, left = done.unionByName(moved.where("at is null")), moved.where("at is not null")
    return done.where("origin is not null").select("origin", "dst", "length")


def _with_before(arcs: DataFrame) -> DataFrame:
    """arcs (src, dst, is_root) with before (the one page by which a shortest path comes to src on its way to dst) and branching (there are several, or src is a root)."""
    into = arcs.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("n"), F.min("src").alias("low"), F.max("src").alias("high"))
    n, low, high, dst = F.coalesce("n", F.lit(0)), F.col("low"), F.col("high"), F.col("dst")
    before = F.when((n == 1) & (low != dst), low).when((n == 2) & (low == dst), high).when((n == 2) & (high == dst), low)
    branching = F.col("is_root") | (n > 2) | ((n == 2) & (low != dst) & (high != dst))
    return arcs.join(into, "src", "left").select("src", "dst", "is_root", before.alias("before"), branching.alias("branching"))


def _jump_within(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The links (src, dst, before) of a task in blocks, each with the farthest link before it in its block and the length from there on; or with the origin of its chain."""
    own, n = [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, block):
            own.append(part := whole.slice(at, block))
            n += part.num_rows
            if n >= block:
                yield _jump_block(own)
                own, n = [], 0
    if own:
        yield _jump_block(own)


def _jump_block(own: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(own).combine_chunks()
    src, dst, before = (table.column(c).combine_chunks() for c in ("src", "dst", "before"))
    names = pa.chunked_array([src, dst, before]).unique().drop_null()
    code = lambda c: pc.fill_null(pc.index_in(c, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    s, d, b = code(src), code(dst), code(before)
    key, wanted = s * len(names) + d, b * len(names) + s
    order = np.argsort(key)
    place = np.minimum(np.searchsorted(key[order], wanted), len(key) - 1)
    here = (b >= 0) & (key[order][place] == wanted)
    jump, steps = np.where(here, order[place], np.arange(len(key))), here.astype(np.int64)
    for _ in range(len(key).bit_length()):
        steps, jump = steps + steps[jump], jump[jump]
    open_ = b[jump] >= 0
    pick = lambda c, keep: c.take(pa.array(jump, mask=~keep))
    return pa.RecordBatch.from_arrays([src, dst, pick(before, open_), pick(src, open_), pick(src, ~open_), pa.array(steps + 1)], ["src", "dst", "at", "via", "origin", "length"])


def click_depth(keys: DataFrame, edges: DataFrame, path: str = "path", site: str | None = None) -> DataFrame:
    """key, depth of the crawled pages that clicks from the homepage reach; with site, from the homepage of each site."""
    inside = edges.where("is_internal").join(keys.select(F.col("key").alias("dst")), "dst", "left_semi")
    return bfs(inside, homepage(keys, path, site))


def depth_summary(depths: DataFrame) -> DataFrame:
    return depths.agg(F.count("*").alias("reached"), F.coalesce(F.floor(F.avg("depth") * 10 + 0.5) / 10, F.lit(0.0)).alias("average"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"))


def unreachable(keys: DataFrame, depths: DataFrame) -> DataFrame:
    return keys.where("status_code between 200 and 299").join(depths.select("key"), "key", "left_anti").select("key")


def spider(edges: DataFrame, seed, most: int | None = None) -> DataFrame:
    """key, depth of pages found from a seed; with `most`, so many in the order of depth and key."""
    roots = edges.sparkSession.range(1, numPartitions=1).select(F.lit(seed).cast(edges.schema["src"].dataType).alias("key"))
    found = bfs(edges, roots, limit=most)
    return found if most is None else found.orderBy("depth", "key").limit(most)


def page_links(pages: DataFrame, seed: str) -> DataFrame:
    """src, dst of the links of pages (url, html) that a spider from seed follows: to http pages of its site, fragments off, no assets."""
    found = pages.select(urls.without_fragment(F.col("url")).alias("src"), F.explode(html.hrefs(F.col("html"))).alias("href"))
    absolute = F.when(urls.is_absolute(F.col("href")), F.col("href")).otherwise(urls.join(F.col("src"), F.col("href")))
    links = found.select("src", urls.without_fragment(absolute).alias("dst"))
    dst = F.col("dst")
    return links.where(urls.is_absolute(dst) & urls.protocol(dst).isin("http", "https") & urls.same_site(dst, F.lit(seed)) & ~urls.is_asset(dst)).distinct()


def path_nodes(pages: DataFrame, depth: int = 3) -> DataFrame:
    """id, label, grp, depth, parent, size of every origin and path prefix of pages (url), down to a depth."""
    rows = pages.select(urls.tree_key(F.col("url")).alias("u")).where("u is not null").distinct().select("u", F.concat(urls.protocol(F.col("u")), F.lit("://"), urls.host(F.col("u"))).alias("origin"), urls.host(F.col("u")).alias("host"), urls.segments(F.col("u")).alias("parts"))
    steps = rows.select("*", F.explode(F.sequence(F.lit(0), F.least(F.size("parts"), F.lit(depth)))).alias("depth"))
    prefix = lambda n: F.concat("origin", F.lit("/"), F.array_join(F.slice("parts", F.lit(1), n), "/"))
    d = F.col("depth")
    return steps.select(
        prefix(d).alias("id"),
        F.when(d == 0, F.col("host")).otherwise(F.get("parts", d - 1)).alias("label"),
        F.when(d == 0, F.col("host")).otherwise(F.concat("host", F.lit("/"), F.get("parts", F.lit(0)))).alias("grp"),
        d.alias("depth"),
        F.when(d > 0, prefix(d - 1)).alias("parent"),
        F.when(d == 0, 8).otherwise(F.greatest(F.lit(1), 4 - d)).alias("size"),
    ).distinct()


def path_links(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target")).distinct()


def colours(nodes: DataFrame, palette: int = 12) -> DataFrame:
    """id, colour: groups in the order of their first id, modulo the palette."""
    ranges = nodes.groupBy("grp").agg(F.min("id").alias("first")).repartitionByRange("first").sortWithinPartitions("first")
    ranges = stored(ranges.select("grp", F.spark_partition_id().alias("range"), (F.monotonically_increasing_id() % (1 << 33)).alias("place")), "groups")
    # one row a range: how many groups are in those before
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    groups = ranges.join(F.broadcast(sizes), "range").select("grp", ((F.col("before") + F.col("place")) % palette).cast("int").alias("colour"))
    return nodes.join(groups, "grp").select("id", "colour")
