"""Redirect chains: their kind, loops and ends, from a chain column or from a table of hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..plans.storage import counted, stored

MOST_HOPS = 10


def kind(chain: Column) -> Column:
    """none, http, meta-refresh, javascript, or mixed for several."""
    has = lambda t: F.exists(chain, lambda h: (h["type"] == t) & (h["status"].between(300, 399) if t == "http" else F.lit(True)))
    names = F.array_compact(F.array(*(F.when(has(t), F.lit(t)) for t in ("http", "meta-refresh", "javascript"))))
    return F.when(F.size(names) > 1, "mixed").when(F.size(names) == 1, F.get(names, F.lit(0))).otherwise("none")


def chains(crawl: DataFrame) -> DataFrame:
    """ord, key, url, hop_count, is_loop, ends_in_error, final_url, final_status, kind of the pages with a chain."""
    keys = F.transform("redirect_chain", lambda h: urls.analysis_key(h["url"]))
    final = F.coalesce("final_url", "redirected_url", F.try_element_at("redirect_chain", F.lit(-1))["url"], "url")
    loop = (F.size(F.array_distinct(keys)) < F.size(keys)) | (urls.analysis_key(final) == urls.analysis_key(F.col("url")))
    rows = crawl.where(F.size(F.coalesce("redirect_chain", F.array())) > 0)
    return rows.select("ord", urls.analysis_key(F.col("url")).alias("key"), F.coalesce("initial_url", "url").alias("url"), F.size("redirect_chain").alias("hop_count"), loop.alias("is_loop"), (F.col("status_code") >= 400).alias("ends_in_error"), final.alias("final_url"), F.col("status_code").alias("final_status"), kind(F.col("redirect_chain")).alias("kind"))


def resolve(hops: DataFrame) -> DataFrame:
    """key, length, final_key, circle of every key that hops (src, dst) lead on from, however long the way.

    Where the way ends: its length and last key, circle 0. Where it runs into a circle: the length up to the first key of the circle, that key, and the number of keys on the circle. Jumps double in
    length, so the jobs grow with the logarithm of the longest way; a key keeps where it has come to, not its path.
    """
    links = stored(hops.groupBy(F.col("src").alias("key")).agg(F.min("dst").alias("dst")), "hops")  # of several hops the least
    ways = _jumped(links)
    # who has not come to an end after as many hops as there are keys is on a circle
    on_circle = ways.where("not ended").select("at").distinct()
    if on_circle.isEmpty():
        return ways.select("key", "length", F.col("at").alias("final_key"), F.lit(0).cast("long").alias("circle"))
    on_circle = stored(on_circle, "circles")
    # the least key within so many hops of a key on a circle is the least of its circle
    circles = on_circle.join(ways.select(F.col("key").alias("at"), F.col("low").alias("name")), "at").select("at", "name")
    size = circles.groupBy("name").agg(F.count("*").alias("circle"))
    members = stored(circles.join(size, "name").select("at", "circle"), "circles")
    # ways into a circle end at its first key
    into = _jumped(links.join(ways.where("not ended").select("key"), "key").join(members.select(F.col("at").alias("key")), "key", "left_anti"))
    ended = ways.where("ended").select("key", "length", F.col("at").alias("final_key"), F.lit(0).cast("long").alias("circle"))
    leading = into.join(members, "at").select("key", "length", F.col("at").alias("final_key"), "circle")
    return ended.unionByName(leading).unionByName(members.select(F.col("at").alias("key"), F.lit(0).cast("long").alias("length"), F.col("at").alias("final_key"), "circle"))


def _jumped(links: DataFrame) -> DataFrame:
    """key, at, length, low, ended: how far links (key, dst) lead from a key, the least key met before `at`; not ended if that was still on its way after as many hops as there are keys."""
    ends = links.select(F.col("key").alias("dst"), F.lit(True).alias("goes_on"))
    state = links.join(ends, "dst", "left").select("key", F.col("dst").alias("at"), F.lit(1).cast("long").alias("length"), F.col("key").alias("low"), F.col("goes_on").isNull().alias("ended"))
    state, count = counted(state, "jumps")
    for _ in range(count.bit_length()):
        left = state.where("not ended")
        if left.isEmpty():
            break
        there = state.select(F.col("key").alias("at"), F.col("at").alias("next"), F.col("length").alias("more"), F.col("low").alias("other"), F.col("ended").alias("end"))
        moved = left.join(there, "at").select("key", F.col("next").alias("at"), (F.col("length") + F.col("more")).alias("length"), F.least("low", "other").alias("low"), F.col("end").alias("ended"))
        state = stored(state.where("ended").unionByName(moved), "jumps")
    return state


def walk(starts: DataFrame, hops: DataFrame, most: int = MOST_HOPS, ask_last: bool = True) -> DataFrame:
    """key, hop_count, final_key, ended ('end', 'loop', 'most') of starts (key) followed through hops (src, dst); a loop ends at the first key met again.

    ask_last: whether the key that the last of `most` hops comes to is asked if it leads on; a fetcher that stops there does not know, and says 'most'.
    """
    ways = starts.join(resolve(hops), "key", "left")
    length = F.coalesce("length", F.lit(0)) + F.coalesce("circle", F.lit(0))
    ways = stored(ways.select("key", length.cast("int").alias("hop_count"), F.coalesce("final_key", "key").alias("final_key"), F.when(F.coalesce("circle", F.lit(0)) > 0, "loop").otherwise("end").alias("ended")), "ways")
    links = hops.groupBy(F.col("src").alias("at")).agg(F.min("dst").alias("dst"))
    cut = ways.where(F.col("hop_count") > most).select("key", F.col("key").alias("at"))
    for _ in range(most):
        cut = cut.join(links, "at").select("key", F.col("dst").alias("at"))
    cut = cut.select("key", F.lit(most).alias("hop_count"), F.col("at").alias("final_key"), F.lit("most").alias("ended"))
    unknown = (F.col("ended") == "end") & (F.col("hop_count") == most) & F.lit(not ask_last)
    return ways.where(F.col("hop_count") <= most).withColumn("ended", F.when(unknown, "most").otherwise(F.col("ended"))).unionByName(cut)


def next_hop(status: Column, location: Column, refresh_header: Column, page: Column, base: Column | None = None) -> Column:
    """(type, target as written) of where an answer leads: HTTP redirect, Refresh header, meta refresh, script; null if it is the end."""
    at_once = html.refresh(refresh_header)
    meta = html.meta_refresh(page)
    script = html.script_redirect(page, base)
    hop = lambda kind, target: F.struct(F.lit(kind).alias("type"), target.alias("target"))
    return F.when(status.between(300, 399) & (F.coalesce(location, F.lit("")) != ""), hop("http", location)).when(at_once.isNotNull(), hop("meta-refresh", at_once["target"])).when(meta.isNotNull(), hop("meta-refresh", meta["target"])).when(script.isNotNull(), hop("javascript", script))
