"""Crawl records from raw pages, and a fetcher with an injected transport."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import elements as el
from ..functions import html as h
from ..functions import urls
from ..operators import redirects
from ..plans.storage import stored
from .pacing import paced

#: Answers worth another try, and how often and how long.
RETRY = {408, 425, 429}
TRIES, WAIT, LONG_WAIT, MOST_WAIT = 4, 0.5, 1.5, 15.0


def extract(pages: DataFrame, links: str = "main") -> DataFrame:
    """One record a page of pages (page_id, url, html), from one pass over its elements; links: of the main content, or of all the page."""
    rows = pages.select(F.col("page_id").alias("ord"), "url", el.elements(F.col("html"), F.col("url")).alias("e"))
    e = F.col("e")
    fields = rows.select(
        "ord", "url", el.title(e).alias("title"), el.named_meta(e, "description").alias("description"), *(el.headings(e, t).alias(t + "s") for t in ("h1", "h2", "h3")), el.images(e).alias("images"),
        el.json_ld(e).alias("found_schemas"), el.named_meta(e, "robots").alias("robots"), el.canonical(e).alias("canonical"), el.hreflangs(e).alias("hreflangs"), el.social_tags(e, F.col("url")).alias("social_tags"), el.anchors(e, links == "main").alias("found"),
    )
    link = lambda p: F.struct(p["said"].alias("anchor_text"), p["href"].alias("href"), (~urls.is_absolute(p["href"]) | urls.same_site(p["href"], F.col("url"))).alias("is_internal"), p["rel"].alias("rel"), *(F.array_contains(F.split(p["rel"], r"\s+"), k).alias(k) for k in ("nofollow", "sponsored", "ugc")), p["address"].alias("address"))
    named = F.filter(F.transform("found", link), lambda x: x["anchor_text"] != "")
    schemas = el.pretty_all(F.col("found_schemas"))
    return fields.select("ord", "url", "title", "description", "h1s", "h2s", "h3s", "images", schemas.alias("schemas"), "robots", "canonical", h.canonical_status(F.col("url"), F.col("canonical")).alias("canonical_status"), "hreflangs", named.alias("internal_links"), "social_tags")


class Answer(NamedTuple):
    status: int
    headers: dict[str, str]
    body: str


def retry_after(value: str, now: Callable[[], float] = time.time) -> float | None:
    """The seconds that a Retry-After header asks for: a number of them, or a date."""
    if value.strip().isdigit():
        return float(value)
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now())
    except (TypeError, ValueError):
        return None


def fetch_one(url: str, send: Callable[[str, int], Answer], wait: Callable[[float], None] = time.sleep) -> tuple[Answer | None, int]:
    """(the answer, tries): tries again on busy and server errors, longer each time; none if nothing answered."""
    for attempt in range(1, TRIES + 1):
        try:
            answer = send(url, attempt)
        except OSError:
            answer = None
        if answer is not None:
            blocked = answer.headers.get("cf-mitigated") == "challenge" or answer.status in (403, 503) and "cloudflare" in answer.headers.get("server", "").lower()
            if blocked or not (answer.status in RETRY or answer.status >= 500):
                return answer, attempt
        if attempt == TRIES:
            return answer, attempt
        after = answer.headers.get("retry-after", "") if answer is not None else ""
        base = LONG_WAIT if answer is not None and answer.status in (429, 503) else WAIT
        asked = retry_after(after)
        wait(min(asked, MOST_WAIT) if asked is not None else base * 2 ** (attempt - 1))
    return None, TRIES


FETCHED = "ord long, url string, status string, status_code int, html string, fetch_time string, location string, refresh string"


#: Rows, and characters of pages, that a task gathers before it hands them on.
BATCH_ROWS, BATCH_SIZE = 200, 8 << 20


def lanes(addresses: DataFrame, n: int | None = None) -> DataFrame:
    """Safe addresses (ord, url) with their host, all of a host in one of n partitions, and there in turns: the first of every host, then the second.

    A host is asked by one task alone, since its pace is one; a host with most of the addresses takes that task's time, but its rows are sorted and streamed, never held.
    """
    n = n or int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    safe = addresses.where(urls.is_safe(F.col("url"))).select("ord", "url", urls.host(F.col("url")).alias("host")).repartition(n, "host")
    return safe.withColumn("turn", F.row_number().over(Window.partitionBy("host").orderBy("ord"))).sortWithinPartitions("turn", "host")


def fetch(addresses: DataFrame, send: Callable[[str, int], Answer], workers: int = 3, deadline: float | None = 125.0, rate: float | None = None, burst: int = 1, tasks: int | None = None) -> DataFrame:
    """FETCHED of addresses (ord, url); unsafe ones are left out, those past the deadline of their task (none: no deadline) are errors, `skipped (deadline)`, to be fetched again.

    Each of the tasks has its own hosts and workers. A host has one request at a time, at most `rate` a second with `burst` at once (none: as fast as it answers); see `lanes` and `pacing.paced`.
    """

    def one(row: tuple) -> tuple:
        began = time.monotonic()
        answer, _ = fetch_one(row[1], send)
        took = f"{time.monotonic() - began:.1f}s"
        if answer is None or not 200 <= answer.status < 400:
            return *row, "Error", answer.status if answer else 0, "", took, "", ""
        page = 200 <= answer.status < 300 and "html" in answer.headers.get("content-type", "text/html")
        return *row, "OK", answer.status, answer.body if page else "", took, answer.headers.get("location", ""), answer.headers.get("refresh", "")

    def skipped(row: tuple) -> tuple:
        return *row, "Error", 0, "", "skipped (deadline)", "", ""

    columns = [c.split()[0] for c in FETCHED.split(", ")]

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = None if deadline is None else time.monotonic() + deadline
        asked = ((h, (o, u)) for batch in batches for o, u, h in zip(batch["ord"], batch["url"], batch["host"], strict=True))
        rows, size = [], 0
        for row in paced(asked, one, skipped, workers, rate, burst, end):
            rows.append(row)
            size += len(row[4])
            if len(rows) >= BATCH_ROWS or size >= BATCH_SIZE:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return lanes(addresses, tasks).select("ord", "url", "host").mapInPandas(fetched, FETCHED)


HOPS = "array<struct<url:string,status:int,type:string>>"


def follow(addresses: DataFrame, send: Callable[[str, int], Answer], workers: int = 3, deadline: float | None = 125.0, most: int = redirects.MOST_HOPS, rate: float | None = None, burst: int = 1, tasks: int | None = None) -> DataFrame:
    """Addresses (ord, url) fetched through their redirects: FETCHED of the last answer, with the columns of the chain.

    initial_url, redirect_chain (the addresses that led on, with their status and kind), hop_count, final_url, redirected_url (null without a hop), redirect_type,
    redirect_status_code (the first hop's). A chain ends at an answer that leads nowhere, at an address it had before, or after `most` hops. An unsafe address is an error.
    """
    going = addresses.select("ord", F.col("url").alias("initial_url"), F.col("url").alias("at"), F.array().cast(HOPS).alias("redirect_chain"))
    done = None
    for turn in range(most + 1):
        answers = fetch(going.select("ord", F.col("at").alias("url")), send, workers, deadline, rate, burst, tasks).drop("url")
        hop = redirects.next_hop(F.col("status_code"), F.col("location"), F.col("refresh"), F.col("html"), F.col("at"))
        rows = stored(going.join(answers, "ord", "left").withColumn("hop", hop), "answers")
        target = F.when(urls.is_absolute(F.col("hop.target")), F.col("hop.target")).otherwise(urls.join(F.col("at"), F.col("hop.target")))
        rows = rows.withColumn("next", F.when(F.col("hop.target").isNotNull(), urls.without_fragment(target)))
        visited = F.array_append(F.transform("redirect_chain", lambda h: urls.without_fragment(h["url"])), urls.without_fragment(F.col("at")))
        chain = F.array_append("redirect_chain", F.struct(F.col("at").alias("url"), F.col("status_code").alias("status"), F.col("hop.type").alias("type")))
        leads = F.col("next").isNotNull() & (F.lit(turn) < most)
        again = F.array_contains(visited, F.col("next"))
        ended = rows.where(~leads | again).withColumn("redirect_chain", F.when(leads, chain).otherwise(F.col("redirect_chain"))).withColumn("final_url", F.when(leads, F.col("next")).otherwise(F.col("at")))
        ended = ended.drop("hop", "next", "at", "location", "refresh")
        done = ended if done is None else done.unionByName(ended)
        going = rows.where(leads & ~again).select("ord", "initial_url", F.col("next").alias("at"), chain.alias("redirect_chain"))
        if going.isEmpty():
            break
    hops = F.size("redirect_chain")
    return done.select(
        "ord", F.col("initial_url").alias("url"), F.coalesce("status", F.lit("Error")).alias("status"), F.coalesce("status_code", F.lit(0)).alias("status_code"), F.coalesce("html", F.lit("")).alias("html"), F.coalesce("fetch_time", F.lit("0.0s")).alias("fetch_time"),
        "initial_url", "redirect_chain", hops.alias("hop_count"), "final_url", F.when(hops > 0, F.col("final_url")).alias("redirected_url"), redirects.kind(F.col("redirect_chain")).alias("redirect_type"), F.get("redirect_chain", F.lit(0))["status"].alias("redirect_status_code"),
    )


def assemble(fetched: DataFrame) -> DataFrame:
    """Fetched rows (ord, url, status_code, html, ...) with `status`, and html emptied where nothing was answered; a last 3xx stays OK."""
    good = F.col("status_code").between(200, 399)
    return fetched.withColumn("status", F.when(good, "OK").otherwise("Error")).withColumn("html", F.when(F.col("status_code").between(200, 299), F.col("html")).otherwise(""))


def table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
