"""Crawl batches as streams: once-only pages, fetched batches, a frontier, progressive counts, field updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls
from ..operators.graph import page_links
from ..operators.merge import overlay, unseen
from ..plans.storage import stored
from ..sources import pages as page_source
from ..sources.pages import Answer


def distinct_pages(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows (url, ts) of pages not seen before within a time; its state is bounded by the watermark."""
    return stream.withColumn("page", urls.crawl_key(F.col("url"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["page"])


def distinct_events(stream: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first event (ts) of each key, however late the others are: the state holds every key. With `late`, keys are forgotten after that time, and later events lost."""
    return stream.dropDuplicates(keys) if late is None else stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def append_unseen(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch (url, final_url, ord, ...) without pages of earlier batches, appended to a Parquet table."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a batch that runs again replaces its own part and is not held against it
        seen = spark.read.parquet(table).where(F.col("batch") != number).select("url", "final_url") if _exists(spark, table) else batch.select("url", "final_url").limit(0)
        unseen(batch, seen).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_fetched(stream: DataFrame, send: Callable[[str, int], Answer], table: str, checkpoint: str, **pace) -> StreamingQuery:
    """Each micro-batch of addresses (ord, url) fetched (pace: as in `sources.pages.fetch`) into a part of its own of a Parquet table.

    The source says how many a batch takes (maxFilesPerTrigger of a folder of addresses). A query that starts again goes on with the batch it was in: that one is fetched again
    in its place, earlier ones are neither asked for again nor lost.
    """

    def step(batch: DataFrame, number: int) -> None:
        page_source.fetch(batch, send, **pace).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


QUEUE = "url string, depth int, reached boolean"


def once(queue: DataFrame) -> DataFrame:
    """url, depth of the pages of a stream of QUEUE that are new: never named before, neither as an address to fetch nor as one that a fetch reached.

    The state is one flag a page key, spread by key; with the RocksDB provider of Spark's state store it may be far larger than memory. Of one batch's rows of a page the
    lowest depth, then the lowest address, stands for it. Null and empty addresses are left out.
    """

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, reached = None, state.exists
        for rows in frames:
            reached = reached or bool(rows["reached"].any())
            for depth, url in zip(rows["depth"], rows["url"], strict=True):
                best = min(best or (int(depth), url), (int(depth), url))
        state.update((True,))
        if not reached:
            yield pd.DataFrame({"url": [best[1]], "depth": [best[0]]})

    keyed = queue.where("url <> ''").withColumn("key", urls.crawl_key(F.col("url"))).withColumn("reached", F.coalesce("reached", F.lit(False))).withColumn("depth", F.coalesce("depth", F.lit(0)))
    return keyed.groupBy("key").applyInPandasWithState(first, "url string, depth int", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def frontier(spark: SparkSession, seed: str, send: Callable[[str, int], Answer], path: str, listed: DataFrame | None = None, rounds: int | None = None, **pace) -> bool:
    """Crawls seed's site from it (and from listed addresses, url) to an empty queue: fetched pages, with their depth, in path/pages; whether the queue is empty.

    A round is a stream's run over what the last one put into path/queue: pages not seen before (`once`) are fetched through their redirects, their links to pages of the site queued,
    and the addresses that redirects ended at marked as seen. So a round reads the rows of the last one and the state of their keys, not the pages before. `rounds` pauses
    after so many; the next call with this path goes on, as it does after a failure: a round's parts are replaced as a whole.
    """
    queue, table, mark = (f"{path.rstrip('/')}/{k}" for k in ("queue", "pages", "mark"))
    seeds = spark.createDataFrame([(seed,)], "url string")
    seeds = seeds if listed is None else seeds.unionByName(listed.select("url"))
    if not _exists(spark, f"{queue}/batch=-1/_SUCCESS"):
        seeds.select("url", F.lit(0).alias("depth"), F.lit(False).alias("reached")).write.mode("overwrite").parquet(f"{queue}/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        fresh = stored(batch.withColumn("ord", F.monotonically_increasing_id()), "frontier")
        fetched = page_source.follow(fresh, send, **pace).join(fresh.select("ord", "depth"), "ord").drop("ord")
        fetched.write.mode("overwrite").parquet(f"{table}/batch={number}")
        got = spark.read.parquet(f"{table}/batch={number}")
        pages = got.where("status = 'OK'").select(F.col("final_url").alias("url"), "html", "depth").where(urls.same_site(F.col("url"), F.lit(seed)))
        depths = pages.groupBy(urls.without_fragment(F.col("url")).alias("src")).agg((F.min("depth") + 1).cast("int").alias("depth"))
        links = page_links(pages.select("url", "html"), seed).join(depths, "src").groupBy(F.col("dst").alias("url")).agg(F.min("depth").alias("depth")).withColumn("reached", F.lit(False))
        ends = got.where("hop_count > 0").select(F.col("final_url").alias("url"), "depth", F.lit(True).alias("reached"))
        links.unionByName(ends).write.mode("overwrite").parquet(f"{queue}/batch={number}")

    done = 0
    while rounds is None or done < rounds:
        rows = spark.readStream.schema(QUEUE).parquet(f"{queue}/batch=*")
        run = once(rows).writeStream.foreachBatch(step).option("checkpointLocation", mark).trigger(availableNow=True).start()
        run.awaitTermination()
        if not any(p.numInputRows for p in run.recentProgress):
            return True
        done += 1
    return False


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def status_counts(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of status codes by window of ts, for a progress display."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "status_code").agg(F.count("*").alias("pages"))


def extend(old: DataFrame, batches: list[DataFrame], fields: list[str]) -> DataFrame:
    """Fields of re-crawled batches laid over old rows, one batch after the other."""
    for batch in batches:
        old = overlay(old, batch, fields)
    return old
