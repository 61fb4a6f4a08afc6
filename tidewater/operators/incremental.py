"""An audit kept up to date: what a re-crawl changes is counted with signs, and only counts of changed keys are read and written again.

Two tables under a path. `keys` (kind, key, item, n; by bucket): how many internal links lead to a page with an anchor (kind `link`), how many pages have a title, a
description, a first h1 (kinds of `rules.SHARED`). `rules` (rule_id, n): how many pages each rule holds for, and the number of pages under an empty id. Inbound counts, groups of
duplicates, issues and scores are read from them and equal those of a whole run.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import counted, stored
from . import links, rules

KEYS = ["kind", "key", "item"]


class Touched(NamedTuple):
    """Rows of `keys` that an update read, those that changed, and how many buckets were written again."""

    read: int
    changed: int
    buckets: int


def _keys(crawl: DataFrame, n: int = 1) -> DataFrame:
    """kind, key, item of crawl records, each row counting n."""
    texts = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in rules.shared_keys().items()))
    shared = crawl.select(F.explode(texts).alias("t")).select("t.kind", "t.key", F.lit("").alias("item")).where("key is not null")
    led = links.edges(crawl).where("is_internal").select(F.lit("link").alias("kind"), F.col("dst").alias("key"), F.lower(F.trim(F.coalesce("anchor", F.lit("")))).alias("item"))
    return shared.unionByName(led).withColumn("n", F.lit(n))


def _summed(keys: DataFrame) -> DataFrame:
    """kind, key, item, n of the keys whose sum is not 0. Keys that are null have no sum: a filter on them would move below the steps that resolve addresses, and these would run twice."""
    return keys.groupBy(*KEYS).agg(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))).alias("n")).where("n <> 0")


def _rules(crawl: DataFrame) -> DataFrame:
    """rule_id, n of the rules that look at one page alone, and of all pages."""
    own = [r for r in rules.RULES if r.id not in rules.SHARED.values()]
    held = F.array_compact(F.array(F.lit(""), *(F.when(r.test(), F.lit(r.id)) for r in own)))
    return crawl.select(F.explode(held).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))


def _repeats(n: str):
    """The pages of a text that several have."""
    return F.when(F.col(n) > 1, F.col(n)).otherwise(0)


def _shared_rules(changes: DataFrame) -> DataFrame:
    """rule_id, n: by how many pages the rules on repeated texts change, of (kind, before, after)."""
    named = F.create_map(*(F.lit(x) for kv in rules.SHARED.items() for x in kv))
    return changes.where("kind <> 'link'").groupBy(F.element_at(named, F.col("kind")).alias("rule_id")).agg(F.sum(_repeats("after") - _repeats("before")).cast("long").alias("n"))


def create(crawl: DataFrame, path: str, buckets: int = 256) -> None:
    """The tables of crawl records, in so many buckets (of keys and items, so that a page with a third of all links is spread)."""
    keys = _summed(_keys(crawl)).withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
    keys.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/keys")
    shared = _shared_rules(_read(crawl.sparkSession, path).select("kind", F.lit(0).alias("before"), F.col("n").alias("after")))
    _rules(crawl).unionByName(shared).write.parquet(f"{path}/rules")
    crawl.sparkSession.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/buckets")


def update(path: str, before: DataFrame, after: DataFrame) -> Touched:
    """Takes rows that were in the crawl (before) out and others (after) in: two versions of re-crawled pages, or, with one of them empty, pages that are new or gone.

    Work grows with these rows and the buckets of their keys. New sums are a table of their own before they replace the old ones, so a task that is run again adds nothing twice.
    """
    spark = before.sparkSession
    buckets = spark.read.parquet(f"{path}/buckets").first()[0]
    signed = _summed(_keys(after).unionByName(_keys(before, -1))).withColumnRenamed("n", "d")
    delta, changed = counted(signed.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")), "delta")
    touched = [r[0] for r in delta.select("bucket").distinct().collect()]  # at most `buckets` numbers
    old = _read(spark, path).where(F.col("bucket").isin(touched)) if touched else _read(spark, path).limit(0)
    sums = old.join(delta, [*KEYS, "bucket"], "full").select(*KEYS, "bucket", F.coalesce("n", F.lit(0)).alias("before"), (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("after"), F.col("d").isNotNull().alias("new"))
    sums = stored(sums, "sums")
    read = sums.where("before > 0").count()
    own = _rules(after).unionByName(_rules(before).withColumn("n", -F.col("n"))).unionByName(_shared_rules(sums))
    totals = stored(spark.read.parquet(f"{path}/rules").unionByName(own).groupBy("rule_id").agg(F.sum("n").alias("n")), "rules")
    # sums that came to nothing stay as zeros until their bucket is written again: a bucket without rows would not be replaced
    rows = sums.where("after > 0 or new").select(*KEYS, F.col("after").alias("n"), "bucket")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/keys")
    totals.write.mode("overwrite").parquet(f"{path}/rules")
    return Touched(read, changed, len(touched))


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, key string, item string, n long, bucket int").parquet(f"{path}/keys").where("n > 0")


def inbound(spark: SparkSession, path: str) -> DataFrame:
    """key, incoming, unique_anchors of every address with internal links to it."""
    return _read(spark, path).where("kind = 'link'").groupBy("key").agg(F.sum("n").alias("incoming"), F.count(F.when(F.col("item") != "", 1)).alias("unique_anchors"))


def duplicates(spark: SparkSession, path: str) -> DataFrame:
    """kind, key, size of the texts that several pages have."""
    return _read(spark, path).where("kind <> 'link' and n > 1").select("kind", "key", F.col("n").alias("size"))


def issues(spark: SparkSession, path: str) -> DataFrame:
    """The rules' issues with share and priority, as `rules.prioritised` of a whole run (without insights)."""
    held = spark.read.parquet(f"{path}/rules").where("n > 0")
    pages = held.where("rule_id = ''").select("n").first()
    return rules.rated(rules.described(held.where("rule_id <> ''").select("rule_id", F.col("n").alias("count"))), pages[0] if pages else 0)
