"""Re-crawls and logs: fresh fields over old rows, first and last of a key, the newest turns of a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def overlay(old: DataFrame, fresh: DataFrame, fields: list[str], key: str = "url") -> DataFrame:
    """old with these fields from fresh where it has the key (its last row, by ord); new keys are not added."""
    last = Window.partitionBy(key).orderBy(F.desc("ord"))
    newest = fresh.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in fields))
    joined = old.join(newest, old[key] == F.col("_key"), "left")
    return joined.select(*(F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns))


def first_of(df: DataFrame, key: Column, order: str = "ord") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def unseen(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of a batch (url) whose page is in no earlier batch (url, final_url), once each."""
    known = seen.select(urls.crawl_key(F.col("url")).alias("k")).union(seen.where("final_url is not null").select(urls.crawl_key(F.col("final_url")))).distinct()
    own = first_of(batch.withColumn("k", urls.crawl_key(F.col("url"))), F.col("k"))
    return own.join(known, "k", "left_anti").drop("k")


def newest(turns: DataFrame, scope: str, order: str, n: int = 50) -> DataFrame:
    return turns.withColumn("_n", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def truncated(turns: DataFrame, scope: str, order: str, at: DataFrame) -> DataFrame:
    """Turns before the one that was edited: at (scope, cut)."""
    return turns.join(at, scope, "left").where(F.col("cut").isNull() | (F.col(order) < F.col("cut"))).drop("cut")


def nested(parents: DataFrame, children: DataFrame, key: str, parent: str, order: str, name: str) -> DataFrame:
    """parents with an array of their children, in order; empty where there are none."""
    own = [c for c in children.columns if c != parent]
    kind = f"array<struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in children.schema if f.name != parent)}>>"
    lists = children.groupBy(F.col(parent).alias("_parent")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*own).alias("_c")))), lambda x: x["_c"]).alias(name))
    return parents.join(lists, F.col(key) == F.col("_parent"), "left").drop("_parent").withColumn(name, F.coalesce(name, F.array().cast(kind)))
