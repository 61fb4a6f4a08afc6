"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame functions alone.

A source's target is its share of all words by weight, at most `MOST` times its own words; what is beyond that goes to the
others by weight (`targets`). A target takes complete epochs of its source first. The rest is drawn by
Efraimidis-Spirakis sampling: each document gets the exponential key -ln(u)/weight, u from a hash of its id, the keys are sorted
within the source, and a prefix sum of sizes fills the budget; the document at the border is cut, so a source meets its target to the
word. The keys are dealt to ranges of about `RANGE_ROWS` documents, so a source of any share is sorted by many tasks.

A null text has size 0 and is never drawn. A null source is a source of its own, the last. A null, non-positive or missing weight counts as
`NEUTRAL`. Rows equal in id, source and text are taken alike (a cut among them is rounded down to equal parts). An empty table
gives an empty result. Extra columns stay, whatever their names (`mix`), or are ignored (`shares`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, nested, stored, unnested

SOURCE_WEIGHTS = (5, 2, 1)
MOST = 3
NEUTRAL = 1.0
#: The draw's weight of a document by its quality label.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}
RANGE_ROWS = 10_000


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight by labels (doc_id, quality): the best label where an id has several."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    weight = F.lit(NEUTRAL)
    for quality, w in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("quality") == quality, w).otherwise(weight)
    return best.select("doc_id", weight.alias("weight"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, rows, target of sizes (source, source_size, rows): one row a source.

    With sources in the order of cap / weight, the level if all earlier ones are capped rises until it stops to exceed
    the next cap; so the greatest level is that at which the targets min(cap, level * weight) add up to all sizes.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*map(F.lit, SOURCE_WEIGHTS))
    weighed = sizes.withColumn("at", F.row_number().over(by_name) - 1).withColumn("share", F.element_at(kinds, F.col("at") % len(SOURCE_WEIGHTS) + 1)).withColumn("cap", F.col("source_size") * MOST)
    by_cap = Window.orderBy(F.col("cap") / F.col("share"), "at")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier, later = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("share").over(later)
    return weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything)).select("source", "source_size", "rows", F.least(F.col("cap").cast("double"), F.col("level") * F.col("share")).alias("target"))


def shares(docs: DataFrame, weights: DataFrame | None = None, seed: str = "mix") -> DataFrame:
    """What the mix takes of docs (doc_id, text, source): a row for each distinct (doc_id, source, text).

    doc_id, source, tie (the text's hash), size, rows (how many such rows), source_size, target, full (times that each row is taken whole),
    part (words of one more, cut copy; else 0). weights: doc_id, weight.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    items = rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("rows"))
    if weights is not None:
        items = items.join(weights.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left")
    else:
        items = items.withColumn("weight", F.lit(NEUTRAL))
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(u) / F.when(F.col("weight") > 0, F.col("weight")).otherwise(NEUTRAL)
    items = stored(items.select("doc_id", "source", "size", "tie", "rows", key.alias("key")), "mix-items")

    words = F.col("size") * F.col("rows")
    wanted = targets(items.groupBy("source").agg(F.sum(words).alias("source_size"), F.count("*").alias("rows")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(0)
    wanted = wanted.select("source", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"), F.ceil(F.col("rows") / RANGE_ROWS).alias("ranges"))
    same = items["source"].eqNullSafe(wanted["source"])
    dealt = items.join(wanted, same).drop(wanted["source"])
    # 1 - exp(-key) is even on (0, 1) for neutral weights, and rises with the key
    dealt = dealt.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")), F.col("ranges") - 1))
    ranges = dealt.groupBy("source", "range").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum(words).over(within), F.lit(0))).join(ranges, (F.col("source").eqNullSafe(F.col("s"))) & (F.col("range") == F.col("r")))
    each = placed.withColumn("each", F.expr("least(greatest(rest - base - inside, 0L), size * rows) div rows"))
    whole = (F.col("size") > 0) & (F.col("each") == F.col("size"))
    return each.select("doc_id", "source", "tie", "size", "rows", "source_size", "target", (F.col("epochs") + whole.cast("long")).alias("full"), F.when(whole, 0).otherwise(F.col("each")).cast("long").alias("part"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    found, gaps = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.split(text, WORD, -1)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(found, F.lit(1), n), lambda g, w: F.length(g) + F.length(w))
    return F.substring(text, F.lit(1), F.aggregate(lengths, F.lit(0), lambda a, x: a + x))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = "mix") -> DataFrame:
    """The mixed corpus: rows of docs, each as often as it is taken; the document at a source's border with its first words only."""
    rows = nested(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("tie"))
    taken = shares(docs, weights, seed).where("full > 0 or part > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("tie").alias("own"), F.col("full").cast("int").alias("full"), F.col("part").cast("int").alias("part"))
    joined = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("own")))
    copies = F.concat(F.array_repeat(F.lit(0), F.col("full")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<int>")))
    out = joined.select("row", F.explode(copies).alias("cut"))
    return unnested(out, docs, F.when(F.col("cut") > 0, first_words(F.col("row.text"), F.col("cut"))).otherwise(F.col("row.text")), F.col("cut") > 0)


SQL = rf"""
with d as (select doc_id, source, text, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size from documents),
g as (select doc_id, source, size, coalesce(text, '') as text, count(*) as k from d group by all),
q as (select doc_id, max(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id),
i as (select g.*, -ln((cast('0x' || substr(md5(coalesce(cast(g.doc_id as varchar), '') || ':mix'), 1, 13) as bigint) + 0.5) / 4503599627370496.0)
        / case q.quality when 1 then 2.0 when 0 then 0.5 else 1.0 end as key from g left join q on g.doc_id = q.doc_id),
s as (select source, cast(sum(size * k) as bigint) as source_size from i group by source),
w as (select *, list_extract([5, 2, 1], cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as bigint)) as share,
        row_number() over (order by source nulls last) as nth, source_size * 3 as cap from s),
l as (select *, cast((sum(source_size) over () - coalesce(sum(cap) over (order by cap / share, nth rows between unbounded preceding and 1 preceding), 0)) as double)
        / cast(sum(share) over (order by cap / share, nth rows between current row and unbounded following) as double) as level from w),
t as (select source, source_size, least(cast(cap as double), max(level) over () * share) as target from l),
e as (select *, case when source_size > 0 then cast(round(target) as bigint) // source_size else 0 end as epochs from t),
p as (select i.doc_id, i.size, i.k, e.source_size, e.target, e.epochs, cast(round(e.target) as bigint) - e.epochs * e.source_size as rest,
        coalesce(sum(i.size * i.k) over (partition by i.source order by i.key, i.doc_id rows between unbounded preceding and 1 preceding), 0) as before
        from i join e on i.source is not distinct from e.source)
select doc_id, size, source_size, target, cast(epochs * size + least(greatest(rest - before, 0), size * k) // k as bigint) as taken
from (select *, unnest(range(k)) as copy from p)
"""
