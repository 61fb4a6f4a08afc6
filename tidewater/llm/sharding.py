"""Proportional stratified interleaving: shards that each hold the sources in the corpus's own proportions.

The rows of each source are put in a seeded random order (by md5 of seed, id and text). Row r of the n of a source has the fractional rank (r + u) / n, where u in [0, 1) belongs to the source, so that
small sources do not all fall in the middle. All rows are sorted by fractional rank and cut into shards of equal counts, at most one row apart: a shard of a k-th of all rows has a
k-th of each source, but for a row or two and the share of that source in as many rows as there are sources.

Both orders come from ranges (repartitionByRange, a count a range, a place within): no task holds a source, and a source with a third of all rows is many ranges. Only keys and what the caller
selects are sorted; `shard` and `write` join the texts to the places found.

A null source is one of its own, after the others. A null text has no bytes; a null or repeated id is a row as any other. Rows that repeat id and text are interchangeable: they take neighbouring places.
With fewer rows than shards some shards are empty; an empty table gives an empty result. The input's columns are kept in one column `row`, so that none clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 8
SEED = "tidewater"


def _hash(*columns: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns)).cast("binary"))


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows as a table, with the range of the order of keys that they are in, and their place in it."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ordered.select("*", F.spark_partition_id().alias("range"), (F.monotonically_increasing_id() % (1 << 33)).alias("place")), name)


def interleave(rows: DataFrame, source: Column, key: Column, shards: int = SHARDS) -> DataFrame:
    """rows (as one column `row`) with their shard and their slot in it; source is the stratum of a row, key its place among those of its stratum."""
    # rows of equal keys are dealt to different ranges all the same
    keyed = rows.select(F.struct("*").alias("row"), source.isNull().alias("lacking"), F.coalesce(source.cast("string"), F.lit("")).alias("stratum"), key.alias("key"), F.monotonically_increasing_id().alias("tie"))
    first = _numbered(keyed, ["lacking", "stratum", "key", "tie"], "strata").drop("key", "tie")
    within = first.groupBy("range", "lacking", "stratum").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    stratum = Window.partitionBy("lacking", "stratum")
    earlier = F.sum("n").over(stratum.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    start = F.conv(F.substring(F.md5(F.col("stratum").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    shift = within.select("range", "lacking", "stratum", (F.coalesce(earlier, F.lit(0)) - F.col("low")).alias("shift"), F.sum("n").over(stratum).alias("total"), start.alias("start"))
    ranked = first.join(shift, ["range", "lacking", "stratum"])
    second = _numbered(ranked.select("row", "lacking", "stratum", ((F.col("place") + F.col("shift") + F.col("start")) / F.col("total")).alias("fraction")), ["fraction", "lacking", "stratum"], "interleaved")
    # one row a range
    sizes = second.groupBy("range").agg(F.count("*").alias("n"))
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    k, total = F.lit(shards), F.col("total")
    placed = second.join(F.broadcast(sizes), "range").select("row", "total", (F.col("before") + F.col("place")).alias("position"))
    placed = placed.withColumn("shard", F.expr(f"position * {shards} div total").cast("int"))
    # the first position of a shard is the least whose multiple reaches it
    low = F.ceil(F.col("shard") * total / k)
    return placed.select("row", "shard", (F.col("position") - low).alias("slot"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (bytes of the text and one), text_crc32, and the key of the seeded shuffle, of docs (doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shuffle_key(docs).alias("shuffled"))


def shuffle_key(docs: DataFrame, seed: str = SEED) -> Column:
    return _hash(F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """row (all columns of docs), shard and slot: the texts are written once with a number, and joined to the places of the numbers."""
    kept = stored(docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), shuffle_key(docs, seed).alias("shuffled"), F.monotonically_increasing_id().alias("number")), "rows")
    places = interleave(kept.select("number", "source", "shuffled"), F.col("source"), F.col("shuffled"), shards)
    return kept.select("number", "row").join(places.select(F.col("row.number").alias("number"), "shard", "slot"), "number").select("row", "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED) -> None:
    """Parquet folders shard=0, 1, ...; each file holds a range of a shard's slots, in their order."""
    placed = shard(docs, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


#: The same as DuckDB SQL, for the columns of op12. The checksum is worked out bit by bit from the text's bytes.
SQL = f"""
with recursive t(i, c, k) as (select i, i, 0 from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from t where k < 8),
crc as (select list(c order by i) as table_of from t where k = 8),
d as (select doc_id, source, coalesce(text, '') as text from documents),
h as (select doc_id, source, octet_length(encode(text)) + 1 as size, md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || text) as shuffled,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)), lambda a, b: xor(a >> 8, table_of[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32
    from d, crc),
r as (select *, (row_number() over (partition by source order by shuffled) - 1 + ('0x' || substr(md5(coalesce(source, '')), 1, 8))::bigint / 4294967296.0::double) / count(*) over (partition by source) as fraction from h),
p as (select *, row_number() over (order by fraction, source is null, coalesce(source, '')) - 1 as position, count(*) over () as total from r),
s as (select *, (position * {SHARDS}) // total as shard from p)
select doc_id, size, text_crc32, 'rows' as law, shard::int as shard, (position - -((-shard * total) // {SHARDS}))::bigint as slot, null::int as grown_shard from s
"""
