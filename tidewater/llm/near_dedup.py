"""Near-duplicate components by MinHash banding, sequential Bayesian pruning and exact verification.

A document's set holds the distinct `SHINGLE`-word shingles of its text, lower-cased in A-Z; with fewer words the whole sequence is one shingle. Documents are linked when
100 * intersection >= `PERCENT` * union, and the components of these links are the result.

1. One pass over the texts gives each document's set size, set fingerprint and signature of `BANDS` * `ROWS` minima. Equal sets are one node from here on.
2. Nodes that share a band are candidates (a pair of the least similarity linked shares none once in 300,000 times). Each is first compared with the least node of its
   bucket: linear in the bucket, however large, as is the count of these pairs.
3. Pairs whose nodes are then in different components are left. They are compared in blocks of at most `BLOCK` by `BLOCK` nodes of a bucket,
   so that no pair is a row; each pair is taken in its first common band. Those that survive go on by blocks of documents.
4. A comparison looks at signature batches of `BATCH`, and drops a pair as soon as the posterior probability (uniform prior) that it is
   similar enough falls below `MISS`. What survives is verified on the full sets, read again from the texts of the candidates.

Null texts and texts without words have an empty set and are linked with nothing. Repeated rows are exact copies, each with its row.
A null id is linked like any, and never chosen while its component has another id. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashes, mix, nested, rows_of, slices, stored, unnested, words

SHINGLE = 2
PERCENT = 80
BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-4
BLOCK = 1024
#: Documents of a block of the last verification, on average.
VERIFIED = 2048
#: Bits of the map that tells which texts may be candidates; false ones cost a set, nothing else.
MAP_BITS = 24
SIGNED = "doc_id long, tie long, n_shingles long, node long, signature binary"


def shingles(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of each text, sorted distinct shingle hashes)."""
    code, row, distinct = words(text)
    n = len(text)
    h = hashes(distinct)[code] if len(code) else np.zeros(0, np.uint64)
    at = rows_of(row, n)
    count = np.diff(at)
    key = mix(h)
    span = np.minimum(size, np.repeat(count, count))  # words of the shingle that starts at a word
    place = np.arange(len(h)) - np.repeat(at[:-1], count)
    for k in range(1, size):
        later = np.minimum(np.arange(len(h)) + k, max(0, len(h) - 1))
        key = np.where(k < span, mix(key * np.uint64(0x100000001B3) + h[later]), key)
    starts = (place == 0) | (place + size <= np.repeat(count, count))
    key, own = key[starts], row[starts]
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return rows_of(own[new], n), key[new]


_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def signatures(at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The minima of every hash over each non-empty set."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, BANDS * ROWS), np.uint32)
    if len(full):
        for j in range(BANDS * ROWS):
            out[full, j] = (np.minimum.reduceat(key * _MULTIPLY[j] + _ADD[j], at[full]) >> np.uint64(32)).astype(np.uint32)
    return out


def fingerprints(at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One 64-bit value of each set; 0 for an empty one."""
    sums = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        sums[full] = mix(np.add.reduceat(mix(key), at[full]) + np.diff(at)[full].astype(np.uint64)) | np.uint64(1)
    return sums.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=4 << 20):
        at, key = shingles(batch.column("text"), size)
        rows = signatures(at, key)
        count = np.diff(at).astype(np.int64)
        node = fingerprints(at, key)
        blobs = [r.tobytes() if n else None for r, n in zip(rows, count, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(count), pa.array(node), pa.array(blobs, pa.binary())], ["doc_id", "tie", "n_shingles", "node", "signature"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column("node").to_numpy()
        rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(node), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
        for j in range(ROWS):
            key = mix(key * np.uint64(0x100000001B3) + rows[:, :, j])
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, BANDS))], ["bucket", "node"])


def _sets(batches: Iterator[pa.RecordBatch], size: int, candidates: np.ndarray) -> Iterator[pa.RecordBatch]:
    """node, items of texts whose node's bit is set."""
    for batch in slices(batches, limit=4 << 20):
        at, key = shingles(batch.column("text"), size)
        node = fingerprints(at, key)
        bit = (node.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
        some = np.flatnonzero(np.unpackbits(candidates, bitorder="little")[bit] & (np.diff(at) > 0))
        blobs = [key[at[i] : at[i + 1]].tobytes() for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(blobs, pa.binary())], ["node", "items"])


@cache
def least_matches(n: int, percent: int, miss: float = MISS) -> int:
    """The fewest of n equal minima with which the similarity is still percent or more with probability miss."""
    x = (np.arange(20_000) + 0.5) / 20_000
    for m in range(n + 1):
        log = m * np.log(x) + (n - m) * np.log1p(-x)
        p = np.exp(log - log.max())
        if p[x >= percent / 100].sum() / p.sum() >= miss:
            return m
    return n


def linked(a: np.ndarray, rest: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of rest are similar enough to the set a; all sorted."""
    size = np.fromiter(map(len, rest), np.int64, len(rest))
    flat = np.concatenate(rest)
    at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    both = np.add.reduceat((a[at] == flat).astype(np.int64), np.cumsum(size) - size)
    return 100 * both >= percent * (len(a) + size - both)


def _with_hub(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links of one hub (left: node, signature, items) with its candidates (right)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    hub = np.frombuffer(left.column("signature")[0].as_py(), np.uint32)
    items = np.frombuffer(left.column("items")[0].as_py(), np.uint64)
    rows = np.frombuffer(b"".join(right.column("signature").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
    alive, count = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    for at in range(0, BANDS * ROWS, BATCH):
        count[alive] += (rows[alive, at : at + BATCH] == hub[at : at + BATCH]).sum(axis=1)
        alive = alive[count[alive] >= least_matches(at + BATCH, percent)]
    column, other = right.column("items"), right.column("node").to_numpy()
    found = []
    for k in range(0, len(alive), 256):
        part = alive[k : k + 256]
        found.append(part[linked(items, [np.frombuffer(column[int(i)].as_py(), np.uint64) for i in part], percent)])
    found = np.concatenate(found) if found else np.zeros(0, np.int64)
    return pa.table([np.full(len(found), left.column("node")[0].as_py()), other[found]], schema=schema)


def _tile(table: pa.Table, percent: int, blocks: int) -> pa.Table:
    """Pairs of one bucket's block that may be linked: (block of the partners, node, its partners)."""
    schema = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("partners", pa.list_(pa.int64()))])
    table = table.sort_by("node")
    node, component, size, side = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles", "side"))
    one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    rows = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
    tile_band = int(table.column("band")[0].as_py())
    lefts, rights = (np.arange(len(node)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    flat = rows.reshape(len(rows), -1)
    need = [least_matches(at + BATCH, percent) for at in range(0, BANDS * ROWS, BATCH)]
    out: dict[str, list] = {"block": [], "node": [], "partners": []}
    for x in lefts:
        ys = rights[(component[rights] != component[x]) & (np.minimum(size[rights], size[x]) * 100 >= percent * np.maximum(size[rights], size[x]))]
        if one:
            ys = ys[ys > x]
        count = np.zeros(len(ys), np.int64)
        for k, at in enumerate(range(0, BANDS * ROWS, BATCH)):
            if not len(ys):
                break
            count += (flat[ys, at : at + BATCH] == flat[x, at : at + BATCH]).sum(axis=1)
            keep = count >= need[k]
            ys, count = ys[keep], count[keep]
        if len(ys) and tile_band:  # a pair is taken in its first common band
            ys = ys[~(rows[ys, :tile_band] == rows[x, :tile_band]).all(axis=2).any(axis=1)]
        if len(ys):
            block = node[ys] % blocks  # nodes are hashes already
            for b in np.unique(block):
                out["block"].append(int(b))
                out["node"].append(int(node[x]))
                out["partners"].append(node[ys[block == b]])
    return pa.table([pa.array(out["block"], pa.int64()), pa.array(out["node"], pa.int64()), pa.array(out["partners"], pa.list_(pa.int64()))], schema=schema)


def _verify(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links of rows (node, items, partners) with partners of this block (right: node, items)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    own = dict(zip(right.column("node").to_pylist(), right.column("items").to_pylist(), strict=True))
    a, b = [], []
    for node, items, partners in zip(*(left.column(c).to_pylist() for c in ("node", "items", "partners")), strict=True):
        some = np.array(partners, np.int64)
        hit = some[linked(np.frombuffer(items, np.uint64), [np.frombuffer(own[p], np.uint64) for p in partners], percent)]
        a += [node] * len(hit)
        b += hit.tolist()
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least reachable node) of the nodes of edges (a, b): alternating large and small stars."""
    table = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        table = stored(small, "edges")
        now = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = table.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return table.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)


def _anew(df: DataFrame) -> DataFrame:
    """df with columns of its own, for a plan in which it stands twice."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A bit for each value of the top MAP_BITS bits of the nodes: 2 MB, however many nodes."""
    bit = F.shiftrightunsigned("node", 64 - MAP_BITS).alias("bit")
    packed = nodes.select(bit).selectExpr("cast(shiftright(bit, 6) as int) as at", "shiftleft(1L, cast(bit % 64 as int)) as bits").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << MAP_BITS - 6, np.int64)
    out[packed.column("at").to_numpy()] = packed.column("bits").to_numpy()
    return out.view(np.uint8)


def find(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, tie (the text's hash), n_shingles, node (of its set; 0: empty), component_id of every row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    signed = stored(texts.mapInArrow(lambda b: _sign(b, size), SIGNED), "signatures")
    # equal sets: one node, with the least id and any of the equal signatures
    nodes = signed.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    nodes = stored(nodes, "nodes")
    bands = nodes.select("node", "signature").mapInArrow(_bands, "bucket long, node long")
    buckets = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = stored(bands.join(buckets, "bucket"), "buckets")
    candidates = stored(members.select("node").distinct(), "candidates")
    flags = _bitmap(candidates)
    sets = texts.select("text").mapInArrow(lambda b: _sets(b, size, flags), "node long, items binary").groupBy("node").agg(F.first("items").alias("items"))
    full = stored(sets.join(candidates, "node").join(nodes.drop("low"), "node"), "sets")

    pairs = members.where("node <> hub").select("hub", "node").distinct().join(full.select("node", "signature", "items"), "node")
    hubs = _anew(full).join(members.select(F.col("hub").alias("node")).distinct(), "node").select(F.col("node").alias("hub"), "node", "signature", "items")
    # a hub of very many candidates is dealt to many tasks, each with the hub's row
    sizes = _anew(members).where("node <> hub").groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("deals"))
    pairs = pairs.join(sizes, "hub").withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals")).cast("int"))
    hubs = hubs.join(_anew(sizes), "hub").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    links = stored(hubs.select("hub", "deal", "node", "signature", "items").groupBy("hub", "deal").cogroup(pairs.select("hub", "deal", "node", "signature", "items").groupBy("hub", "deal")).applyInArrow(lambda a, b: _with_hub(a, b, percent), "a long, b long"), "links")

    parts = stored(components(links), "components")
    placed = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("n")).where("n > 2 and c1 <> c2")
    mixed = mixed.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    left = placed.join(mixed, "bucket").join(full.select("node", "signature", "n_shingles"), "node")
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.withColumn("i", F.least("own", "k")).withColumn("j", F.greatest("own", "k")).withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1))
    left = left.select("bucket", "i", "j", "side", "node", "component", "n_shingles", "signature")
    amount = max(1, candidates.count() // VERIFIED)
    tiles = left.groupBy("bucket", "i", "j").applyInArrow(lambda t: _tile(_with_band(t), percent, amount), "block long, node long, partners array<long>")
    asked = stored(tiles, "survivors").join(full.select("node", "items"), "node")
    partners = _anew(full.select("node", "items")).withColumn("block", F.pmod("node", F.lit(amount)))
    more = asked.groupBy("block").cogroup(partners.groupBy("block")).applyInArrow(lambda a, b: _verify(a, b, percent), "a long, b long")
    joined = components(stored(links.unionByName(more), "links"))

    low = nodes.select("node", "low").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = low.select("node", "component").join(low.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("node", "component_id")
    out = signed.drop("signature").join(low, "node", "left")
    return out.select("doc_id", "tie", "n_shingles", "node", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_band(table: pa.Table) -> pa.Table:
    """The table with `band`, the band of its bucket: the first in which two of its members agree with the bucket's key."""
    rows = np.frombuffer(table.column("signature")[0].as_py(), np.uint32).reshape(1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for j in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + rows[:, :, j])
    band = int(np.flatnonzero(key[0].view(np.int64) == table.column("bucket")[0].as_py())[0])
    return table.append_column("band", pa.array(np.full(table.num_rows, band)))


def deduplicate(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with one document of each component, that of the least id; all columns."""
    found = find(docs, size, percent)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"), F.col("tie").alias("own")).distinct()
    rows = nested(docs).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("tie"))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("own")), "left_semi").dropDuplicates(["doc_id", "tie"])
    return unnested(kept, docs, F.col("row.text"), F.lit(False))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as items from w),
x as (select doc_id, len(items) as size, unnest(items) as item from s),
f as (select item, count(*) as n from x group by item),
r as (select doc_id, size, x.item, row_number() over (partition by doc_id order by f.n, x.item) as nth from x join f on x.item = f.item),
p as (select doc_id, item from r where nth <= size - (80 * size + 99) // 100 + 1),
c as (select distinct a.doc_id as a, b.doc_id as b from p a join p b on a.item = b.item and a.doc_id < b.doc_id),
i as (select a, b, len(u.items) + len(v.items) as total, len(list_intersect(u.items, v.items)) as shared from c join s u on u.doc_id = a join s v on v.doc_id = b),
l as (select a, b from i where 100 * shared >= 80 * (total - shared)),
e as (select a, b from l union all select b, a from l),
reach(doc_id, other) as (select doc_id, doc_id from s union select reach.doc_id, e.b from reach join e on e.a = reach.other),
low as (select doc_id, min(other) as component_id from reach group by doc_id)
select s.doc_id, cast(len(items) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept from s join low on low.doc_id = s.doc_id
"""
