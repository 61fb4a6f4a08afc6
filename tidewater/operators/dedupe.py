"""Duplicate titles, descriptions and headings: exact groups, near pairs by prefix filter, greedy near groups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import blank, squeeze, token_set
from ..plans.storage import counted, stored

NEAR, FEWEST, BLOCK = 0.85, 4, 1000
#: Sets of a side of a cell in which pairs are compared, and of a task's group of cells.
SIDE, TOGETHER = 2000, 2000
#: Classes of tokens of which every task knows how often they occur, and tokens for each 64 bits of an outline.
RARE, OUTLINE = 1 << 22, 128
#: Rounds whose leaders become one table.
ROUNDS = 16
#: Pairs that are Python objects at a time: a dense cell has a quarter of a million.
SLICE = 1 << 14


def exact_groups(rows: DataFrame, value: Column) -> DataFrame:
    """norm, value (the first), size of texts that more than one row (ord) has."""
    items = rows.where(~blank(value)).select("ord", value.alias("value"), squeeze(value).alias("norm"))
    return items.groupBy("norm").agg(F.min_by("value", "ord").alias("value"), F.count("*").alias("size")).where("size > 1")


def repeated(rows: DataFrame, value: Column) -> DataFrame:
    """The rows whose trimmed lower-case text another row has too."""
    items = rows.withColumn("norm", F.lower(F.trim(value))).where("norm <> ''")
    return items.join(items.groupBy("norm").agg(F.count("*").alias("copies")).where("copies > 1"), "norm")


def near_candidates(rows: DataFrame, value: Column, fewest: int = FEWEST) -> DataFrame:
    """ord, value, tokens of texts of enough tokens that are in no exact group.

    Texts are shuffled before their tokens are made, which take more bytes than they do; copies are told by digests alone.
    """
    items = rows.where(~blank(value)).select("ord", value.alias("value"), F.sha2(squeeze(value), 256).alias("same"))
    single = items.groupBy("same").agg(F.count("*").alias("copies")).where("copies = 1").select("same")
    return items.join(single, "same", "left_semi").select("ord", "value", token_set(F.col("value")).alias("tokens")).where(F.size("tokens") >= fewest)


def near_pairs(items: DataFrame, threshold: float = NEAR, block: int = BLOCK) -> DataFrame:
    """a, b, similarity of items (ord, tokens) alike enough: exact, by the rarest tokens of each set.

    Two sets of that similarity share one of their |A| - ceil(t |A|) + 1 rarest tokens, and after the first that they share each has
    enough tokens left for what they must have in common. Any one order of the tokens will do, so they are ordered by counts of RARE classes of them, which every task knows, and no
    token is shuffled for it. Sets that share a token meet in blocks of about `block` of them, so that a frequent one is spread over many tasks.
    What they cannot have in common by their outlines (`outlined`) goes before any set is shuffled.
    """
    kind = items.schema["ord"].dataType.simpleString()
    hashed = items.select("ord", F.sort_array(F.transform("tokens", lambda t: F.xxhash64(t))).alias("tokens"))
    items = stored(hashed.mapInArrow(outlined, f"ord {kind}, tokens array<long>, outline array<long>"), "items")  # words as 64-bit hashes
    counts = items.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(RARE - 1).cast("int").alias("of")).agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(RARE, np.int32)
    df[counts.column("of").to_numpy()] = np.minimum(counts.column("df").to_numpy(), (1 << 31) - 1)
    heads = items.select("ord", "tokens").mapInArrow(lambda b: _heads(b, df, threshold), f"ord {kind}, n int, place int, token long")
    heads = stored(heads, "heads")
    shared = heads.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select("token", F.ceil(F.col("sets") / block).cast("int").alias("blocks"))
    heads = heads.join(shared, "token").withColumn("own", F.pmod(F.xxhash64("ord"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = heads.select("token", F.col("own").alias("i"), F.col("other").alias("j"), F.col("ord").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    b = heads.select("token", F.col("other").alias("i"), F.col("own").alias("j"), F.col("ord").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    common = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    left_over = 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    alike = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & (left_over >= common)
    pairs = a.join(b, ["token", "i", "j"]).where(alike).select("a", "b").distinct()
    both = _compared(stored(_possible(pairs, items.select("ord", F.size("tokens").alias("n"), "outline"), threshold), "candidates"), items.select("ord", "tokens"))
    similarity = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)


def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ord, tokens) with an outline: 64 bits for each 2 * 64 tokens (a power of two of longs), of which each token turns one.

    The outline of twice as many longs folds to one of half: its halves, one xor the other. Two sets of an outline's length differ in as many tokens at least as their outlines do in bits.
    """
    for batch in batches:
        tokens = batch.column("tokens")
        n = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        width = 1 << np.ceil(np.log2(np.maximum(1, n / OUTLINE))).astype(np.int64)
        starts = np.cumsum(width) - width
        h = tokens.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.repeat(starts, n) + ((h >> np.uint64(6)) & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
        bits = np.zeros(int(width.sum()), np.uint64)
        np.bitwise_xor.at(bits, at, np.uint64(1) << (h & np.uint64(63)))
        outline = pa.ListArray.from_arrays(pa.array(np.append(starts, len(bits)).astype(np.int32)), pa.array(bits.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("ord"), tokens, outline], ["ord", "tokens", "outline"])


def _heads(batches: Iterator[pa.RecordBatch], df: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """ord, n, place, token: the tokens of each set (ord, tokens) that are rarest by df of their classes, ties by the tokens themselves."""
    for batch in batches:
        n = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
        token = batch.column("tokens").flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((token, df[token & (len(df) - 1)], row))
        place = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        some = np.flatnonzero(place < np.repeat((n - np.ceil(n * threshold - 1e-9) + 1).astype(np.int64), n))
        yield pa.RecordBatch.from_arrays([batch.column("ord").take(pa.array(row[some])), pa.array(n[row[some]], pa.int32()), pa.array(place[some], pa.int32()), pa.array(token[order[some]])], ["ord", "n", "place", "token"])


def _possible(pairs: DataFrame, outlines: DataFrame, threshold: float) -> DataFrame:
    """a, b of pairs whose outlines (ord, n, outline) differ in no more bits than sets of that similarity differ in tokens."""
    x, y = F.col("x"), F.col("y")
    half = lambda v: F.zip_with(F.slice(v, F.lit(1), F.floor(F.size(v) / 2).cast("int")), F.slice(v, F.floor(F.size(v) / 2).cast("int") + 1, F.size(v)), lambda p, q: p.bitwiseXOR(q))
    both = pairs.join(outlines.select(F.col("ord").alias("a"), F.col("n").alias("na"), F.col("outline").alias("x")), "a").join(outlines.select(F.col("ord").alias("b"), F.col("n").alias("nb"), F.col("outline").alias("y")), "b")
    both = both.select("a", "b", "na", "nb", F.when(F.size(x) > F.size(y), half(x)).otherwise(x).alias("x"), F.when(F.size(y) > F.size(x), half(y)).otherwise(y).alias("y"))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    least = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    return both.where((F.size(x) != F.size(y)) | (differ <= F.col("na") + F.col("nb") - 2 * least)).select("a", "b").distinct()


def _compared(pairs: DataFrame, items: DataFrame, side: int = SIDE) -> DataFrame:
    """a, b, na, nb, both (what they have in common) of pairs (a, b) of items (ord, tokens).

    Pairs whose sets have the same least neighbours meet in cells of about `side` sets a side: of a group of near copies, whose pairs grow with its square, each set is shuffled once for each cell that it
    is in, not once for each of its pairs. Cells share groups of about TOGETHER sets.
    """
    low = pairs.select(F.col("a").alias("ord"), F.col("a").alias("low")).union(pairs.select(F.col("b").alias("ord"), F.col("a").alias("low"))).groupBy("ord").agg(F.min("low").alias("low"))
    cells = pairs.join(low.select(F.col("ord").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("ord").alias("b"), F.col("low").alias("lb")), "b")
    # estimates that only say how large cells are divided; few cells are
    parts = cells.groupBy("la", "lb").agg(F.ceil(F.greatest(F.approx_count_distinct("a"), F.approx_count_distinct("b")) / side).alias("parts")).where("parts > 1")
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1)))
    cells = stored(cells.join(parts, ["la", "lb"], "left").select("a", "b", F.xxhash64("la", "lb", part("a"), part("b")).alias("cell")), "cells")
    members = cells.select("cell", F.col("a").alias("ord")).union(cells.select("cell", F.col("b").alias("ord"))).distinct()
    members, count = counted(members, "members")
    group = F.pmod("cell", F.lit(count // TOGETHER + 1)).alias("group")
    sets = members.select(group, "ord").distinct().join(items, "ord").select("group", "ord", "tokens")
    kind = items.schema["ord"].dataType.simpleString()
    return cells.select(group, "a", "b").groupBy("group").cogroup(sets.groupBy("group")).applyInArrow(lambda a, b: _common(a, b), f"a {kind}, b {kind}, na int, nb int, both int")


def _common(pairs: pa.Table, sets: pa.Table, limit: int = SLICE) -> pa.Table:
    """Of pairs (a, b) what their sets (ord, tokens) have in common, by slices of limit pairs; an ord with several sets has each."""
    tokens = sets.column("tokens").combine_chunks()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))]).astype(np.int64)
    words, code = np.unique(tokens.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    places: dict = {}
    for i, o in enumerate(sets.column("ord").to_pylist()):
        places.setdefault(o, []).append(i)
    of = lambda i: code[starts[i] : starts[i + 1]]
    marked, own, parts = np.zeros(len(words), bool), None, []
    kinds = [pairs.schema.field("a").type, pairs.schema.field("b").type, pa.int32(), pa.int32(), pa.int32()]
    pairs = pairs.sort_by("a")
    for at in range(0, max(1, pairs.num_rows), limit):
        part, found = pairs.slice(at, limit), []
        for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
            for i in places.get(a, ()):
                if i != own:
                    if own is not None:
                        marked[of(own)] = False
                    marked[of(i)], own = True, i
                found.extend((a, b, len(of(i)), len(of(j)), int(np.count_nonzero(marked[of(j)]))) for j in places.get(b, ()))
        columns = zip(*found, strict=True) if found else [[]] * 5
        parts.append(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "na", "nb", "both"]))
    return pa.concat_tables(parts)


def near_groups(items: DataFrame, threshold: float = NEAR) -> DataFrame:
    """ord, leader: each item with the first earlier leader that it is like; leaders are like no earlier leader.

    Rounds decide items from the earliest on: those without an undecided earlier neighbour lead, and what is beside them follows. A round reads only the pairs of undecided items.
    """
    pairs = stored(near_pairs(items, threshold).select("a", "b"), "pairs")
    rest, led = pairs, []
    while not rest.isEmpty():
        leaders = stored(rest.select(F.col("a").alias("ord")).distinct().join(rest.select(F.col("b").alias("ord")).distinct(), "ord", "left_anti"), "leaders")
        follow = stored(rest.join(leaders.select(F.col("ord").alias("a")), "a", "left_semi").select("b").distinct(), "follow")
        rest = stored(rest.join(follow, "b", "left_anti").join(follow.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"), "rest")
        led.append(leaders)
        if len(led) == ROUNDS:
            led = [stored(reduce(DataFrame.unionByName, led), "leaders")]
    leaders = reduce(DataFrame.unionByName, led) if led else pairs.select(F.col("a").alias("ord"))
    follows = pairs.join(leaders.select(F.col("ord").alias("a")), "a").groupBy(F.col("b").alias("ord")).agg(F.min("a").alias("leader"))
    return follows.unionByName(follows.select(F.col("leader").alias("ord"), "leader").distinct())


def group_members(crawl: DataFrame, threshold: float = NEAR) -> DataFrame:
    """field, kind, grp, value, size, ord, url: a row for each 2xx page of the exact and near groups by title, description and first h1; value is the first page's.

    A group is rows that share its name: no array holds its pages, however many they are.
    """
    rows = crawl.where("status_code between 200 and 299").select("ord", "url", "title", "description", F.get("h1s", F.lit(0)).alias("h1"))
    every = []
    for field in ("title", "description", "h1"):
        value = F.col(field)
        own = rows.where(~blank(value)).select("ord", "url", value.alias("own"), squeeze(value).alias("norm"))
        groups = exact_groups(rows, value).select("norm", "value", "size")
        exact = own.join(groups, "norm").select(F.lit("exact").alias("kind"), F.col("norm").alias("grp"), "value", "size", "ord", "url")
        members = stored(near_groups(near_candidates(rows, value), threshold), "members")
        leaders = members.groupBy("leader").agg(F.count("*").alias("size")).join(own.select(F.col("ord").alias("leader"), F.col("own").alias("value")), "leader")
        near = members.join(leaders, "leader").join(own.select("ord", "url"), "ord").select(F.lit("near").alias("kind"), F.col("leader").cast("string").alias("grp"), "value", "size", "ord", "url")
        every.append(exact.unionByName(near).select(F.lit(field).alias("field"), "*"))
    return every[0].unionByName(every[1]).unionByName(every[2])


def field_groups(crawl: DataFrame, threshold: float = NEAR) -> DataFrame:
    """field, kind, value, urls of the groups, for display; urls in crawl order. An array holds a group: for large ones use `group_members`."""
    urls = F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"])
    return group_members(crawl, threshold).groupBy("field", "kind", "grp").agg(F.first("value").alias("value"), urls.alias("urls")).drop("grp")


def largest(groups: DataFrame, n: int | None = 6) -> DataFrame:
    """Groups (field, kind, value, urls) from the largest on, exact ones first; n: so many of a field."""
    rank = Window.partitionBy("field").orderBy(F.desc(F.size("urls")), F.col("kind") != "exact", "value")
    ranked = groups.withColumn("rank", F.row_number().over(rank))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def group_rows(groups: DataFrame) -> DataFrame:
    """field, kind, value, size, url: a row an address of each group."""
    return groups.select("field", "kind", "value", F.size("urls").alias("size"), F.explode("urls").alias("url"))


def summary(exact: DataFrame, near: DataFrame) -> DataFrame:
    """How many exact and near groups there are, and how many pages they hold."""
    a = exact.agg(F.count("*").alias("exact_groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("exact_pages"))
    return a.join(near.agg(F.countDistinct("leader").alias("near_groups"), F.count("*").alias("near_pages")))
