"""Best-fit packing of token sequences by planning over the histogram of lengths.

A document becomes the ids of its text and one closing id; only what is longer than a sequence is cut.
The pieces' lengths are counted (at most `capacity` rows reach the driver), best-fit decreasing runs over these
counts, and each piece takes the slot that the plan holds for its rank among the pieces of its length.

Nulls and empty texts are the closing id alone. Equal rows are packed each for itself. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, rows_of, slices, stored, words

CAPACITY = 4096
CLOSING_ID = 1
#: Pieces of one length that are ranked together, on average: so many, or for very many pieces the root of their number.
RANK_ROWS = 1000
#: Distinct words whose ids a Python worker keeps; others are encoded again when they return.
KEPT_WORDS = 300_000
#: Words whose ids a task holds at once, if no document has more.
GROUP_WORDS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of distinct words by a tokenizer that drops white space and never merges across it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.known: dict[str, int] = {}  # places in start and size
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of many words, where each word's begin, how many they are)."""
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0).tolist()
        plain = [i for i in new if "<|" not in distinct[i] and distinct[i]]
        parts, sizes = [], []
        for at in range(0, len(plain), 20_000):  # many words a call: the mark keeps them apart
            own = plain[at : at + 20_000]
            texts = [self.mark.join([distinct[i] for i in own[k : k + 500]]) for k in range(0, len(own), 500)]
            for encoded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                ids = np.asarray(encoded.ids, np.uint32)
                cuts = np.flatnonzero(ids == self.mark_id)
                sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
                parts.append(np.delete(ids, cuts))
        special = [i for i in new if "<|" in distinct[i] or not distinct[i]]
        for i in special:
            ids = np.asarray(self.tokenizer.encode(distinct[i], add_special_tokens=False).ids, np.uint32)
            parts.append(ids)
            sizes.append(np.array([len(ids)]))
        size, start = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        seen = place >= 0
        size[seen], start[seen] = self.size[place[seen]], self.start[place[seen]]
        if not new:
            return self.flat, start, size
        order, own_size = np.array(plain + special), np.concatenate(sizes).astype(np.int64)
        own_start = len(self.flat) + np.cumsum(own_size) - own_size
        size[order], start[order] = own_size, own_start
        flat = np.concatenate([self.flat, *parts])
        if keep := min(len(plain), KEPT_WORDS - len(self.known)):
            first = len(self.known)
            self.known.update(zip((distinct[i] for i in plain[:keep]), range(first, first + keep), strict=True))
            self.start, self.size = np.append(self.start, own_start[:keep]), np.append(self.size, own_size[:keep])
            self.flat = flat[: own_start[keep - 1] + own_size[keep - 1]].copy()
        return flat, start, size


_ENCODERS: dict[str, WordIds] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = _ENCODERS.setdefault(path, None) or _ENCODERS.__setitem__(path, WordIds(path)) or _ENCODERS[path]
    for batch in slices(batches, limit=8 << 20):
        code, row, distinct = words(batch.column("text"), lower=False)
        flat, start, size = encoder(distinct.to_pylist())
        at = rows_of(row, batch.num_rows)
        out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32")}
        hi = 0
        while hi < batch.num_rows:  # documents in groups: their ids take bounded memory
            lo = hi
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + GROUP_WORDS, side="right")) - 1)
            part = code[at[lo] : at[hi]]
            ids = flat[ragged(start[part], size[part])]
            ends = np.concatenate(([0], np.cumsum(size[part])))[at[lo : hi + 1] - at[lo]]
            for k in range(hi - lo):
                own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(CLOSING_ID)).astype("<u4", copy=False)
                for piece, begin in enumerate(range(0, len(own), capacity)):
                    cut = own[begin : begin + capacity]
                    out["row"].append(lo + k)
                    out["piece"].append(piece)
                    out["start"].append(begin)
                    out["length"].append(len(cut))
                    out["ids_crc32"].append(zlib.crc32(cut.data))
        columns = [batch.column("doc_id").cast(pa.int64()).take(pa.array(out["row"], pa.int64()))]
        columns += [pa.array(out[k], pa.int32() if k == "piece" else pa.int64()) for k in ("piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: _pieces(batches, tokenizer_path, capacity), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram length -> count.

    Rows (length, first rank, end of ranks, first sequence, pieces a sequence, offset): the piece of that length with
    rank k takes sequence first + (k - rank) // pieces at offset + (k - rank) % pieces * length. Sequences with equal room
    are kept as ranges, so the work and the rows depend on the number of lengths, not of pieces: each range is
    filled at most log2(capacity) times, and each length makes three new ranges at most.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, how many)
    rooms: list[int] = []
    rows: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]

        def fill(left: int, first: int, n: int) -> None:
            nonlocal rank
            each = left // length
            full = min(n, (end - rank) // each)
            offset = capacity - left
            if full:
                rows.append((length, rank, rank + full * each, first, each, offset))
                rank += full * each
                put(left - each * length, first, full)
            if full < n and rank < end:
                some = end - rank
                rows.append((length, rank, end, first + full, each, offset))
                rank = end
                put(left - some * length, first + full, 1)
                full += 1
            put(left, first + full, n - full)

        at = bisect_left(rooms, length)
        fits = rooms[at:]
        for left in fits:
            if rank == end:
                break
            ranges = room.pop(left)
            rooms.remove(left)
            for k, (first, n) in enumerate(ranges):
                if rank == end:
                    for rest in ranges[k:]:
                        put(left, *rest)
                    break
                fill(left, first, n)
        if rank < end:
            n = -(-(end - rank) // (capacity // length))
            first, opened = opened, opened + n
            fill(capacity, first, n)
    return rows


def ranked(table: DataFrame, by: str, order: list[str], counts: dict[int, int]) -> DataFrame:
    """table with `rank` from 0 among the rows of equal `by` (counts: how many); a frequent value is dealt to many tasks by a salt."""
    rows = max(RANK_ROWS, math.isqrt(sum(counts.values())))
    salts = table.sparkSession.createDataFrame([(k, -(-n // rows)) for k, n in counts.items()], f"{by} long, salts int")
    salted = table.join(F.broadcast(salts), by).withColumn("salt", F.pmod(F.xxhash64(*order), F.col("salts")).cast("int")).drop("salts")
    before = Window.partitionBy(by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(by, "salt").agg(F.count("*").alias("n")).select(by, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(by, "salt").orderBy(*order)
    numbered = salted.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(offsets, [by, "salt"]).withColumn("rank", F.col("at") + F.col("before")).drop("salt", "at", "before")


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    table = stored(pieces(docs, tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity), "length long, from long, to long, first long, each long, base long")
    placed = ranked(table, "length", ["doc_id", "piece", "ids_crc32"], counts).join(F.broadcast(slots), "length").where("rank >= from and rank < to")
    step = F.col("rank") - F.col("from")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + F.pmod(step, F.col("each")) * F.col("length")).cast("long").alias("offset"))
