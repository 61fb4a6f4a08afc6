"""A Katz backoff language model of any order over the whole corpus, its counts in tables partitioned by context.

A text is its words, lower-cased, and one end. Words are known by their whole 64-bit hash, contexts by that of their words (before a text stand `order` - 1 begins).

    P(word | context) = d_r r / D(context)                          if the n-gram was counted r times,
                        alpha(context) P(word | shorter context)    otherwise,
    P(word)           = (c + 1/2) / (N + (V + 1) / 2)               with N tokens, V different words, and one place for unknown words.

d_r are Good-Turing discounts of each order for r up to `KATZ` (`discounts`). D is the sum of a context's counts, and one more where no count is small enough for a
discount. alpha is exact: what the discounts leave, over the shorter context's mass of the words not seen; it is 1 for a context never seen.

Evaluated from the shortest context up. A chunk of at most `CHUNK_BYTES` of texts is turned into its distinct n-grams of the highest order, each with its training count
and documents, and these are dealt by word, then by context of one word, of two, and so on. A part holds all n-grams of its contexts: it counts them
(a stored table of each order), and once the counts of counts are known gives each its probability, which the next order's alpha and backoff need. What a part sends to another is one row,
whatever number of chunks its n-grams are of, so rows grow with the pairs of parts, not with these times the chunks. At the end a chunk gets the sums of its documents, from each part as one row. Words are dealt only if they are not among the `HOT` most frequent, whose counts every task knows.

Skew: an n-gram reaches its part once a chunk, with at most `SHIPPED` documents; where more documents of a chunk hold it, they stay with the chunk, and its probability goes back. A
context whose last word has more than `SPLIT` tokens is dealt to several parts by word, and these share their sums. Parts are made for `PART_BYTES` of text each.

Null and empty texts are one end. Repeated rows are counted and scored each. Without training rows all counts are 0, and the formulas hold. An empty table gives an empty
result. Extra columns are ignored. Documents keep their place in a chunk when a task is run again if the input's order is stable, as a file scan's is.
Logarithms are added as multiples of 2^-30, so sums are the same in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashes, mix, ragged, rows_of, slices, stored, words

ORDER = 2
KATZ = 5
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 1 << 15
PART_BYTES = 12 << 20
SPLIT = 1 << 19
HOT = 1 << 18
SHIPPED = 8
ONE = 1 << 30
#: Sums of probabilities that parts share are multiples of this.
FINE = float(1 << 60)
DEALT = "part int, chunk long, data binary"
SHARED = ["key", "total", *(f"n{r}" for r in range(1, KATZ + 1)), "lower"]
COUNTED = pa.schema([("part", pa.int32()), ("chunks", pa.list_(pa.int64())), ("data", pa.list_(pa.binary())), ("repeats", pa.list_(pa.int64())), ("shared", pa.list_(pa.struct([(c, pa.int64()) for c in SHARED])))])
COUNTED_SQL = f"part int, chunks array<long>, data array<binary>, repeats array<long>, shared array<struct<{', '.join(f'{c}: long' for c in SHARED)}>>"
SCORED = "doc_id long, n_tokens long, n_known long, base long, score long"

FIELDS = ("key", "many", "code", "cold", "p", "count", "docs", "doc", "times", "slot", "deals", "above", "own", "known", "base", "ids", "nulls", "tokens", "chunks", "of")
HASHED = ("key", "cold", "above", "ids")


def end_hash() -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\n")  # no word has white space


def begin_hash() -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\n\n")


def discounts(repeats: list[int]) -> np.ndarray:
    """d_0 to d_(KATZ + 1) from how many n-grams were counted 1, 2, ... KATZ + 1 times; (r - 1/2) / r where Good-Turing gives none in (0, 1)."""
    n = [0, *repeats]
    d = np.ones(KATZ + 2)
    tail = (KATZ + 1) * n[KATZ + 1] / n[1] if n[1] else 1.0
    for r in range(1, KATZ + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of FIELDS as byte planes, compressed unless they are tiny; `key` by its differences (it ascends)."""
    import zstandard

    widths, sizes, body = [], [], []
    for name in FIELDS:
        a = arrays.get(name)
        if a is None or not len(a):
            widths.append(0)
            sizes.append(0)
            continue
        if a.dtype.kind == "f":
            width, planes = 9, np.ascontiguousarray(a, np.float64).view(np.uint8).reshape(-1, 8).T
        else:
            a = np.ascontiguousarray(a).astype(np.uint64)
            if name == "key":
                a = np.diff(a, prepend=np.uint64(0))
            width = max(1, (int(a.max()).bit_length() + 7) // 8)
            planes = a.view(np.uint8).reshape(-1, 8).T[:width]
        widths.append(width)
        sizes.append(len(a))
        body.append(np.ascontiguousarray(planes).tobytes())
    count = np.array(sizes, np.uint64)
    size = next(s for s in (1, 2, 4, 8) if max(sizes) < 1 << 8 * s)
    data = bytes([size, *widths]) + count.astype(f"<u{size}").tobytes() + b"".join(body)
    return b"\0" + data if len(data) < 200 else b"\1" + zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]) if data[0] else data[1:], np.uint8)
    size, n = int(raw[0]), len(FIELDS)
    widths, sizes = raw[1 : n + 1], raw[n + 1 : n + 1 + n * size].view(f"<u{size}").astype(np.int64)
    at, out = n + 1 + n * size, {}
    for name, width, length in zip(FIELDS, widths.tolist(), sizes.tolist(), strict=True):
        planes = np.zeros((length, 8), np.uint8)
        real = min(width, 8)
        planes[:, :real] = raw[at : at + real * length].reshape(real, length).T
        at += real * length
        own = planes.view(np.float64 if width == 9 or name == "p" else np.uint64).ravel()
        if name == "key":
            own = np.cumsum(own, dtype=np.uint64)
        out[name] = own if name in HASHED or own.dtype.kind == "f" else own.astype(np.int64)
    return out


@dataclass
class Frequent:
    """The most frequent words by their hashes, and the formula of P(word)."""

    word: np.ndarray
    count: np.ndarray
    mass: int  # 2 N + V + 1
    begins: int

    def __post_init__(self) -> None:
        self.order = np.argsort(self.word)
        self.sorted = self.word[self.order]

    def __reduce__(self) -> tuple:
        return Frequent, (self.word, self.count, self.mass, self.begins)

    def code(self, own: np.ndarray) -> np.ndarray:
        """1 and the place of a word in the list; 0 where it is not in it."""
        if not len(self.word):
            return np.zeros(len(own), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, own), len(self.word) - 1)
        return np.where(self.sorted[at] == own, self.order[at] + 1, 0)

    def p(self, count: np.ndarray) -> np.ndarray:
        return (2 * count + 1) / self.mass

    def deals(self, context: np.ndarray) -> np.ndarray:
        """To how many parts a context that ends in this word is dealt."""
        code = self.code(context)
        count = np.where(code > 0, self.count[code - 1], 0) if len(self.count) else np.zeros(len(context), np.int64)
        return 1 + np.where(context == np.uint64(begin_hash()), self.begins, count) // SPLIT


@dataclass
class Grams:
    """Distinct n-grams of each of some chunks: by key (the word, or the context), with what the orders above need."""

    key: np.ndarray
    w: np.ndarray
    code: np.ndarray
    p: np.ndarray  # of the order below
    count: np.ndarray  # in training rows
    docs: np.ndarray  # documents that travel with it; 0: they stay with the chunk
    slot: np.ndarray
    deals: np.ndarray
    chunk: np.ndarray
    above: np.ndarray  # the longer contexts
    doc: np.ndarray
    times: np.ndarray

    def take(self, at: np.ndarray) -> Grams:
        inner = ragged((np.cumsum(self.docs) - self.docs)[at], self.docs[at])
        return Grams(*(x[at] for x in (self.key, self.w, self.code, self.p, self.count, self.docs, self.slot, self.deals, self.chunk)), self.above[:, at], self.doc[inner], self.times[inner])

    def packed(self, n: int) -> bytes:
        first = np.flatnonzero(_new(self.key))
        many = np.diff(first, append=len(self.key))
        own = {}
        if n > 1:
            cold = self.code == 0
            own = {"code": self.code, "cold": self.w[cold], "p": self.p[cold] if n == 2 else self.p}
        own["chunks"], of = _distinct(self.chunk)
        if len(own["chunks"]) > 1:
            own["of"] = of
        return pack(key=self.key[first], many=many, count=self.count, docs=self.docs, doc=self.doc, times=self.times, slot=self.slot[self.docs == 0], deals=self.deals - 1, above=self.above.ravel(), **own)


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _distinct(chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different chunks, and the place of each row's."""
    if len(chunk) and (chunk == chunk[0]).all():
        return chunk[:1], np.zeros(len(chunk), np.int64)
    return np.unique(chunk, return_inverse=True)


def joined(grams: list[Grams]) -> Grams:
    if len(grams) == 1:
        return grams[0]
    return Grams(*(np.concatenate([getattr(g, f.name) for g in grams], axis=-1) for f in fields(Grams)))


def opened(data: bytes, n: int, order: int, frequent: Frequent) -> Grams:
    x = unpack(data)
    key = np.repeat(x["key"], x["many"])
    size = len(key)
    if n == 1:
        w, code, p = key, np.zeros(size, np.int64), np.zeros(size)
    else:
        code = x["code"]
        hot = code > 0
        w = np.empty(size, np.uint64)
        w[hot], w[~hot] = frequent.word[code[hot] - 1], x["cold"]
        p = x["p"]
        if n == 2:
            p = np.empty(size)
            p[hot], p[~hot] = frequent.p(frequent.count[code[hot] - 1]), x["p"]
    slot = np.full(size, -1, np.int32)
    slot[x["docs"] == 0] = x["slot"]
    chunk = x["chunks"][x["of"]] if len(x["of"]) else np.broadcast_to(x["chunks"], size)
    small = [a.astype(np.int32) for a in (code, x["count"], x["docs"], x["deals"] + 1, x["doc"], x["times"])]  # a part's n-grams are held together
    code, count, docs, deals, doc, times = small
    return Grams(key, w, code, p, count, docs, slot, deals, chunk, x["above"].reshape(order - n, size), doc, times)


def tokens(text: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row, the words' hashes, codes of each token's word and of those before it); codes index the hashes, of which the last two are end and begin."""
    code, row, known = words(text)
    n = len(text)
    h = np.append(hashes(known), np.array([end_hash(), begin_hash()], np.uint64))
    at = rows_of(row, n)
    own, rows = np.empty(len(code) + n, np.int64), np.empty(len(code) + n, np.int64)
    place, ends = np.arange(len(code)) + row, at[1:] + np.arange(n)
    own[place], own[ends] = code, len(h) - 2
    rows[place], rows[ends] = row, np.arange(n)
    position = np.arange(len(own)) - (at[:-1] + np.arange(n))[rows]
    codes = [own]
    for k in range(1, order):
        before = np.full(len(own), len(h) - 1)
        inside = np.flatnonzero(position >= k)
        before[inside] = own[inside - k]
        codes.append(before)
    return rows, h, codes


def contexts(h: np.ndarray, before: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the contexts of one word, of two, ... from the codes of the words before."""
    out = [h[c] for c in before[:1]]
    for c in before[1:]:
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + h[c]))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=CHUNK_BYTES):
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            yield batch.slice(at, CHUNK_ROWS)


def distinct(keys: list[np.ndarray], size: int, row: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a place, training count, number of documents) of each distinct row of keys below size, and (document, times) of their documents."""
    merged = keys[:1]
    room = (1 << 62) // size
    for k in keys[1:]:  # as few keys as 62 bits allow
        if room >= size:
            merged[-1], room = merged[-1] * size + k, room // size
        else:
            merged, room = [*merged, k], (1 << 62) // size
    order = np.argsort(merged[0], kind="stable") if len(merged) == 1 else np.lexsort(merged[::-1])  # stable: documents ascend
    new = _new(*(k[order] for k in merged))
    own = row[order]
    start = np.flatnonzero(new | _new(own))
    gram = (np.cumsum(new) - 1)[start]
    doc, times = own[start], np.diff(start, append=len(order))
    n = int(new.sum())
    count = np.bincount(gram, times * training[doc], n).astype(np.int64)
    return order[np.flatnonzero(new)], count, np.bincount(gram, minlength=n), doc, times


def _grams(chunk: int, row: np.ndarray, h: np.ndarray, codes: list[np.ndarray], training: np.ndarray, frequent: Frequent, hot: bool) -> Grams:
    """A chunk's n-grams whose word is frequent (by context), or of those whose word is not (by word)."""
    listed = frequent.code(h)
    some = np.flatnonzero((listed[codes[0]] > 0) == hot)
    codes = [c[some] for c in codes]
    at, count, docs, doc, times = distinct(codes, len(h), row[some], training)
    own, *before = (c[at] for c in codes)
    above = contexts(h, before)
    deals = frequent.deals(h)[before[0]] if before else np.ones(len(at), np.int64)
    key = above.pop(0) if hot else h[own]
    slot = np.full(len(at), -1)
    if hot:
        many = docs > SHIPPED
        slot[many] = np.arange(int(many.sum()))
    return Grams(key, h[own], listed[own], np.zeros(len(at)), count, docs, slot, deals, np.full(len(at), chunk), np.array(above, np.uint64).reshape(len(above), len(at)), doc, times)


def _kept(grams: Grams, stay: bool) -> Grams:
    """The n-grams with the documents that stay with the chunk (these alone), or with those that travel."""
    some = grams.slot >= 0
    if stay:
        return grams.take(np.flatnonzero(some))
    inner = np.repeat(~some, grams.docs)
    return replace(grams, docs=np.where(some, 0, grams.docs), doc=grams.doc[inner], times=grams.times[inner])


def _aside(chunk: int) -> int:
    """Where the documents of a chunk, and sums over them, wait: below 0, as no part of n-grams is."""
    return -1 - int(mix(np.array([chunk], np.uint64))[0] & np.uint64(0x3FFFFFFF))


def _deal(grams: Grams, n: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """N-grams by part, a row each."""
    deal = mix(grams.w ^ np.uint64(0x9E3779B97F4A7C15)) % grams.deals.astype(np.uint64) if n > 1 else np.uint64(0)
    part = (mix(grams.key + deal * np.uint64(0xD1B54A32D192ED03)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(grams.key)
    order = order[np.argsort(part[order].astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")]
    start = np.flatnonzero(_new(part[order]))
    for a, b in zip(start, start + np.diff(start, append=len(order)), strict=True):
        yield int(part[order[a]]), 0, grams.take(order[a:b]).packed(n)


def _rows(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT in batches of bounded size."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[2])
        if size > 16 << 20:
            yield _batch(some)
            some, size = [], 0
    if some:
        yield _batch(some)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["part", "chunk", "data"])


def _send(batches: Iterator[pa.RecordBatch], order: int, frequent: Frequent, hot: bool, parts: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of each chunk; with the frequent words also its documents, as a part of their own."""

    def rows() -> Iterator[tuple[int, int, bytes]]:
        for batch in _chunks(batches):
            chunk, training = batch.column("row")[0].as_py(), batch.column("training").to_numpy(zero_copy_only=False).astype(np.int64)
            row, h, codes = tokens(batch.column("text"), order)
            grams = _grams(chunk, row, h, codes, training, frequent, hot) if order > 1 or not hot else None
            if hot:
                yield _aside(chunk), chunk, _documents(batch.column("doc_id"), row, frequent.code(h), codes[0], frequent, _kept(grams, True) if grams else None)
            if grams:
                yield from _deal(_kept(grams, False), 2 if hot else 1, parts)

    return _rows(rows())


def _documents(doc_id: pa.Array, row: np.ndarray, listed: np.ndarray, own: np.ndarray, frequent: Frequent, stay: Grams | None) -> bytes:
    """A chunk's documents with their sums over frequent words, and the n-grams whose documents stay."""
    n, size = len(doc_id), len(frequent.word) + 1
    code = listed[own]
    hot = np.flatnonzero(code)
    at, times = np.unique(row[hot] * size + code[hot], return_counts=True)
    base = np.zeros(n, np.int64)
    if len(at):
        np.add.at(base, at // size, _fixed(frequent.p(frequent.count[at % size - 1]), times))
    kept = {"docs": stay.docs, "doc": stay.doc, "times": stay.times} if stay else {}
    ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return pack(ids=ids, nulls=doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.int64), tokens=np.bincount(row, minlength=n), known=np.bincount(row[hot], minlength=n), base=base, **kept)


def _fixed(p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """-log10 times each, in multiples of 1 / ONE."""
    return np.rint(-np.log10(p) * times * ONE).astype(np.int64)


def _sums(doc: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The documents, and the sum of each value over them."""
    own, at = np.unique(doc, return_inverse=True)
    out = [own]
    for v in values:
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, v)
        out.append(total)
    return out


def _by_chunk(chunk: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each chunk with the places of its n-grams and those of their documents."""
    chunks, of = _distinct(chunk)
    order, first = np.argsort(of, kind="stable"), np.cumsum(docs) - docs
    ends = np.cumsum(np.bincount(of, minlength=len(chunks)))
    for c, a, b in zip(chunks.tolist(), np.append(0, ends[:-1]), ends, strict=True):
        at = order[a:b]
        yield c, at, ragged(first[at], docs[at])


def _words(table: pa.Table, order: int, frequent: Frequent, parts: int) -> pa.Table:
    """A part of the words: their probabilities, and the sums of their documents; goes on to the contexts of one word."""
    g = joined([opened(d, 1, order, frequent) for d in table.column("data").to_pylist()])
    own, at = np.unique(g.key, return_inverse=True)
    count = np.zeros(len(own), np.int64)
    np.add.at(count, at, g.count)
    r = count[at]
    p = frequent.p(r)
    rows = []
    for chunk, at, inner in _by_chunk(g.chunk, g.docs):
        docs, times = g.docs[at], g.times[inner]
        doc, known, base = _sums(g.doc[inner], np.repeat(r[at] > 0, docs) * times, _fixed(np.repeat(p[at], docs), times))
        rows.append((_aside(chunk), chunk, pack(own=doc, known=known, base=base)))
    if order > 1:
        rows += _deal(replace(g, key=g.above[0], above=g.above[1:], p=p), 2, parts)
    return pa.Table.from_batches([_batch(rows)])


def _types(grams: list[Grams]) -> tuple[np.ndarray, ...]:
    """The n-grams of a part over all chunks: (type of each, count and key of each type, its lower probability; each key, and whether it is shared)."""
    keys, key = np.unique(np.concatenate([g.key for g in grams]), return_inverse=True)
    code = np.concatenate([g.code for g in grams])
    cold = np.flatnonzero(code == 0)
    others, at = np.unique(np.concatenate([g.w[g.code == 0] for g in grams]), return_inverse=True)
    code[cold] = -1 - at
    size = int(code.max()) + len(others) + 1
    code += len(others)
    both = key * size + code  # below 2^62: keys and words of one part
    order = np.argsort(both, kind="stable")
    new = _new(both[order])
    first = np.flatnonzero(new)
    count = np.add.reduceat(np.concatenate([g.count for g in grams])[order], first, dtype=np.int64)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    shared = np.zeros(len(keys), bool)
    shared[key[np.concatenate([g.deals for g in grams]) > 1]] = True
    return kind, count, key[order[first]], np.concatenate([g.p for g in grams])[order[first]], keys, shared


def _count(table: pa.Table, n: int, order: int, frequent: Frequent) -> pa.Table:
    """One row of a part: all that came to it, how many n-grams were counted 1, 2, ... times, and the sums of contexts that lie in other parts too."""
    data, part = table.column("data").to_pylist(), table.column("part")[0].as_py()
    head = [pa.array([part], pa.int32()), pa.array([table.column("chunk").to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.list_(pa.binary()))]
    if part < 0:  # documents, and sums over them
        return pa.table([*head, pa.array([[]], pa.list_(pa.int64())), pa.array([[]], COUNTED.field("shared").type)], schema=COUNTED)
    _, count, key_of, lower, key, shared = _types([opened(d, n, order, frequent) for d in data])
    repeats = [int((count == r).sum()) for r in range(1, KATZ + 2)]
    stat = _context_sums(count, key_of, lower, len(key))
    stat["lower"] = np.zeros(len(key), np.int64)
    np.add.at(stat["lower"], key_of, np.where(count > 0, np.rint(lower * FINE), 0).astype(np.int64))
    at = np.flatnonzero(shared)
    fields = [pa.array(key[at].view(np.int64)), *(pa.array(stat[c][at].astype(np.int64)) for c in SHARED[1:])]
    sums = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.StructArray.from_arrays(fields, SHARED))
    return pa.table([*head, pa.array([repeats], pa.list_(pa.int64())), sums], schema=COUNTED)


def _context_sums(count: np.ndarray, key_of: np.ndarray, lower: np.ndarray, n: int) -> dict[str, np.ndarray]:
    out = {"total": np.bincount(key_of, count, n), "lower": np.bincount(key_of, np.where(count > 0, lower, 0.0), n)}
    for r in range(1, KATZ + 1):
        out[f"n{r}"] = np.bincount(key_of[count == r], minlength=n)
    return out


def probabilities(grams: list[Grams], shared: dict[str, np.ndarray], discount: np.ndarray) -> np.ndarray:
    """P(word | context) of each n-gram of a part."""
    kind, count, key_of, lower, key, _ = _types(grams)
    stat = _context_sums(count, key_of, lower, len(key))
    if len(shared["key"]):
        at = np.searchsorted(key, shared["key"])
        for c in stat:
            stat[c] = stat[c].astype(np.float64)
            stat[c][at] = shared[c] / FINE if c == "lower" else shared[c]
    left = sum(stat[f"n{r}"] * r * (1 - discount[r]) for r in range(1, KATZ + 1))
    divisor = np.where(left > 0, stat["total"], stat["total"] + 1)
    alpha = np.where(stat["total"] > 0, np.where(left > 0, left, 1.0) / divisor / (1 - stat["lower"]), 1.0)
    p = np.where(count > 0, discount[np.minimum(count, KATZ + 1)] * count / divisor[key_of], alpha[key_of] * lower)
    return p[kind]


def _evaluate(batches: Iterator[pa.RecordBatch], n: int, order: int, frequent: Frequent, discount: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Each part's probabilities: to the parts of the next order, or as sums to the chunks."""

    def rows() -> Iterator[tuple[int, int, bytes]]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, chunks, data = (batch.column(c)[i].as_py() for c in ("part", "chunks", "data"))
                if part < 0:
                    yield from ((part, chunk, own) for chunk, own in zip(chunks, data, strict=True))
                    continue
                given = batch.column("shared")[i].as_py() or []
                shared = {c: np.array([x[c] for x in given], np.int64) for c in SHARED}
                shared["key"] = shared["key"].view(np.uint64)
                grams = [opened(d, n, order, frequent) for d in data]
                p = probabilities(grams, shared, discount)
                if n < order:
                    g = joined(grams)
                    del data, grams
                    yield from _deal(replace(g, key=g.above[0], above=g.above[1:], p=p), n + 1, parts)
                else:
                    few = [[getattr(g, f) for g in grams] for f in ("chunk", "docs", "slot", "doc", "times")]
                    del data, grams
                    yield from _answers(p, *map(np.concatenate, few))

    return _rows(rows())


def _answers(p: np.ndarray, chunk: np.ndarray, docs: np.ndarray, slot: np.ndarray, doc: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """A part's row for each chunk: the sums of its documents, and the probabilities of n-grams whose documents stayed."""
    for c, at, inner in _by_chunk(chunk, docs):
        own, total = _sums(doc[inner], _fixed(np.repeat(p[at], docs[at]), times[inner]))
        stay = at[docs[at] == 0]
        yield 0, c, pack(doc=own, times=total, slot=slot[stay], p=p[stay])


def _finish(table: pa.Table, order: int) -> pa.Table:
    """The documents of a chunk with all their sums."""
    data = [unpack(d) for d in table.column("data").to_pylist()]
    own = next(x for x in data if len(x["ids"]))
    known, base = own["known"], own["base"]
    score, p = np.zeros(len(base), np.int64), np.ones(len(own["docs"]))
    for x in data:
        if x is not own:
            np.add.at(known, x["own"], x["known"])
            np.add.at(base, x["own"], x["base"])
            np.add.at(score, x["doc"], x["times"])
            p[x["slot"]] = x["p"]
    np.add.at(score, own["doc"], _fixed(np.repeat(p, own["docs"]), own["times"]))
    ids = pa.array(own["ids"].view(np.int64), mask=own["nulls"].astype(bool))
    return pa.table([ids, own["tokens"], known, base, score if order > 1 else base], schema=pa.schema([(c.split()[0], pa.int64()) for c in SCORED.split(", ")]))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word is in a chunk."""
    for batch in _chunks(batches):
        _, h, codes = tokens(batch.column("text"), 1)
        count = np.bincount(codes[0], minlength=len(h))
        yield pa.RecordBatch.from_arrays([pa.array(h[count > 0].view(np.int64)), pa.array(count[count > 0])], ["word", "count"])


def counted(dealt: DataFrame, n: int, order: int, frequent: Frequent) -> DataFrame:
    """The stored table of an order: a row a part (COUNTED)."""
    return stored(dealt.groupBy("part").applyInArrow(lambda t: _count(t, n, order, frequent), COUNTED_SQL), f"grams{n}")


def _with_shared(table: DataFrame) -> DataFrame:
    """The table with the sums of its shared contexts over all their parts."""
    each = table.select("part", F.explode("shared").alias("s")).select("part", "s.*")
    whole = each.groupBy("key").agg(*(F.sum(c).alias(c) for c in SHARED[1:]))
    given = stored(each.select("part", "key").join(whole, "key").groupBy("part").agg(F.sort_array(F.collect_list(F.struct(*SHARED))).alias("shared")), "shared")
    return table.select("part", "chunks", "data").join(given, "part", "left")


def score(docs: DataFrame, training: Column | str, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text), by the model of the rows for which training holds."""
    known = F.coalesce(F.expr(training) if isinstance(training, str) else training, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), known.alias("training"))
    vocabulary = stored(texts.where("training").select("text").mapInArrow(_tally, "word long, count long").groupBy("word").agg(F.sum("count").alias("count")), "words")
    size, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    top = vocabulary.orderBy(F.desc("count"), "word").limit(HOT).toArrow()
    rows, width = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()
    frequent = Frequent(top.column("word").to_numpy().view(np.uint64), top.column("count").to_numpy(), 2 * total + size + 1, rows)
    parts = max(1, -(-width // PART_BYTES))
    texts = texts.withColumn("row", F.monotonically_increasing_id())

    answers = texts.mapInArrow(lambda b: _send(b, order, frequent, False, max(1, parts // 4)), DEALT).groupBy("part").applyInArrow(lambda t: _words(t, order, frequent, parts), DEALT)
    answers = answers.unionByName(texts.mapInArrow(lambda b: _send(b, order, frequent, True, parts), DEALT))
    for n in range(2, order + 1):
        table = counted(answers, n, order, frequent)
        repeats = table.select(*(F.coalesce(F.sum(F.get("repeats", F.lit(r))), F.lit(0)) for r in range(KATZ + 1))).first()
        answers = _with_shared(table).mapInArrow(_evaluator(n, order, frequent, discounts([int(x) for x in repeats]), parts), DEALT)
    scored = answers.groupBy("chunk").applyInArrow(lambda t: _finish(t, order), SCORED)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") / -ONE).alias("base_score"), (F.col("score") / -ONE).alias("score"))


def _evaluator(n: int, order: int, frequent: Frequent, discount: np.ndarray, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _evaluate(batches, n, order, frequent, discount, parts)
