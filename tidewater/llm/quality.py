"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its hashed lower-cased words with counts scaled to length 1, one bin of each structure statistic (shares of upper case,
digits, marks, white space and non-ASCII bytes, word length, repetition, lines, words), and one bin of n_chars. The score is
sigmoid(b + sum w x + 1/2 sum_f ((sum v x)^2 - sum v^2 x^2)): pairwise interactions of rank `RANK` in time linear in the vector.

Fitting takes at most `SAMPLE` labelled documents (parameter), by hash of id, those of the held-out fold never. Scoring reads whole
texts. Null and empty texts have their structure bins only and get a score all the same. A null n_chars or a table without it has a bin of its own. Repeated
label rows count once, with the best label; null labels are ignored; without labels of both kinds the score is their share (0.5
without any). Repeated documents are scored each. Extra columns are ignored (`score`) or kept (`keep`). Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashes, plain, release, remainder, slices, words

BUCKETS = 1 << 16
RANK = 8
SAMPLE = 8000
EPOCHS = 12
THRESHOLD = 0.3
#: Upper ends of the statistics' bins.
SHARES = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.6])
COUNTS = np.array([0, 1, 3, 7, 15, 31, 63, 127, 255, 511, 1023, 4095, 16383])
LENGTHS = np.array([0, 2, 3, 4, 4.5, 5, 5.5, 6, 7, 9, 12, 20])
BINS = 16
STATISTICS = 11
WIDTH = BUCKETS + STATISTICS * BINS

_KIND = np.zeros(256, np.uint8)  # 0: lower case and others
_KIND[list(range(65, 91))] = 1
_KIND[list(range(48, 58))] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[128:] = 4
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'"]] = 5


def vectors(text: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of each document, rows ascending."""
    n = len(text)
    text = pa.concat_arrays([plain(text)])
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]] if text.buffers()[2] and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends -= ends[0]
    kind = _KIND[data]
    size = np.maximum(np.diff(ends), 1)

    def share(of: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(of, dtype=np.int32)))
        return np.diff(total[ends]) / size

    code, row, distinct = words(text)
    own = np.bincount(row, minlength=n)
    pair, count = np.unique(row.astype(np.int64) * (len(distinct) + 1) + code, return_counts=True)
    of = pair // (len(distinct) + 1)
    kinds = np.bincount(of, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, of, count)
    lines = share(data == 10)
    chars = np.asarray(n_chars.to_numpy(zero_copy_only=False), np.float64)
    bins = [
        *(np.searchsorted(SHARES, share(kind == k)) for k in (1, 2, 3, 4, 5)),
        np.searchsorted(LENGTHS, size / np.maximum(own, 1)),
        np.searchsorted(COUNTS, own),
        np.searchsorted(SHARES, 1 - kinds / np.maximum(own, 1)),
        np.searchsorted(SHARES, most / np.maximum(own, 1)),
        np.searchsorted(SHARES, lines),
        np.where(np.isnan(chars), BINS - 1, np.searchsorted(COUNTS, np.nan_to_num(chars))),
    ]
    bucket = (hashes(distinct) % np.uint64(BUCKETS)).astype(np.int64)
    pair, at = np.unique(of * BUCKETS + bucket[pair % (len(distinct) + 1)], return_inverse=True)
    value = np.bincount(at, weights=count, minlength=len(pair))
    of = pair // BUCKETS
    norm = np.sqrt(np.bincount(of, weights=value * value, minlength=n))
    rows = np.concatenate([of, *[np.arange(n)] * STATISTICS])
    feature = np.concatenate([pair % BUCKETS, *(BUCKETS + k * BINS + np.minimum(b, BINS - 1) for k, b in enumerate(bins))])
    values = np.concatenate([value / norm[of], np.ones(n * STATISTICS)])
    order = np.argsort(rows, kind="stable")
    return rows[order], feature[order], values[order].astype(np.float32)


class Machine:
    """Bias, weights and factors."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def score(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(row, self.weights[feature] * value, n)
        for f in range(self.factors.shape[1]):
            part = self.factors[feature, f] * value
            z += 0.5 * (np.bincount(row, part, n) ** 2 - np.bincount(row, part * part, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(row: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss in small batches; the factors start near zero."""
    n = len(label)
    rng = np.random.default_rng(seed)
    base = (label.sum() + 0.5) / (n + 1)
    machine = Machine(float(np.log(base / (1 - base))), np.zeros(WIDTH, np.float32), rng.normal(0, 0.03, (WIDTH, RANK)).astype(np.float32))
    if n == 0 or label.min() == label.max():
        machine.factors[:] = 0
        if n:
            machine.bias = 30.0 if label[0] else -30.0
        return machine
    starts = np.searchsorted(row, np.arange(n + 1))
    seen_w, seen_v = np.full(WIDTH, 1e-2), np.full((WIDTH, RANK), 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 128):
            docs = order[at : at + 128]
            entries = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
            r = np.repeat(np.arange(len(docs)), starts[docs + 1] - starts[docs])
            j, x = feature[entries], value[entries]
            used, local = np.unique(j, return_inverse=True)
            v = machine.factors[j] * x[:, None]
            sums = np.stack([np.bincount(r, v[:, f], len(docs)) for f in range(RANK)], axis=1)
            error = machine.score(r, j, x, len(docs)) - label[docs]
            g = error[r] * x
            gw = np.bincount(local, g, len(used)) / len(docs) + 1e-5 * machine.weights[used]
            each = g[:, None] * (sums[r] - v)
            gv = np.stack([np.bincount(local, each[:, f], len(used)) for f in range(RANK)], axis=1) / len(docs) + 1e-5 * machine.factors[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            machine.weights[used] -= (0.3 * gw / np.sqrt(seen_w[used])).astype(np.float32)
            machine.factors[used] -= (0.05 * gv / np.sqrt(seen_v[used])).astype(np.float32)
            machine.bias -= 0.05 * float(error.mean())
    return machine


def _inputs(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), chars.alias("n_chars"))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=4 << 20):
        row, feature, value = vectors(batch.column("text"), batch.column("n_chars"))
        at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (feature.astype(np.int32), value)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "feature", "value"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine learned from labels (doc_id, quality) of docs outside the held-out fold."""
    known = labels.where((F.col("doc_id").isNotNull()) & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("label"))
    chosen = known.where(remainder("doc_id") != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # broadcast: at most sample ids
    rows = _inputs(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text", "n_chars")
    got = rows.mapInArrow(_vectors, "doc_id long, label int, feature array<int>, value array<float>").toArrow().sort_by("doc_id").combine_chunks()
    label = got.column("label").to_numpy().astype(np.float64)
    if not len(label):
        return train(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32), label)
    lists = [pa.concat_arrays(got.column(c).chunks) for c in ("feature", "value")]
    row = np.repeat(np.arange(len(label)), np.diff(lists[0].offsets.to_numpy()))
    machine = train(row, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), label)
    del got, lists, row
    release()
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            p = machine.score(*vectors(batch.column("text"), batch.column("n_chars")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return _inputs(docs).mapInArrow(scored, "doc_id long, score double")


def keep(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, all their columns."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            n = batch.schema.get_field_index("n_chars")
            chars = batch.column(n).cast(pa.float64()) if n >= 0 else pa.nulls(batch.num_rows, pa.float64())
            p = machine.score(*vectors(batch.column("text").cast(pa.string()), chars), batch.num_rows)
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(kept, docs.schema)
