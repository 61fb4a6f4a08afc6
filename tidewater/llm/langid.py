"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's vector counts its lower-cased byte n-grams (1 to 3; all that is no letter is a space) in `WIDTH` hashed cells, damped by log, weighed by inverse
document frequency and scaled to length 1. Each language has up to `CLUSTERS` centroids by spherical k-means, as its texts are not all alike. The
language is that of the centroid with the greatest cosine. A text farther from it than `REJECT` of the language's own sample is
rejected: `identify` gives `und` for it, `predict` the language together with `rejected`.

Fitting takes at most `PER_LANGUAGE` texts of a language and `SAMPLE` in all (parameters), by hash of id, none of the held-out fold.
Whole texts are read. Null texts and texts without a letter are `und` with score 0, as is everything if nothing was learned. Rows with a null
language teach nothing. Repeated rows are predicted each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, remainder, slices

WIDTH = 1 << 13
CLUSTERS = 4
PER_LANGUAGE = 500
SAMPLE = 20_000
REJECT = 0.001
UNKNOWN = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def counts(text: pa.Array) -> np.ndarray:
    """n-gram counts of each text, one row of WIDTH cells each."""
    n = len(text)
    text = pa.concat_arrays([pc.utf8_lower(plain(text))])
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    if ends[-1] == ends[0]:
        return np.zeros((n, WIDTH), np.float32)
    data = _LETTER[np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]].astype(np.uint32)
    base = np.repeat(np.arange(n, dtype=np.int64) * WIDTH, np.diff(ends))
    blank = data == 32
    keys = [base[~blank] + data[~blank] % WIDTH]
    pair = data[:-1] * np.uint32(256) + data[1:]
    ok = (base[:-1] == base[1:]) & ~(blank[:-1] & blank[1:])
    cell = ((pair * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.int64)
    keys.append(base[:-1][ok] + cell[ok])
    three = pair[:-1] * np.uint32(256) + data[2:] if len(data) > 2 else np.zeros(0, np.uint32)
    cell = (((three ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)) >> np.uint32(19)).astype(np.int64)
    ok = (ok[:-1] & ok[1:]) & (base[: len(three)] == base[2:])
    keys.append(base[: len(three)][ok] + cell[ok])
    return np.bincount(np.concatenate(keys), minlength=n * WIDTH).reshape(n, WIDTH).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


class Model(NamedTuple):
    languages: list[str]
    of: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray  # the least cosine of each language

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language's index, cosine, rejected) of each text."""
        x = unit(np.log1p(counts(text)) * self.idf)
        cosine = x @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return self.of[best], score, score < self.limits[self.of[best]]


def cluster(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit rows; empty clusters go."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        own = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[own == j].sum(axis=0) for j in np.unique(own)]))
    return c


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1 << 20):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            row, cell = np.nonzero(x := counts(part.column("text")))
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)), pa.array(v)) for v in (cell.astype(np.int32), x[row, cell])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *lists], ["doc_id", "lang", "cell", "n"])


def spark_table(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A small table (one row a language) in the session of docs."""
    return docs.sparkSession.createDataFrame(rows, schema)


def fit(docs: DataFrame) -> Model | None:
    """The model learned from docs (doc_id, text, lang) outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder("doc_id") != 0))
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counted:
        return None
    each = max(2, min(PER_LANGUAGE, SAMPLE // len(counted)))
    # the lowest hashes of each language: a share that holds `each` but once in many millions goes on, so that a language's task has some thousand rows at any size
    share = spark_table(docs, [(r["lang"], min(1.0, (2 * each + 64) / r["n"])) for r in counted], "lang string, share double")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = known.join(F.broadcast(share), "lang").where((F.xxhash64("doc_id") / 2.0**64 + 0.5) <= F.col("share"))
    chosen = some.select("doc_id", "lang").withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= each).select("doc_id", "lang").distinct()
    got = known.join(F.broadcast(chosen), ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"]).select("doc_id", "lang", "text").mapInArrow(_sampled, "doc_id long, lang string, cell array<int>, n array<float>").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    lang = np.array(got.column("lang").to_pylist())
    cells, values = (pa.concat_arrays(got.column(c).chunks) for c in ("cell", "n"))
    at = cells.offsets.to_numpy()
    cells, values = cells.flatten().to_numpy(), np.log1p(values.flatten().to_numpy())
    at = at - at[0]
    idf = np.log((1 + len(lang)) / (1 + np.bincount(cells, minlength=WIDTH))).astype(np.float32) + np.float32(0.1)
    names, of, centroids, limits = [], [], [], []
    for k, name in enumerate(sorted(set(lang))):
        own = np.flatnonzero(lang == name)
        x = np.zeros((len(own), WIDTH), np.float32)
        for i, d in enumerate(own):
            x[i, cells[at[d] : at[d + 1]]] = values[at[d] : at[d + 1]]
        x = unit(x * idf)
        c = cluster(x, CLUSTERS)
        names.append(str(name))
        of += [k] * len(c)
        centroids.append(c)
        limits.append(float(np.quantile((x @ c.T).max(axis=1), REJECT)))
    return Model(names, np.array(of), np.concatenate(centroids), idf, np.array(limits))


PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every document (doc_id, text)."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = plain(part.column("text"))
                letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                if model is None:
                    name, score, rejected = np.full(len(text), UNKNOWN, object), np.zeros(len(text)), np.ones(len(text), bool)
                else:
                    best, score, rejected = model.predict(text)
                    name = np.where(letters, np.array(model.languages, object)[best], UNKNOWN)
                columns = [part.column("doc_id"), pa.array(name, pa.string()), pa.array(np.where(letters, score, 0), pa.float64()), pa.array(rejected | ~letters)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predicted, PREDICTED)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, score: rejected texts are `und`."""
    return predict(docs, model).select("doc_id", F.when(F.col("rejected"), UNKNOWN).otherwise(F.col("lang_pred")).alias("lang"), "score")
