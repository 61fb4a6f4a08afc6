"""What the operators share: the shared work folder, bounded Arrow slices, word tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts, as a Java and RE2 character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without one (tests) a new local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidewater-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one table in the shared folder; the folder goes when the driver's Python ends."""
    path = f"{work_dir(spark)}/tidewater-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nested(docs: DataFrame) -> DataFrame:
    """docs as one column `row`, so that no name of theirs meets another."""
    return docs.select(F.struct("*").alias("row"))


def unnested(rows: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of docs from rows (row), with this text; n_chars, if it is there, follows where the text has changed."""
    columns = []
    for field in docs.schema:
        own = F.col("row")[field.name]
        if field.name == "text":
            own = text.cast(field.dataType)
        elif field.name == "n_chars":
            own = F.when(changed, F.length(text)).otherwise(own).cast(field.dataType)
        columns.append(own.alias(field.name))
    return rows.select(*columns)


def remainder(doc_id: Column | str, divisor: int = 5) -> Column:
    """crc32(doc_id as text) mod divisor; 0 for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % divisor, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text of a slice takes at most limit bytes, or is one row."""
    for number, batch in enumerate(batches):
        if number % 16 == 15:
            release()
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < n:
            floor = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, floor + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Gives back what Arrow and the allocator keep of freed memory: Python workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def plain(array: pa.Array) -> pa.Array:
    """The text with null as empty."""
    return pc.fill_null(array, "")


def words(array: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, its row, the distinct words) of a text column; codes index the distinct words."""
    text = plain(array)
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    encoded = flat.dictionary_encode()
    code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    distinct = encoded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:  # white space at an end of a text leaves an empty word
        keep = code != empty
        code, row = code[keep], row[keep]
    return code, row, distinct


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def rows_of(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n rows in a sorted row column."""
    return np.searchsorted(row, np.arange(n + 1))
