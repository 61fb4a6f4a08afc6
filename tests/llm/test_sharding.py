"""Interleaved shards held against a plain version, with the mixture of each shard and rows of every odd kind."""

import hashlib
import zlib
from collections import Counter

import pytest

from tidewater.llm import queries, sharding

SCHEMA = "doc_id long, text string, source string, shard string, slot string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 5) for r in rows], SCHEMA)


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute(rows, shards):
    """(doc_id, text, source, shard, slot): sorted and cut in one list."""
    sizes = Counter(s for *_, s in rows)
    order = []
    for source in sizes:
        own = sorted((digest(f"{sharding.SEED}:{'' if d is None else d}:{t or ''}"), d, t) for d, t, s in rows if s == source)
        start = int(digest(source or "")[:8], 16) / 2**32
        order += [((r + start) / sizes[source], source is None, source or "", d, t) for r, (_, d, t) in enumerate(own)]
    order.sort(key=lambda o: o[:3])
    found, slots = [], Counter()
    for at, (_, lacking, source, d, t) in enumerate(order):
        k = at * shards // len(order)
        found.append((d, t, None if lacking else source, k, slots[k]))
        slots[k] += 1
    return sorted(found, key=repr)


def placed(df):
    return sorted(((r.row.doc_id, r.row.text, r.row.source, r.shard, r.slot) for r in df.collect()), key=repr)


ROWS = [(i, f"text {i}", ("hot", "hot", "b", "c", None, "")[i % 6]) for i in range(1000)] + [(5000 + i, None if i % 2 else "", f"single {i}") for i in range(20)] + [(7, "other text of 7", "b"), (None, "é" * 50_000, None)]


@pytest.mark.parametrize("shards", [1, 8, 13])
def test_as_plain(spark, shards):
    df = frame(spark, ROWS).repartition(7)
    assert placed(sharding.shard(df, shards)) == brute(ROWS, shards)


def test_shards_match_the_mixture(spark):
    found = sharding.shard(frame(spark, ROWS)).collect()
    counts = Counter(r.shard for r in found)
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for k in counts:
        assert sorted(r.slot for r in found if r.shard == k) == list(range(counts[k]))
    for source in ("hot", "b", "c", None, ""):
        own = Counter(r.shard for r in found if r.row.source == source)
        assert all(abs(own[k] - sum(own.values()) / 8) <= 4 for k in range(8))
    # sources of one row each do not meet in the middle
    assert len({r.shard for r in found if (r.row.source or "").startswith("single")}) >= 5


def test_repeated_rows_and_few_rows(spark):
    same = [(None, None, None)] * 300 + [(1, "a", "s")] * 9
    found = placed(sharding.shard(frame(spark, same).repartition(5)))
    assert found == brute(sorted(same, key=repr), 8)
    few = sharding.shard(frame(spark, ROWS[:3])).collect()
    assert sorted(r.shard for r in few) == [0, 2, 5] and all(r.slot == 0 for r in few)
    assert sharding.shard(frame(spark, [])).count() == 0


def test_query(spark):
    rows = queries.op12_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id].encode()) + 1, zlib.crc32(docs[r.doc_id].encode()), "rows", None) for r in rows)


def test_files_in_slot_order(spark, tmp_path):
    df = frame(spark, ROWS)
    sharding.write(df, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(((r.row.doc_id, r.row.text, r.row.source, r.shard, r.slot) for r in back.collect()), key=repr) == brute(ROWS, 4)
    for file in (tmp_path / "shards").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
