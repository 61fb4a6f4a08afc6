import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import packing

SCHEMA = "doc_id long, text string, offset int, rank int"
TEXTS = [
    (1, "Hello, World! it's 123 TIMES\n\tover", 0, 0),
    (2, None, 0, 0),
    (3, "", 0, 0),
    (4, " \x0b\x0c ", 0, 0),
    (5, "naïve ÉÈ é Σ. ΟΔΟΣ   wide space ́x", 0, 0),
    (6, "a <|endoftext|> b<|startoftext|>c <| d |>", 0, 0),
    (7, "ünïque " * 6000, 0, 0),
    (8, "x" * 9000, 0, 0),
    (8, "x" * 9000, 0, 0),
    (9, "twice twice don't we'll 日本語 テキスト 🙂👍🏽 # ## $$$", 0, 0),
]


def brute(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc_id, text, *_ in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at : at + 4096]
            yield (doc_id, piece, at, len(cut), zlib.crc32(cut.tobytes()))


def whole(rows, capacity=4096):
    """No gap, no overlap, nothing beyond the capacity; the number of sequences."""
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_pieces_are_those_of_whole_texts(spark):
    rows = packing.pack(spark.createDataFrame(TEXTS, SCHEMA)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(brute(TEXTS))
    whole(rows)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(brute(docs.select("doc_id", "text").collect()))
    n = whole(rows)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_plan_is_best_fit_decreasing(counts):
    rows, seen = packing.plan(counts, 50), {}
    for length, lo, hi, first, each, base in rows:
        for k in range(hi - lo):
            seen.setdefault((length, lo + k), []).append((first + k // each, base + k % each * length))
    assert {k: len(v) for k, v in seen.items()} == {(n, k): 1 for n, c in counts.items() for k in range(c)}
    used = {}
    for (length, _), [(sequence, offset)] in seen.items():
        used.setdefault(sequence, []).append((offset, length))
    rooms = []
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        rooms.append(50 - at)
    assert sorted(rooms) == best_fit([n for n, c in counts.items() for _ in range(c)], 50)


def test_ranks_with_many_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 30)
    table = spark.range(1000).selectExpr("id as doc_id", "if(id % 3 = 0, 7L, id % 50) as length")
    counts = {r.length: r.n for r in table.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    rows = packing.ranked(table, "length", ["doc_id"], counts).collect()
    assert len(rows) == 1000
    for length, n in counts.items():
        assert sorted(r.rank for r in rows if r.length == length) == list(range(n))
