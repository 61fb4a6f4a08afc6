import re
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash

from tidewater.llm import katz, queries
from tidewater.llm.common import remainder

SCHEMA = "doc_id long, text string, kind int, part int, n_tokens int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(0, None, 0, 0, 0), (1, "", 0, 0, 0), (2, "One ONE\tone\x0bétÉ", 0, 0, 0), (3, "w " * 30_000, 0, 0, 0), (6, "never seen ones", 0, 0, 0), (None, "null id one", 0, 0, 0), (7, "a b a b a c a d", 0, 0, 0), (7, "a b a b a c a d", 0, 0, 0), (-8, "a b a b", 0, 0, 0), (9, "a b c d", 0, 0, 0), (10, "x a b c", 0, 0, 0)]


def split(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), "\n"]


class Brute:
    """The formulas over dictionaries of whole words."""

    def __init__(self, texts, order):
        self.order, self.n = order, 0
        self.counts = {n: defaultdict(Counter) for n in range(1, order + 1)}
        for t in texts:
            w = ["^"] * (order - 1) + split(t)
            for i in range(order - 1, len(w)):
                self.n += 1
                for n in range(1, order + 1):
                    self.counts[n][tuple(w[i - n + 1 : i])][w[i]] += 1
        self.words = self.counts[1][()]
        self.d, self.memo = {}, {}
        for n in range(2, order + 1):
            by_count = Counter(r for c in self.counts[n].values() for r in c.values())
            self.d[n] = katz.discounts([by_count[r] for r in range(1, katz.KATZ + 2)])

    def alpha(self, context, seen, left, over):
        if context not in self.memo:
            self.memo[context] = (left or 1) / over / (1 - sum(self.p(context[1:], x) for x in seen))
        return self.memo[context]

    def p(self, context, w):
        if not context:
            return (self.words[w] + 0.5) / (self.n + (len(self.words) + 1) / 2)
        n = len(context) + 1
        seen = self.counts[n].get(context)
        if not seen:
            return self.p(context[1:], w)
        left = sum((1 - self.d[n][r]) * r for r in seen.values() if r <= katz.KATZ)
        over = sum(seen.values()) + (0 if left else 1)
        if w in seen:
            return self.d[n][min(seen[w], katz.KATZ + 1)] * seen[w] / over
        return self.alpha(context, seen, left, over) * self.p(context[1:], w)

    def score(self, text):
        w = ["^"] * (self.order - 1) + split(text)
        at = range(self.order - 1, len(w))
        return len(at), sum(w[i] in self.words for i in at), self.n, sum(log10(self.p((), w[i])) for i in at), sum(log10(self.p(tuple(w[i - self.order + 1 : i]), w[i])) for i in at)


def hold(got, rows, brute):
    want = sorted(((r[0], *brute.score(r[1])) for r in rows), key=repr)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=repr), want, strict=True):
        assert g[:4] == w[:4] and g[4:6] == pytest.approx(w[4:], rel=1e-8, abs=1e-6)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("hot", [2, 1000])
def test_edge_rows(spark, order, hot, monkeypatch):
    """Few and many frequent words; contexts split over parts; documents that travel and that stay."""
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "SPLIT", 2)
    monkeypatch.setattr(katz, "SHIPPED", 1)
    monkeypatch.setattr(katz, "PART_BYTES", 10_000)
    docs = spark.createDataFrame(EDGE, SCHEMA).coalesce(2)
    brute = Brute([r[1] for r in EDGE if r[0] is None or r[0] % 5 != 1], order)
    hold(katz.score(docs, "doc_id is null or doc_id % 5 <> 1", order).collect(), EDGE, brute)


@pytest.mark.parametrize("order", [2, 3])
def test_table(spark, sf_dir, monkeypatch, order):
    monkeypatch.setattr(katz, "PART_BYTES", 100_000)
    monkeypatch.setattr(katz, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(katz, "CHUNK_ROWS", 7)
    monkeypatch.setattr(katz, "HOT", 200)
    monkeypatch.setattr(katz, "SPLIT", 500)
    monkeypatch.setattr(katz, "SHIPPED", 2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = katz.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id % 5 <> 1", order).collect()
    hold(got, rows, Brute([t for i, t in rows if i % 5 != 1], order))


def test_words_of_near_hashes_stay_apart(spark, tmp_path):
    """By 20 bits of their hashes the two words are the same one."""
    classes: dict[int, str] = {}
    for i in range(100_000):
        word = f"w{i}"
        other = classes.setdefault(xxhash.xxh3_64_intdigest(word) >> 44, word)
        if other != word:
            break
    rows = [(i, f"before {other} after and {i % 7} before", 0, 0, 0) for i in range(60)] + [(i, f"before {word} after", 0, 0, 0) for i in range(60, 90)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    held = {r.doc_id for r in spark.createDataFrame(rows, SCHEMA).where(remainder("doc_id") == 1).collect()}
    got = queries.op8_katz(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if r.held_out} == held
    hold([tuple(r)[:6] for r in got], rows, Brute([r[1] for r in rows if r[0] not in held], 2))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_no_training_and_no_rows(spark, order):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    rows = katz.score(docs, "false", order).collect()
    assert len(rows) == len(EDGE) and {r.n_known for r in rows} == {0} and all(r.score == 0 for r in rows)
    assert katz.score(docs.limit(0), "true", order).count() == 0


def test_probabilities_add_up_to_one():
    texts = ["a b c a b d", "a b", "e f g a", "a b a b a b a b a b a b", "b a"]
    brute = Brute(texts, 3)
    places = (len(brute.words) + 1) / 2 + brute.n
    for n in (1, 2):
        for context in list(brute.counts[n + 1]):
            known = sum(brute.p(context, w) for w in brute.words)
            unknown = brute.p(context, "never")
            assert known + unknown == pytest.approx(1) and places > 0


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = katz.score(docs, "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1").selectExpr("*", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1 as held").collect()
    held = [r for r in rows if r.held]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_packing_of_arrays():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 5000):
        arrays = {"key": np.sort(rng.integers(0, 2**64, size, np.uint64)), "many": rng.integers(0, 300, size), "p": rng.random(size), "cold": rng.integers(0, 2**64, size, np.uint64), "base": rng.integers(0, 2**62, size)}
        got = katz.unpack(katz.pack(**arrays))
        assert all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in arrays.items() if size) and not len(got["doc"])


def test_a_part_sends_a_row_to_each_other_part_whatever_the_chunks():
    frequent, chunks, parts = katz.Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1000, 6), 6, 4
    texts = [[f"w{i % 5} w{i} w{i + j} w{j}" for i in range(40)] for j in range(chunks)]
    batches = [pa.RecordBatch.from_pydict({"row": pa.array(range(100 * j, 100 * j + 40)), "doc_id": pa.array(range(40)), "text": pa.array(t), "training": pa.array([True] * 40)}) for j, t in enumerate(texts)]
    sent = pa.Table.from_batches(list(katz._send(iter(batches), 2, frequent, False, 1)))
    assert sent.num_rows == chunks
    out = katz._words(sent, 2, frequent, parts)
    grams = out.filter(pc.greater_equal(out.column("part"), 0))
    assert sorted(grams.column("part").to_pylist()) == list(range(parts))  # 24 rows when each chunk had its own
    assert sorted(out.filter(pc.less(out.column("part"), 0)).column("chunk").to_pylist()) == [100 * j for j in range(chunks)]
    for part in range(parts):
        counted = katz._count(grams.filter(pc.equal(grams.column("part"), part)), 2, 2, frequent)
        answers = pa.Table.from_batches(list(katz._evaluate(iter(counted.to_batches()), 2, 2, frequent, katz.discounts([0] * 6), parts)))
        chunk = answers.column("chunk").to_pylist()
        assert len(chunk) == len(set(chunk)) and set(chunk) <= {100 * j for j in range(chunks)}
