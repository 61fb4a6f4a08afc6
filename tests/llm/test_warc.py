import gzip
import hashlib
import io
import random

import duckdb
import pytest

from tidewater.llm import warc

SCHEMA = "page_id long, url string, html string, digest int, n int, newest int, path int"


def rows_of(pages):
    newest = {}
    for page_id, _, html, *_ in pages:
        if len((html or "").encode()) >= 1000 and page_id is not None:
            newest[html] = max(newest.get(html, page_id), page_id)
    for page_id, _, html, *_ in pages:
        raw = (html or "").encode()
        other = newest.get(html)
        again = other is not None and other != page_id
        yield page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", other if again else None


PAGES = [
    (1, "http://a/ b\r\nX: y", "é" * 500, 0, 0, 0, 0),
    (7, None, "é" * 500, 0, 0, 0, 0),
    (3, "http://a/3", "é" * 500, 0, 0, 0, 0),
    (4, "http://a/4", "short", 0, 0, 0, 0),
    (5, "http://a/5", "short", 0, 0, 0, 0),
    (6, "http://a/6", None, 0, 0, 0, 0),
    (8, "http://a/8", "", 0, 0, 0, 0),
    (None, "http://a/9", "n" * 2000, 0, 0, 0, 0),
    (10, "http://a/10", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 300, 0, 0, 0, 0),
    (10, "http://a/10", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 300, 0, 0, 0, 0),
    (-2, "http://a/11", "long é \r\n\r\n" * 60_000, 0, 0, 0, 0),
]


def test_edge_rows(spark):
    got = warc.round_trip(spark.createDataFrame(PAGES, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows_of(PAGES)))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table_in_small_splits(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 1000", "url", "html")).union(pages.where("page_id % 3 = 0").selectExpr("page_id + 2000", "url", "html"))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    got = sorted(map(tuple, warc.round_trip(pages).collect()))
    assert got == sorted(rows_of([tuple(r) for r in pages.collect()]))
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    assert sorted(con.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc.SQL})").fetchall(), key=repr) == sorted(got, key=repr)


class Source(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 10**6])
@pytest.mark.parametrize("block", [20, 64, 1 << 20])
def test_every_record_belongs_to_one_range(split, block):
    records = [warc.record(i, f"http://x/{i}", bytes(range(256)) * (i % 5), "0" * 40, None) for i in range(12)]
    junk = gzip.compress(b"not a record") + b"\x1f\x8b\x08" + b"\0" * 9
    data = b"".join([warc.member(r) + (junk if i % 4 == 1 else b"") for i, r in enumerate(records)])
    found = []
    for start in range(0, len(data), split):
        found += [r for at, _, r in warc.members(Source(data), len(data), start, min(start + split, len(data)), block) if start <= at < start + split]
    assert found == records


def test_records_inside_a_record(spark, tmp_path, monkeypatch):
    """A payload that cannot be compressed and holds whole archives is one record, wherever ranges begin."""
    monkeypatch.setattr(warc, "SPLIT_BYTES", 500)
    rng = random.Random(4)
    noise = lambda n: rng.randbytes(n)
    inner = b"".join(warc.member(warc.record(100 + i, f"http://in/{i}", noise(900), "0" * 40, None)) for i in range(5))
    payloads = [noise(300), noise(700) + inner + noise(50), b"text", inner, inner + noise(2000) + inner]
    data = b"".join(gzip.compress(warc.record(i, f"http://out/{i}", x, hashlib.sha1(x).hexdigest(), None), 0) for i, x in enumerate(payloads))
    assert data.count(b"\x1f\x8b\x08") >= 25
    (tmp_path / "a.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(data), 0)], warc.MANIFEST)
    assert warc._ranges(manifest, False).count() > len(payloads)
    for with_payloads in (False, True):
        rows = warc.read(manifest, with_payloads).orderBy("page_id").collect()
        assert [(r.page_id, r.payload_digest) for r in rows] == [(i, hashlib.sha1(x).hexdigest()) for i, x in enumerate(payloads)]
        assert not with_payloads or [bytes(r.payload) for r in rows] == payloads


def test_payloads_and_headers():
    fields, block = warc.decode(warc.record(3, None, b"body", "ab", None))
    assert fields["warc-target-uri"] == "urn:unknown" and block.endswith(b"\r\n\r\nbody")
    assert warc.fields_of(warc.record(3, "u", b"body", "ab", 9))[5] == 9
    assert warc.decode(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nx") is None and warc.fields_of(b"junk") is None
