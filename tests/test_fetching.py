"""Paced fetching, fetched streams and the crawl's frontier, over injected transports."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tidewater.sources import pages
from tidewater.sources.pacing import paced
from tidewater.sources.pages import Answer
from tidewater.streaming import crawl


def test_a_hot_host_delays_no_other():
    rows = [("hot", ("hot", 0)), *((f"h{i}", (f"h{i}", 0)) for i in range(10)), *(("hot", ("hot", i)) for i in range(1, 8))]
    began, asked, busy, clash = time.monotonic(), [], set(), []
    lock = threading.Lock()

    def ask(item):
        with lock:
            clash.extend([item] * (item[0] in busy))
            busy.add(item[0])
            asked.append((item, time.monotonic() - began))
        time.sleep(0.3 if item[0] == "hot" and item[1] == 0 else 0.005)
        with lock:
            busy.discard(item[0])
        return item

    got = list(paced(iter(rows), ask, None, 3, rate=20))
    when = dict(asked)
    assert sorted(got) == sorted(r[1] for r in rows) and not clash
    assert all(when[f"h{i}", 0] < 0.25 for i in range(10))
    hot = sorted(t for (h, _), t in asked if h == "hot")
    assert all(b - a > 0.04 for a, b in zip(hot, hot[1:], strict=False))


@pytest.mark.parametrize("burst, most", [(1, 3), (4, 6)])
def test_bucket_lets_a_burst_through(burst, most):
    began = time.monotonic()
    times = list(paced(iter([("h", i) for i in range(8)]), lambda i: time.monotonic() - began, None, 4, 10, burst))
    assert sum(t < 0.25 for t in times) <= most and sum(t < 0.08 for t in times) >= min(burst, 3) and times[-1] >= (8 - burst) / 10 - 0.02


def test_deadline_skips_the_rest():
    got = list(paced(iter([("h", i) for i in range(30)]), lambda i: (i, True), lambda i: (i, False), 2, 20, 1, time.monotonic() + 0.3))
    assert sorted(i for i, _ in got) == list(range(30)) and 3 <= sum(ok for _, ok in got) <= 8
    assert list(paced(iter([]), None, None, 2, 5)) == []


def test_lanes_take_turns(spark):
    rows = spark.createDataFrame([(i, f"https://{'hot' if i < 20 else f'h{i}'}.example/{i}") for i in range(30)] + [(99, None), (98, "http://10.0.0.1/x")], "ord long, url string")
    parts = pages.lanes(rows, 3).select("host", "turn", F.spark_partition_id().alias("p")).collect()
    assert len(parts) == 30 and len({(r.host, r.p) for r in parts}) == 11
    for p in {r.p for r in parts}:
        turns = [r.turn for r in parts if r.p == p]
        assert turns == sorted(turns)


def test_fetch_with_a_deadline_gives_every_row(spark):
    rows = spark.createDataFrame([(i, f"https://h{i % 3}.example/{i}") for i in range(60)], "ord long, url string")
    got = pages.fetch(rows, lambda url, attempt: Answer(200, {}, url), deadline=0.5, rate=10, tasks=2).collect()
    assert sorted(r.ord for r in got) == list(range(60)) and {r.status for r in got} == {"OK", "Error"}
    assert all((r.fetch_time == "skipped (deadline)") == (r.status == "Error") and (r.html == r.url) == (r.status == "OK") for r in got)


def test_fetched_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema, log = "ord long, url string", str(tmp_path / "log")
    for k in range(4):
        spark.createDataFrame([(k * 5 + i, f"https://h{i}.example/{k}") for i in range(5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # the source takes files by their time

    def sender(broken):
        def send(url, attempt):
            if broken and url.endswith("/2"):
                raise RuntimeError("lost")
            with open(log, "a") as f:
                f.write(url + "\n")
            return Answer(200, {}, "x")

        return send

    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    args = str(tmp_path / "table"), str(tmp_path / "mark")
    with pytest.raises(Exception, match="lost"):
        crawl.append_fetched(stream(), sender(True), *args, tasks=2).awaitTermination()
    assert spark.read.parquet(args[0]).count() == 10
    crawl.append_fetched(stream(), sender(False), *args, tasks=2).awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(args[0]).collect()) == list(range(20))
    asked = open(log).read().split()
    assert len(asked) == len(set(asked)) == 20


SITE = {
    "/": '<a href="/a">a</a> <a href="/b#x">b</a> <a href="https://other.example/">o</a> <a href="/f.pdf">f</a>',
    "/a": '<a href="/">home</a> <a href="/c">c</a> <a href="/old">old</a>',
    "/b": '<a href="/b/">b</a> <a href="/old">old</a> <a href="/gone">gone</a>',
    "/c": '<a href="/d">d</a>',
    "/d": '<a href="/new">new</a> <a href="/a/">a</a>',
    "/new": '<a href="/e">e</a>',
    "/e": "",
    "/listed": '<a href="/c">c</a>',
}


@pytest.mark.parametrize("pause", [None, 1])
def test_frontier(spark, tmp_path, pause):
    log, path = str(tmp_path / "log"), str(tmp_path / "crawl")

    def send(url, attempt):
        with open(log, "a") as f:
            f.write(url + "\n")
        page = url.removeprefix("https://x.example")
        if page == "/old":
            return Answer(301, {"location": "/new"}, "")
        return Answer(200, {}, SITE[page]) if page in SITE else Answer(404, {}, "")

    listed = spark.createDataFrame([("https://x.example/listed",), (None,), ("https://x.example/",)], "url string")
    calls = 1
    while not crawl.frontier(spark, "https://x.example/", send, path, listed, pause, tasks=2):
        calls += 1
    assert calls == (1 if pause is None else calls) and (pause is None or calls > 4)
    got = {r.url.removeprefix("https://x.example"): (r.depth, r.status_code) for r in spark.read.parquet(f"{path}/pages").collect()}
    # /new was reached through /old, so the link to it in /d is no page of its own
    assert got == {"/": (0, 200), "/listed": (0, 200), "/a": (1, 200), "/b": (1, 200), "/c": (1, 200), "/d": (2, 200), "/old": (2, 200), "/gone": (2, 404), "/e": (3, 200)}
    asked = open(log).read().split()
    assert len(asked) == len(set(asked)) == 10
