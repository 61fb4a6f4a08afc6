"""Files written in two phases, and sitemap files of any size read in ranges."""

import gzip
import os
import re

import pytest
from pyspark.sql import functions as F

from tidewater.operators import generators
from tidewater.sources import exports, lists


def _names(path):
    return sorted(n for n in os.listdir(path) if not n.startswith("."))


def test_csv_for_spreadsheets(spark, tmp_path):
    rows = [(i, f"u{i:03d}", 'say "a, b"' if i % 3 == 0 else None if i % 3 == 1 else "two\nlines") for i in range(50)]
    df = spark.createDataFrame(rows, "n int, url string, title string").repartition(7)
    exports.write_csv(df, str(tmp_path / "out"), ["url"], names=["N", "URL", "Title, long"], lines=20)
    files = [n for n in _names(tmp_path / "out") if n != "_SUCCESS"]
    assert len(files) >= 3 and files == [f"part-{i + 1:05d}.csv" for i in range(len(files))]
    texts = [(tmp_path / "out" / n).read_bytes().decode() for n in files]
    head = '﻿N,URL,"Title, long"\r\n'
    assert all(t.startswith(head) and t.endswith("\r\n") for t in texts)
    lines = [x for t in texts for x in t[len(head) :].split("\r\n")[:-1]]
    said = {0: '"say ""a, b"""', 1: "", 2: '"two\nlines"'}
    assert lines == [f"{i},u{i:03d},{said[i % 3]}" for i in range(50)]


def test_tsv(spark, tmp_path):
    exports.write_tsv(spark.createDataFrame([("b", "x\ty"), ("a", None)], "u string, t string"), str(tmp_path / "t"), [F.col("u")])
    text = "".join((tmp_path / "t" / n).read_text() for n in _names(tmp_path / "t"))
    assert [x for x in text.split("\n") if x and x != "u\tt"] == ["a\t", "b\tx y"]


def test_limits_in_bytes(spark, tmp_path):
    lines = spark.createDataFrame([("é" * 10,) for _ in range(9)], "line string").coalesce(1)
    exports.write_lines(lines, str(tmp_path / "x"), head="h", tail="t", bytes=2 + 2 + 21 * 3)
    files = [n for n in _names(tmp_path / "x") if n != "_SUCCESS"]
    assert len(files) == 3 and all((tmp_path / "x" / n).stat().st_size == 67 for n in files)


def test_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "x")
    good = spark.range(40).select(F.col("id").cast("string").alias("line")).repartition(4)
    exports.write_lines(good, path)
    before = {n: open(f"{path}/{n}").read() for n in _names(path)}
    bad = good.select(F.when(F.col("line") == "33", F.raise_error(F.lit("lost"))).otherwise(F.col("line")).cast("string").alias("line"))
    with pytest.raises(Exception, match="lost"):
        exports.write_lines(bad, path, mode="overwrite")
    assert {n: open(f"{path}/{n}").read() for n in _names(path)} == before
    with pytest.raises(Exception, match="already"):
        exports.write_lines(good, path)
    exports.write_lines(good.limit(1), path, mode="overwrite")
    assert len(_names(path)) == 2
    exports.write_lines(good.limit(0), path, mode="overwrite")
    assert _names(path) == ["_SUCCESS"]


@pytest.mark.parametrize("compressed", [False, True])
def test_sitemaps_with_index(spark, tmp_path, monkeypatch, compressed):
    monkeypatch.setattr(generators, "SITEMAP_LINES", 40)
    want = sorted(f"https://x.example/{i:03d}?a=1&b" for i in range(300))
    path = str(tmp_path / "out")
    generators.write_sitemaps(spark.createDataFrame([(u, "2024-01-02") for u in want], "loc string, lastmod string"), path, "https://x.example/maps/", compressed)
    read = (lambda p: gzip.open(p, "rt").read()) if compressed else (lambda p: open(p).read())
    index = re.findall("<loc>(.*?)</loc>", open(f"{path}/sitemap_index.xml").read())
    found = [u for f in index for u in re.findall("<loc>(.*?)</loc>", read(f"{path}/{f.rpartition('/')[2]}"))]
    assert found == [u.replace("&", "&amp;") for u in want] and len(index) == len(_names(path)) - 2 and all(f.startswith("https://x.example/maps/part-") for f in index)
    got = lists.scan(spark, path).groupBy("kind").agg(F.sort_array(F.collect_list("url")).alias("urls")).collect()
    assert {r.kind: r.urls for r in got} == {"url": want, "sitemap": index}


@pytest.mark.parametrize("size", [1, 7, 37, 100, 1 << 20])
def test_scan_in_ranges(spark, tmp_path, size):
    """Every range size gives every entry once; cut, nameless and unclosed ones never."""
    urls = "".join(f"<url>\n <loc>https://é.example/{i}?a&amp;b</loc><lastmod>2024-01-01</lastmod><image:image><image:loc>https://img/{i}</image:loc></image:image>\n</url>\n" for i in range(8))
    odd = "<url><loc><![CDATA[ https://x/cdata ]]></loc></url><URL><lOC>https://x/upper</loC></URL><url><loc></loc></url><url><locale>no</locale></url><url><loc a='1'>https://x/attribute</loc ></url>"
    cut = "<url><loc>https://x/whole</loc></url><url><loc>https://x/unclosed</loc>"
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><urlset>" + urls + odd + cut)
    (tmp_path / "b.xml").write_text("<sitemapindex><sitemap><loc>https://x/m.xml</loc></sitemap></sitemapindex>")
    (tmp_path / "c.xml").write_text("")
    (tmp_path / "d.xml").write_text("<urlset><url><loc>https://x/cu")
    with gzip.open(tmp_path / "e.xml.gz", "wt") as f:
        f.write("<urlset>" + urls.replace("é", "z") + "</urlset>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", max(size, 7))
        spark.conf.set("spark.sql.files.openCostInBytes", size)
        scanned = lists.scan(spark, str(tmp_path))
        assert size > 100 or scanned.rdd.getNumPartitions() > 8
        got = sorted((r.kind, r.url) for r in scanned.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [("url", f"https://{h}.example/{i}?a&b") for h in "éz" for i in range(8)] + [("url", f"https://x/{w}") for w in ("cdata", "upper", "attribute", "whole")] + [("sitemap", "https://x/m.xml")]
    assert got == sorted(want)
