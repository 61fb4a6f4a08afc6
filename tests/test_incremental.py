"""An audit kept up to date equals a whole run after every overlay, and reads only what changed."""

from pyspark.sql import functions as F

from tidewater.operators import incremental, links, merge, rules
from tidewater.plans import fixtures
from tidewater.plans.storage import stored


def _rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def _same(spark, path, crawl):
    edges = links.edges(crawl)
    every = edges.where("is_internal").select(F.col("dst").alias("key")).distinct()
    assert _rows(incremental.inbound(spark, path), "key", "incoming", "unique_anchors") == _rows(links.inbound(edges, every), "key", "incoming", "unique_anchors")
    columns = ["rule_id", "count", "share", "priority", "category"]
    want = rules.prioritised(rules.hits(crawl), crawl.count())
    assert _rows(incremental.issues(spark, path), *columns) == _rows(want, *columns)
    assert _rows(rules.categories(incremental.issues(spark, path)), "category", "score", "issues") == _rows(rules.categories(want), "category", "score", "issues")
    found = crawl.where("status_code between 200 and 299").groupBy(F.lower(F.trim("title")).alias("key")).agg(F.count("*").alias("size")).where("key <> '' and size > 1")
    assert _rows(incremental.duplicates(spark, path).where("kind = 'title'"), "key", "size") == _rows(found, "key", "size")


def test_three_overlays(spark, sf_dir, tmp_path):
    crawl, path = fixtures.crawl(spark, sf_dir), str(tmp_path / "kept")
    incremental.create(crawl, path, 64)
    _same(spark, path, crawl)
    total = spark.read.parquet(f"{path}/keys").count()
    fields = ["title", "h1s", "internal_links", "status_code", "robots"]
    changes = [
        {"title": F.lit("One title of all"), "robots": F.lit("noindex")},
        {"internal_links": F.slice("internal_links", 1, 1), "h1s": F.array().cast("array<string>")},
        {"title": F.concat(F.lit("own "), F.col("ord")), "status_code": F.lit(500), "internal_links": F.lit(None).cast(crawl.schema["internal_links"].dataType)},
    ]
    for k, change in enumerate(changes):
        before = crawl.where(f"ord % 60 in ({k}, {k + 1})")
        fresh = before.withColumns(change)
        after = merge.overlay(before, fresh, fields)
        touched = incremental.update(path, before, after)
        assert 0 < touched.buckets <= 64 and 0 < touched.changed and touched.read <= total
        crawl = stored(merge.overlay(crawl, fresh, fields), "overlay")
        _same(spark, path, crawl)


def test_one_page_reads_its_buckets(spark, sf_dir, tmp_path):
    crawl, path = fixtures.crawl(spark, sf_dir), str(tmp_path / "kept")
    incremental.create(crawl, path, 64)
    total = spark.read.parquet(f"{path}/keys").count()
    one = crawl.orderBy("ord").limit(1)
    touched = incremental.update(path, one, one.withColumn("title", F.lit("another")))
    assert touched.changed == 2 and touched.buckets <= 2 and touched.read < total / 10
    assert incremental.update(path, one, one) == (0, 0, 0)


def test_new_and_gone_pages(spark, sf_dir, tmp_path):
    crawl, path = fixtures.crawl(spark, sf_dir), str(tmp_path / "kept")
    some, rest = crawl.where("ord % 3 = 0"), crawl.where("ord % 3 <> 0")
    incremental.create(some, path, 8)
    incremental.update(path, some.limit(0), rest)
    _same(spark, path, crawl)
    incremental.update(path, some, some.limit(0))
    _same(spark, path, rest)
    incremental.update(path, rest, rest.limit(0))
    assert not incremental.inbound(spark, path).count() and not incremental.issues(spark, path).count()


def test_empty_crawl(spark, sf_dir, tmp_path):
    crawl, path = fixtures.crawl(spark, sf_dir), str(tmp_path / "kept")
    incremental.create(crawl.limit(0), path, 8)
    incremental.update(path, crawl.limit(0), crawl)
    _same(spark, path, crawl)
