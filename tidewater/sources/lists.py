"""URL lists, sitemaps and stored crawls as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.scalars import text
from ..operators.merge import first_of
from ..plans.storage import stored


def from_text(lines: DataFrame) -> DataFrame:
    """ord, url of pasted lines (ord, value): addresses only, each once, in order."""
    rows = lines.select("ord", F.trim("value").alias("url")).where(F.col("url").rlike("^https?://"))
    return first_of(rows, F.col("url")).orderBy("ord")


def from_rows(lines: DataFrame) -> DataFrame:
    """ord, url of CSV lines (ord, value): the first cell of a line that is an address."""
    cells = F.transform(F.split("value", ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    rows = lines.select("ord", F.get(F.filter(cells, lambda c: c.rlike("^https?://")), F.lit(0)).alias("url")).where("url is not null")
    return first_of(rows, F.col("url")).orderBy("ord")


def from_workbook(spark: SparkSession, path: str) -> DataFrame:
    """ord, url of a workbook's first sheet: the first address of a row. Needs a reader of such files for pandas."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as error:
        raise NotImplementedError("reading workbooks needs openpyxl") from error
    import pandas as pd

    sheet = pd.read_excel(path, header=None, dtype=str).fillna("")
    return from_rows(spark.createDataFrame([(i, ",".join(row)) for i, row in enumerate(sheet.itertuples(index=False))], "ord int, value string"))


def locations(xml: Column, wrapper: str) -> Column:
    """The first loc of each wrapper element: CDATA taken off, white space removed, `&amp;` decoded."""
    found = F.regexp_extract_all(text(xml), F.lit(rf"(?is)<{wrapper}\b[^>]*>(.*?)</{wrapper}>"), F.lit(1))
    loc = lambda x: F.replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"(?is)<loc\b[^>]*>(.*?)</loc>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"\s+", ""), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(found, loc), lambda u: u != "")


def sitemap(files: DataFrame, roots: list[str], domain: str, limit: int | None = None) -> DataFrame:
    """url of what the sitemaps from roots list, within a domain and its subdomains; files: (url, xml) of every sitemap.

    Indexes are followed until they name no new sitemap. limit: so many in the order of the addresses.
    """
    spark = files.sparkSession
    frontier = spark.createDataFrame([(r,) for r in roots], "url string")
    seen, found = frontier, None
    while True:
        own = files.join(frontier, "url", "left_semi")
        pages = own.where(~F.col("xml").rlike("(?i)<sitemapindex")).select(F.explode(locations(F.col("xml"), "url")).alias("url"))
        found = pages if found is None else found.unionByName(pages)
        frontier = own.where(F.col("xml").rlike("(?i)<sitemapindex")).select(F.explode(locations(F.col("xml"), "sitemap")).alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = stored(frontier, "sitemaps")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    listed = found.where(urls.within_domain(F.col("url"), domain)).distinct()
    return listed if limit is None else listed.orderBy("url").limit(limit)


#: What follows `<loc` of an entry up to the next: its address and the element that closes around it.
_ENTRY = r"(?is)(?:^|<loc)(?:\s[^>]*)?>(.*?)</loc\s*>.*?</(url|sitemap)\s*>"


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """file, url, kind (`url` or `sitemap`) of every entry of sitemap files, plain or .gz; files and folders of any size.

    The files are read as text that `<loc` divides, so that ranges of spark.sql.files.maxPartitionBytes of a plain file are read by different tasks, an entry by the one
    in whose range it begins, and no task holds a file; a .gz file is streamed by one task. An entry needs its </loc> and its closing </url> or </sitemap>: what a cut file ends with is
    none. Of several loc in one element the last counts. CDATA is taken off, white space removed, `&amp;` decoded; empty addresses are left out. Commented entries count, as they do in `locations`.
    """
    parts = spark.read.option("lineSep", "<loc").option("recursiveFileLookup", "true").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), "value")
    found = parts.select("file", F.explode(F.regexp_extract_all("value", F.lit(_ENTRY), F.lit(0))).alias("entry"))  # more than one only where tags are in capitals
    rows = found.select("file", F.regexp_extract("entry", _ENTRY, 1).alias("loc"), F.lower(F.regexp_extract("entry", _ENTRY, 2)).alias("kind"))
    address = F.replace(F.regexp_replace(F.regexp_replace("loc", r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"\s+", ""), F.lit("&amp;"), F.lit("&"))
    return rows.select("file", address.alias("url"), "kind").where("url <> ''")


def declared_sitemaps(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(text(content), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1)), lambda x: F.trim(x))


def all_locations(xml: Column) -> Column:
    """Every loc of a document, whatever wraps it."""
    found = F.regexp_extract_all(text(xml), F.lit(r"(?is)<loc\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&"))), lambda u: u != "")


#: Where sitemaps are if robots.txt names none.
WELL_KNOWN = ["sitemap_index.xml", "sitemap.xml", "wp-sitemap.xml", "sitemap-index.xml"]


def sitemap_candidates(origin: Column, content: Column) -> Column:
    """The sitemaps that robots.txt declares, then the usual places."""
    return F.array_distinct(F.concat(declared_sitemaps(content), F.array(*(F.concat(origin, F.lit("/" + p)) for p in WELL_KNOWN))))


def site_scope(crawl: DataFrame) -> DataFrame:
    """One row: the host of the first address."""
    return crawl.where(urls.is_absolute(F.col("url"))).agg(F.min_by(urls.hostname(F.col("url")), "ord").alias("scope"))


def with_sitemap(spidered: DataFrame, listed: DataFrame, limit: int | None = None) -> DataFrame:
    """url, origin of spidered pages and of what only the sitemap lists; with a limit, so many in this order."""
    rest = listed.join(spidered.select("url"), "url", "left_anti").select("url", F.lit("sitemap").alias("origin"))
    every = spidered.select("url", F.lit("spider").alias("origin")).unionByName(rest)
    return every if limit is None else every.orderBy(F.col("origin") != "spider", "url").limit(limit)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """A stored crawl."""
    return spark.read.parquet(path)


def store(crawl: DataFrame, path: str) -> None:
    crawl.write.mode("overwrite").parquet(path)
