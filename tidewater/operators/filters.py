"""Filters over crawl rows: trees of conditions compiled to one predicate, quick filters by name, search over fields."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank, mentions, ok, text

OPERATORS = ("contains", "not_contains", "equals", "not_equals", "regex", "not_regex")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: str


#: Groups are joined by or, the conditions of a group by and.
Filter = list[list[Condition]]


def _compiles(pattern: str) -> bool:
    """Whether the engine that runs patterns takes this one."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def condition(c: Condition, fields: dict[str, Column]) -> Column:
    """A blank value passes; a pattern that does not compile finds nothing."""
    if not c.value.strip():
        return F.lit(True)
    own, wanted = text(fields[c.field]), c.value
    if c.operator in ("regex", "not_regex"):
        hit = own.rlike("(?iu)" + wanted) if _compiles(wanted) else F.lit(False)
    elif c.operator in ("equals", "not_equals"):
        hit = F.lower(own) == wanted.lower()
    else:
        hit = F.lower(own).contains(wanted.lower())
    return ~hit if c.operator.startswith("not_") else hit


def predicate(groups: Filter, fields: dict[str, Column]) -> Column | None:
    """None if the filter says nothing."""
    groups = [g for g in groups if g]
    if not any(c.value.strip() for g in groups for c in g):
        return None
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (condition(c, fields) for c in g)) for g in groups))


def scoped(groups: Filter, fields: Iterable[str]) -> Filter:
    """Without conditions on fields that a table does not have, and without the groups that this empties."""
    own = set(fields)
    return [kept for g in groups if (kept := [c for c in g if c.field in own])]


def search(query: str, fields: dict[str, Column]) -> Column:
    wanted = query.strip().lower()
    return F.lit(True) if not wanted else reduce(lambda a, b: a | b, (F.lower(text(c)).contains(wanted) for c in fields.values()))


def apply(df: DataFrame, groups: Filter, query: str, fields: dict[str, Column]) -> DataFrame:
    """A filter that says something overrides the search."""
    found = predicate(scoped(groups, fields), fields)
    return df.where(found if found is not None else search(query, fields))


def meta_fields() -> dict[str, Column]:
    """The meta table's fields as text."""
    many = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " | ")
    chain = F.array_join(F.transform("redirect_chain", lambda h: h["url"]), " → ")
    return {"url": F.col("url"), "title": F.col("title"), "description": F.col("description"), "h1": many("h1s"), "h2": many("h2s"), "h3": many("h3s"), "robots": F.col("robots"), "canonical": F.col("canonical"), "canonical_status": F.col("canonical_status"), "status": F.col("status"), "status_code": F.col("status_code").cast("string"), "redirected_url": F.col("redirected_url"), "redirect_type": F.col("redirect_type"), "redirect_chain": chain, "fetch_time": F.col("fetch_time")}


def _code(low: int, high: int) -> Column:
    return F.col("status_code").between(low, high)


def _size(c: str) -> Column:
    return F.size(F.coalesce(F.col(c), F.array()))


def _some(c: str, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(c, test), F.lit(False))


def _answered(test: Column) -> Column:
    """Image, schema, canonical, hreflang and link filters look at answered pages alone."""
    return (F.col("status") == "OK") & test


QUICK: dict[str, Callable[[], Column]] = {
    "all": lambda: F.lit(True),
    "errors": lambda: F.col("status") == "Error",
    "missing-title": lambda: (F.col("status") == "OK") & blank("title"),
    "missing-desc": lambda: (F.col("status") == "OK") & blank("description"),
    "title-long": lambda: F.length(text("title")) > 60,
    "multi-h1": lambda: _size("h1s") > 1,
    "missing-h1": lambda: (F.col("status") == "OK") & (_size("h1s") == 0),
    "has-robots": lambda: ~blank("robots"),
    "no-robots": lambda: (F.col("status") == "OK") & blank("robots"),
    "noindex": lambda: mentions("robots", "noindex"),
    "nofollow": lambda: mentions("robots", "nofollow"),
    "2xx": lambda: ok(),
    "3xx": lambda: _code(300, 399) | F.col("redirect_status_code").between(300, 399),
    "4xx": lambda: _code(400, 499),
    "5xx": lambda: _code(500, 599),
    "images-missing-alt": lambda: _answered(_some("images", lambda i: i["alt"].isNull())),
    "images-none": lambda: _answered(_size("images") == 0),
    "images-some": lambda: _answered(_size("images") > 0),
    "schema-some": lambda: _answered(_size("schemas") > 0),
    "schema-none": lambda: _answered(_size("schemas") == 0),
    "canonical-self": lambda: _answered(F.col("canonical_status") == "Self Referencing"),
    "canonical-away": lambda: _answered(F.col("canonical_status") == "Canonicalised"),
    "canonical-missing": lambda: _answered((F.col("canonical_status") == "Missing") | blank("canonical")),
    "hreflang-some": lambda: _answered(_size("hreflangs") > 0),
    "hreflang-none": lambda: _answered(_size("hreflangs") == 0),
    "hreflang-default": lambda: _answered(_some("hreflangs", lambda h: h["hreflang"] == "x-default")),
    "links-internal": lambda: _answered(_some("internal_links", lambda x: x["is_internal"])),
    "links-external": lambda: _answered(_some("internal_links", lambda x: ~x["is_internal"])),
    "links-none": lambda: _answered(_size("internal_links") == 0),
    "social-some": lambda: _size("social_tags") > 0,
    "social-none": lambda: _size("social_tags") == 0,
    "social-og": lambda: _some("social_tags", lambda t: t["network"] == "og"),
    "social-twitter": lambda: _some("social_tags", lambda t: t["network"] == "twitter"),
    "social-no-og": lambda: ~_some("social_tags", lambda t: t["network"] == "og"),
    "social-no-twitter": lambda: ~_some("social_tags", lambda t: t["network"] == "twitter"),
}


#: Of exploded, audited links.
LINKS: dict[str, Callable[[], Column]] = {"all": lambda: F.lit(True), "external": lambda: ~F.col("is_internal"), "missing-rel": lambda: F.col("missing_rel"), "nofollow": lambda: F.col("nofollow"), "sponsored": lambda: F.col("sponsored"), "ugc": lambda: F.col("ugc")}


def issues(df: DataFrame, severity: str | None = None, query: str = "") -> DataFrame:
    """Issues of a severity whose title or group contains a text."""
    found = search(query, {"title": F.col("title"), "grp": F.col("grp")})
    return df.where(found & (F.col("severity") == severity) if severity else found)


def quick(df: DataFrame, name: str) -> DataFrame:
    return df.where(QUICK[name]())


def sort_meta(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """By a text column as readers expect it (cases together); ties in crawl order."""
    key = F.collate(text(by), "UNICODE")
    return df.orderBy(key.desc() if descending else key.asc(), "ord")
