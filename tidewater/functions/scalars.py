"""Scalar expressions shared by the audit operators; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Half up, for negatives too."""
    return F.floor(x + 0.5)


def one_decimal(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(100 * part / whole + 0.5)).otherwise(0)


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def blank(c: Column | str) -> Column:
    return F.trim(text(c)) == ""


def ok(code: Column | str = "status_code") -> Column:
    return (F.col(code) if isinstance(code, str) else code).between(200, 299)


def mentions(c: Column | str, word: str) -> Column:
    return F.lower(text(c)).contains(word)


def indexable() -> Column:
    return ok() & ~mentions("robots", "noindex")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def status_bucket(code: Column) -> Column:
    """Pie buckets; 0 and whatever is no answer is blocked."""
    out = F.lit("blocked")
    for k in (5, 4, 3, 2):
        out = F.when(code.between(100 * k, 100 * k + 99 if k < 5 else 10_000), f"{k}xx").otherwise(out)
    return out


def status_label(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 50, "Needs work").otherwise("Critical")


def length_badge(n: Column, least: int, most: int) -> Column:
    return F.when(n == 0, "missing").when(n < least, "short").when(n > most, "long").otherwise("ideal")


def link_status(rel: Column, nofollow: Column, sponsored: Column, ugc: Column) -> Column:
    return F.when(sponsored, "Sponsored").when(ugc, "UGC").when(nofollow, "Nofollow").when(F.length(text(rel)) > 0, "Followed").otherwise("No rel")


def equity_score(incoming: Column) -> Column:
    return F.least(F.lit(100), js_round(F.log2(incoming + 1) * 25)).cast("int")


def equity_strength(incoming: Column) -> Column:
    s = equity_score(incoming)
    return F.when(incoming == 0, "orphan").when(s >= 60, "strong").when(s >= 30, "average").otherwise("weak")


def leading_number(c: Column) -> Column:
    """The number that a text begins with, else null."""
    return F.regexp_extract(c, r"^[ \t]*([+-]?[0-9]+(?:\.[0-9]*)?|[+-]?\.[0-9]+)", 1).try_cast("double")


def squeeze(c: Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"(?U)\s+", " "))


#: Words that do not count when texts are compared.
STOP_WORDS = ["a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "by", "at", "as", "it", "its", "this", "that", "from", "you", "your", "our", "we", "i"]


def token_set(c: Column) -> Column:
    words = F.split(F.regexp_replace(squeeze(c), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def escape_xml(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def escape_attribute(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def csv_quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_if_needed(c: Column) -> Column:
    return F.when(text(c).rlike('[",\\r\\n]'), csv_quoted(c)).otherwise(text(c))


def tsv_clean(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[\t\r\n]+", " ")


def iso_date(c: Column) -> Column:
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd")


def http_date(c: Column) -> Column:
    """A Last-Modified header as ISO text; null if it is none."""
    return F.date_format(F.try_to_timestamp(F.substring(c, 6, 100), F.lit("dd MMM yyyy HH:mm:ss z")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def retry_after_ms(c: Column, now: Column) -> Column:
    """Milliseconds to wait, 15 s at most: seconds, or a date from now on."""
    seconds = F.trim(c).try_cast("int")
    date = F.try_to_timestamp(F.substring(c, 6, 100), F.lit("dd MMM yyyy HH:mm:ss z"))
    later = F.unix_millis(date) - F.unix_millis(now)
    return F.when(seconds.isNotNull(), F.least(F.greatest(seconds, F.lit(0)) * 1000, F.lit(15_000))).when(date.isNotNull(), F.least(F.greatest(later, F.lit(0)), F.lit(15_000)))


def relative_time(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 60_000)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(minutes < 1, "just now").when(minutes < 60, say(minutes, "m ago")).when(minutes < 1440, say(F.floor(minutes / 60), "h ago")).otherwise(say(F.floor(minutes / 1440), "d ago"))


def period_label(start: Column, end: Column, current: Column) -> Column:
    month = lambda d: F.date_format(d, "MMMM yyyy")
    return F.concat_ws(" – ", month(start), F.when(current, "Present").otherwise(month(end)))


def hreflang_code(language: Column, country: Column) -> Column:
    return F.concat_ws("-", F.lower(language), F.when(~blank(country), F.upper(country)))


def cut_at_word(c: Column, n: int) -> Column:
    """At most n characters, ending at a word, with an ellipsis if cut."""
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(F.substring(c, 1, n), r"\s+\S*$", ""), F.lit("…"))).otherwise(c)


def file_stem(name: str) -> str:
    return re.sub(r"-{2,}", "-", re.sub(r"[^a-z0-9.-]+", "-", re.sub(r"^https?://", "", name.lower()))).strip("-") or "site"
