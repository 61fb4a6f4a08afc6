"""URL expressions. Absolute URLs are taken apart by pattern; only relative ones need a (vectorised) function."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import text

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(c: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(c, _URL, k), F.lit(""))


def is_absolute(c: Column) -> Column:
    return text(c).rlike(_URL) & (_part(c, 2) != "")


def protocol(c: Column) -> Column:
    return F.lower(_part(c, 1))


def host(c: Column) -> Column:
    """Host with port, lower case, without www."""
    return F.regexp_replace(F.lower(_part(c, 2)), r"^www\.", "")


def hostname(c: Column) -> Column:
    return F.regexp_replace(host(c), r":[0-9]*$", "")


def path(c: Column) -> Column:
    return F.when(_part(c, 3) == "", "/").otherwise(_part(c, 3))


def query(c: Column) -> Column:
    return F.when(_part(c, 4) == "?", "").otherwise(_part(c, 4))


def segments(c: Column) -> Column:
    return F.filter(F.split(_part(c, 3), "/"), lambda s: s != "")


def segment(c: Column) -> Column:
    """The first directory, `/` if there is none."""
    return F.concat(F.lit("/"), F.coalesce(F.get(segments(c), F.lit(0)), F.lit("")))


def short_label(c: Column) -> Column:
    return F.when(path(c) == "/", host(c)).otherwise(path(c))


def _no_port(c: Column) -> Column:
    """Host without the port that its protocol implies."""
    return F.when(protocol(c) == "http", F.regexp_replace(host(c), ":80$", "")).when(protocol(c) == "https", F.regexp_replace(host(c), ":443$", "")).otherwise(host(c))


def _bare_path(c: Column) -> Column:
    return F.when(path(c) == "/", "/").otherwise(F.regexp_replace(path(c), "/$", ""))


def analysis_key(c: Column) -> Column:
    """The key pages are joined by: no fragment, www, user or last slash; what is no URL stays."""
    return _key_of(c, *(_part(c, k) for k in (1, 2, 3, 4)))


def _key_of(c: Column, scheme: Column, authority: Column, path: Column, query: Column) -> Column:
    protocol, host = F.lower(scheme), F.regexp_replace(F.lower(authority), r"^www\.", "")
    no_port = F.when(protocol == "http", F.regexp_replace(host, ":80$", "")).when(protocol == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    bare_path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    return F.when(authority != "", F.concat(protocol, F.lit("://"), no_port, bare_path, F.when(query == "?", "").otherwise(query))).otherwise(c)


def with_analysis_key(rows: DataFrame, name: str, c: Column) -> DataFrame:
    """rows with the analysis key of an address as a column. The parts are columns first, so that each is matched once a row, not once for each place that names it."""
    parts = ["_scheme", "_authority", "_path", "_query"]
    taken = rows.withColumn("_address", c).withColumns({part: _part(F.col("_address"), k) for k, part in enumerate(parts, 1)})
    return taken.withColumn(name, _key_of(F.col("_address"), *map(F.col, parts))).drop("_address", *parts)


def graph_key(c: Column) -> Column:
    """As analysis_key, but a user stays; null if it is no URL."""
    user = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)", 1)
    return F.when(is_absolute(c), F.concat(protocol(c), F.lit("://"), user, _no_port(c), _bare_path(c), query(c)))


def crawl_key(c: Column) -> Column:
    """The key of pages already crawled: all last slashes and the fragment go, the host is in lower case, www stays."""
    full = F.concat(protocol(c), F.lit("://"), F.lower(_part(c, 2)), _part(c, 3), query(c))
    return F.regexp_replace(F.when(is_absolute(c), full).otherwise(c), "/+$", "")


def tree_key(c: Column) -> Column:
    return F.when(is_absolute(c), F.concat(protocol(c), F.lit("://"), host(c), _bare_path(c)))


def without_fragment(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def same_site(a: Column, b: Column) -> Column:
    return hostname(a) == hostname(b)


def within_domain(c: Column, domain: str) -> Column:
    """The domain itself or a subdomain of it."""
    return (hostname(c) == domain) | F.endswith(hostname(c), F.lit("." + domain))


def is_private(c: Column) -> Column:
    """Hosts that must not be fetched: local names, private, loopback and link-local addresses."""
    name = F.regexp_replace(hostname(c), r"^\[|\]$", "")
    address = r"^(127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
    return name.isin("localhost", "::1", "::", "0.0.0.0") | name.rlike(address) | name.rlike(r"\.(local|internal|localhost)$") | name.rlike("^(fc|fd|fe8|fe9|fea|feb)[0-9a-f]*:")


def is_safe(c: Column) -> Column:
    return is_absolute(c) & protocol(c).isin("http", "https") & ~is_private(c)


#: File endings that are no pages.
ASSETS = [
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "bmp", "tiff", "mp4", "mp3", "wav", "avi", "mov", "webm", "pdf", "zip", "rar", "7z", "tar", "gz", "exe", "dmg", "pkg",
    "css", "js", "json", "xml", "woff", "woff2", "ttf", "otf", "eot",
]


def is_asset(c: Column) -> Column:
    return F.lower(path(c)).rlike(r"\.(" + "|".join(ASSETS) + ")$")


#: A page's address up to its path, and links from the root that stay as written behind it: `join` changes nothing in them (no dot segments, parameters, blanks or control characters).
_ORIGIN = r"^(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)(?=[/?#]|\z)"
_PLAIN = r"[\p{L}\p{N}._~%!$&'()*+,=:@/-]"
_FROM_ROOT = rf"^/(?!/)(?!(?:[^?]*/)?\.\.?(?:[/?]|\z)){_PLAIN}*(?:\?{_PLAIN}+)?\z"


def join_plain(base: Column, link: Column) -> Column:
    """As join, for links from the root of a plain http address; null for all others, which need join."""
    origin = F.lower(F.regexp_extract(base, _ORIGIN, 1))
    return F.when((origin != "") & link.rlike(_FROM_ROOT), F.concat(origin, link))


@F.pandas_udf(StringType())
def join(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as seen from its page; null if that is no http address."""

    def one(b: str | None, x: str | None) -> str | None:
        if b is None and x is None:
            return None
        try:
            full = urljoin(b or "", (x or "").strip())
            parts = urlsplit(full)
        except ValueError:
            return None
        if parts.scheme not in ("http", "https") or not parts.netloc:
            return None
        return parts._replace(netloc=parts.netloc.lower(), path=parts.path.replace(" ", "%20") or "/").geturl()

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)
