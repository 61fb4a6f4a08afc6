"""The elements of a page that an audit reads, from one pass of a tokenizer with a stack of open tags; extractors are expressions over that column.

Comments are skipped, quoted attributes may hold `>`, and the text of scripts and styles holds no tags. What has no end tag of its own is not closed: only what is closed has an inside, and only closed
blocks are furniture. An element knows its depth, its range, whether it is in the head, in a block of furniture (navigation, footers, blocks whose class or id says so), or in an svg, script or noscript.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from . import html as h

#: name, attributes (lower-case names, decoded values, the first of each), depth, range, places; inner (as written) and said (its text; of a link, what it says) of what has text; address: href or src resolved.
_FIELDS = {"name": StringType(), "attributes": MapType(StringType(), StringType()), "depth": IntegerType(), "start": IntegerType(), "end": IntegerType(), **dict.fromkeys(("head", "furniture", "hidden", "closed"), BooleanType()), **dict.fromkeys(("inner", "said", "address"), StringType())}
TYPE = ArrayType(StructType([StructField(k, t) for k, t in _FIELDS.items()]))
_KIND = pa.list_(pa.struct([(k, pa.map_(pa.string(), pa.string()) if isinstance(t, MapType) else pa.int32() if isinstance(t, IntegerType) else pa.bool_() if isinstance(t, BooleanType) else pa.string()) for k, t in _FIELDS.items()]))

_TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ANY_TAG = re.compile(r"<[^>]+>")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));")
_BASIC = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#x27;", "'")]
#: Elements without an end tag, elements whose content is text, and blocks that are no content by their name.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style"}
HIDING = {"svg", "noscript"}
NO_CONTENT = {"header", "footer", "nav", "noscript", "iframe"}
BLOCKS = {"div", "section", "aside", "ul", "ol", "form"}
_FURNITURE = re.compile(r"\b(?:" + "|".join(h.FURNITURE) + r")\b", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WITH_TEXT = {"title", "a", *HEADINGS}
KEPT = {"meta", "link", "img", "script", *WITH_TEXT}


def decode(s: str) -> str:
    """Basic and numeric entities, `&amp;` first."""
    if "&" not in s:
        return s
    for entity, raw in _BASIC:
        s = s.replace(entity, raw)

    def one(m: re.Match) -> str:
        point = (int(m[1], 16) if m[1] else int(m[2])) & 0xFFFF
        return "�" if 0xD800 <= point < 0xE000 else chr(point)

    return _NUMBER.sub(one, s)


def said(inner: str) -> str:
    return _SPACE.sub(" ", decode(_ANY_TAG.sub("", inner))).strip()


_HEADING = re.compile(r"<h[1-6]\b[^>]*>(.*?)</h[1-6]>", re.I | re.S)
_LABEL = re.compile(r"<(span|strong|b|em|p)\b[^>]*>(.*?)</\1>", re.I | re.S)
_ALT = re.compile(r"<img\b[^>]*?\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I | re.S)
_BLOCK = re.compile(r"<(div|p)\b[^>]*>(.*?)</\1>", re.I | re.S)
_PRICE, _PRICED = re.compile(r"MRP|₹|\$", re.I), re.compile(r"MRP|₹|\$|inclusive of|taxes", re.I)
_OFFER = re.compile(r"save |off\b", re.I)
_MARKS = re.compile("[®™©]")


def _cut(text: str, most: int) -> str:
    """At a word's end."""
    return text if len(text) <= most else re.sub(r"\s+\S*$", "", text[:most]) + "…"


def link_text(inner: str) -> str:
    """What a link says: its heading, a short label, its image's alt, or its text; a card's heading and description where that says more."""
    whole = said(inner)
    if "<" not in inner:
        return _cut(whole, 100)
    found, label, alt = _HEADING.search(inner), _LABEL.search(inner), _ALT.search(inner)
    heading, label = said(found[1]) if found else "", said(label[2]) if label else ""
    alt = said(alt[1] or alt[2] or "") if alt else ""
    own = heading[:150] if len(heading) > 1 else label if 2 <= len(label) <= 100 else alt[:150] if len(alt) > 1 else _cut(whole, 100)
    card = _card(inner, heading, whole) if heading and (len(own) <= 3 or own == heading) else ""
    return card or own


def _card(inner: str, heading: str, whole: str) -> str:
    """`heading — description`: the longest block that is no price, else what follows the heading's last mention."""
    blocks = [b for b in (said(m[2]) for m in _BLOCK.finditer(inner)) if 40 <= len(b) <= 500 and not _PRICED.search(b) and not _OFFER.search(b)]
    if blocks:
        text = max(blocks, key=len).removeprefix(heading).strip()
        bare, name = _MARKS.sub("", text).strip(), _MARKS.sub("", heading).strip()
        text = bare.removeprefix(name).strip() if bare.startswith(name) else text
        if len(text) > 20:
            return f"{heading} — {_cut(text, 120)}"
    place = whole.rfind(heading)
    rest = whole[place + len(heading) :]
    if place < 0 or len(rest) <= 30:
        return ""
    rest = rest.strip()
    if _PRICED.search(rest):
        price = _PRICE.search(rest)
        if not price or price.start() <= 20:
            return ""
        rest = rest[: price.start()].strip()
    return f"{heading} — {_cut(rest, 120)}" if len(rest) > 20 else ""


def resolve(base: str, address: str) -> str:
    """An address as the page at base means it; as written where it cannot be one."""
    try:
        if address.startswith("//"):
            return f"{urlsplit(base).scheme}:{address}"
        return address if re.match(r"(?i)(https?:|data:)", address) else urljoin(base, address)
    except ValueError:
        return address


def read(page: str, base: str) -> list[dict]:
    """The kept elements of a page, in order."""
    lower, found, stack, furniture, hidden, head = page.lower(), [], [], [], [], None
    at, last = 0, page.rfind(">") + 1  # no tag ends beyond
    while m := _TAG.search(page, at, last):
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _close(stack[k], m.start(), m.end(), page, furniture, hidden)
                    if name == "head" and head is None:
                        head = (stack[k][2], m.start())
                    del stack[k:]  # what was open inside ends here without an end tag
                    break
            continue
        wanted = name in KEPT or name in BLOCKS
        attributes = {}
        if wanted:
            for a in _ATTRIBUTE.finditer(m[3]):
                attributes.setdefault(a[1].lower(), _SPACE.sub(" ", decode(a[2] or a[3] or a[4] or "")).strip())
        element = None
        if name in KEPT:
            href = attributes.get("src" if name == "img" else "href")
            address = resolve(base, href) if href and name in ("a", "img", "link") else None
            element = {"name": name, "attributes": list(attributes.items()), "depth": len(stack), "start": m.start(), "end": m.end(), "head": False, "furniture": False, "hidden": False, "closed": name in VOID, "inner": None, "said": None, "address": address}
            found.append(element)
        if name in RAW:
            end = lower.find(f"</{name}", at)
            if end < 0:
                continue  # never closed: what follows is read as tags
            if element is not None:
                element["closed"], element["inner"] = True, page[at:end]
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            if element is not None:
                element["end"] = at
            continue
        if name in VOID:
            continue
        if name == "a":  # a link ends where the next begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "a":
                    _close(stack[k], m.start(), m.start(), page, furniture, hidden)
                    del stack[k]
                    break
        furnished = name in NO_CONTENT or name in BLOCKS and any(_FURNITURE.search(attributes.get(k, "")) for k in ("class", "id"))
        stack.append((name, m.start(), m.end(), element, furnished))
    furniture, hidden = _merged(furniture), _merged(hidden)
    for e in found:
        e["head"] = head is None or head[0] <= e["start"] < head[1]
        e["furniture"], e["hidden"] = _inside(furniture, e["start"]), _inside(hidden, e["start"])
    return found


def _close(opened: tuple, inner_end: int, end: int, page: str, furniture: list, hidden: list) -> None:
    name, start, inner_start, element, furnished = opened
    if furnished:
        furniture.append((start, end))
    if name in HIDING:
        hidden.append((start, end))
    if element is not None:
        element["closed"], element["end"] = True, end
        if name in WITH_TEXT:
            element["inner"] = page[inner_start:inner_end]
            element["said"] = (link_text if name == "a" else said)(element["inner"])


def _merged(ranges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The starts and ends of the ranges, overlapping ones as one."""
    starts, ends = [], []
    for start, end in sorted(ranges):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _inside(ranges: tuple[list[int], list[int]], place: int) -> bool:
    k = bisect_right(ranges[0], place) - 1
    return k >= 0 and place < ranges[1][k]


#: Bytes of pages that are Python objects at a time: their elements take some thirty times as much.
SLICE = 1 << 20


def cuts(page: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, length) of the ranges of a batch whose pages take at most limit bytes, or are one page."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(page), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(page):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, to - at
        at = to


@F.arrow_udf(TYPE)
def elements(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The elements of pages (html, url), handed on slice by slice: a worker never holds those of a whole batch."""
    for page, base in batches:
        for at, n in cuts(page):
            yield pa.array([read(p or "", b or "") for p, b in zip(page.slice(at, n).to_pylist(), base.slice(at, n).to_pylist(), strict=True)], _KIND)


@F.arrow_udf(ArrayType(StringType()))
def pretty_all(texts: pa.Array) -> pa.Array:
    """Each text that is JSON with two spaces of indent; what is no JSON stays."""
    return pa.array([None if own is None else [pretty(t) for t in own] for own in texts.to_pylist()], pa.list_(pa.string()))


def pretty(text: str) -> str:
    def refuse(_: str) -> None:
        raise ValueError

    try:
        return json.dumps(_plain(json.loads(text, parse_constant=refuse)), indent=2, ensure_ascii=False)
    except (ValueError, RecursionError):
        return text


def _plain(value):
    """Whole numbers are written without a fraction."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 1e21 else value


# Expressions over an elements column.


def _of(e: Column, *names: str) -> Column:
    return F.filter(e, lambda x: x["name"].isin(*names))


def attribute(x: Column, name: str) -> Column:
    """An attribute of an element, `` if it has none."""
    return F.coalesce(F.try_element_at(x["attributes"], F.lit(name)), F.lit(""))


def _first(values: Column) -> Column:
    return F.coalesce(F.get(F.filter(values, lambda x: x != ""), F.lit(0)), F.lit(""))


def title(e: Column) -> Column:
    seen = F.filter(_of(e, "title"), lambda x: ~x["hidden"] & x["closed"])
    return F.coalesce(F.get(F.filter(seen, lambda x: x["head"]), F.lit(0))["said"], F.get(seen, F.lit(0))["said"], F.lit(""))


def named_meta(e: Column, name: str) -> Column:
    return _first(F.transform(F.filter(_of(e, "meta"), lambda x: F.lower(attribute(x, "name")) == name), lambda x: attribute(x, "content")))


def headings(e: Column, tag: str) -> Column:
    found = F.filter(_of(e, tag), lambda x: ~x["hidden"] & x["closed"] & (x["said"] != ""))
    return F.transform(found, lambda x: F.substring(x["said"], 1, 200))


def images(e: Column) -> Column:
    """(src resolved, alt or null) of each image that is no data URL."""
    found = F.filter(_of(e, "img"), lambda x: (attribute(x, "src") != "") & ~F.startswith(x["address"], F.lit("data:")))
    return F.transform(found, lambda x: F.struct(x["address"].alias("src"), F.nullif(attribute(x, "alt"), F.lit("")).alias("alt")))


def json_ld(e: Column) -> Column:
    found = F.filter(_of(e, "script"), lambda x: (F.lower(attribute(x, "type")) == "application/ld+json") & x["closed"])
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x["inner"], r"^\s+|\s+$", ""))), lambda x: x != "")


def _links(e: Column, rel: str) -> Column:
    return F.filter(_of(e, "link"), lambda x: F.lower(attribute(x, "rel")) == rel)


def canonical(e: Column) -> Column:
    return _first(F.transform(_links(e, "canonical"), lambda x: attribute(x, "href")))


def hreflangs(e: Column) -> Column:
    found = F.filter(_links(e, "alternate"), lambda x: (attribute(x, "hreflang") != "") & (attribute(x, "href") != ""))
    return F.transform(found, lambda x: F.struct(attribute(x, "href").alias("href"), attribute(x, "hreflang").alias("hreflang")))


#: Properties that hold addresses.
_ADDRESSES = ["og:image", "og:image:secure_url", "og:video", "og:audio", "og:url", "twitter:image", "twitter:url", "twitter:player"]


def social_tags(e: Column, page: Column) -> Column:
    """(network, property, content) of the head's social tags, each once; addresses resolved."""
    key = lambda x: F.lower(F.trim(F.coalesce(F.nullif(attribute(x, "property"), F.lit("")), attribute(x, "name"))))
    found = F.transform(F.filter(_of(e, "meta"), lambda x: x["head"]), lambda x: F.struct(key(x).alias("property"), attribute(x, "content").alias("content")))
    found = F.filter(found, lambda t: t["property"].rlike("^(og|twitter):") & (t["content"] != ""))
    origin, scheme = F.regexp_extract(page, "^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract(page, "^([A-Za-z]+:)//", 1)
    folder = F.regexp_extract(page, "^([A-Za-z]+://[^/?#]*(?:[^?#]*/)?)", 1)
    full = lambda c: F.when(c.rlike("(?i)^(https?://|data:)"), c).when(F.startswith(c, F.lit("//")), F.concat(scheme, c)).when(F.startswith(c, F.lit("/")), F.concat(origin, c)).otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), c))
    return F.array_distinct(F.transform(found, lambda t: F.struct(F.when(F.startswith(t["property"], F.lit("og:")), "og").otherwise("twitter").alias("network"), t["property"].alias("property"), F.when(t["property"].isin(_ADDRESSES), full(t["content"])).otherwise(t["content"]).alias("content"))))


def anchors(e: Column, main: bool = False) -> Column:
    """(href, rel, said, address) of each link that leads to a page; main: outside furniture."""
    parts = F.transform(F.filter(_of(e, "a"), lambda x: x["closed"] & (~x["furniture"] if main else F.lit(True))), lambda x: F.struct(attribute(x, "href").alias("href"), F.lower(attribute(x, "rel")).alias("rel"), x["said"].alias("said"), x["address"].alias("address")))
    return F.filter(parts, lambda p: (p["href"] != "") & ~p["href"].rlike("(?i)^(#|javascript:|mailto:|tel:)"))
