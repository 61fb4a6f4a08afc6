"""Fields of raw HTML as expressions: tolerant patterns, as crawlers use them, not a parser."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import script
from .scalars import cut_at_word, text


def without_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def without_blocks(c: Column, *tags: str) -> Column:
    for tag in tags:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return c


def head(c: Column) -> Column:
    """The head, or all if there is none."""
    found = F.regexp_extract(c, r"(?is)<head\b[^>]*>(.*?)</head>", 1)
    return F.when(found == "", c).otherwise(found)


def decode(c: Column) -> Column:
    """Basic entities, `&amp;` first, so that what was encoded twice is decoded twice; others stay."""
    for entity, raw in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&#x27;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(raw))
    return c


@F.pandas_udf(StringType())
def decode_numbers(c: pd.Series) -> pd.Series:
    """Numeric character references, decimal and hexadecimal; code points are cut to 16 bits."""
    pattern = re.compile(r"&#(?:x([0-9a-f]+)|([0-9]+));", re.I)

    def one(m: re.Match) -> str:
        point = (int(m[1], 16) if m[1] else int(m[2])) & 0xFFFF
        return "�" if 0xD800 <= point < 0xE000 else chr(point)

    return c.map(lambda s: None if s is None else pattern.sub(one, s))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<[^>]*>", " ")


def title(c: Column) -> Column:
    clean = without_blocks(without_comments(text(c)), "svg", "script", "noscript")
    pattern = r"(?is)<title\b[^>]*>(.*?)</title>"
    inside = F.regexp_extract(head(clean), pattern, 1)
    return collapse(decode(F.when(inside != "", inside).otherwise(F.regexp_extract(clean, pattern, 1))))


def _tags(c: Column, tag: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(?is)(<{tag}\b[^>]*>)"), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    """A quoted or bare attribute of a tag; the first that begins at a word boundary."""
    double = F.regexp_extract(tag, rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.when(double != "", double).when(single != "", single).otherwise(bare)


def named_meta(c: Column, name: str) -> Column:
    """The first non-empty content of a meta tag of that name."""
    contents = F.transform(F.filter(_tags(without_comments(text(c)), "meta"), lambda t: F.lower(attribute(t, "name")) == name), lambda t: collapse(decode(attribute(t, "content"))))
    return F.coalesce(F.get(F.filter(contents, lambda x: x != ""), F.lit(0)), F.lit(""))


def description(c: Column) -> Column:
    return named_meta(c, "description")


def robots(c: Column) -> Column:
    return named_meta(c, "robots")


def headings(c: Column, tag: str) -> Column:
    clean = without_blocks(without_comments(text(c)), "svg", "script", "style", "noscript")
    found = F.regexp_extract_all(clean, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.substring(collapse(decode(without_tags(x))), 1, 200)), lambda x: x != "")


def json_ld(c: Column) -> Column:
    found = F.regexp_extract_all(text(c), F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def schema_label(c: Column) -> Column:
    """The types that a JSON-LD text declares; `Raw` if it is no JSON."""
    parsed = F.try_parse_json(c)
    types = lambda v: F.coalesce(F.array_join(F.try_variant_get(v, "$['@type']", "array<string>"), ", "), F.try_variant_get(v, "$['@type']", "string"))
    graph = F.array_join(F.filter(F.transform(F.try_variant_get(parsed, "$['@graph']", "array<variant>"), types), lambda x: x.isNotNull() & (x != "")), " + ")
    many = F.array_join(F.filter(F.transform(F.try_variant_get(parsed, "$", "array<variant>"), types), lambda x: x.isNotNull() & (x != "")), " + ")
    full = lambda x: F.when(x != "", x)
    own = F.when(F.try_variant_get(parsed, "$", "array<variant>").isNull(), types(parsed))
    return F.when(parsed.isNull(), "Raw").otherwise(F.coalesce(full(own), full(graph), full(many), F.lit("Schema")))


def canonical(c: Column) -> Column:
    links = F.filter(_tags(text(c), "link"), lambda t: F.lower(attribute(t, "rel")) == "canonical")
    return F.coalesce(F.get(F.filter(F.transform(links, lambda t: F.trim(attribute(t, "href"))), lambda x: x != ""), F.lit(0)), F.lit(""))


def canonical_status(page: Column, target: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^([A-Za-z]+://[^/?#]*)$", "$1/"), "/+$", "")
    return F.when(text(target) == "", "Missing").when(bare(page) == bare(target), "Self Referencing").otherwise("Canonicalised")


def hreflangs(c: Column) -> Column:
    links = F.filter(_tags(text(c), "link"), lambda t: (F.lower(attribute(t, "rel")) == "alternate") & (attribute(t, "hreflang") != "") & (attribute(t, "href") != ""))
    return F.transform(links, lambda t: F.struct(attribute(t, "href").alias("href"), attribute(t, "hreflang").alias("hreflang")))


def images(c: Column) -> Column:
    """(src as written, alt or null) of each image that is no data URL."""
    tags = F.filter(_tags(text(c), "img"), lambda t: (attribute(t, "src") != "") & ~F.startswith(attribute(t, "src"), F.lit("data:")))
    alt = lambda t: F.trim(decode(attribute(t, "alt")))
    return F.transform(tags, lambda t: F.struct(attribute(t, "src").alias("src"), F.when(alt(t) != "", alt(t)).alias("alt")))


def social_tags(c: Column) -> Column:
    def key(t: Column) -> Column:
        prop, name = F.lower(attribute(t, "property")), F.lower(attribute(t, "name"))
        return F.when(prop.rlike("^(og|twitter):"), prop).when(name.rlike("^(og|twitter):"), name)

    tags = F.filter(_tags(head(without_comments(text(c))), "meta"), lambda t: key(t).isNotNull() & (attribute(t, "content") != ""))
    return F.array_distinct(F.transform(tags, lambda t: F.struct(F.when(F.startswith(key(t), F.lit("og:")), "og").otherwise("twitter").alias("network"), key(t).alias("property"), decode(attribute(t, "content")).alias("content"))))


#: Class and id words of page furniture.
FURNITURE = [
    "nav", "menu", "sidebar", "footer", "header", "breadcrumb", "social", "share", "widget", "advert", "cookie", "popup", "modal", "comment", "related", "newsletter",
    "signup", "subscribe", "promo", "banner", "toolbar", "topbar", "bottombar", "masthead", "drawer", "overlay", "lightbox", "sticky", "dock",
]


@F.pandas_udf(StringType())
def without_furniture(c: pd.Series) -> pd.Series:
    """Balanced blocks whose class or id names furniture are removed; ranges are merged before they are cut."""
    opener = re.compile(r"<(div|section|aside|ul|ol|form)\b[^>]*\b(?:class|id)\s*=\s*[\"'][^\"']*\b(?:" + "|".join(FURNITURE) + r")\b[^\"']*[\"'][^>]*>", re.I)

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        out, at = [], 0
        for m in opener.finditer(s):
            if m.start() < at:
                continue
            depth, end = 1, len(s)
            for t in re.compile(rf"<(/?){m[1]}\b[^>]*>", re.I).finditer(s, m.end()):
                depth += -1 if t[1] else 1
                if not depth:
                    end = t.end()
                    break
            out.append(s[at : m.start()])
            at = end
        return "".join([*out, s[at:]])

    return c.map(one)


def main_content(c: Column) -> Column:
    body = F.regexp_extract(text(c), r"(?is)<body\b[^>]*>(.*)</body>", 1)
    return without_blocks(without_comments(F.when(body != "", body).otherwise(text(c))), "header", "footer", "nav", "script", "style", "noscript", "iframe")


def _plain(x: Column) -> Column:
    return collapse(decode(F.regexp_replace(x, r"(?s)<[^>]*>", "")))


def _heading(inner: Column) -> Column:
    return _plain(F.regexp_extract(inner, r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>", 1))


def anchor_text(inner: Column) -> Column:
    """What a link says: its heading, a short inline label, its image's alt, or the whole text cut at a word."""
    label = _plain(F.regexp_extract(inner, r"(?is)<(span|strong|b|em|p)\b[^>]*>(.*?)</\1>", 2))
    alt = collapse(decode(attribute(F.regexp_extract(inner, r"(?is)(<img\b[^>]*>)", 1), "alt")))
    heading = _heading(inner)
    return F.when(F.length(heading) > 1, F.substring(heading, 1, 150)).when(F.length(label).between(2, 100), label).when(F.length(alt) > 1, F.substring(alt, 1, 150)).otherwise(cut_at_word(_plain(inner), 100))


_PRICE, _PRICED = r"(?i)MRP|₹|\$", r"(?i)MRP|₹|\$|inclusive of|taxes"


def card_text(inner: Column) -> Column:
    """`heading — description` of a link around a card, null if it is none: the longest description that is no price, else what follows the heading."""
    heading, whole = _heading(inner), _plain(inner)
    blocks = F.transform(F.regexp_extract_all(inner, F.lit(r"(?is)<(div|p)\b[^>]*>(.*?)</\1>"), F.lit(2)), _plain)
    fit = F.filter(blocks, lambda x: F.length(x).between(40, 500) & ~x.rlike(_PRICED + r"|(?i)save |off\b"))
    longest = F.array_max(F.transform(fit, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("text"))))["text"]
    unmarked = lambda c: F.trim(F.regexp_replace(c, "[®™©]", ""))
    after = lambda c, start: F.trim(F.substring(c, F.length(start) + 1, F.length(c)))
    first = F.when(F.startswith(longest, heading), after(longest, heading)).otherwise(longest)
    clean = F.when(F.startswith(unmarked(first), unmarked(heading)), after(unmarked(first), unmarked(heading))).otherwise(first)
    return F.when(heading == "", None).when(F.length(clean) > 20, F.concat(heading, F.lit(" — "), cut_at_word(clean, 120))).otherwise(_card_tail(heading, whole))


def _card_tail(heading: Column, whole: Column) -> Column:
    """What follows the last mention of the heading, up to a price."""
    place = F.length(whole) - F.instr(F.reverse(whole), F.reverse(heading)) - F.length(heading) + 2
    rest = F.substring(whole, place + F.length(heading), F.length(whole))
    price = F.length(F.regexp_extract(F.trim(rest), "(?is)^(.*?)(?:MRP|₹|\\$)", 1))
    described = F.when(~F.trim(rest).rlike(_PRICED), F.trim(rest)).when(F.trim(rest).rlike(_PRICE) & (price > 20), F.trim(F.substring(F.trim(rest), F.lit(1), price)))
    return F.when((F.instr(F.reverse(whole), F.reverse(heading)) > 0) & (F.length(rest) > 30) & (F.length(described) > 20), F.concat(heading, F.lit(" — "), cut_at_word(described, 120)))


def link_text(inner: Column) -> Column:
    """The link's text, or its card's where the text is at most 3 characters or the card's heading."""
    own, card = anchor_text(inner), card_text(inner)
    full = F.when(card.isNotNull() & ((F.length(own) <= 3) | (own == _heading(inner))), card).otherwise(own)
    return F.when(~F.contains(inner, F.lit("<")), cut_at_word(_plain(inner), 100)).otherwise(full)  # most links hold text alone


#: Link texts that say nothing of their target.
GENERIC = [
    "shop now", "read more", "click here", "learn more", "view more", "see more", "buy now", "order now", "add to cart", "view details", "more info", "details", "here", "link",
    "go", "visit", "explore", "discover", "get started", "continue", "next", "previous", "back", "submit", "download", "sign up", "subscribe", "join", "contact us", "get in touch",
]


def is_generic(anchor: Column) -> Column:
    return F.lower(F.trim(anchor)).isin(GENERIC)


def hrefs(c: Column) -> Column:
    """Every link of the page as written that may lead to a page."""
    tags = F.transform(_tags(without_comments(text(c)), "a"), lambda t: F.trim(attribute(t, "href")))
    return F.filter(tags, lambda x: (x != "") & ~x.rlike("^(javascript|mailto|tel):"))


def social_map(c: Column) -> Column:
    """property -> content of the social tags, the last of a property."""
    return F.aggregate(social_tags(c), F.create_map().cast("map<string,string>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, _: k != t["property"]), F.create_map(t["property"], t["content"])))


def anchors(c: Column) -> Column:
    """(href as written, rel, inner HTML) of each link that leads to a page."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    parts = F.transform(found, lambda a: F.struct(F.trim(decode(attribute(F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1), "href"))).alias("href"), F.lower(attribute(F.regexp_extract(a, r"(?is)^(<a\b[^>]*>)", 1), "rel")).alias("rel"), F.regexp_extract(a, r"(?is)^<a\b[^>]*>(.*)</a>$", 1).alias("inner")))
    return F.filter(parts, lambda p: (p["href"] != "") & ~p["href"].rlike("(?i)^(#|javascript:|mailto:|tel:)"))


def meta_refresh(c: Column) -> Column:
    """(delay, target as written) of a refresh within 5 seconds, else null."""
    tags = F.filter(_tags(head(without_comments(text(c))), "meta"), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh")
    content = decode(F.get(F.transform(tags, lambda t: attribute(t, "content")), F.lit(0)))
    return refresh(content)


def refresh(content: Column) -> Column:
    """(delay, target) of a refresh value within 5 seconds, else null."""
    delay = F.regexp_extract(content, r"^\s*([0-9.]+)", 1).try_cast("double")
    target = F.regexp_extract(content, r"(?i)url\s*=\s*[\"']?([^\"'\s;]+)", 1)
    return F.when((delay <= 5) & (target != ""), F.struct(delay.alias("delay"), target.alias("target")))


@F.pandas_udf(StringType())
def _script_redirect(c: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([script.redirect(page, own) for page, own in zip(c, base, strict=True)], dtype=object)


def script_redirect(c: Column, base: Column | None = None) -> Column:
    """The address, as written, that a script of the page goes to at once: assignments to location outside event handlers. A page does not lead to itself (base)."""
    return _script_redirect(c, F.lit("") if base is None else base)


#: What rich text may hold.
ALLOWED_TAGS = {
    "p", "br", "hr", "span", "div", "b", "strong", "i", "em", "u", "s", "strike", "sup", "sub", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "blockquote", "pre", "code",
    "a", "img", "table", "thead", "tbody", "tr", "th", "td",
}
ALLOWED_ATTRIBUTES = {"href", "target", "rel", "src", "alt", "title", "class", "colspan", "rowspan"}


@F.pandas_udf(StringType())
def sanitise(c: pd.Series) -> pd.Series:
    """Rich text without other tags, attributes and addresses than the allowed; scripts and styles go with what they hold."""
    drop = re.compile(r"<(script|style|iframe|object)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)", re.I | re.S)
    tag = re.compile(r"<(/?)([a-z][a-z0-9]*)\b([^>]*)>", re.I)
    pair = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

    def kept(m: re.Match) -> str:
        name = m[2].lower()
        if name not in ALLOWED_TAGS:
            return ""
        if m[1]:
            return f"</{name}>"
        own = []
        for p in pair.finditer(m[3]):
            value = entities.unescape(p[2] or p[3] or p[4] or "")
            if p[1].lower() in ALLOWED_ATTRIBUTES and not re.match(r"[\s\x00-\x1f]*(javascript|data|vbscript)\s*:", value, re.I):
                own.append(f' {p[1].lower()}="{entities.escape(value)}"')
        return f"<{name}{''.join(own)}>"

    return c.map(lambda s: None if s is None else tag.sub(kept, drop.sub("", s)))
