"""robots.txt: parsed to rule rows, matched against URLs and agents, suggested from a crawl."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

#: Directives that are known though they have no effect here.
KNOWN = {"host", "clean-param", "noindex", "request-rate", "visit-time"}
#: Agents by kind.
BOTS = {
    "Search": ["Googlebot", "Googlebot-Image", "Googlebot-News", "Googlebot-Video", "Bingbot", "Slurp", "DuckDuckBot", "YandexBot", "Baiduspider", "Applebot"],
    "AI": ["GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-Web", "anthropic-ai", "PerplexityBot", "Perplexity-User", "Google-Extended", "CCBot", "Bytespider", "Amazonbot", "Meta-ExternalAgent", "cohere-ai", "Diffbot"],
    "Social": ["facebookexternalhit", "Twitterbot", "LinkedInBot", "Pinterestbot", "WhatsApp", "TelegramBot"],
    "SEO": ["AhrefsBot", "SemrushBot", "MJ12bot", "DotBot", "rogerbot", "Screaming Frog SEO Spider"],
}
ROWS = "source string, kind string, grp int, agents array<string>, rule int, line int, path string, value double"


def _rows(content: str) -> Iterator[tuple]:
    """(kind, group, agents, rule, line, path, value): agent and rule rows carry their group's agents."""
    groups: list[dict] = []
    other, open_agents = [], False
    for line, raw in enumerate(re.split(r"\r?\n", content), 1):
        bare = raw.split("#", 1)[0].strip()
        if not bare:
            continue
        m = re.fullmatch(r"([A-Za-z-]+)\s*:\s*(.*)", bare)
        if not m:
            other.append(("warning", line, f"Malformed line: {raw.strip()}"))
            continue
        name, value = m[1].lower(), m[2].strip()
        if name == "user-agent":
            if not value:
                other.append(("warning", line, "Empty user-agent"))
                continue
            if not groups or not open_agents:
                groups.append({"agents": [], "rules": [], "delay": None})
                open_agents = True
            groups[-1]["agents"].append(value.lower())
        elif name == "sitemap":
            if value:
                other.append(("sitemap", line, value))
        elif name in ("allow", "disallow"):
            if not groups:
                other.append(("warning", line, f"{m[1]} before any user-agent"))
                continue
            open_agents = False
            if name == "allow" or value:
                groups[-1]["rules"].append((name, line, value))
        elif name == "crawl-delay":
            if groups:
                try:
                    groups[-1]["delay"] = (line, float(value))
                except ValueError:
                    pass
        elif name not in KNOWN:
            other.append(("warning", line, f"Unknown directive: {m[1]}"))
    for g, own in enumerate(groups):
        yield "group", g, own["agents"], None, None, None, None
        for k, (name, line, path) in enumerate(own["rules"]):
            yield name, g, own["agents"], k, line, path, None
        if own["delay"]:
            yield "crawl-delay", g, own["agents"], None, own["delay"][0], None, own["delay"][1]
    for kind, line, what in other:
        yield kind, None, None, None, line, what, None


def parse(files: DataFrame) -> DataFrame:
    """ROWS of files (source, content): one row a group, rule, delay, sitemap and warning."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            rows = [(source, *r) for source, content in zip(batch["source"], batch["content"], strict=True) for r in _rows(content or "")]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("grp", "rule", "line"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("source", "content").mapInPandas(parsed, ROWS)


def pattern(path: Column) -> Column:
    """A rule's path as a regular expression: `*` is anything, a last `$` the end."""
    path = F.when(path == "", "/").otherwise(path)
    body = F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(F.endswith(path, F.lit("$")), "$").otherwise(""))


def groups(parsed: DataFrame, agents: DataFrame) -> DataFrame:
    """source, agent, grp: the group that speaks for each agent of agents (agent) in each file: of the longest token in its name, the first of equals; else the last group for all."""
    tokens = parsed.where("kind = 'group'").select("source", "grp", F.posexplode("agents").alias("nth", "token"))
    any_agent = F.col("token") == "*"
    # tokens without `*` meet the agents that hold them: few agents, so this is one pass over the tokens
    fits = tokens.join(F.broadcast(agents.select("agent").distinct()), any_agent | F.contains(F.lower("agent"), F.col("token")))
    rank = F.struct((~any_agent).alias("own"), F.when(any_agent, 0).otherwise(F.length("token")).alias("length"), F.when(any_agent, F.col("grp")).otherwise(-F.col("grp")).alias("place"), (-F.col("nth")).alias("nth"))
    return fits.groupBy("source", "agent").agg(F.max_by("grp", rank).alias("grp"))


def index(parsed: DataFrame) -> DataFrame:
    """source, grp, prefix, kind, path, line, rule, wild of every rule: prefix is what a matching path begins with, up to the first wildcard; wild: whether more than that is asked."""
    rules = parsed.where("kind in ('allow', 'disallow')").select("source", "grp", "kind", "path", "line", "rule", F.when(F.col("path") == "", "/").otherwise(F.col("path")).alias("asked"))
    prefix = F.regexp_extract("asked", r"^([^*]*?)(?:[*].*|[$])?$", 1)
    return rules.select("source", "grp", prefix.alias("prefix"), "kind", "path", "line", "rule", (prefix != F.col("asked")).alias("wild"))


def candidates(indexed: DataFrame, cases: DataFrame) -> DataFrame:
    """cases (source, grp, place, ...) with each rule of their group whose prefix their place begins with.

    A place is cut at the lengths of its group's prefixes, and the cuts are joined with the prefixes: a case costs as many rows as its group has lengths, however many rules it has.
    """
    lengths = indexed.groupBy("source", "grp").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    at = F.explode(F.filter("lengths", lambda n: n <= F.length("place")))
    cut = cases.join(lengths, ["source", "grp"]).select(*cases.columns, at.alias("n")).withColumn("prefix", F.expr("substring(place, 1, n)")).drop("n")
    return cut.join(indexed, ["source", "grp", "prefix"])


def match(parsed: DataFrame, tests: DataFrame) -> DataFrame:
    """source, url, agent, allowed, kind, path, line of tests (source, url, agent): the winning rule, null if none matched.

    Of the rules whose prefix the address begins with, those with wildcards are tried as patterns; the most specific wins, allow before disallow, then the first.
    """
    cases = tests.select("source", "url", "agent").distinct()
    place = F.concat(urls.path(F.col("url")), urls.query(F.col("url")))
    asked = cases.where(urls.is_absolute(F.col("url"))).join(groups(parsed, cases), ["source", "agent"]).withColumn("place", place)
    met = candidates(index(parsed), asked).where(~F.col("wild") | F.rlike("place", pattern(F.col("path"))))
    specific = F.length(F.regexp_replace(F.regexp_replace("path", r"\*", ""), r"\$$", ""))
    rank = F.struct(specific.alias("specific"), (F.col("kind") == "allow").alias("allow"), (-F.col("rule")).alias("rule"))
    won = met.groupBy("source", "url", "agent").agg(F.max_by(F.struct("kind", "path", "line"), rank).alias("won")).select("source", "url", "agent", "won.*")
    return cases.join(won, ["source", "url", "agent"], "left").select("source", "url", "agent", (F.coalesce("kind", F.lit("allow")) == "allow").alias("allowed"), "kind", "path", "line")


def bots(spark: SparkSession) -> DataFrame:
    """kind, agent of the known agents, to test a page against all of them."""
    return spark.createDataFrame([(k, a) for k, own in BOTS.items() for a in own], "kind string, agent string")


def suggested(crawl: DataFrame) -> DataFrame:
    """prefix, errors of first directories with two or more errors of the kind that should not be crawled."""
    rows = crawl.where(F.col("status_code").isin(401, 403, 404, 410)).where(F.size(urls.segments(F.col("url"))) > 0)
    return rows.groupBy(F.concat(urls.segment(F.col("url")), F.lit("/")).alias("prefix")).agg(F.count("*").alias("errors")).where("errors >= 2")


def generate(crawl: DataFrame, domain: str) -> DataFrame:
    """One row: the text of a robots.txt that keeps crawlers out of the suggested directories."""
    lines = suggested(crawl).agg(F.array_join(F.transform(F.array_sort(F.collect_list("prefix")), lambda p: F.concat(F.lit("Disallow: "), p)), "\n").alias("rules"))
    return lines.select(F.concat_ws("\n", F.lit("User-agent: *"), F.lit("Allow: /"), F.when(F.col("rules") != "", F.col("rules")), F.lit(""), F.lit(f"Sitemap: https://{domain}/sitemap.xml"), F.lit("")).alias("content"))
