"""Address discovery over stored pages, sitemaps and robots files."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from ..functions import urls as U
from ..sources.scratch import cut


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """``host, sitemap`` of each ``Sitemap:`` line."""
    lines = robots.select("host", F.explode(F.split("text", "\n")).alias("line"))
    found = lines.select("host", F.regexp_extract("line", r"(?i)^\s*Sitemap:\s*(\S+)\s*$", 1).alias("sitemap"))
    return found.where("sitemap <> ''")


@F.pandas_udf(StructType().add("kind", StringType()).add("locs", ArrayType(StringType())))
def _sitemap(xml: pd.Series) -> pd.DataFrame:
    from xml.etree import ElementTree

    def one(text: str | None) -> dict:
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError:
            return {"kind": None, "locs": []}
        locs = [e.text.strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc" and e.text]
        return {"kind": "index" if root.tag.endswith("sitemapindex") else "urls", "locs": locs}

    return pd.DataFrame([one(x) for x in xml])


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """``sitemap, kind, loc``: pages (``urls``) or child sitemaps (``index``); a malformed document has no rows."""
    parsed = sitemaps.select(F.col("url").alias("sitemap"), _sitemap("xml").alias("s"))
    return parsed.select("sitemap", "s.kind", F.explode("s.locs").alias("loc"))


def expand_sitemaps(seeds: DataFrame, sitemaps: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Article addresses below the seed sitemaps (``url``); every sitemap is read once, level by level until none is new."""
    entries = cut(sitemap_entries(sitemaps), "sitemaps")
    level = seen = cut(seeds.select("url").distinct(), "level")
    found = None
    while level.take(1):
        at = entries.join(level, entries.sitemap == level.url, "left_semi")
        pages = at.where("kind = 'urls'").where(U.is_article_url("loc", patterns)).select(F.col("loc").alias("url"))
        found = pages if found is None else found.unionByName(pages)
        level = cut(at.where("kind = 'index'").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"), "level")
        seen = seen.unionByName(level)
    return seen.limit(0) if found is None else found.distinct()


#: Links that expressions resolve as the exact form does: absolute, or from the root, without a query or dots to climb.
PLAIN_LINK = r"^(?:[a-z]+://[A-Za-z0-9.:-]+|/(?=[^/]|$))[^?#%;\s]*$"


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, url, link``: each link's exact normalised form, resolved against its page; odd ones by a vectorised helper."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    rows = pages.select("page_id", "url", F.explode(hrefs).alias("href"))
    simple = F.col("href").rlike(PLAIN_LINK) & ~F.col("href").contains("/.") & F.col("url").rlike("^[a-z]+://[^/?#]+")
    whole = F.when(F.col("href").startswith("/"), F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), "href")).otherwise(F.col("href"))
    easy = rows.where(simple).select("page_id", "url", U.normalize_url(whole).alias("link"))
    odd = rows.where(~F.coalesce(simple, F.lit(False))).select("page_id", "url", U.normalize_url_exact("href", "url").alias("link"))
    return easy.unionByName(odd.where("link is not null"))


def classify_links(links: DataFrame, base: str, patterns: Iterable[str], seen: DataFrame, roots: Iterable[str] | None = None) -> DataFrame:
    """``link, kind`` of the distinct unseen links within the base's domain: ``article``, or ``frontier`` under a category root
    (``roots``; the base itself where none are given)."""
    own = links.select("link").distinct().where(U.same_domain("link", F.lit(base)))
    below = reduce(lambda out, r: out | F.col("link").startswith(r), roots or [base], F.lit(False))
    kind = F.when(U.is_article_url("link", patterns), "article").when(below, "frontier")
    return own.withColumn("kind", kind).where("kind is not null").join(seen.select(F.col("url").alias("link")), "link", "left_anti")


def crawl(pages: DataFrame, roots: DataFrame, base: str, patterns: Iterable[str], max_pages: int = 200, under: Iterable[str] | None = None) -> DataFrame:
    """Articles reached from ``roots`` (``url``) over stored pages, breadth first, visiting ``max_pages`` pages at most.

    ``url, level``. The bound is the operator's feature; within a level pages come in order of their address. ``under``:
    prefixes of pages that may be visited. Levels go on until the bound is reached or nothing is left to visit.
    """
    links = cut(page_links(pages.withColumn("url", U.normalize_url("url"))), "links")
    level = seen = roots.select("url").distinct()
    visited, depth, found = 0, 0, roots.select("url", F.lit(0).alias("level")).limit(0)
    while visited < max_pages:
        level = cut(level.orderBy("url").limit(max_pages - visited), "level")
        n = level.count()
        if not n:
            break
        visited += n
        at = cut(classify_links(links.join(level, "url", "left_semi"), base, patterns, seen, under), "links")
        found = found.unionByName(at.where("kind = 'article'").select(F.col("link").alias("url"), F.lit(depth).alias("level")))
        seen = cut(seen.unionByName(at.select(F.col("link").alias("url"))), "seen")
        level, depth = at.where("kind = 'frontier'").select(F.col("link").alias("url")), depth + 1
    return found


def discover(pages: DataFrame, category_roots: DataFrame, base: str, patterns: Iterable[str], least: int = 50) -> DataFrame:
    """The crawl from the category roots, and from the base too where that finds fewer than ``least`` addresses."""
    found = cut(crawl(pages, category_roots, base, patterns).select("url").distinct())
    if found.count() >= least:
        return found
    again = crawl(pages, pages.sparkSession.createDataFrame([(base,)], "url string"), base, patterns)
    return found.unionByName(again.select("url")).distinct()


def urls_in_text(texts: DataFrame, base: str, patterns: Iterable[str]) -> DataFrame:
    """Distinct article addresses of the base's domain out of any text, search results in JSON for one."""
    found = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"""https?://[^"']+"""), F.lit(0))).alias("url"))
    return found.where(U.same_domain("url", F.lit(base)) & U.is_article_url("url", patterns)).distinct()


def merge_discovered(lists: list[DataFrame], max_urls: int | None = None) -> DataFrame:
    """Addresses of all lists, distinct and sorted, the first ``max_urls`` where given."""
    every = lists[0].select("url")
    for more in lists[1:]:
        every = every.unionByName(more.select("url"))
    ordered = every.distinct().orderBy("url")
    return ordered.limit(max_urls) if max_urls else ordered


def enabled_urls(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """Addresses whose host is that of an enabled source (``base_url, key, enabled``)."""
    hosts = sources.where("enabled").select(U.netloc_of("base_url").alias("h_"))
    return urls.withColumn("h_", U.netloc_of("url")).join(hosts, "h_", "left_semi").drop("h_")


def source_of_urls(urls: DataFrame, sources: DataFrame) -> DataFrame:
    hosts = sources.select(U.netloc_of("base_url").alias("h_"), F.col("key").alias("source_key")).dropDuplicates(["h_"])
    return urls.withColumn("h_", U.netloc_of("url")).join(hosts, "h_", "left").drop("h_")


def robots_verdicts(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``url, allowed`` under each host's robots file (``host, text``); a host without one allows all.

    Rules are parsed once a host and batch; files travel to their host's addresses by a join, which splits a hot host.
    """

    @F.pandas_udf(BooleanType())
    def verdict(url: pd.Series, rules: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        parsed: dict = {}

        def one(u, text) -> bool:
            if not isinstance(text, str):
                return True
            if text not in parsed:
                parsed[text] = RobotFileParser()
                parsed[text].parse(text.splitlines())
            return parsed[text].can_fetch(agent, u)

        return pd.Series([one(u, t) for u, t in zip(url, rules)])

    rows = urls.withColumn("h_", U.netloc_of("url")).join(robots.select(F.col("host").alias("h_"), F.col("text").alias("rules_")), "h_", "left")
    return rows.withColumn("allowed", verdict("url", "rules_")).drop("h_", "rules_")
