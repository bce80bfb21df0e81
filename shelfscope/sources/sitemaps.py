"""Sitemaps and robots files as tables of bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import urls
from shelfscope.sources.stored import checkpointed

LOC = r"<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)\s*(?:\]\]>)?\s*</loc>"


def is_sitemap(body: Column) -> Column:
    """The body starts like a sitemap, not like a web page."""
    head = F.lower(F.ltrim(F.substring(body, 1, 1024)))
    page = head.startswith("<!doctype html") | head.startswith("<html")
    return F.coalesce(~page & (head.startswith("<?xml") | F.contains(head, F.lit("<urlset")) | F.contains(head, F.lit("<sitemapindex"))), F.lit(False))


def locations(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(LOC), 1)


def entries(docs: DataFrame) -> DataFrame:
    """(url, body) to (url, loc, lastmod), a row for each page that the sitemap lists."""
    block = F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<url>(.*?)</url>"), 1)).alias("block")
    rows = docs.where(is_sitemap(F.col("body"))).select("url", block)
    when = F.nullif(F.regexp_extract("block", r"(?is)<lastmod>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)", 1), F.lit(""))
    return rows.select("url", F.try_element_at(locations(F.col("block")), F.lit(1)).alias("loc"), when.alias("lastmod")).where("loc IS NOT NULL")


def children(docs: DataFrame) -> DataFrame:
    """(url, body) of index sitemaps to (url, child), without those that never list products."""
    index = docs.where(is_sitemap(F.col("body")) & F.contains(F.lower("body"), F.lit("<sitemapindex")))
    rows = index.select("url", F.explode(locations(F.col("body"))).alias("child"))
    return rows.where(~urls.is_other_sitemap(F.col("child")) & ~urls.is_wordpress_other(F.col("child")))


def reached(docs: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, url, depth): sitemaps below the roots, through indices up to a depth, each at the least
    depth at which it is met. What has been met is not followed again, so that indices that list each
    other end."""
    links = checkpointed(children(docs).distinct())
    level = roots.select(F.col("url").alias("root"), "url", F.lit(0).alias("depth")).distinct()
    out = level
    for d in range(1, depth + 1):
        found = level.join(links, "url").select("root", F.col("child").alias("url")).distinct()
        level = checkpointed(found.join(out, ["root", "url"], "left_anti").withColumn("depth", F.lit(d)))
        out = out.unionByName(level)
    return out


def product_only(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """Whether every child that an index keeps is a product sitemap."""
    kept = children(docs).join(roots, "url")
    return kept.groupBy("url").agg(F.every(urls.is_product_sitemap(F.col("child"))).alias("product_only"))


def declared(robots: DataFrame) -> DataFrame:
    """(origin, body) of robots files to the sitemaps that they declare, in order."""
    found = F.regexp_extract_all("body", F.lit(r"(?m)^\s*[Ss]itemap:\s*([^\s\r]+)"), 1)
    return robots.select("origin", F.posexplode(found).alias("rank", "url"))


def candidates(robots: DataFrame, locale: str = "") -> DataFrame:
    """Sitemaps to try, in order: declared ones of the locale, then the two usual places."""
    first = declared(robots).where(urls.in_locale(F.col("url"), locale))
    usual = robots.select("origin", F.posexplode(F.array(F.concat("origin", F.lit("/sitemap.xml")), F.concat("origin", F.lit("/sitemap_index.xml")))).alias("rank", "url"))
    both = first.unionByName(usual.withColumn("rank", F.col("rank") + 1_000_000))
    return both.groupBy("origin", "url").agg(F.min("rank").alias("rank"))


def outcome(docs: DataFrame) -> DataFrame:
    """What became of each candidate (url, body, error): ok, html or error, with its URL count."""
    kind = F.when(F.col("error").isNotNull() | F.col("body").isNull(), "error").when(is_sitemap(F.col("body")), "ok").otherwise("html")
    return docs.select("url", kind.alias("outcome"), F.when(kind == "ok", F.size(locations(F.col("body")))).otherwise(0).cast("long").alias("n"))


def handles(html: Column) -> Column:
    """Product handles on a collection page: those linked below a collection, else all."""
    scoped = F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)/collections/[^/\"']+/products/([a-z0-9][a-z0-9_-]*)"), 1))
    return F.when(F.size(scoped) > 0, scoped).otherwise(F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)/products/([a-z0-9][a-z0-9_-]*)"), 1)))


def probe(found: DataFrame, budget: int = 10) -> DataFrame:
    """Of each origin's candidates (origin, rank, url, loc): the first with entries, the share that are
    products, the first product, and whether the budget cut the search short."""
    per = found.groupBy("origin", "rank", "url").agg(F.count("loc").alias("n"), F.avg(urls.is_product(F.col("loc")).cast("double")).alias("share"), F.min(F.when(urls.is_product(F.col("loc")), F.col("loc"))).alias("first_product"))
    tried = per.groupBy("origin").agg(F.count("*").alias("tried"), F.min_by(F.struct("url", "n", "share", "first_product"), F.when(F.col("n") > 0, F.col("rank"))).alias("best"))
    return tried.select("origin", "best.*", (F.col("best.share") > 0.5).alias("product_sitemap"), (F.col("best").isNull() & (F.col("tried") >= budget)).alias("budget_limited"))
