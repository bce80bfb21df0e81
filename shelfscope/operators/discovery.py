"""Which URLs are products: classification of sitemap URLs, strategies, the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import urls
from shelfscope.sources.stored import checkpointed


def product_entries(entries: DataFrame, by: str = "origin", least: float = 0.6) -> DataFrame:
    """The entries (by, loc) of a sitemap that are product pages.

    An explicit product path always counts; landing pages never do; where explicit paths are more
    than `least` of a site's entries nothing else counts; else leaves do, below a section that is
    itself an entry.
    """
    segs = urls.segments(F.col("loc"))
    rows = entries.withColumn("segs", segs).withColumn("explicit", urls.is_product(F.col("loc")))
    share = F.avg(F.col("loc").rlike(urls.PRODUCT_BASE).cast("double")).over(Window.partitionBy(by))
    rows = rows.withColumn("dominant", share > least).withColumn("path", F.concat_ws("/", "segs"))
    # Every path above another entry is a section, not a leaf.
    above = rows.where(F.size("segs") > 1).select(by, F.explode(F.transform(F.sequence(F.lit(1), F.size("segs") - 1), lambda i: F.array_join(F.slice("segs", 1, i), "/"))).alias("path")).distinct()
    sections = rows.where(F.size("segs") == 1).select(by, F.col("segs")[0].alias("head")).distinct()
    rows = rows.withColumn("head", F.try_element_at("segs", F.lit(1))).join(above.withColumn("inner", F.lit(True)), [by, "path"], "left").join(sections.withColumn("listed", F.lit(True)), [by, "head"], "left")
    last = F.coalesce(F.try_element_at("segs", F.lit(-1)), F.lit(""))
    leaf = (F.size("segs") >= 2) & ~urls.is_section_word(F.col("head")) & F.col("listed").isNotNull() & F.col("inner").isNull()
    keep = F.when(F.col("explicit"), True).when(last.rlike("-in-[a-z0-9-]+$"), False).when(F.col("dominant"), False).otherwise(leaf)
    return rows.where(keep).select(*entries.columns)


def base_share(entries: DataFrame, by: str, least: float = 0.6) -> DataFrame:
    """Per site: entries, those with a product path, and whether these are more than `least`."""
    n, base = F.count("*"), F.count_if(F.col("loc").rlike(urls.PRODUCT_BASE))
    return entries.groupBy(by).agg(n.alias("n"), base.alias("base"), ((base > 0) & (base > n * least)).alias("dominant"))


def junk_audit(products: DataFrame, by: str = "origin", least: float = 0.6) -> DataFrame:
    """Per store: products, whether explicit paths dominate, junk and landing pages among them."""
    u = F.col("url")
    n, base = F.count("*"), F.count_if(u.rlike(urls.PRODUCT_BASE))
    return products.groupBy(by).agg(n.alias("active"), (base > n * least).alias("dominant"), F.count_if(urls.has_junk(u)).alias("junk"), F.count_if(urls.is_landing(u)).alias("landing"))


def merged(strategies: list[DataFrame]) -> DataFrame:
    """URLs of several strategies, each once, with the first strategy that found it."""
    out = None
    for n, s in enumerate(strategies):
        rows = s.select("url", F.lit(n).alias("strategy"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("url").agg(F.min("strategy").alias("strategy"))


def first_usable(candidates: DataFrame, useful: Column) -> DataFrame:
    """Rows of the first candidate (by rank) that has a useful row; none if no candidate has one."""
    best = candidates.where(useful).agg(F.min("rank").alias("rank"))
    return candidates.join(F.broadcast(best), "rank", "left_semi")  # one row


def unknown_urls(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("url"), "url", "left_anti")


def matching_pattern(found: DataFrame, pattern: str | None) -> tuple[DataFrame, str | None]:
    """URLs that match a user's pattern; a pattern that is none filters nothing and gives a warning."""
    if not pattern:
        return found, None
    try:
        found.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as error:  # an invalid pattern is the user's, not ours
        return found, f"pattern ignored: {type(error).__name__}"
    return found.where(F.col("url").rlike(f"(?i){pattern}")), None


def resumed(found: DataFrame, state: DataFrame) -> DataFrame:
    """URLs with what is stored of them; unchanged ones (equal, known lastmod) need no new fetch."""
    both = found.join(state.select("url", F.col("lastmod").alias("stored_lastmod"), "etag"), "url", "left")
    return both.withColumn("skip", F.coalesce((F.col("lastmod") == F.col("stored_lastmod")), F.lit(False)))


def crawl_roots(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Where the crawl of each origin starts: its home page; if that is not among the pages, those that
    no other page links to; if there are none, the first by url."""
    linked = links.where("src <> dst").select(F.col("dst").alias("url")).distinct().withColumn("linked", F.lit(True))
    origin = F.regexp_extract("url", urls.ORIGIN, 1)
    kind = F.when(F.col("url") == F.concat(origin, F.lit("/")), 0).when(F.col("linked").isNull(), 1).otherwise(2)
    rows = pages.where("url IS NOT NULL").distinct().join(linked, "url", "left").withColumn("kind", kind)
    order = Window.partitionBy(origin).orderBy("kind", F.when(F.col("kind") == 2, F.col("url")))
    return rows.withColumn("place", F.rank().over(order)).where("place = 1").select("url")


def link_bfs(links: DataFrame, roots: DataFrame, depth: int = 3, most_pages: int | None = 60) -> DataFrame:
    """Pages reached from roots over (src, dst) within a depth, by levels; of each level the first by
    url until the page limit of the origin's crawl, which is part of its politeness; none if None."""
    seen = roots.select("url").distinct().withColumn("depth", F.lit(0))
    edge = seen
    for level in range(1, depth + 1):
        found = edge.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        edge = checkpointed(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(edge)
    if most_pages is None:
        return seen
    order = Window.partitionBy(F.regexp_extract("url", urls.ORIGIN, 1)).orderBy("depth", "url")
    return seen.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most_pages).drop("nth")


def link_hosts(links: DataFrame, own: str, most: int = 5) -> DataFrame:
    """Other hosts that pages link to, most frequent first."""
    return links.where(F.col("host") != own).groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(most)


def with_prices(found: DataFrame, ids: DataFrame, prices: DataFrame) -> DataFrame:
    """URLs with their product ids, and these with their prices; either may be missing."""
    return found.join(ids, "url", "left").join(prices, "product_id", "left")


def id_chunks(ids: DataFrame, size: int = 100) -> DataFrame:
    """Ids of each country in numbered groups of `size`, for batched requests."""
    order = Window.partitionBy("country").orderBy("product_id")
    return ids.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / size))
