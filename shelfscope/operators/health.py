"""What kind of site a store is, how to crawl it, and how well that should work.

Ordered rules: the first that applies decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import urls
from shelfscope.sources import extract


def _has(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def generators(html: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<meta[^>]+name=[\"']generator[\"'][^>]+content=[\"']([^\"']+)[\"']"), 1), F.trim), lambda g: g != "")


def platform(robots: Column, html: Column) -> Column:
    """struct<platform, kind>: from robots paths, then generator tags, then assets of the home page."""
    r, page = F.lower(F.coalesce(robots, F.lit(""))), F.lower(F.coalesce(html, F.lit("")))
    g = F.lower(F.array_join(generators(F.coalesce(html, F.lit(""))), " · "))
    shop = _has(r, "woocommerce", "filter_brand") | (_has(r, "/checkout") & _has(r, "/cart"))
    # Markers of each platform, in the order in which they are tried.
    wordpress = _has(g, "elementor", "site kit by google", "rank math", "yoast", "astra", "wordpress") | _has(r, "wp-content", "wp-json", "wp-admin") | _has(page, "wp-content")
    rules = [
        (_has(r, "shopify"), "Shopify", "store"),
        (_has(r, "magento"), "Magento", "store"),
        (_has(r, "prestashop"), "PrestaShop", "store"),
        (shop & ~_has(page, "cdn.shopify.com"), "WooCommerce", "store"),
        (_has(g, "woocommerce"), "WooCommerce", "store"),
        (_has(g, "shopify"), "Shopify", "store"),
        (_has(g, "magento"), "Magento", "store"),
        (_has(g, "prestashop"), "PrestaShop", "store"),
        (_has(g, "bigcommerce"), "BigCommerce", "store"),
        (wordpress & shop, "WordPress", "store"),
        (wordpress, "WordPress", "corporate"),
        (_has(g, "wix.com"), "Wix", "unknown"),
        (_has(g, "squarespace"), "Squarespace", "unknown"),
        (_has(page, "cdn.shopify.com"), "Shopify", "store"),
        (page.rlike(r"cdn\d+\.bigcommerce\.com"), "BigCommerce", "store"),
        (_has(page, "/static/version", "magento"), "Magento", "store"),
    ]
    out = F.struct(F.lit("Unknown").alias("platform"), F.lit("unknown").alias("kind"))
    for when, name, kind in reversed(rules):
        out = F.when(when, F.struct(F.lit(name).alias("platform"), F.lit(kind).alias("kind"))).otherwise(out)
    return out


def framework(html: Column) -> Column:
    # Traces that frameworks leave in pages.
    return (
        F.when(html.rlike(r"(?i)__NEXT_DATA__|id=[\"']__next[\"']|/_next/|/\.next/|next/static"), "next")
        .when(html.rlike(r"(?i)__NUXT__|_nuxt/|nuxt\.config|@nuxt"), "nuxt")
        .when(html.rlike(r"(?i)__gatsby|gatsby-|_gatsby|gatsby\.js"), "gatsby")
        .otherwise("plain")
    )


def needs_browser(html: Column, least_text: int = 200, least_links: int = 3) -> Column:
    """A shell that scripts fill in: hardly any visible text and links, but scripts."""
    text = F.length(urls.strip_html(extract.visible(html)))
    return (text < least_text) & (F.size(extract.anchors(html)) < least_links) & F.contains(F.lower(html), F.lit("<script"))


def rendering(html: Column) -> Column:
    return F.when(needs_browser(html), "csr-shell").when(framework(html) == "gatsby", "ssg").otherwise("ssr")


def protection(status: Column, headers: Column, html: Column, most: int | None = 60_000) -> Column:
    """struct<provider, blocking> from a response: status, headers (map, lower-case names), body, of
    which the first `most` characters are looked at, or all."""
    h = lambda n: F.try_element_at(headers, F.lit(n))
    server = F.lower(F.coalesce(h("server"), F.lit("")))
    challenge = F.lower(html if most is None else F.substring(html, 1, most)).rlike("just a moment|checking your browser|verify you are human|captcha|cf-chl")
    akamai = F.coalesce(*(h(n) for n in ("akamai-x-s", "akamai-x-stuck", "akamai-x-cache", "x-akamai-transformed"))).isNotNull()
    made = lambda name, blocking: F.struct(F.lit(name).alias("provider"), blocking.alias("blocking"))
    return (
        F.when(status == 429, made("rate-limited", F.lit(True)))
        .when(h("cf-ray").isNotNull() | F.contains(server, F.lit("cloudflare")), made("cloudflare", (status >= 400) | challenge))
        .when(akamai | F.contains(server, F.lit("akamai")), made("akamai", status >= 400))
        .otherwise(made("none", F.lit(False)))
    )


def homepage(pages: DataFrame, most: int | None = 5) -> DataFrame:
    """(url, html) to link counts, other shops linked to (`most` of them, or all) and whether it looks
    like one."""
    u = F.col("url")
    links = F.transform(extract.anchors(F.col("html")), lambda a: F.when(a.rlike("(?i)^https?://"), a).otherwise(F.concat(F.regexp_extract(u, r"^(\w+://[^/?#]*)", 1), F.when(~a.startswith("/"), "/").otherwise(""), a)))
    rows = pages.select("url", links.alias("links"))
    own = urls.host_key(u)
    hosts = F.array_distinct(F.filter(F.transform("links", urls.host_key), lambda h: (h != own) & h.rlike(r"(^|\.)(shop|store|buy)\.|shop|store")))
    products, categories = F.size(F.filter("links", urls.is_product_link)), F.size(F.filter("links", urls.is_category_link))
    return rows.select("url", products.cast("long").alias("product_links"), categories.cast("long").alias("category_links"), (hosts if most is None else F.slice(hosts, 1, most)).alias("store_hosts"), ((products > 0) | (categories > 0)).alias("looks_like_store"))


def has_price(node: Column) -> Column:
    """A JSON-LD product with a positive price of its own or in an offer, however deep."""
    own = lambda n: F.coalesce(extract.ld_price(n, "price") > 0, F.lit(False))
    inner = lambda n: F.filter(extract.json_items(extract.member(n, "offers")), lambda o: F.ltrim(o).startswith("{"))
    # A node has no more levels of offers than it names them; an escaped name counts as one.
    levels = F.sequence(F.lit(0), F.regexp_count(node, F.lit(r"offers|\\u")))
    start = F.struct(F.array(node).alias("nodes"), F.lit(False).alias("found"))
    step = lambda s, _: F.struct(F.flatten(F.transform(s["nodes"], inner)).alias("nodes"), (s["found"] | F.exists(s["nodes"], own)).alias("found"))
    return F.coalesce(F.aggregate(levels, start, step, lambda s: s["found"]), F.lit(False))


def tier(p: DataFrame) -> DataFrame:
    """How to crawl. p: api_public, blocking, sitemap_found, sitemap_urls, rendering."""
    choice = (
        F.when(F.col("api_public"), "API-first").when(F.col("blocking"), "manual").when(~F.col("sitemap_found") | (F.col("sitemap_urls") == 0), "HTML-BFS")
        .when(F.col("rendering") == "csr-shell", "sitemap-browser").otherwise("sitemap-HTTP")
    )
    return p.withColumn("tier", choice)


def health(p: DataFrame) -> DataFrame:
    """Verdict, score from 0 to 100 and up to 4 flags. p: as for tier, and kind, product_schema,
    priced_schema, budget_limited, looks_like_store, store_hosts, provider."""
    c = F.col
    api, shell, n = c("api_public"), c("rendering") == "csr-shell", c("sitemap_urls")
    priced, some = c("product_schema") & c("priced_schema"), c("product_schema") | c("priced_schema")
    corporate = (c("kind") == "corporate") | ((F.size("store_hosts") > 0) & ~c("looks_like_store"))
    nothing = ~shell & ~api & ~some & (~c("sitemap_found") | (n < 100))
    points = F.when(api, 50).otherwise(0) + F.when(priced, 40).when(some, 20).otherwise(0) + F.when(c("looks_like_store"), 5).otherwise(0)
    points += F.when(c("sitemap_found"), 10 + F.when(n >= 1000, 15).when(n >= 100, 10).when(n >= 10, 5).otherwise(0)).otherwise(0)
    verdict = F.when(api, "healthy").when(c("blocking"), "blocked").when(corporate, "corporate").when(nothing, "no-products").when(c("budget_limited") & ~c("sitemap_found"), "unclear").otherwise("healthy")
    cap = F.when(verdict == "blocked", 45).when(verdict == "corporate", 30).when(verdict == "no-products", 25).otherwise(100)
    flags = F.array_compact(
        F.array(
            F.when(api, "public api"), F.when(priced, "priced schema").when(some, "partial schema").when(~api & ~shell, "no schema"),
            F.when(c("sitemap_found"), F.concat(n.cast("string"), F.lit(" sitemap urls"))).when(c("budget_limited"), "sitemap budget").otherwise("no sitemap"),
            F.when(c("looks_like_store"), "store front"), F.when(verdict == "blocked", F.concat(F.lit("blocked: "), c("provider"))).when(verdict.isin("corporate", "no-products", "unclear"), verdict),
        )
    )
    return p.withColumn("verdict", verdict).withColumn("score", F.greatest(F.lit(0), F.least(points, cap))).withColumn("flags", F.slice(flags, 1, 4))


def crawl_plan(p: DataFrame) -> DataFrame:
    """Crawl settings from tier and protection: browser, concurrency, delay, warning."""
    limited = F.col("provider") == "rate-limited"
    return p.select(
        "*",
        (F.col("tier") == "sitemap-browser").alias("use_browser"),
        F.when(limited, F.lit(1)).otherwise(F.col("concurrency")).alias("planned_concurrency"),
        F.when(limited, F.greatest("delay_ms", F.lit(2000))).otherwise(F.col("delay_ms")).alias("planned_delay_ms"),
        F.when(F.col("verdict") != "healthy", F.col("verdict")).alias("warning"),
    )


def recrawl_with_browser(runs: DataFrame) -> DataFrame:
    """Deep runs without a browser that fetched enough pages but read no price. runs: a row for each
    product with run_id, type, use_browser, fetched, price."""
    one = runs.groupBy("run_id", "type", "use_browser", "fetched").agg(F.count_if(F.col("price") > 0).alias("priced"))
    again = (F.col("type") == "deep") & ~F.col("use_browser") & (F.col("fetched") >= 10) & (F.col("priced") == 0)
    return one.select("run_id", again.alias("again"))
