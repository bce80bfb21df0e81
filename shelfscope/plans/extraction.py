"""Queries over pages and parts: extraction, platforms, sitemaps, site profiles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.functions import prices
from shelfscope.operators import health
from shelfscope.sources import extract, platforms, sitemaps
from shelfscope.sources.tables import dealt, read


_HOST = r"lower(regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def _ld(doc: object) -> str:
    return f'<html><script type="application/ld+json">{json.dumps(doc)}</script></html>'


#: Pages by kind; NAME, DOT (1,234.56), COMMA (1.234,56), TEXT (1234.56) and KEY stand for a part's.
TEMPLATES = {
    "root": _ld({"@type": "Product", "name": "NAME", "offers": {"@type": "Offer", "price": "DOT", "priceCurrency": "OMR"}}),
    "graph": _ld({"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "Product"], "name": "NAME", "brand": {"name": "Acme"}, "offers": [{"price": "TEXT"}, {"price": 7, "availability": "https://schema.org/InStock"}]}]}),
    "main_entity": _ld([{"@type": "WebPage", "mainEntity": {"@type": "schema:Product", "name": "NAME", "sku": "SKEY", "gtin13": 123, "gtin": "0001234KEY"}}]),
    "aggregate": _ld({"@type": "Product", "name": "NAME", "offers": {"@type": "AggregateOffer", "lowPrice": "TEXT", "highPrice": "99999"}}),
    "nested_price": _ld({"@type": "Product", "name": "NAME", "offers": {"priceSpecification": {"price": "COMMA", "priceCurrency": "EUR"}}}),
    "broken_then_good": '<script type="application/ld+json">{bad</script>' + _ld({"@type": "Product", "name": "NAME"}),
    "meta": '<meta property="og:title" content="NAME"><meta property="product:price:amount" content="TEXT"><meta property="product:availability" content="instock">',
    "text": "<h1>NAME <b>item</b></h1><script>var a='$1'</script><span class=\"price\">OMR DOT</span> Add to cart",
    "text_symbol": "<h1>NAME</h1><p>Total price <i>$</i><b>$DOT</b></p> sold out",
    "nothing": "<h1>Only NAME</h1>",
}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a price of four digits and cents, written in three ways."""
    n, cents = "(1000 + p_partkey % 9000)", "lpad(CAST(p_partkey % 100 AS STRING), 2, '0')"
    rest = f"lpad(CAST({n} % 1000 AS STRING), 3, '0')"
    texts = {"plain": f"{n} || '.' || {cents}", "dot": f"({n} div 1000) || ',' || {rest} || '.' || {cents}", "comma": f"({n} div 1000) || '.' || {rest} || ',' || {cents}", "whole": f"({n} div 1000) || ',' || {rest}"}
    return dealt(read(spark, d, "part"), "p_partkey").withColumns({k: F.expr(v) for k, v in texts.items()}).withColumn("n", F.expr(n))


def extracted_products(spark, d):
    """A page of one of the kinds for each part. Prices in running text lose all their signs where they
    have more than a decimal one."""
    html = F.element_at(F.array(*map(F.lit, TEMPLATES.values())), (F.col("p_partkey") % len(TEMPLATES) + 1).cast("int"))
    for mark, c in (("NAME", F.col("p_name")), ("DOT", F.col("dot")), ("COMMA", F.col("comma")), ("TEXT", F.col("plain")), ("KEY", F.col("p_partkey").cast("string"))):
        html = F.replace(html, F.lit(mark), c)
    p = extract.products(_texts(spark, d).select(F.col("p_partkey").cast("string").alias("url"), html.alias("html"))).withColumn("p", F.col("product"))
    return p.select("url", "p.name", "p.price", "p.currency", "p.availability", "p.brand", "p.sku", "p.gtin", "p.source")


def page_products(spark, d):
    """The extractors over all pages."""
    return extract.products(read(spark, d, "pages")).groupBy(F.col("product.source").alias("source")).agg(F.count("*").alias("n"))


def page_platform(spark, d):
    p = read(spark, d, "pages").withColumn("p", health.platform(F.lit(""), F.col("html")))
    return p.groupBy("p.platform", "p.kind", health.rendering(F.col("html")).alias("rendering"), health.framework(F.col("html")).alias("framework")).agg(F.count("*").alias("n"))


#: robots.txt, what is added to the page, and what that makes of the site: platform, kind, framework, rendering.
_GENERATOR = '<meta name="generator" content="{}">'
TRACES = [
    ("", "", "Unknown", "unknown", "plain", "ssr"),
    ("Disallow: /checkout Disallow: /cart", "", "WooCommerce", "store", "plain", "ssr"),
    ("Disallow: /checkout Disallow: /cart", '<img src="https://cdn.shopify.com/a.png">', "Shopify", "store", "plain", "ssr"),
    ("# We use Shopify", "", "Shopify", "store", "plain", "ssr"),
    ("", _GENERATOR.format("WooCommerce 8.1"), "WooCommerce", "store", "plain", "ssr"),
    ("", _GENERATOR.format("WordPress 6.4"), "WordPress", "corporate", "plain", "ssr"),
    ("Disallow: /checkout Disallow: /cart", _GENERATOR.format("WordPress 6.4") + '<img src="https://cdn.shopify.com/a.png">', "WordPress", "store", "plain", "ssr"),
    ("", _GENERATOR.format("Wix.com Website Builder"), "Wix", "unknown", "plain", "ssr"),
    ("", _GENERATOR.format("Squarespace"), "Squarespace", "unknown", "plain", "ssr"),
    ("", '<img src="https://cdn11.bigcommerce.com/a.png">', "BigCommerce", "store", "plain", "ssr"),
    ("", '<link href="/static/version17/a.css">', "Magento", "store", "plain", "ssr"),
    ("Disallow: /wp-admin/", "", "WordPress", "corporate", "plain", "ssr"),
    ("", '<script id="__NEXT_DATA__"></script>', "Unknown", "unknown", "next", "ssr"),
    ("", "<script>window.__NUXT__={}</script>", "Unknown", "unknown", "nuxt", "ssr"),
    ("", '<div class="gatsby-image"></div>', "Unknown", "unknown", "gatsby", "ssg"),
    ("", _GENERATOR.format("PrestaShop"), "PrestaShop", "store", "plain", "ssr"),
]


def platform_traces(spark, d):
    """All pages, each with one site's traces added by its number."""
    robots, added = (F.element_at(F.array(*(F.lit(t[k]) for t in TRACES)), (F.col("page_id") % len(TRACES) + 1).cast("int")) for k in (0, 1))
    html = F.concat(F.col("html"), added)
    p = read(spark, d, "pages").where("html IS NOT NULL").withColumn("p", health.platform(robots, html))
    return p.groupBy((F.col("page_id") % len(TRACES)).alias("trace"), "p.platform", "p.kind", health.framework(html).alias("framework"), health.rendering(html).alias("rendering")).agg(F.count("*").alias("n"))


#: A page's JSON-LD, and whether it holds a product with a price.
PRICED = [
    ({"@type": "Product", "price": 5}, True),
    ({"@type": "Product", "price": "0"}, False),
    ({"@type": "Product", "offers": {"price": "1,200.50"}}, True),
    ({"@type": "Product", "offers": [{"price": 0}, {"offers": [{"offers": {"offers": {"price": 3}}}]}]}, True),
    ({"@type": "Product", "offers": [{"priceCurrency": "USD"}, [{"price": 8}]]}, False),
    ({"@type": "Product", "price": -1, "offers": {"lowPrice": 4}}, False),
    ({"@graph": [{"@type": "WebPage", "price": 4}, {"@type": "Product", "price": "free", "offers": [None, 3, {"price": "7"}]}]}, True),
    ({"@type": "WebPage", "price": 9}, False),
]


def priced_schema(spark, d):
    """All pages, each with one of the documents by its number."""
    added = F.element_at(F.array(*(F.lit(_ld(doc)) for doc, _ in PRICED)), (F.col("page_id") % len(PRICED) + 1).cast("int"))
    p = read(spark, d, "pages").select("page_id", F.try_element_at(extract.product_nodes(F.concat(F.coalesce("html", F.lit("")), added)), F.lit(1)).alias("node"))
    return p.groupBy((F.col("page_id") % len(PRICED)).alias("case"), health.has_price(F.col("node")).alias("priced")).agg(F.count("*").alias("n"))


def homepage_links(spark, d):
    h = health.homepage(read(spark, d, "pages"))
    return h.select("url", "product_links", "category_links", F.size("store_hosts").cast("long").alias("hosts"), "looks_like_store")


def number_texts(spark, d):
    """Prices of parts as shops write them, some of them no numbers or below zero."""
    text = F.element_at(F.array("plain", "dot", "comma", "whole", F.lit("free"), F.concat(F.lit("-"), "plain"), F.lit("0.00"), F.lit(None)), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = _texts(spark, d).select(F.col("p_partkey").alias("i"), text.alias("v"))
    return rows.select("i", prices.decimal_text(F.col("v")).alias("number"), prices.price_text(F.col("v")).alias("price"), prices.positive(F.col("v")).alias("positive"))


def _platform_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(origin, json) of parts as three platforms tell them, a third of the parts each."""
    t, key = _texts(spark, d), F.col("p_partkey").cast("string")
    of = lambda k, *columns: t.where(f"p_partkey % 3 = {k}").select(F.lit("https://s.example").alias("origin"), F.to_json(F.struct(*columns)).alias("json"))
    c = lambda value, name: (value if isinstance(value, Column) else F.lit(value)).alias(name)
    more = (F.col("n") + 500).cast("string")
    variants = F.array(
        F.struct(c("0", "price"), c(F.lit(None).cast("string"), "compare_at_price"), c(0, "inventory_quantity"), c(F.concat(F.lit("X"), key), "sku")),
        F.struct(c(F.col("plain"), "price"), c(more, "compare_at_price"), c((F.col("p_partkey") % 2).cast("int"), "inventory_quantity"), c("", "sku")),
    )
    shop = of(0, c(F.col("p_partkey"), "id"), c(F.col("p_name"), "title"), c(F.concat(F.lit("h-"), key), "handle"), c(F.col("p_brand"), "vendor"), c("a, b,", "tags"), c(variants, "variants"))
    coded = F.array(F.struct(c("_ean", "key"), c(F.concat(F.lit(" 40063"), key), "value")))
    stock = F.when(F.col("p_partkey") % 2 == 0, "outofstock").otherwise("instock")
    woo = of(1, c(F.col("p_partkey"), "id"), c(F.concat(F.lit(" "), "p_name", F.lit(" ")), "name"), c(F.concat(F.lit("m-"), key), "slug"), c(F.col("whole"), "price"), c(F.when(F.col("p_partkey") % 4 == 0, F.col("whole")).otherwise(more), "regular_price"), c(coded, "meta_data"), c(stock, "stock_status"))
    custom = F.struct(c(F.concat(F.when(F.col("p_partkey") % 4 < 2, "/").otherwise(""), F.lit("b"), key, F.lit("/")), "url"))
    big = of(2, c(F.col("p_partkey"), "id"), c(F.concat("p_name", F.lit("!")), "name"), c(F.col("n") + 500, "price"), c(F.col("n"), "calculated_price"), c(F.when(F.col("p_partkey") % 2 == 0, "available").otherwise("disabled"), "availability"), c(custom, "custom_url"))
    return shop, woo, big


def platform_products(spark, d):
    shop, woo, big = _platform_rows(spark, d)
    out = platforms.shopify(shop).unionByName(platforms.woocommerce(woo)).unionByName(platforms.bigcommerce(big))
    return out.select("url", "name", "price", "compare_at", "available", "sku", "gtin", F.coalesce(F.when(F.col("tags").isNotNull(), F.size("tags")), F.lit(0)).cast("long").alias("tags"))


def sitemap_candidates(spark, d):
    """Of each host's robots file, with a sitemap for each first part of its pages' paths, those to try."""
    p = read(spark, d, "pages").select(F.expr(f"'https://' || {_HOST}").alias("origin"), F.expr(r"lower(regexp_extract(url, '://[^/?#]*/([a-zA-Z]+)', 1))").alias("part"))
    line = F.concat(F.element_at(F.array(F.lit("Sitemap: "), F.lit("sitemap: ")), (F.length("part") % 2 + 1).cast("int")), "origin", F.lit("/"), "part", F.lit("/map.xml\r\n"))
    robots = p.groupBy("origin").agg(F.concat(F.lit("User-agent: *\r\n"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("part") != "", line))), "")).alias("body"))
    order = Window.partitionBy("origin").orderBy("rank")
    return sitemaps.candidates(robots, "fr").select("origin", "url", F.row_number().over(order).cast("long").alias("rank"))


def site_health(spark, d):
    """Pages as sites: a finding for each of five bits of their numbers."""
    bit = lambda k: (F.col("id").bitwiseAND(F.lit(1 << k)) > 0)
    p = read(spark, d, "pages").select(F.col("page_id").alias("id")).select(
        "id", bit(0).alias("api_public"), bit(1).alias("blocking"), bit(2).alias("sitemap_found"), F.when(bit(2), F.col("id") % 32 * 40).otherwise(0).alias("sitemap_urls"),
        F.when(bit(3), "csr-shell").otherwise("ssr").alias("rendering"), F.lit("store").alias("kind"), bit(4).alias("product_schema"), bit(4).alias("priced_schema"), F.lit(False).alias("budget_limited"),
        F.lit(True).alias("looks_like_store"), F.expr("CAST(array() AS array<string>)").alias("store_hosts"), F.lit("none").alias("provider"),
    )
    h = health.health(health.tier(p))
    return h.select("id", "tier", "verdict", F.col("score").cast("long").alias("score"))


QUERIES = {f.__name__: f for f in (extracted_products, page_products, page_platform, platform_traces, priced_schema, homepage_links, number_texts, platform_products, sitemap_candidates, site_health)}

_LINKS = r"""list_transform(regexp_extract_all(html, '(?i)<a\s+[^>]*href=["'']([^"''#]+)["'']', 1), lambda a: CASE WHEN regexp_matches(a, '(?i)^https?://') THEN a ELSE regexp_extract(url, '^(\w+://[^/?#]*)', 1) || CASE WHEN starts_with(a, '/') THEN '' ELSE '/' END || a END)"""
_SITE = r"regexp_replace(lower(regexp_extract({}, '(?is)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_TRACED = ", ".join(f"({k}, {', '.join(repr(x) for x in t[2:])})" for k, t in enumerate(TRACES))
_TEXTS = """q AS (SELECT *, 1000 + p_partkey % 9000 AS n, lpad((p_partkey % 100)::VARCHAR, 2, '0') AS c FROM part),
  t AS (SELECT *, n || '.' || c AS plain, (n // 1000) || '.' || lpad((n % 1000)::VARCHAR, 3, '0') || ',' || c AS comma FROM q)"""
ORACLES = {
    "page_platform": r"""WITH p AS (SELECT lower(html) AS page, html, lower(array_to_string(regexp_extract_all(html, '(?i)<meta[^>]+name=["'']generator["''][^>]+content=["'']([^"'']+)["'']', 1), ' · ')) AS g,
        regexp_replace(html, '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>', '', 'g') AS seen FROM pages),
      q AS (SELECT *, CASE WHEN regexp_matches(html, '(?i)__NEXT_DATA__|id=["'']__next["'']|/_next/|/\.next/|next/static') THEN 'next' WHEN regexp_matches(html, '(?i)__NUXT__|_nuxt/|nuxt\.config|@nuxt') THEN 'nuxt' WHEN regexp_matches(html, '(?i)gatsby-|_gatsby|gatsby\.js') THEN 'gatsby' ELSE 'plain' END AS framework,
        CASE WHEN contains(g, 'woocommerce') THEN ['WooCommerce', 'store'] WHEN contains(g, 'shopify') THEN ['Shopify', 'store'] WHEN contains(g, 'magento') THEN ['Magento', 'store'] WHEN contains(g, 'prestashop') THEN ['PrestaShop', 'store']
          WHEN contains(g, 'bigcommerce') THEN ['BigCommerce', 'store'] WHEN regexp_matches(g, 'elementor|site kit by google|rank math|yoast|astra|wordpress') OR contains(page, 'wp-content') THEN ['WordPress', 'corporate'] WHEN contains(g, 'wix.com') THEN ['Wix', 'unknown']
          WHEN contains(g, 'squarespace') THEN ['Squarespace', 'unknown'] WHEN contains(page, 'cdn.shopify.com') THEN ['Shopify', 'store'] WHEN regexp_matches(page, 'cdn\d+\.bigcommerce\.com') THEN ['BigCommerce', 'store']
          WHEN contains(page, '/static/version') OR contains(page, 'magento') THEN ['Magento', 'store'] ELSE ['Unknown', 'unknown'] END AS found FROM p)
      SELECT found[1] AS platform, found[2] AS kind, CASE WHEN length(trim(regexp_replace(regexp_replace(seen, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) < 200 AND len(regexp_extract_all(html, '(?i)<a\s+[^>]*href=["''][^"''#]+["'']')) < 3 AND contains(page, '<script') THEN 'csr-shell' WHEN framework = 'gatsby' THEN 'ssg' ELSE 'ssr' END AS rendering, framework, count(*) AS n
      FROM q GROUP BY ALL""",
    "platform_traces": f"SELECT trace::BIGINT AS trace, platform, kind, framework, rendering, count(*) AS n FROM pages JOIN (VALUES {_TRACED}) t(trace, platform, kind, framework, rendering) ON page_id % {len(TRACES)} = trace WHERE html IS NOT NULL GROUP BY ALL",
    "priced_schema": f'SELECT page_id % {len(PRICED)} AS "case", [{", ".join(str(x) for _, x in PRICED)}][page_id % {len(PRICED)} + 1] AS priced, count(*) AS n FROM pages GROUP BY ALL',
    "homepage_links": rf"""WITH l AS (SELECT url, {_LINKS} AS links FROM pages),
      c AS (SELECT url, len(list_filter(links, lambda x: regexp_matches(x, '(?i)/(product|products|item|dp|p)/[a-z0-9_-]+|/shop/(?:[a-z0-9_-]+/)+[a-z0-9_-]+'))) AS product_links,
          len(list_filter(links, lambda x: regexp_matches(x, '(?i)/product-category/|[?&]product_cat=|/(category|categories|collection|collections|shop|catalog)(/|\?|#|$)'))) AS category_links,
          list_distinct(list_filter(list_transform(links, lambda x: {_SITE.format("x")}), lambda h: h <> {_SITE.format("url")} AND regexp_matches(h, '(^|\.)(shop|store|buy)\.|shop|store'))) AS hosts FROM l)
      SELECT url, product_links, category_links, least(len(hosts), 5)::BIGINT AS hosts, product_links > 0 OR category_links > 0 AS looks_like_store FROM c""",
    "page_products": "SELECT NULL::VARCHAR AS source, count(*) AS n FROM pages",
    "number_texts": f"""WITH {_TEXTS}, v AS (SELECT p_partkey AS i, p_partkey % 8 AS k, plain::DOUBLE AS x, n::DOUBLE AS n, comma FROM t)
      SELECT i, CASE WHEN k < 3 THEN x WHEN k = 3 THEN n WHEN k = 5 THEN -x ELSE 0 END AS number, CASE WHEN k < 3 THEN x WHEN k = 3 THEN n WHEN k = 5 THEN -x WHEN k = 6 THEN 0 END AS price,
        CASE WHEN k < 2 THEN x WHEN k = 2 THEN replace(comma, ',', '')::DOUBLE WHEN k = 3 THEN n ELSE 0 END AS positive FROM v""",
    "extracted_products": f"""WITH {_TEXTS}, c AS (SELECT *, p_partkey % 10 AS k, plain::DOUBLE AS x FROM t)
      SELECT p_partkey::VARCHAR AS url, CASE WHEN k = 7 THEN p_name || ' item' WHEN k < 9 THEN p_name END AS name, CASE WHEN k IN (2, 5) THEN 0.0 WHEN k IN (7, 8) THEN (n * 100 + p_partkey % 100)::DOUBLE WHEN k < 9 THEN x END AS price,
        CASE WHEN k IN (0, 7) THEN 'OMR' WHEN k = 4 THEN 'EUR' WHEN k IN (6, 8) THEN 'USD' END AS currency, CASE WHEN k IN (2, 5) THEN 'unknown' WHEN k = 8 THEN 'out_of_stock' WHEN k < 9 THEN 'in_stock' END AS availability,
        CASE WHEN k = 1 THEN 'Acme' END AS brand, CASE WHEN k = 2 THEN 'S' || p_partkey END AS sku, CASE WHEN k = 2 THEN '0001234' || p_partkey END AS gtin,
        CASE WHEN k < 6 THEN 'jsonld' WHEN k = 6 THEN 'opengraph' WHEN k < 9 THEN 'html-heuristics' END AS source FROM c""",
    "platform_products": f"""WITH {_TEXTS}, c AS (SELECT *, p_partkey AS i, p_partkey % 3 AS k FROM t)
      SELECT 'https://s.example/' || CASE k WHEN 0 THEN 'products/h-' || i WHEN 1 THEN 'product/m-' || i ELSE 'b' || i || '/' END AS url, CASE k WHEN 2 THEN p_name || '!' ELSE p_name END AS name,
        CASE k WHEN 0 THEN plain::DOUBLE ELSE n END AS price, CASE WHEN k = 1 AND i % 4 = 0 THEN NULL ELSE (n + 500)::DOUBLE END AS compare_at, CASE k WHEN 2 THEN i % 2 = 0 ELSE i % 2 = 1 END AS available,
        CASE k WHEN 0 THEN 'X' || i ELSE '' END AS sku, CASE k WHEN 1 THEN '40063' || i ELSE '' END AS gtin, CASE k WHEN 0 THEN 2 ELSE 0 END AS tags FROM c""",
    "sitemap_candidates": rf"""WITH p AS (SELECT DISTINCT 'https://' || {_HOST} AS origin, lower(regexp_extract(url, '://[^/?#]*/([a-zA-Z]+)', 1)) AS part FROM pages),
      c AS (SELECT origin, origin || '/fr/map.xml' AS url, 0 AS r FROM p WHERE part = 'fr' UNION ALL SELECT DISTINCT origin, origin || f, r FROM p, (VALUES ('/sitemap.xml', 1), ('/sitemap_index.xml', 2)) v(f, r))
      SELECT origin, url, row_number() OVER (PARTITION BY origin ORDER BY r) AS rank FROM c""",
    "site_health": """WITH p AS (SELECT i::BIGINT AS id, i & 1 > 0 AS api, i & 2 > 0 AS blk, i & 4 > 0 AS sm, CASE WHEN i & 4 > 0 THEN i % 32 * 40 ELSE 0 END AS n, i & 8 > 0 AS sh, i & 16 > 0 AS sc FROM (SELECT page_id AS i FROM pages)),
      v AS (SELECT *, CASE WHEN api THEN 'healthy' WHEN blk THEN 'blocked' WHEN NOT sh AND NOT sc AND (NOT sm OR n < 100) THEN 'no-products' ELSE 'healthy' END AS verdict,
        CASE WHEN api THEN 50 ELSE 0 END + CASE WHEN sc THEN 40 ELSE 0 END + 5 + CASE WHEN sm THEN 10 + CASE WHEN n >= 1000 THEN 15 WHEN n >= 100 THEN 10 WHEN n >= 10 THEN 5 ELSE 0 END ELSE 0 END AS pts FROM p)
      SELECT id, CASE WHEN api THEN 'API-first' WHEN blk THEN 'manual' WHEN NOT sm OR n = 0 THEN 'HTML-BFS' WHEN sh THEN 'sitemap-browser' ELSE 'sitemap-HTTP' END AS tier, verdict,
        least(pts, CASE verdict WHEN 'blocked' THEN 45 WHEN 'no-products' THEN 25 ELSE 100 END)::BIGINT AS score FROM v""",
}
