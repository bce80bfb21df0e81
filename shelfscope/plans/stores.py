"""Queries over stores, jobs, links and products made from the tables: sinks, discovery, competitor
lists, extraction from product pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions import names, numbers, prices, times, urls
from shelfscope.operators import analytics, discovery, ingest, matching, metrics, readpath
from shelfscope.plans import catalogue, market
from shelfscope.sources import extract, platforms, sinks
from shelfscope.sources.tables import dealt, distinct_values, lookup, read

AS_OF = "2024-01-20 00:00:00"


def _part(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part")


def _k():
    return F.col("p_partkey")


def method_histogram(spark, d):
    return matching.method_histogram(catalogue.match_exact_unique(spark, d))


def match_kpis(spark, d):
    mine, theirs = catalogue._catalogues(spark, d)
    pairs = matching.looked_up(catalogue.match_exact_unique(spark, d), mine, theirs)
    rows = pairs.select(F.col("mine").alias("mine_id"), F.col("theirs").alias("theirs_id"), F.col("my_product.price").alias("mine_price"), F.col("their_product.price").alias("theirs_price"))
    return analytics.matching_kpis(rows, mine, theirs)


def _compared(spark, d):
    """Every part with a price of its own and, for two of three, one of a match."""
    theirs = F.when(_k() % 3 != 0, F.col("p_retailprice") + _k() % 7 - 3)
    return _part(spark, d).select("p_partkey", F.col("p_retailprice").alias("mine"), theirs.alias("theirs"), F.when(_k() % 3 != 0, 60 + _k() % 41).alias("confidence"))


def row_classes(spark, d):
    out = None
    for kind in ("cheaper", "missing", "low-confidence", "all"):
        one = analytics.row_class(_compared(spark, d), kind).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def client_diff(spark, d):
    both, log, _ = market._store_crawls(spark, d)
    out = analytics.client_diff(log)
    return out.select("origin", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "price_changed")


def brand_gaps(spark, d):
    """Brands by the mean of theirs minus mine, largest first, the first six."""
    gaps = _compared(spark, d).join(_part(spark, d).select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(numbers.half_up(F.avg(F.col("theirs") - F.col("mine")), 4).alias("gap"))
    return analytics.gap_order(gaps, "gap", "p_brand").limit(6)


def store_picker(spark, d):
    stores = read(spark, d, "pages").groupBy(urls.host_key(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return readpath.picker(stores, stores.where(F.length("host") % 2 == 0), " TH", "host", "n")


def competitor_list(spark, d):
    """Suppliers as stores, a third crawled; customers as manual ones; part prices as products."""
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".example")).alias("host"), "s_suppkey", "s_acctbal")
    stores = s.where("s_suppkey % 3 <> 1").select("host", F.concat(F.lit("https://"), F.col("host")).alias("origin"))
    shots = s.crossJoin(spark.range(3)).select("host", F.col("id").alias("finished_at"), ((F.col("s_suppkey") + F.col("id")) % 4).alias("fetched")).where("s_suppkey % 5 <> 0")
    manual = s.where("s_suppkey % 2 = 0").select("host", F.concat(F.lit("Shop "), F.col("s_suppkey")).alias("name"), F.concat(F.lit("https://www."), F.col("host")).alias("origin"))
    goods = read(spark, d, "lineitem").where("l_suppkey % 7 <> 0").select(F.concat(F.lit("s"), F.col("l_suppkey"), F.lit(".example")).alias("host"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("price"), (F.col("l_returnflag") != "R").alias("available"))
    out = analytics.competitors(stores, shots, manual, goods, "s1.example", "https://s1.example")
    return out.withColumn("avg_price", numbers.half_up(F.col("avg_price"), 6))


def profile_upsert(spark, d):
    """Supplier profiles with fresh values for some: a null keeps what is stored."""
    s = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    fresh = s.select((F.col("s_suppkey") + 5).alias("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.col("s_name"), F.lit("!"))).alias("s_name"))
    return sinks.upsert_profile(s, fresh, ["s_suppkey"])


def store_deleted(spark, d):
    """All items of some suppliers go with these."""
    gone = read(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return sinks.delete_keys(read(spark, d, "lineitem"), gone, "l_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))


def junk_purge(spark, d):
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("https://x.example"), F.when(F.col("page_id") % 3 == 0, "/blog/a").otherwise("/product/b")).alias("url"), F.lit(True).alias("available"), F.lit(AS_OF).cast("timestamp").alias("last_seen_at"))
    done = sinks.purge(p, urls.has_junk(F.col("url")), dry_run=False)
    return done.select("page_id", "available", F.unix_millis("last_seen_at").alias("seen"))


def stripped_jobs(spark, d):
    jobs = catalogue._jobs(spark, d).withColumn("payload", F.concat(F.lit("p"), F.col("job_id")))
    out = sinks.strip_payload(jobs, "payload", F.col("status") == "done", F.lit("2024-01-10").cast("timestamp"))
    return out.groupBy("status").agg(F.count("payload").alias("kept"), F.count("*").alias("n"))


def vocabulary(spark, d):
    """Word and trigram lists filled in where they are missing."""
    p = _part(spark, d).select("p_partkey", F.col("p_name").alias("name"), F.when(_k() % 2 == 0, F.array(F.lit("kept"))).alias("tokens"), F.array().cast("array<string>").alias("trigrams"))
    out = ingest.with_vocabulary(p)
    return out.select("p_partkey", F.array_join("tokens", " ").alias("tokens"), F.size("trigrams").cast("long").alias("grams"))


def _found(spark, d, rest: int):
    return read(spark, d, "pages").where(F.col("page_id") % 4 != rest).select("page_id", "url")


def url_strategies(spark, d):
    """URLs of three strategies, each with the first that found it."""
    return discovery.merged([_found(spark, d, r).where(F.col("page_id") % 5 != r) for r in range(3)])


def new_urls(spark, d):
    """Found, not known, and matching a user's pattern; a broken pattern filters nothing."""
    found = discovery.unknown_urls(_found(spark, d, 0), _found(spark, d, 1))
    kept, _ = discovery.matching_pattern(found, r"EXAMPLE\.(net|org)/")
    same, warning = discovery.matching_pattern(kept, "(")
    assert warning
    return same.select("page_id", "url")


def resume_crawl(spark, d):
    """Pages with what an earlier crawl stored of them; of a url stored more than once, the earliest."""
    day = lambda k: F.concat(F.lit("2024-01-0"), F.col("page_id") % k + 1)
    found = _found(spark, d, 0).withColumn("lastmod", F.when(F.col("page_id") % 7 != 0, day(3)))
    stored = F.struct(day(2).alias("lastmod"), F.col("page_id").alias("page_id"))
    state = _found(spark, d, 1).groupBy("url").agg(F.min(stored).alias("s")).select("url", "s.lastmod", F.concat(F.lit("e"), "s.page_id").alias("etag"))
    return discovery.resumed(found, state).select("page_id", "lastmod", "stored_lastmod", "skip")


def first_usable(spark, d):
    rows = read(spark, d, "pages").select("page_id", (5 - F.col("page_id") % 5).alias("rank"), "url")
    return discovery.first_usable(rows, F.col("url").rlike("/es/") & (F.col("rank") > 1)).select("page_id", "rank")


def price_requests(spark, d):
    """Parts in numbered requests of a hundred ids by country, with the prices that came back."""
    ids = _part(spark, d).select(F.concat(F.lit("u"), _k()).alias("url"), _k().alias("product_id"), F.substring("p_brand", -1, 1).alias("country"))
    chunks = discovery.id_chunks(ids)
    priced = _part(spark, d).where(_k() % 3 != 0).select(_k().alias("product_id"), F.col("p_retailprice").alias("price"))
    all_urls = ids.select("url").where("url NOT LIKE '%7'")
    got = discovery.with_prices(all_urls, chunks, priced)
    return got.groupBy("country", "chunk").agg(F.count("*").alias("n"), F.count("price").alias("priced"), F.max("price").alias("most"))


def link_hosts(spark, d):
    """Hosts that pages link to, all anchors, most frequent first."""
    links = read(spark, d, "pages").select(F.concat(F.lit("https://"), urls.hostname(F.col("url"))).alias("u")).select(urls.host_key(F.col("u")).alias("host"))
    return discovery.link_hosts(links, "ththre.example.org")


def failure_split(spark, d):
    jobs = read(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, "extraction").when(F.col("event_id") % 3 == 1, "http").alias("kind"))
    return metrics.failure_split(jobs)


def parse_rates(spark, d):
    rows = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("fetched"), F.count_if(F.col("event_type") == "click").alias("products"))
    fetched = F.when(F.col("user_id") % 10 != 0, F.col("fetched")).otherwise(0)
    return rows.select("user_id", metrics.parse_rate(F.col("products"), fetched).alias("rate"))


def store_groups(spark, d):
    shots = read(spark, d, "events").select(F.col("event_type").alias("key"), F.col("ts").alias("finished_at"), "event_id")
    g = metrics.store_order(shots).groupBy("key", "newest").agg(F.count("*").alias("n"))
    return g.select("key", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest"), "n")


def verdict_order(spark, d):
    """Suppliers by the rank of a verdict, unknown ones last, then by balance; the first twenty."""
    verdicts = F.element_at(F.array(*map(F.lit, ("healthy", "blocked", "odd", "unclear"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    s = read(spark, d, "supplier").withColumn("verdict", verdicts)
    return readpath.ranked(s, "verdict", {"blocked": 0, "unclear": 1, "healthy": 2}, F.desc("s_acctbal"), F.col("s_suppkey")).limit(20).select("s_suppkey", "verdict")


def stores_with_snapshots(spark, d):
    """Customers with their orders as ordered child rows."""
    children = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("at"), "o_orderstatus")
    out = readpath.embedded(read(spark, d, "customer").select("c_custkey"), children, "c_custkey", "at", "orders")
    text = F.transform("orders", lambda o: F.concat(o["at"].cast("string"), o["o_orderstatus"]))
    return out.select("c_custkey", F.coalesce(F.array_join(text, ","), F.lit("")).alias("orders"))


def columns_and_rows(spark, d):
    """Distinct values of a column, each with one row looked up by key."""
    brands = distinct_values(_part(spark, d), "p_brand")
    one = lookup(_part(spark, d), "p_partkey", 7).select(F.col("p_name").alias("seventh"))
    return brands.join(F.broadcast(one))  # one row


def texts_and_slugs(spark, d):
    n = F.concat(F.lit(" <b>"), F.upper("p_name"), F.lit("</b>&nbsp;#"), _k(), F.lit("  "))
    secret = F.concat(F.lit("https://me:pw"), _k(), F.lit("@x.example/ token-abc"))
    handle = urls.product_handle(F.concat(F.lit("https://x.example/"), F.when(_k() % 2 == 0, "collections/a/").otherwise(""), F.lit("products/p-"), _k(), F.when(_k() % 3 == 0, ".json").otherwise("/")))
    return _part(spark, d).select(
        "p_partkey", urls.strip_html(n).alias("plain"), urls.name_slug(F.when(_k() % 5 != 0, F.concat(F.col("p_name"), F.lit("!"))), F.lit("none")).alias("slug"), urls.redact(secret, "token-abc").alias("redacted"), handle.alias("handle")
    )


def page_numbers(spark, d):
    """Numbers, currencies and money as pages write them."""
    raw = F.when(_k() % 3 == 0, F.concat(_k(), F.lit(",5"))).when(_k() % 3 == 1, F.concat(F.lit("1."), F.lpad(_k().cast("string"), 3, "0"), F.lit(",00"))).otherwise(F.concat(F.lit("x"), _k()))
    text = F.when(_k() % 4 == 0, "now OMR 5").when(_k() % 4 == 1, "only £3 or $4").when(_k() % 4 == 2, "qar, aed").otherwise("free")
    price = F.when(_k() % 6 != 0, F.col("p_retailprice"))
    return _part(spark, d).select("p_partkey", prices.loose_number(raw).alias("number"), prices.guess_currency(text).alias("currency"), prices.money(price, F.when(_k() % 2 == 0, "USD")).alias("money"))


def job_times(spark, d):
    """Labels, waits and remaining times of jobs."""
    e, i = read(spark, d, "events"), F.col("event_id")
    at = F.col("ts").cast("timestamp")
    written = F.when(i % 5 != 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    after = F.when(i % 3 == 0, (i % 100).cast("string")).when(i % 3 == 1, "Sat, 20 Jan 2024 00:10:00 GMT").otherwise("later")
    return e.select(
        "event_id", times.day_label(at).alias("label"), F.unix_millis(times.iso(written)).alias("iso_ms"), times.jitter_ms(i * 1000, F.lit(0.5)).alias("jitter"), times.retry_after_ms(after, F.lit(AS_OF).cast("timestamp")).alias("wait"),
        times.remaining_ms(i % 10, F.lit(9), (i % 7) * 1000).alias("remaining"), times.duration_text(F.when(i % 11 != 0, i * 700)).alias("duration"), times.crawl_kind(F.when(i % 3 != 2, i % 3 == 0)).alias("kind"),
    )


def _product_pages(spark, d):
    """A page for each part, by five ways of telling a product."""
    name, k = F.col("p_name"), _k()
    price = F.format_string("%.2f", "p_retailprice")
    dearer = F.format_string("%.2f", F.col("p_retailprice") + 10)
    ld = lambda *parts: F.concat(F.lit('<html><script type="application/ld+json">'), *(F.lit(x) if isinstance(x, str) else x for x in parts), F.lit("</script></html>"))
    html = (
        F.when(k % 5 == 0, ld('{"@type": "Product", "name": "', name, '", "sku": "S', k, '", "brand": {"name": "', F.col("p_brand"), '"}, "offers": {"price": "', price, '", "priceCurrency": "OMR", "availability": "https://schema.org/OutOfStock"}}'))
        .when(k % 5 == 1, ld('{"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "Product"], "name": "', name, '", "offers": [{"price": ', dearer, ', "priceCurrency": "USD", "availability": "InStock"}, {"price": ', price, ', "priceCurrency": "USD", "availability": "OutOfStock"}]}]}'))
        .when(k % 5 == 2, ld('[{"@type": "WebPage", "mainEntity": {"@type": "schema:Product", "name": "', name, '", "offers": {"@type": "AggregateOffer", "lowPrice": "', price, '", "highPrice": "', dearer, '", "priceCurrency": "USD"}}}]'))
        .when(k % 5 == 3, F.concat(F.lit('<meta property="og:title" content="'), name, F.lit('"><meta property="product:price:amount" content="'), price, F.lit('"><meta property="product:price:currency" content="AED">')))
        .otherwise(F.concat(F.lit("<p>Only text about "), name, F.lit("</p>")))
    )
    return dealt(_part(spark, d), "p_partkey").select(k.cast("string").alias("url"), html.alias("html"))


def page_extraction(spark, d):
    """Products read from a page of each part."""
    out = extract.products(_product_pages(spark, d)).withColumn("p", F.col("product"))
    return out.select("url", "p.name", "p.price", "p.currency", "p.brand", "p.sku", "p.source")


def shop_feed(spark, d):
    """Parts as a shop platform's product JSON, read back."""
    variants = F.array(F.struct(F.lit("0").alias("price"), F.lit(None).cast("string").alias("sku"), F.lit(0).alias("inventory_quantity")), F.struct(F.format_string("%.2f", "p_retailprice").alias("price"), F.concat(F.lit("K"), _k()).alias("sku"), (_k() % 3).cast("int").alias("inventory_quantity")))
    json = F.to_json(F.struct(_k().alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("h"), _k()).alias("handle"), F.lit("a, b").alias("tags"), variants.alias("variants")))
    rows = _part(spark, d).select(F.lit("https://s.example").alias("origin"), json.alias("json"))
    return platforms.shopify(rows).select("url", "name", "price", F.size("tags").cast("long").alias("tags"))


QUERIES = {f.__name__: f for f in (
    method_histogram, match_kpis, row_classes, client_diff, brand_gaps, store_picker, competitor_list, profile_upsert, store_deleted, junk_purge, stripped_jobs, vocabulary,
    url_strategies, new_urls, resume_crawl, first_usable, price_requests, link_hosts, failure_split, parse_rates, store_groups, verdict_order, stores_with_snapshots,
    columns_and_rows, texts_and_slugs, page_numbers, job_times, page_extraction, shop_feed,
)}

_EXACT = catalogue.ORACLES["match_exact_unique"]
_PAIRED = f"m AS ({_EXACT}), a AS (SELECT p_partkey AS id, p_retailprice AS price FROM part WHERE p_partkey % 10 < 8), b AS (SELECT p_partkey AS id, p_retailprice + p_partkey % 4 - 1 AS price FROM part WHERE p_partkey % 10 >= 2)"
_CMP = "c AS (SELECT p_partkey, p_brand, p_retailprice AS mine, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice + p_partkey % 7 - 3 END AS theirs, CASE WHEN p_partkey % 3 <> 0 THEN 60 + p_partkey % 41 END AS confidence FROM part)"
_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '')"

ORACLES = {
    "method_histogram": f"WITH m AS ({_EXACT}) SELECT method, count(*) AS n FROM m GROUP BY 1",
    "match_kpis": f"""WITH {_PAIRED}, k AS (SELECT count(DISTINCT mine) AS matched, count(DISTINCT theirs) AS t, avg(CASE WHEN a.price > 0 AND b.price > 0 THEN b.price - a.price END) AS gap FROM m JOIN a ON a.id = mine JOIN b ON b.id = theirs)
      SELECT matched, (SELECT count(*) FROM a) - matched AS only_you, (SELECT count(*) FROM b) - t AS only_they, floor(matched / (SELECT count(*) FROM a) * 100 + 0.5)::BIGINT AS match_rate, floor(gap * 100 + 0.5) / 100 AS avg_price_gap FROM k""",
    "row_classes": f"""WITH {_CMP} SELECT 'cheaper' AS kind, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM c WHERE theirs < mine UNION ALL SELECT 'missing', count(*), sum(p_partkey)::BIGINT FROM c WHERE confidence IS NULL
      UNION ALL SELECT 'low-confidence', count(*), sum(p_partkey)::BIGINT FROM c WHERE confidence < 90 UNION ALL SELECT 'all', count(*), sum(p_partkey)::BIGINT FROM c""",
    "client_diff": f"""WITH {market._STORES} SELECT s::VARCHAR AS origin, coalesce(string_agg('product ' || p, ',' ORDER BY 'product ' || p) FILTER (type = 'added'), '') AS added,
      coalesce(string_agg('product ' || p, ',' ORDER BY 'product ' || p) FILTER (type = 'removed'), '') AS removed, count(*) FILTER (type = 'price_changed') AS price_changed FROM e GROUP BY 1""",
    "brand_gaps": f"WITH {_CMP} SELECT p_brand, floor(avg(theirs - mine) * 10000 + 0.5) / 10000 AS gap FROM c GROUP BY 1 ORDER BY gap DESC NULLS LAST, p_brand LIMIT 6",
    "store_picker": f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1 HAVING length(host) % 2 = 1 AND contains(host, 'th')",
    "competitor_list": """WITH s AS (SELECT s_suppkey AS k, 's' || s_suppkey || '.example' AS host FROM supplier),
      shots AS (SELECT k, arg_max((k + i) % 4, i) AS fetched FROM s, range(3) r(i) WHERE k % 5 <> 0 GROUP BY 1),
      g AS (SELECT l_suppkey AS k, count(*) AS products, count(*) FILTER (l_returnflag = 'R') AS out_of_stock, avg(CASE WHEN l_linenumber > 1 AND l_quantity > 0 THEN l_quantity END) AS a FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1)
      SELECT host, CASE WHEN k % 2 = 0 THEN 'Shop ' || k ELSE host END AS name, 'https://' || host AS origin, k % 2 = 0 AND k <> 1 AS manual, k = 1 AS is_mine, CASE WHEN coalesce(fetched, 0) > 0 THEN 'active' ELSE 'error' END AS status,
        coalesce(products, 0) AS products, coalesce(out_of_stock, 0) AS out_of_stock, floor(a * 1000000 + 0.5) / 1000000 AS avg_price FROM s LEFT JOIN shots USING (k) LEFT JOIN g USING (k) WHERE k % 3 <> 1
      UNION ALL SELECT host, 'Shop ' || k, 'https://www.' || host, true, false, 'pending', 0, 0, NULL FROM s WHERE k % 2 = 0 AND k % 3 = 1
      UNION ALL SELECT 's1.example', 's1.example', 'https://s1.example', false, true, 'pending', 0, 0, NULL""",
    "profile_upsert": """SELECT coalesce(s.s_suppkey, f.s_suppkey + 5) AS s_suppkey, coalesce(CASE WHEN f.s_suppkey % 2 = 0 THEN f.s_name || '!' END, s.s_name) AS s_name, s.s_acctbal
      FROM supplier s FULL JOIN supplier f ON s.s_suppkey = f.s_suppkey + 5""",
    "store_deleted": "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY 1",
    "junk_purge": f"SELECT page_id, page_id % 3 <> 0 AS available, CASE WHEN page_id % 3 = 0 THEN 0 ELSE epoch_ms(TIMESTAMP '{AS_OF}') END AS seen FROM pages",
    "stripped_jobs": f"WITH {catalogue._JOBS} SELECT status, count(*) FILTER (NOT (status = 'done' AND f < epoch_ms(TIMESTAMP '2024-01-10'))) AS kept, count(*) AS n FROM j GROUP BY 1",
    "vocabulary": f"""WITH {catalogue._GRAMS}, w AS (SELECT p_name, count(DISTINCT gram) AS grams FROM g GROUP BY 1)
      SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'kept' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) END AS tokens, grams FROM part JOIN w USING (p_name)""",
    "url_strategies": """SELECT url, min(s)::INT AS strategy FROM (SELECT url, page_id, unnest([0, 1, 2]) AS s FROM pages) WHERE page_id % 4 <> s AND page_id % 5 <> s GROUP BY 1""",
    "new_urls": "SELECT page_id, url FROM pages WHERE page_id % 4 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 <> 1) AND regexp_matches(url, '(?i)example\\.(net|org)/')",
    "resume_crawl": """WITH st AS (SELECT url, min('2024-01-0' || (page_id % 2 + 1)) AS stored FROM pages WHERE page_id % 4 <> 1 GROUP BY 1),
      f AS (SELECT page_id, url, CASE WHEN page_id % 7 <> 0 THEN '2024-01-0' || (page_id % 3 + 1) END AS lastmod FROM pages WHERE page_id % 4 <> 0)
      SELECT page_id, lastmod, stored AS stored_lastmod, coalesce(lastmod = stored, false) AS skip FROM f LEFT JOIN st USING (url)""",
    "first_usable": "WITH r AS (SELECT page_id, 5 - page_id % 5 AS rank, url FROM pages) SELECT page_id, rank FROM r WHERE rank = (SELECT min(rank) FROM r WHERE contains(url, '/es/') AND rank > 1)",
    "price_requests": """WITH i AS (SELECT p_partkey AS k, right(p_brand, 1) AS country, p_retailprice AS p FROM part), c AS (SELECT *, (row_number() OVER (PARTITION BY country ORDER BY k) - 1) // 100 AS chunk FROM i)
      SELECT country, chunk::BIGINT AS chunk, count(*) AS n, count(CASE WHEN k % 3 <> 0 THEN p END) AS priced, max(CASE WHEN k % 3 <> 0 THEN p END) AS most FROM c WHERE k % 10 <> 7 GROUP BY 1, 2""",
    "link_hosts": f"SELECT {_HOST} AS host, count(*) AS n FROM pages WHERE {_HOST} <> 'ththre.example.org' GROUP BY 1 ORDER BY n DESC, host LIMIT 5",
    "failure_split": "SELECT count(*) FILTER (event_id % 3 = 0) AS extraction, count(*) FILTER (event_id % 3 <> 0) AS http FROM events",
    "parse_rates": "SELECT user_id, CASE WHEN user_id % 10 <> 0 THEN floor(count(*) FILTER (event_type = 'click') / count(*) * 100 + 0.5)::BIGINT END AS rate FROM events GROUP BY 1",
    "store_groups": "SELECT event_type AS key, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest, count(*) AS n FROM events GROUP BY 1",
    "verdict_order": """SELECT s_suppkey, ['healthy', 'blocked', 'odd', 'unclear'][s_suppkey % 4 + 1] AS verdict FROM supplier ORDER BY CASE s_suppkey % 4 WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 0 THEN 2 END NULLS LAST, s_acctbal DESC, s_suppkey LIMIT 20""",
    "stores_with_snapshots": "SELECT c_custkey, coalesce(string_agg(o_orderkey || o_orderstatus, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "columns_and_rows": "SELECT DISTINCT p_brand, (SELECT p_name FROM part WHERE p_partkey = 7) AS seventh FROM part",
    "texts_and_slugs": """SELECT p_partkey, upper(p_name) || ' #' || p_partkey AS plain, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS slug,
      'https://[redacted]@x.example/ [redacted]' AS redacted, 'p-' || p_partkey AS handle FROM part""",
    "page_numbers": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_partkey || '.5')::DOUBLE WHEN 1 THEN ('1' || lpad(p_partkey::VARCHAR, 3, '0') || '00')::DOUBLE END AS number,
      CASE p_partkey % 4 WHEN 0 THEN 'OMR' WHEN 1 THEN 'GBP' WHEN 2 THEN 'AED' END AS currency,
      CASE WHEN p_partkey % 6 = 0 THEN '—' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'USD ' ELSE '' END || format('{:,.2f}', p_retailprice) END AS money FROM part""",
    "job_times": f"""WITH e AS (SELECT event_id AS i, ts FROM events) SELECT i AS event_id, strftime(ts, '%d %b') AS label, CASE WHEN i % 5 <> 0 THEN epoch_ms(date_trunc('second', ts)) END AS iso_ms, floor(least(i * 1000 * 0.15, 900000.0) * 0.5)::BIGINT AS jitter,
      CASE i % 3 WHEN 0 THEN i % 100 * 1000 WHEN 1 THEN 600000 END AS wait, CASE WHEN i % 7 >= 2 AND i % 10 > 0 AND i % 10 < 9 THEN floor((9 - i % 10) * (i % 7 * 1000) / (i % 10) + 0.5)::BIGINT END AS remaining,
      CASE WHEN i % 11 = 0 THEN '—' WHEN i * 7 // 10 < 60 THEN (i * 7 // 10) || 's' ELSE (i * 7 // 10 // 60) || 'm ' || (i * 7 // 10 % 60) || 's' END AS duration, CASE WHEN i % 3 = 1 THEN 'shallow' ELSE 'deep' END AS kind FROM e""",
    "page_extraction": """WITH k AS (SELECT *, p_partkey % 5 AS k FROM part) SELECT p_partkey::VARCHAR AS url, CASE WHEN k < 4 THEN p_name END AS name, CASE WHEN k = 1 THEN p_retailprice + 10 WHEN k < 4 THEN p_retailprice END AS price,
      CASE k WHEN 0 THEN 'OMR' WHEN 3 THEN 'AED' WHEN 4 THEN NULL ELSE 'USD' END AS currency, CASE WHEN k = 0 THEN p_brand END AS brand, CASE WHEN k = 0 THEN 'S' || p_partkey END AS sku, CASE WHEN k = 3 THEN 'opengraph' WHEN k < 3 THEN 'jsonld' END AS source FROM k""",
    "shop_feed": "SELECT 'https://s.example/products/h' || p_partkey AS url, p_name AS name, p_retailprice AS price, 2::BIGINT AS tags FROM part",
}
