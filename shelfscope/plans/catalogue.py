"""Queries over names, URLs, pages, jobs and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions import cursors, names, times, urls
from shelfscope.operators import discovery, matching, metrics, readpath
from shelfscope.sources import extract
from shelfscope.sources.stored import checkpointed
from shelfscope.sources.tables import read

AS_OF = "2024-01-31 00:00:00"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages")


def _part(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part")


def host_key(spark, d):
    return _pages(spark, d).groupBy(urls.host_key(F.col("url")).alias("key")).agg(F.count("*").alias("n"))


def origin_name(spark, d):
    return _pages(spark, d).select("page_id", urls.origin_name(F.col("url")).alias("name"), urls.country(F.col("url")).alias("country"))


def url_slug(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.slug(u).alias("slug"), urls.page_label(u).alias("label"))


def url_pattern(spark, d):
    return _pages(spark, d).groupBy(urls.pattern(F.col("url")).alias("pattern")).agg(F.count("*").alias("n"))


def identity_key(spark, d):
    rows = _part(spark, d)
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("00-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")))
    sku = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("SKU "), F.col("p_partkey")))
    url = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("https://shop.example/p/Item-"), F.col("p_partkey"))).otherwise("")
    return rows.select("p_partkey", names.identity_key(code, sku, url, F.col("p_name")).alias("identity_key"))


def junk_urls(spark, d):
    u = F.concat(F.col("url"), F.when(F.col("page_id") % 5 == 0, "/blog/x").when(F.col("page_id") % 7 == 0, "/mats-in-dubai").otherwise(""))
    u = F.regexp_replace(u, r"[?#].*?(/blog/x|/mats-in-dubai|$)", "$1")
    return _pages(spark, d).select("page_id", urls.has_junk(u).alias("junk"), urls.is_landing(u).alias("landing"))


def _entries(spark, d):
    """Sitemap entries made from the pages' URLs: sections, products, landing pages."""
    p = _pages(spark, d)
    host = F.concat(F.lit("https://"), urls.hostname(F.col("url")))
    tail = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/product/p-"), F.col("page_id"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/shoes/s-"), F.col("page_id"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("/bags/b-in-x"), F.col("page_id"))).otherwise("/shoes")
    return p.select(host.alias("origin"), F.concat(host, tail).alias("loc")).distinct()


def sitemap_leaf_filter(spark, d):
    return discovery.product_entries(_entries(spark, d)).select("loc")


def base_dominance(spark, d):
    return discovery.base_share(_entries(spark, d), "origin")


def junk_audit(spark, d):
    return discovery.junk_audit(_entries(spark, d).select("origin", F.col("loc").alias("url")))


def html_headings(spark, d):
    h = F.col("html")
    return _pages(spark, d).select("page_id", extract.heading(h).alias("h1"), F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1).alias("title"))


def anchor_counts(spark, d):
    return _pages(spark, d).select("page_id", F.size(extract.anchors(F.col("html"))).cast("long").alias("links"))


def script_stripped(spark, d):
    clean = extract.visible(F.col("html"))
    return _pages(spark, d).select("page_id", F.length(clean).cast("long").alias("n"), F.length(urls.strip_html(clean)).cast("long").alias("text_n"))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): the distinct links of pages (url, html) to urls of the same origin."""
    page = urls.address(F.col("url"))
    links = pages.select(page.alias("src"), F.explode(extract.anchors(F.col("html"))).alias("href"))
    links = links.select("src", urls.address(urls.absolute(F.col("href"), F.col("src"))).alias("dst"))
    return links.where(urls.same_origin(F.col("src"), F.col("dst"))).distinct()


def link_bfs(spark, d):
    p = _pages(spark, d)
    links = checkpointed(page_links(p))
    return discovery.link_bfs(links, discovery.crawl_roots(p.select(urls.address(F.col("url")).alias("url")), links))


def name_tokens(spark, d):
    n = _part(spark, d).select("p_name").distinct()
    return n.select("p_name", F.posexplode(names.tokens(F.col("p_name"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def name_trigrams(spark, d):
    n = _part(spark, d).select("p_name").distinct()
    return n.select("p_name", F.explode(names.trigrams(F.col("p_name"))).alias("gram"))


def gram_frequency(spark, d):
    n = _part(spark, d).select(F.col("p_partkey").alias("ord"), names.plain(F.col("p_name")).alias("plain"))
    return matching.gram_counts(n).where("n <= 200").orderBy("n", "gram").limit(8000)


def _names(spark, d):
    return _part(spark, d).select(names.plain(F.col("p_name")).alias("plain")).distinct().withColumn("ord", F.col("plain"))


def name_similarity_pairs(spark, d):
    n = _names(spark, d)
    pairs = matching.band_pairs(n, n).where("mine < theirs")
    return pairs.select("a", "b", names.similarity(F.col("a"), F.col("b")).alias("score")).where("score >= 0.5").withColumn("score", F.floor(F.col("score") * 1000000 + 0.5) / 1000000)


def band_candidates(spark, d):
    n = _names(spark, d)
    return matching.band_counts(n, n)


def _catalogues(spark, d):
    p = _part(spark, d)
    url = F.concat(F.lit("https://a.example/p/"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("item-"), F.col("p_partkey"))).otherwise("x"))
    base = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("10000000"), F.col("p_partkey"))).otherwise("").alias("gtin"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("S"), F.col("p_partkey"))).otherwise("").alias("sku"), url.alias("url"), F.col("p_retailprice").alias("price"))
    return base.where("id % 10 < 8"), base.where("id % 10 >= 2").withColumn("price", F.col("price") + F.col("id") % 4 - 1)


def match_exact_unique(spark, d):
    mine, theirs = (matching.keyed(x) for x in _catalogues(spark, d))
    m = matching.assigned(matching.exact_edges(mine, theirs))
    return m.select("mine", "theirs", "method")


def only_mine(spark, d):
    mine, theirs = (matching.keyed(x) for x in _catalogues(spark, d))
    m = matching.assigned(matching.exact_edges(mine, theirs))
    return matching.unmatched(mine, m, "mine").select(F.col("ord").alias("id"))


def price_differ_count(spark, d):
    mine, theirs = _catalogues(spark, d)
    m = matching.assigned(matching.exact_edges(matching.keyed(mine), matching.keyed(theirs)))
    pairs = matching.looked_up(m, mine, theirs)
    none = F.lit(None).cast("double")
    return matching.price_differs(pairs.select(none.alias("my_usd"), F.col("my_product.price").alias("my_price"), none.alias("their_usd"), F.col("their_product.price").alias("their_price")))


def match_greedy(spark, d):
    """All tiers; no number of pairs makes one of them stop."""
    mine, theirs = _catalogues(spark, d)
    m = matching.match(mine, theirs, pair_limit=None, gram_pairs=None)
    return m.select("mine", "theirs", "method", "confidence")


def match_stores(spark, d):
    """My parts against those of five stores at once, by their keys."""
    mine, theirs = _catalogues(spark, d)
    listed = theirs.withColumn("store", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("id % (store + 3) <> 0")
    m = matching.match(mine, listed, pair_limit=0, trigrams=False, by=("store",))
    return m.select(F.col("store").cast("long").alias("store"), "mine", "theirs", "method")


def match_candidates(spark, d):
    mine, theirs = _catalogues(spark, d)
    return matching.candidates(matching.keyed(mine), matching.keyed(theirs)).select("id")


def _jobs(spark, d):
    e = read(spark, d, "events")
    at, ms = F.col("ts").cast("timestamp"), F.col("event_id") % 600
    status = F.element_at(F.array(*map(F.lit, metrics.STATUSES)), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("job_id"), F.col("event_type").alias("origin"), F.when(F.col("event_id") % 4 == 0, "shallow").otherwise("deep").alias("type"), status.alias("status"),
        at.alias("started_at"), at.alias("scheduled_at"), F.timestamp_millis(F.unix_millis(at) + ms * 1000).alias("finished_at"), F.timestamp_millis(F.unix_millis(at) + ms * 500).alias("heartbeat_at"),
        F.concat(F.lit("w"), F.col("user_id") % 9).alias("worker_id"), (F.col("event_id") % 5).cast("int").alias("attempts"), (F.col("event_id") % 50).alias("requests"),
    )


def job_window_summary(spark, d):
    s = metrics.window_summary(_jobs(spark, d), F.lit("2024-01-10").cast("timestamp"), "origin")
    return s.select("origin", "total", "done", "failed", "dead", "cancelled", "shallow", "deep", "success_rate", "failure_rate", "timed", "avg_ms", "requests", "failed_avg_ms")


def job_p95(spark, d):
    return metrics.window_summary(_jobs(spark, d), F.lit("2024-01-10").cast("timestamp")).select("median_ms", F.col("p95_ms").cast("long").alias("p95_ms"))


def queue_depth(spark, d):
    return metrics.queue_depth(_jobs(spark, d))


def worker_liveness(spark, d):
    w = metrics.liveness(_jobs(spark, d), F.lit("2024-01-25 00:00:00").cast("timestamp"), 86_400_000)
    return w.select("worker_id", "alive", "jobs", "stale")


def stale_claims(spark, d):
    r = metrics.released(_jobs(spark, d), F.lit("2024-01-20").cast("timestamp"))
    return r.groupBy("status", "stale").agg(F.count("*").alias("n"))


def next_claims(spark, d):
    return metrics.next_claims(_jobs(spark, d), F.lit("2024-01-20").cast("timestamp"), 10).select("job_id")


def recent_jobs(spark, d):
    return metrics.recent(_jobs(spark, d), F.lit("2024-01-20").cast("timestamp"), within_ms=3_600_000).select("job_id", "status")


def schedule_due(spark, d):
    o = read(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    freq = F.element_at(F.array(F.lit("hourly"), F.lit("daily"), F.lit("weekly"), F.lit("off")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    stores = o.select(F.col("o_orderkey").alias("store_id"), freq.alias("frequency"), F.when(F.col("o_orderkey") % 10 > 0, at).alias("last_deep_at"), at.alias("last_shallow_at"))
    active = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("store_id"))
    return metrics.due(stores, active, F.lit("1998-08-02 12:00:00").cast("timestamp"))


def miss_streaks(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 11 < 3).alias("ok"))
    return metrics.miss_streaks(e, "user_id", "event_id", "ok", 10)


def keyset_page(spark, d):
    o = read(spark, d, "orders").select(F.lpad(F.hex("o_orderkey"), 24, "0").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_totalprice")
    page = readpath.keyset_page(o.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "id", 50, after=("1998-01-01 00:00:00", "0"))
    return page.select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "o_totalprice", "has_more")


def offset_page(spark, d):
    return readpath.offset_page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 40)


def name_search(spark, d):
    return readpath.search(_part(spark, d), "RED", "p_name").select("p_partkey", "p_name")


def multi_search(spark, d):
    return readpath.search(_part(spark, d), "brand#1", "p_name", "p_brand", "p_type").select("p_partkey")


def stratified_sample(spark, d):
    return readpath.stratified(read(spark, d, "events").select("event_id"), ["event_id"], 37).select("event_id")


def spread_sample(spark, d):
    return readpath.spread(read(spark, d, "events").select("event_id"), ["event_id"]).select("event_id")


def cursor_round_trip(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.lower(F.lpad(F.hex("o_orderkey"), 24, "0")).alias("id"), (F.col("o_orderkey") * 1000).alias("ms"))
    c = o.select("o_orderkey", cursors.encode(F.col("ms"), F.col("id")).alias("cursor"))
    back = cursors.decode(F.col("cursor"))
    return c.select("o_orderkey", "cursor", back["ts"].alias("ts"), back["id"].alias("id"))


def daily_events(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def retry_waits(spark, d):
    """How many attempts of the jobs wait how long before the next."""
    tries = read(spark, d, "events").select((F.col("event_id") % 12).alias("attempt"))
    return tries.groupBy("attempt", times.backoff_ms(F.col("attempt")).alias("ms")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    host_key, origin_name, url_slug, url_pattern, identity_key, junk_urls, sitemap_leaf_filter, base_dominance, junk_audit, html_headings, anchor_counts, script_stripped,
    link_bfs, name_tokens, name_trigrams, gram_frequency, name_similarity_pairs, band_candidates, match_exact_unique, only_mine, price_differ_count, match_greedy, match_stores,
    match_candidates, job_window_summary, job_p95, queue_depth, worker_liveness, stale_claims, next_claims, recent_jobs, schedule_due, miss_streaks, keyset_page,
    offset_page, name_search, multi_search, stratified_sample, spread_sample, cursor_round_trip, daily_events, retry_waits,
)}

_HOST = r"lower(regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_SEGS = f"list_filter(string_split({_PATH}, '/'), lambda s: s <> '')"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_ENTRIES = f"""ent AS (SELECT DISTINCT 'https://' || {_HOST} AS origin, 'https://' || {_HOST} || tail AS loc, tail FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN '/product/p-' || page_id WHEN 1 THEN '/shoes/s-' || page_id WHEN 2 THEN '/bags/b-in-x' || page_id ELSE '/shoes' END AS tail FROM pages))"""
_GRAMS = f"n AS (SELECT p_name, p_partkey, ' ' || {_PLAIN} || ' ' AS s FROM part), g AS (SELECT DISTINCT p_name, p_partkey, substr(s, i, 3) AS gram FROM n, range(1, 200) r(i) WHERE i <= length(s) - 2)"
_NAMES = f"n AS (SELECT plain, row_number() OVER (ORDER BY plain) AS ord FROM (SELECT DISTINCT {_PLAIN} AS plain FROM part)), p AS (SELECT a.ord AS mine, b.ord AS theirs, a.plain AS a, b.plain AS b, floor(length(b.plain) / 5 + 0.5)::BIGINT AS band FROM n a, n b WHERE floor(length(b.plain) / 5 + 0.5) BETWEEN greatest(0, floor((length(a.plain) - 15) / 5 + 0.5)) AND floor((length(a.plain) + 15) / 5 + 0.5))"
_CATS = """b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '10000000' || p_partkey END AS gtin, CASE WHEN p_partkey % 3 = 0 THEN 's' || p_partkey END AS sku, CASE WHEN p_partkey % 5 = 0 THEN 'item-' || p_partkey END AS slug, p_retailprice AS price FROM part),
mine AS (SELECT * FROM b WHERE id % 10 < 8), theirs AS (SELECT * REPLACE (price + id % 4 - 1 AS price) FROM b WHERE id % 10 >= 2),
m AS (SELECT mine.id AS mine, theirs.id AS theirs, CASE WHEN mine.gtin = theirs.gtin THEN 'GTIN' WHEN mine.sku = theirs.sku THEN 'SKU' ELSE 'URL slug' END AS method, mine.price AS mp, theirs.price AS tp
      FROM mine JOIN theirs ON mine.id = theirs.id WHERE mine.gtin = theirs.gtin OR mine.sku = theirs.sku OR mine.slug = theirs.slug)"""
_STATUS = "['queued', 'claimed', 'retrying', 'done', 'failed', 'dead', 'cancelled'][event_id % 7 + 1]"
_JOBS = f"j AS (SELECT event_id AS job_id, event_type AS origin, CASE WHEN event_id % 4 = 0 THEN 'shallow' ELSE 'deep' END AS type, {_STATUS} AS status, epoch_ms(ts) AS s, epoch_ms(ts) + event_id % 600 * 1000 AS f, epoch_ms(ts) + event_id % 600 * 500 AS hb, 'w' || user_id % 9 AS worker_id, event_id % 5 AS attempts, event_id % 50 AS requests FROM events)"
_WINDOW = _JOBS + ", w AS (SELECT *, f - s AS ms FROM j WHERE status IN ('done', 'failed', 'dead', 'cancelled') AND f >= epoch_ms(TIMESTAMP '2024-01-10'))"

ORACLES = {
    "host_key": f"SELECT regexp_replace({_HOST}, '^www\\.', '') AS key, count(*) AS n FROM pages GROUP BY 1",
    "origin_name": rf"""SELECT page_id, array_to_string(list_transform(string_split(translate(string_split(regexp_replace({_HOST}, '^www\.', ''), '.')[1], '-_', '  '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name,
      nullif(regexp_extract(lower({_PATH}), '^/([a-z]{{2}})(?:-[a-z]{{2}})?/', 1), '') AS country FROM pages""",
    "url_slug": f"SELECT page_id, CASE WHEN length({_SEGS}[-1]) >= 3 THEN lower({_SEGS}[-1]) ELSE '' END AS slug, coalesce({_SEGS}[-1], {_HOST}) AS label FROM pages",
    "url_pattern": rf"SELECT regexp_replace({_PATH}, '[^/]+/?$', '{{slug}}') AS pattern, count(*) AS n FROM pages GROUP BY 1",
    "identity_key": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'gtin:00' || lpad(p_partkey::VARCHAR, 9, '0') WHEN 1 THEN 'sku:sku' || p_partkey ELSE CASE WHEN true THEN 'slug:item-' || p_partkey END END AS identity_key FROM part",
    "junk_urls": f"SELECT page_id, page_id % 5 = 0 OR page_id % 7 = 0 AS junk, page_id % 5 <> 0 AND page_id % 7 = 0 AS landing FROM pages",
    "sitemap_leaf_filter": f"""WITH {_ENTRIES}, s AS (SELECT *, avg(CASE WHEN loc LIKE '%/product/%' THEN 1.0 ELSE 0 END) OVER (PARTITION BY origin) > 0.6 AS dom, bool_or(tail = '/shoes') OVER (PARTITION BY origin) AS listed FROM ent)
      SELECT loc FROM s WHERE tail LIKE '/product/%' OR (tail LIKE '/shoes/%' AND NOT dom AND listed)""",
    "base_dominance": f"WITH {_ENTRIES} SELECT origin, count(*) AS n, count(*) FILTER (loc LIKE '%/product/%') AS base, count(*) FILTER (loc LIKE '%/product/%') > count(*) * 0.6 AS dominant FROM ent GROUP BY 1",
    "junk_audit": f"WITH {_ENTRIES} SELECT origin, count(*) AS active, count(*) FILTER (loc LIKE '%/product/%') > count(*) * 0.6 AS dominant, 0::BIGINT AS junk, 0::BIGINT AS landing FROM ent GROUP BY 1",
    "html_headings": r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), '') AS h1, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages",
    "anchor_counts": r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s+[^>]*href=["'']([^"''#]+)["'']'))::BIGINT AS links FROM pages""",
    "script_stripped": r"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>', '', 'g') AS c FROM pages)
      SELECT page_id, length(c)::BIGINT AS n, length(trim(regexp_replace(replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '\s+', ' ', 'g')))::BIGINT AS text_n FROM c""",
    "name_tokens": f"SELECT p_name, pos - 1 AS pos, t[pos] AS token FROM (SELECT DISTINCT p_name, string_split({_PLAIN}, ' ') AS t FROM part), range(1, 50) r(pos) WHERE pos <= len(t)",
    "name_trigrams": f"WITH {_GRAMS} SELECT DISTINCT p_name, gram FROM g",
    "gram_frequency": f"WITH {_GRAMS} SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING n <= 200 ORDER BY n, gram LIMIT 8000",
    "name_similarity_pairs": f"""WITH {_NAMES}, x AS (SELECT *, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) AS i, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM p WHERE mine < theirs),
      y AS (SELECT a, b, i / (len(ta) + len(tb) - i) AS j FROM x), z AS (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN j >= 0.75 THEN j WHEN contains(a, b) OR contains(b, a) THEN 0.6 + 0.35 * (least(length(a), length(b)) / greatest(length(a), length(b)))
      ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END AS score FROM y) SELECT a, b, floor(score * 1000000 + 0.5) / 1000000 AS score FROM z WHERE score >= 0.5""",
    "band_candidates": f"WITH {_NAMES} SELECT band, count(*) AS pairs FROM p GROUP BY 1",
    "match_exact_unique": f"WITH {_CATS} SELECT mine, theirs, method FROM m",
    "match_stores": f"WITH {_CATS} SELECT s AS store, mine, theirs, method FROM m, range(5) r(s) WHERE theirs % (s + 3) <> 0",
    "match_candidates": f"WITH {_CATS}, w AS (SELECT p_partkey AS id, unnest(string_split({_PLAIN}, ' ')) AS word FROM part) SELECT id FROM theirs WHERE id IN (SELECT m.id FROM mine m WHERE m.gtin = theirs.gtin OR m.sku = theirs.sku OR m.slug = theirs.slug) OR id IN (SELECT id FROM w WHERE word IN (SELECT word FROM w WHERE id % 10 < 8))",
    "only_mine": f"WITH {_CATS} SELECT id FROM mine WHERE id NOT IN (SELECT mine FROM m)",
    "price_differ_count": f"WITH {_CATS} SELECT count(*) FILTER (mp > 0 AND tp > 0 AND mp <> tp) AS differ FROM m",
    "job_window_summary": f"""WITH {_WINDOW} SELECT origin, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'dead') AS dead, count(*) FILTER (status = 'cancelled') AS cancelled,
      count(*) FILTER (type = 'shallow') AS shallow, count(*) FILTER (type = 'deep') AS deep, floor(count(*) FILTER (status = 'done') / count(*) * 1000 + 0.5) / 10 AS success_rate, floor(count(*) FILTER (status IN ('failed', 'dead')) / count(*) * 1000 + 0.5) / 10 AS failure_rate,
      count(ms) AS timed, floor(avg(ms) + 0.5)::BIGINT AS avg_ms, sum(requests)::BIGINT AS requests, floor(avg(ms) FILTER (status IN ('failed', 'dead')) + 0.5)::BIGINT AS failed_avg_ms FROM w GROUP BY 1""",
    "job_p95": f"WITH {_WINDOW} SELECT median(ms) AS median_ms, quantile_disc(ms, 0.95)::BIGINT AS p95_ms FROM w",
    "queue_depth": f"WITH {_JOBS} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in metrics.STATUSES) + ", count(*) FILTER (status IN ('queued', 'claimed', 'retrying')) AS in_flight FROM j",
    "worker_liveness": f"WITH {_JOBS}, c AS (SELECT *, epoch_ms(TIMESTAMP '2024-01-25') - hb <= 86400000 AS fresh FROM j WHERE status = 'claimed') SELECT worker_id, bool_or(fresh) AS alive, count(*) AS jobs, count(*) FILTER (NOT fresh) AS stale FROM c GROUP BY 1",
    "stale_claims": f"""WITH {_JOBS}, x AS (SELECT *, status = 'claimed' AND (epoch_ms(TIMESTAMP '2024-01-20') - hb > 60000 OR epoch_ms(TIMESTAMP '2024-01-20') - s > 21600000) AS stale FROM j)
      SELECT CASE WHEN stale AND attempts >= 3 THEN 'dead' WHEN stale THEN 'retrying' ELSE status END AS status, stale, count(*) AS n FROM x GROUP BY 1, 2""",
    "next_claims": f"WITH {_JOBS} SELECT job_id FROM j WHERE status IN ('queued', 'retrying') AND s <= epoch_ms(TIMESTAMP '2024-01-20') ORDER BY s, job_id LIMIT 10",
    "recent_jobs": f"""WITH {_JOBS} SELECT * FROM (SELECT job_id, status FROM j WHERE status IN ('queued', 'claimed', 'retrying') ORDER BY s DESC, job_id LIMIT 50)
      UNION ALL SELECT * FROM (SELECT job_id, status FROM j WHERE status NOT IN ('queued', 'claimed', 'retrying') AND epoch_ms(TIMESTAMP '2024-01-20') - f <= 3600000 ORDER BY f DESC, job_id LIMIT 15)""",
    "schedule_due": """WITH s AS (SELECT o_orderkey AS store_id, [1, 24, 168, NULL][o_orderkey % 4 + 1] AS h, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS dp, o_orderdate AS sh FROM orders WHERE o_orderstatus <> 'P'),
      x AS (SELECT *, (epoch_ms(TIMESTAMP '1998-08-02 12:00:00') - epoch_ms(dp::TIMESTAMP)) / 3600000 AS wd, (epoch_ms(TIMESTAMP '1998-08-02 12:00:00') - epoch_ms(sh::TIMESTAMP)) / 3600000 AS ws FROM s WHERE h IS NOT NULL)
      SELECT store_id, CASE WHEN dp IS NULL OR wd >= greatest(h, 6) THEN 'deep' ELSE 'shallow' END AS due FROM x WHERE dp IS NULL OR wd >= greatest(h, 6) OR ws >= h""",
    "miss_streaks": """WITH e AS (SELECT user_id, event_id % 11 < 3 AS ok, sum((event_id % 11 < 3)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT user_id, i, count(*) AS n FROM e WHERE NOT ok GROUP BY 1, 2)
      SELECT user_id, max(n) AS longest, max(n) >= 10 AS tripped FROM s GROUP BY 1""",
    "keyset_page": "WITH o AS (SELECT lpad(printf('%X', o_orderkey), 24, '0') AS id, o_orderdate::TIMESTAMP AS ts, o_totalprice FROM orders) SELECT id, strftime(ts, '%Y-%m-%d') AS day, o_totalprice, true AS has_more FROM o WHERE ts < TIMESTAMP '1998-01-01' OR (ts = TIMESTAMP '1998-01-01' AND id < '0') ORDER BY ts DESC, id DESC LIMIT 50",
    "offset_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 120",
    "name_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')",
    "multi_search": "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')",
    "stratified_sample": "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS c FROM events) SELECT event_id FROM n WHERE rn IN (SELECT floor(i * (SELECT count(*) FROM events) / 37.0)::BIGINT FROM range(37) r(i))",
    "spread_sample": "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS c FROM events) SELECT event_id FROM n WHERE rn % greatest(1, c // 25) = 0 ORDER BY rn LIMIT 25",
    "cursor_round_trip": "SELECT o_orderkey, replace(replace(rtrim(base64(encode((o_orderkey * 1000) || '|' || lower(lpad(printf('%X', o_orderkey), 24, '0')))), '='), '+', '-'), '/', '_') AS cursor, o_orderkey * 1000 AS ts, lower(lpad(printf('%X', o_orderkey), 24, '0')) AS id FROM orders",
    "daily_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "retry_waits": "SELECT event_id % 12 AS attempt, least(15000 * pow(2, event_id % 12), 900000)::BIGINT AS ms, count(*) AS n FROM events GROUP BY 1, 2",
}
