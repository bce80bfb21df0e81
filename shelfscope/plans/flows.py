"""Queries over jobs, catalogue pagers, sitemaps and links that are followed step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.operators import discovery, health, jobs, pagers
from shelfscope.sources import sinks, sitemaps
from shelfscope.sources.stored import checkpointed
from shelfscope.sources.tables import read

RULES = jobs.Rules(beat_ms=12 * 3_600_000, most_ms=40 * 3_600_000, wait_ms=600_000, longest_ms=3_600_000)
#: Fixed value: lines of a job's log that are kept.
LOG_LINES = 200


def _job_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of each user in five days as those of one job of two workers."""
    e = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type")
    e = e.withColumn("job_id", F.col("user_id") * 10 + F.floor(F.dayofmonth("at") / 5)).withColumn("seq", F.col("event_id"))
    control = F.element_at(F.array(F.lit("pause"), F.lit("resume"), F.lit("cancel"), F.lit("heartbeat")), (F.col("event_id") % 4 + 1).cast("int"))
    action = F.when(F.col("event_type") == "signup", "claim").when(F.col("event_type") == "click", "heartbeat").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise(control)
    first = F.row_number().over(Window.partitionBy("job_id").orderBy("at", "seq")) == 1
    return e.select("job_id", "at", "seq", F.when(first, "enqueue").otherwise(action).alias("action"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"))


def job_lives(spark, d):
    return jobs.lives(_job_events(spark, d), F.lit("2024-02-01").cast("timestamp"), RULES)


def job_log(spark, d):
    """The last lines of the log of each kind of event."""
    e = read(spark, d, "events").select("event_id", "event_type", "ts")
    return sinks.newest(e, ["event_type"], "ts", LOG_LINES, "event_id").select("event_type", "event_id")


def _catalogue_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's line items as pages of ten products; every third supplier tells its number of
    pages, and one less than it has."""
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("origin"), "l_orderkey", "l_linenumber")
    # A page is short where a product of it is missing: those of every fiftieth order.
    paged = rows.withColumn("page", F.expr("(row_number() OVER (PARTITION BY origin ORDER BY l_orderkey, l_linenumber) - 1) div 10 + 1"))
    pages = paged.groupBy("origin", "page").agg(F.count_if(F.col("l_orderkey") % 50 != 0).alias("items"))
    last = pages.groupBy("origin").agg(F.max("page").alias("pages"))
    return pages.join(last, "origin").select("origin", "page", "items", F.when(F.col("origin") % 3 == 0, F.greatest(F.col("pages") - 1, F.lit(1))).alias("total_pages"))


def pager_stops(spark, d):
    """How far the pager of each supplier goes, and why it stops."""
    return pagers.stops(_catalogue_pages(spark, d), 10, most=300)


def pager_items(spark, d):
    """The products on the pages that were read, without a bound on them."""
    return pagers.read_pages(_catalogue_pages(spark, d), 10).groupBy("origin").agg(F.sum("items").alias("items"), F.max("page").alias("pages"))


_HOST = r"lower(regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def _sitemap_docs(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps of each host over its pages: some in the root index, some below two more indices, some
    too deep, some of images; an inner index also lists the root."""
    p = read(spark, d, "pages").select("page_id", F.expr(f"'https://' || {_HOST}").alias("o"))
    p = p.withColumn("k", F.col("page_id") % 5).withColumn("part", F.expr("page_id div 500"))
    name = F.expr("CASE k WHEN 0 THEN '/product-sitemap' WHEN 1 THEN '/image-sitemap' WHEN 2 THEN '/low' ELSE '/lowest' END || part || '.xml'")
    leaf = p.where("k < 4").withColumn("url", F.concat("o", name))
    block = F.expr("'<url><loc>' || o || '/p/' || page_id || '</loc>' || CASE WHEN page_id % 2 = 0 THEN '<lastmod>2024-01-0' || (page_id % 9 + 1) || '</lastmod>' ELSE '' END || '</url>'")
    bodies = leaf.groupBy("url").agg(F.concat(F.lit("<urlset>"), F.array_join(F.array_sort(F.collect_list(block)), ""), F.lit("</urlset>")).alias("body"))  # 500 pages at most
    parents = {0: "/sitemap.xml", 1: "/sitemap.xml", 2: "/inner2.xml", 3: "/inner3.xml"}
    listed = leaf.select("o", "url", F.create_map(*(F.lit(x) for kv in parents.items() for x in kv))[F.col("k").cast("int")].alias("parent")).distinct()
    fixed = F.explode(F.array(*(F.struct(F.lit(a).alias("parent"), F.concat("o", F.lit(b)).alias("url")) for a, b in (("/sitemap.xml", "/inner1.xml"), ("/inner1.xml", "/inner2.xml"), ("/inner2.xml", "/inner3.xml"), ("/inner2.xml", "/sitemap.xml")))))
    links = listed.select("o", "parent", "url").unionByName(p.select("o").distinct().select("o", fixed.alias("f")).select("o", "f.parent", "f.url"))
    entry = F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))
    indices = links.groupBy(F.concat("o", "parent").alias("url")).agg(F.concat(F.lit("<?xml version='1.0'?><sitemapindex>"), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</sitemapindex>")).alias("body"))
    return bodies.unionByName(indices)


def sitemap_entries(spark, d):
    """The pages that are listed in sitemaps of a store, through indices three levels deep."""
    docs = _sitemap_docs(spark, d)
    below = sitemaps.reached(docs, docs.where(F.col("url").endswith("/sitemap.xml")).select("url")).select("url").distinct()
    return sitemaps.entries(docs).join(below, "url", "left_semi").select("loc", "lastmod")


def sitemap_levels(spark, d):
    """How many sitemaps are reached at each depth below each host's root."""
    docs = _sitemap_docs(spark, d)
    found = sitemaps.reached(docs, docs.where(F.col("url").endswith("/sitemap.xml")).select("url"))
    return found.groupBy("root", "depth").agg(F.count("*").alias("sitemaps"))


def link_walk(spark, d):
    """All pages within three links of the first page of their host. A page links to two others of it,
    some of which link back."""
    order = Window.partitionBy("o").orderBy("page_id")
    p = read(spark, d, "pages").select("page_id", F.expr(f"'https://' || {_HOST}").alias("o"))
    p = p.withColumn("i", F.row_number().over(order) - 1).withColumn("m", F.count("*").over(Window.partitionBy("o")))
    at = lambda c: F.concat("o", F.lit("/"), F.expr(c).cast("string")).alias("dst")
    links = p.select(at("i").alias("src"), at("(2 * i + 1) % m")).unionByName(p.select(at("i").alias("src"), at("(2 * i + 2) % m")))
    roots = p.where("i = 0").select(at("i").alias("url"))
    return discovery.link_bfs(checkpointed(links), roots, most_pages=None)


def page_protection(spark, d):
    """What guards pages, told from answers that their numbers stand for; whole pages are looked at."""
    p = read(spark, d, "pages").where("html IS NOT NULL")
    status = F.element_at(F.array(*map(F.lit, (200, 403, 429, 503))), (F.col("page_id") % 4 + 1).cast("int"))
    server = F.element_at(F.array(F.lit("Cloudflare"), F.lit("nginx"), F.lit("AkamaiGHost")), (F.col("page_id") % 3 + 1).cast("int"))
    headers = F.when(F.col("page_id") % 5 == 0, F.create_map(F.lit("cf-ray"), F.lit("1"))).when(F.col("page_id") % 7 == 0, F.create_map(F.lit("akamai-x-cache"), F.lit("1"))).otherwise(F.create_map(F.lit("server"), server))
    html = F.when(F.col("page_id") % 11 == 0, F.concat("html", F.lit("<p>Just a moment</p>"))).otherwise(F.col("html"))
    found = p.select(health.protection(status, headers, html, None).alias("p"))
    return found.groupBy("p.provider", "p.blocking").agg(F.count("*").alias("n"))


def linked_shops(spark, d):
    """All shops that pages link to, each page with two more links by its number."""
    more = F.concat(F.lit('<a href="https://shop'), F.col("page_id") % 50, F.lit('.example/x"></a><a href="https://store.example/'), "page_id", F.lit('"></a><a href="https://other.example/"></a>'))
    p = read(spark, d, "pages").where("html IS NOT NULL").withColumn("html", F.concat("html", F.when(F.col("page_id") % 3 > 0, more).otherwise("")))
    return health.homepage(p, most=None).select(F.explode("store_hosts").alias("host")).groupBy("host").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (job_lives, job_log, pager_stops, pager_items, sitemap_entries, sitemap_levels, link_walk, page_protection, linked_shops)}

_JOB_EVENTS = """e0 AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id * 10 + dayofmonth(ts) // 5 AS job_id, event_type, 'w' || (event_id % 2) AS w FROM events),
  e AS MATERIALIZED (SELECT job_id, ms, w, row_number() OVER o AS n, CASE WHEN row_number() OVER o = 1 THEN 'enqueue' WHEN event_type = 'signup' THEN 'claim' WHEN event_type = 'click' THEN 'heartbeat' WHEN event_type = 'error' THEN 'fail'
    WHEN event_type = 'purchase' THEN 'complete' ELSE ['pause', 'resume', 'cancel', 'heartbeat'][(event_id % 4 + 1)::INT] END AS act FROM e0 WINDOW o AS (PARTITION BY job_id ORDER BY ms, event_id))"""
_WAIT = "least(600000 * power(2, {}), 3600000)::BIGINT"


def _timed(columns: str, now: str, rest: str) -> str:
    """What time alone does to jobs (columns of a state) up to a time."""
    return f"""SELECT {rest}, CASE WHEN late AND attempts + 1 >= 3 THEN 'dead' WHEN late THEN 'retrying' ELSE status END AS status, attempts + late::INT AS attempts,
      CASE WHEN late AND attempts + 1 >= 3 THEN NULL ELSE control END AS control, CASE WHEN NOT late THEN worker END AS worker,
      CASE WHEN late AND attempts + 1 < 3 THEN due + {_WAIT.format("(attempts + 1)")} ELSE scheduled_ms END AS scheduled_ms, started_ms, CASE WHEN NOT late THEN beat_ms END AS beat_ms,
      CASE WHEN late AND attempts + 1 >= 3 THEN due ELSE finished_ms END AS finished_ms, moves + late::INT AS moves
    FROM (SELECT *, status = 'claimed' AND {now} > due AS late FROM (SELECT {columns}, least(beat_ms + 43200000, started_ms + 144000000) AS due FROM {{}}))"""


ORACLES = {
    "job_lives": f"""WITH RECURSIVE {_JOB_EVENTS},
  f(job_id, n, status, attempts, control, worker, scheduled_ms, started_ms, beat_ms, finished_ms, moves) AS (
    SELECT job_id, 1::BIGINT, 'queued', 0, NULL::VARCHAR, NULL::VARCHAR, ms, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 1 FROM e WHERE n = 1
    UNION ALL
    SELECT job_id, n, CASE WHEN claims THEN 'claimed' WHEN stops THEN 'cancelled' WHEN completes THEN 'done' WHEN dies THEN 'dead' WHEN fails THEN 'retrying' ELSE status END, attempts + fails::INT,
      CASE WHEN stops OR completes OR dies THEN NULL WHEN pauses THEN 'pause' WHEN resumes THEN NULL WHEN asks THEN 'cancel' ELSE control END, CASE WHEN claims THEN w WHEN fails THEN NULL ELSE worker END,
      CASE WHEN fails AND NOT dies THEN ms + {_WAIT.format("(attempts + 1)")} ELSE scheduled_ms END, CASE WHEN claims THEN ms ELSE started_ms END, CASE WHEN claims OR (beats AND NOT stops) THEN ms WHEN fails THEN NULL ELSE beat_ms END,
      CASE WHEN stops OR completes OR dies THEN ms ELSE finished_ms END, moves + (claims OR stops OR completes OR fails)::INT
    FROM (SELECT *, beats AND control IS NOT DISTINCT FROM 'cancel' OR act = 'cancel' AND waits AS stops, fails AND attempts + 1 >= 3 AS dies, act = 'cancel' AND status = 'claimed' AS asks FROM (
      SELECT *, act = 'claim' AND waits AND scheduled_ms <= ms AND control IS DISTINCT FROM 'pause' AS claims, act = 'heartbeat' AND held AS beats, act = 'complete' AND held AS completes, act = 'fail' AND held AS fails,
        act = 'pause' AND going AS pauses, act = 'resume' AND going AS resumes FROM (
        SELECT *, status IN ('queued', 'retrying') AS waits, status IN ('queued', 'retrying', 'claimed') AS going, status = 'claimed' AND w = worker IS TRUE AS held
        FROM ({_timed("f.*, e.ms, e.act, e.w, e.n AS m", "ms", "job_id, m AS n, ms, act, w").format("f JOIN e ON e.job_id = f.job_id AND e.n = f.n + 1")}))))),
  l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1)
  {_timed("*", "epoch_ms(TIMESTAMP '2024-02-01')", "job_id").format("l")}""",
    "job_log": f"SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= {LOG_LINES}",
}

_PAGES = """r AS (SELECT l_suppkey AS origin, l_orderkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 10 + 1 AS page FROM lineitem),
  c AS (SELECT origin, page, count(*) FILTER (l_orderkey % 50 <> 0) AS items FROM r GROUP BY ALL), p AS (SELECT *, CASE WHEN origin % 3 = 0 THEN greatest(max(page) OVER (PARTITION BY origin) - 1, 1) END AS total FROM c),
  b AS (SELECT *, coalesce(sum(items) OVER (PARTITION BY origin ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
  x AS (SELECT *, CASE WHEN {} before >= {} THEN 'limit' WHEN page > total THEN 'total' END AS why_not, items = 0 AS empty, total IS NULL AND items < 10 AS short FROM b),
  s AS (SELECT origin, min(page) FILTER (why_not IS NOT NULL) AS n1, min(page) FILTER (empty OR short) AS n2, max(page) AS n3 FROM x GROUP BY 1),
  k AS (SELECT origin, CASE WHEN n1 IS NOT NULL AND (n2 IS NULL OR n1 <= n2) THEN n1 - 1 ELSE coalesce(n2, n3) END AS pages, n1, n2 FROM s)"""
ORACLES["pager_stops"] = f"""WITH {_PAGES.format("", 300)} SELECT k.origin, pages, sum(items)::BIGINT AS items,
  coalesce(max(y.why), CASE WHEN max(n2) IS NULL THEN 'end' WHEN bool_or(x.page = n2 AND empty) THEN 'empty' ELSE 'short' END) AS stop
  FROM k JOIN x ON x.origin = k.origin AND x.page <= k.pages LEFT JOIN (SELECT origin, page, why_not AS why FROM x) y ON y.origin = k.origin AND y.page = n1 AND (n2 IS NULL OR n1 <= n2) GROUP BY 1, 2"""
ORACLES["pager_items"] = f"WITH {_PAGES.format('false AND', 300)} SELECT k.origin, sum(items)::BIGINT AS items, max(x.page) AS pages FROM k JOIN x ON x.origin = k.origin AND x.page <= k.pages GROUP BY 1"

_SITEMAPS = f"""WITH RECURSIVE p AS (SELECT page_id, 'https://' || {_HOST} AS o, page_id % 5 AS k, page_id // 500 AS part FROM pages),
  leaf AS (SELECT *, o || ['/product-sitemap', '/image-sitemap', '/low', '/lowest'][(k + 1)::INT] || part || '.xml' AS url FROM p WHERE k < 4),
  links AS (SELECT DISTINCT o || ['/sitemap.xml', '/sitemap.xml', '/inner2.xml', '/inner3.xml'][(k + 1)::INT] AS src, url AS dst FROM leaf WHERE k <> 1
    UNION SELECT DISTINCT o || a, o || b FROM p, (VALUES ('/sitemap.xml', '/inner1.xml'), ('/inner1.xml', '/inner2.xml'), ('/inner2.xml', '/inner3.xml'), ('/inner2.xml', '/sitemap.xml')) v(a, b)),
  reach(root, url, depth) AS (SELECT DISTINCT o || '/sitemap.xml', o || '/sitemap.xml', 0 FROM p UNION SELECT root, dst, depth + 1 FROM reach JOIN links ON src = url WHERE depth < 3),
  found AS (SELECT root, url, min(depth) AS depth FROM reach GROUP BY ALL)"""
ORACLES["sitemap_entries"] = f"{_SITEMAPS} SELECT o || '/p/' || page_id AS loc, CASE WHEN page_id % 2 = 0 THEN '2024-01-0' || (page_id % 9 + 1) END AS lastmod FROM leaf WHERE url IN (SELECT url FROM found)"
ORACLES["sitemap_levels"] = f"{_SITEMAPS} SELECT root, depth, count(*) AS sitemaps FROM found GROUP BY ALL"
ORACLES["link_walk"] = f"""WITH RECURSIVE p AS (SELECT 'https://' || {_HOST} AS o, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) - 1 AS i, count(*) OVER (PARTITION BY {_HOST}) AS m FROM pages),
  links AS (SELECT o || '/' || i AS src, o || '/' || (2 * i + 1) % m AS dst FROM p UNION SELECT o || '/' || i, o || '/' || (2 * i + 2) % m FROM p),
  reach(url, depth) AS (SELECT o || '/0', 0 FROM p WHERE i = 0 UNION SELECT dst, depth + 1 FROM reach JOIN links ON src = url WHERE depth < 3)
  SELECT url, min(depth) AS depth FROM reach GROUP BY 1"""
ORACLES["page_protection"] = """WITH p AS (SELECT [200, 403, 429, 503][(page_id % 4 + 1)::INT] AS s, page_id % 5 = 0 OR page_id % 7 <> 0 AND page_id % 3 = 0 AS cf, page_id % 5 <> 0 AND (page_id % 7 = 0 OR page_id % 3 = 2) AS ak,
    page_id % 11 = 0 OR regexp_matches(lower(html), 'just a moment|checking your browser|verify you are human|captcha|cf-chl') AS asks FROM pages WHERE html IS NOT NULL)
  SELECT CASE WHEN s = 429 THEN 'rate-limited' WHEN cf THEN 'cloudflare' WHEN ak THEN 'akamai' ELSE 'none' END AS provider, s = 429 OR cf AND (s >= 400 OR asks) OR NOT cf AND ak AND s >= 400 AS blocking, count(*) AS n FROM p GROUP BY ALL"""
ORACLES["linked_shops"] = """WITH a AS (SELECT host, n FROM (SELECT 'shop' || page_id % 50 || '.example' AS host, count(*) AS n FROM pages WHERE html IS NOT NULL AND page_id % 3 > 0 GROUP BY 1)),
  b AS (SELECT 'store.example' AS host, count(*) AS n FROM pages WHERE html IS NOT NULL AND page_id % 3 > 0) SELECT * FROM a UNION ALL SELECT * FROM b"""
