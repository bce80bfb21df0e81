"""Queries over price observations: changes, crawls as months, as-of prices, trends, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfscope.functions import prices as P
from shelfscope.functions import times
from shelfscope.functions.numbers import half_up
from shelfscope.operators import alerts, analytics, ingest, metrics, readpath
from shelfscope.sources import sinks, tables
from shelfscope.sources.tables import monthly, observations, read

#: Fixed currency units per USD for the conversion queries.
RATES = {"AED": 3.6725, "OMR": 0.3845, "SAR": 3.75, "QAR": 3.64, "KWD": 0.307, "USD": 1.0}
CURRENCIES = ("USD", "AED", "OMR", "SAR", "QAR", "XXX", "KWD", "")

OBS = """
obs AS (
  SELECT l_suppkey AS store_id, l_partkey AS product_id, l_shipdate AS t,
         min(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100) AS price,
         min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) = 1 AS available
  FROM lineitem GROUP BY 1, 2, 3)"""
MONTHS = (
    OBS
    + """,
months AS (
  SELECT store_id, product_id, year(t) * 12 + month(t) - 1 AS month, arg_max(price, t) AS price, arg_max(available, t) AS available
  FROM obs GROUP BY 1, 2, 3),
hist AS (
  SELECT *, lag(month) OVER w AS prev_month, lag(price) OVER w AS prev_price, lag(available) OVER w AS prev_available, lead(month) OVER w AS next_month
  FROM months WINDOW w AS (PARTITION BY store_id, product_id ORDER BY month))"""
)
MONTH = 1997 * 12 + 5


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(read(spark, sf_dir, "lineitem"))


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(_obs(spark, sf_dir))


def _cents(rows: DataFrame) -> DataFrame:
    """Prices as whole numbers, whose sums don't depend on the order of rows."""
    return rows.withColumn("price", F.round(F.col("price") * 100))


def _day(c: str = "t"):
    return F.date_format(c, "yyyy-MM-dd")


def _changes(obs: DataFrame) -> DataFrame:
    w = Window.partitionBy("store_id", "product_id").orderBy("t")
    return obs.select("*", F.lag("price").over(w).alias("first"), F.lag("available").over(w).alias("was_available"))


def price_changes(spark, d):
    c = _changes(_obs(spark, d)).where("first IS NOT NULL AND first <> price")
    return c.select("store_id", "product_id", _day().alias("day"), "first", F.col("price").alias("latest"), half_up(P.change_percent(F.col("first"), F.col("price")), 1).alias("pct"))


def stock_changes(spark, d):
    c = _changes(_obs(spark, d)).where("was_available <> available")
    return c.select("store_id", "product_id", _day().alias("day"), "was_available", "available")


def crawl_diff_month(spark, d):
    months = _months(spark, d)
    h = ingest.history_changes(months)
    seen = h.groupBy("month").agg(
        F.count_if(F.col("prev_month").isNull()).alias("added"),
        F.count_if(F.col("prev_price") != F.col("price")).alias("price_changed"),
        F.count_if(F.col("prev_available") != F.col("available")).alias("stock_changed"),
    )
    last = months.agg(F.max("month").alias("last"))
    gone = h.where(F.col("next_month").isNull() | (F.col("next_month") > F.col("month") + 1)).join(F.broadcast(last), F.col("month") < F.col("last"))  # one row
    gone = gone.groupBy((F.col("month") + 1).alias("month")).agg(F.count("*").alias("removed"))
    return seen.join(gone, "month", "left").select("month", "added", "price_changed", "stock_changed", F.coalesce("removed", F.lit(0)).alias("removed"))


def crawl_events(spark, d):
    """One crawl (a month) against the state before it, through the change log."""
    months = _months(spark, d)
    point = [F.col("store_id").cast("string").alias("origin"), F.col("store_id").cast("string").alias("key"), F.col("product_id").cast("string").alias("identity_key")]
    rest = [F.concat(F.lit("product "), F.col("product_id")).alias("name"), F.lit("").alias("url"), "price", "available"]
    before = analytics.latest(months.where(F.col("month") < MONTH), ["store_id", "product_id"], "month")
    state = before.select(*point, *rest, F.col("month").alias("last_seen_at"))
    crawl = months.where(F.col("month") == MONTH).select(*point, *rest)
    log = ingest.events(ingest.compared(state, crawl), F.lit(MONTH), F.lit(MONTH - 1), full=True)
    return log.select("origin", "identity_key", "type", F.col("old.price").alias("old_price"), F.col("new.price").alias("new_price"))


def _store_crawls(spark, d):
    """A batch of crawls of all stores in one month, some partial or capped, against the state before:
    (both, log, facts)."""
    months, s = _months(spark, d), F.col("store_id")
    point = [s.cast("string").alias("origin"), s.cast("string").alias("key"), F.col("product_id").cast("string").alias("identity_key")]
    rest = [F.concat(F.lit("product "), F.col("product_id")).alias("name"), F.lit("").alias("url"), "price", "available"]
    before = analytics.latest(months.where(F.col("month") < MONTH), ["store_id", "product_id"], "month")
    state = before.select(*point, *rest, F.col("month").alias("last_seen_at"))
    crawl = months.where(F.col("month") == MONTH).select(*point, *rest)
    past = months.where(F.col("month") < MONTH).select("store_id", "month").distinct()
    snapshots = past.select(s.cast("string").alias("origin"), F.col("month").alias("finished_at"), ((F.col("month") + s) % 3 == 0).alias("full"))
    crawls = months.select("store_id").distinct().select(s.cast("string").alias("origin"), F.lit(MONTH).cast("long").alias("at"), (s % 2 == 0).alias("full_crawl"), (s % 5 == 4).alias("capped"))
    facts = ingest.facts(crawls, crawl, snapshots, F.lit(0).cast("long"))
    both = ingest.compared_by_origin(state, crawl, facts)
    return both, ingest.stamped(ingest.events(both, F.col("at"), F.col("anchor"), F.col("full"))), facts


def multi_store_events(spark, d):
    _, log, _ = _store_crawls(spark, d)
    return log.select("origin", "identity_key", "type", F.col("old.price").alias("old_price"), F.col("new.price").alias("new_price"), "snapshot_id")


def multi_store_snapshots(spark, d):
    s = ingest.snapshots_of(*_store_crawls(spark, d))
    return s.join(ingest.changed(s).withColumn("rematch", F.lit(True)), "origin", "left").withColumn("rematch", F.coalesce("rematch", F.lit(False)))


def biggest_movers(spark, d):
    c = _changes(_obs(spark, d)).where("first IS NOT NULL AND first <> price").select("store_id", "product_id", "t", "first", F.col("price").alias("latest"))
    m = analytics.movers(c).select("store_id", "product_id", _day().alias("day"), "first", "latest", half_up(F.col("change"), 2).alias("change"))
    return m.orderBy(F.desc(F.abs("change")), F.desc("day"), "store_id", "product_id").limit(20)


def _products(spark, d):
    return analytics.latest(_obs(spark, d), ["store_id", "product_id"])


def active_since_full(spark, d):
    seen = _months(spark, d).groupBy("store_id", "product_id").agg(F.max("month").alias("last_seen"))
    anchor = seen.groupBy("store_id").agg(F.max("last_seen").alias("anchor"))
    return seen.join(anchor, "store_id").where("last_seen >= anchor").groupBy("store_id").agg(F.count("*").alias("active"))


def active_not_purged(spark, d):
    p = _products(spark, d).withColumn("last_seen_at", F.col("t").cast("timestamp"))
    return ingest.active(p).groupBy("store_id").agg(F.count("*").alias("active"))


def _snapshots(obs: DataFrame) -> DataFrame:
    """A crawl of every store at the start of each year."""
    years = obs.select("store_id", F.date_trunc("year", "t").alias("t")).distinct()
    return years.select("store_id", F.col("t").cast("timestamp_ntz").alias("t"))


def price_asof_snapshot(spark, d):
    obs = _obs(spark, d)
    a = analytics.store_averages_at(_snapshots(obs), _cents(obs))
    return a.select("store_id", _day().alias("day"), "n", half_up(F.col("avg_price") / 100, 6).alias("avg_price"))


def market_trend(spark, d):
    obs = _obs(spark, d)
    averages = analytics.store_averages_at(_snapshots(obs), _cents(obs)).withColumn("avg_price", F.col("avg_price") / 100)
    t = analytics.trend(averages, 0, F.date_format("t", "yyyy"))
    return t.select(_day().alias("day"), "label", "you", "market", "cheapest")


def store_price_index(spark, d):
    return analytics.price_index(_cents(_products(spark, d))).select("store_id", "products", half_up(F.col("avg_price") / 100, 6).alias("avg_price"), "price_index")


def dashboard_kpis(spark, d):
    p = _products(spark, d).where("store_id <> 0")
    per = p.groupBy("store_id").agg(analytics.zero_average(F.col("price")).alias("a"), F.count_if(~F.col("available")).alias("out"), F.sum(F.coalesce("price", F.lit(0.0))).alias("s"), F.count("*").alias("n"))
    ends = analytics.extremes(per.select(F.concat(F.lit("store "), F.col("store_id")).alias("name"), "a"), "name", "a")
    total = per.agg(F.sum("out").alias("out_of_stock"), half_up(F.sum("s") / F.sum("n"), 6).alias("market_avg"))
    return total.join(ends)


def market_product_rollup(spark, d):
    r = analytics.rollup(_cents(_products(spark, d)))
    return r.select("product_id", "store_count", (F.col("min_price") / 100).alias("min_price"), (F.col("max_price") / 100).alias("max_price"), half_up(F.col("avg_price") / 100, 6).alias("avg_price"), F.array_join(F.transform("stores.store_id", lambda s: s.cast("string")), ",").alias("stores"))


def _priced(spark, d):
    code = F.element_at(F.array(*map(F.lit, CURRENCIES)), (F.col("store_id") % len(CURRENCIES) + 1).cast("int"))
    p = _products(spark, d).withColumn("currency", code).join(F.broadcast(tables.rates(spark, RATES)), "currency", "left")  # a fixed table
    return p.withColumn("usd", P.to_usd(F.col("price"), F.col("currency"), F.col("rate")))


def price_usd(spark, d):
    return _priced(spark, d).select("store_id", "product_id", "currency", "price", "usd")


def fx_gap(spark, d):
    p = _priced(spark, d)
    mine = p.where("store_id = 0").select("product_id", F.col("price").alias("p0"), F.col("usd").alias("u0"), F.col("currency").alias("c0"))
    pairs = p.where("store_id <> 0").join(mine, "product_id")
    same = F.col("currency").eqNullSafe(F.col("c0"))
    a, b = P.effective(F.col("u0"), F.col("p0"), same), P.effective(F.col("usd"), F.col("price"), same)
    return pairs.select("store_id", "product_id", a.alias("mine"), b.alias("theirs"), P.badge(a, b).alias("cheaper"), half_up(P.gap_percent(a, b), 1).alias("gap_pct"))


def price_history_tail(spark, d):
    newest = sinks.newest(_obs(spark, d), ["store_id", "product_id"], "t", ingest.HISTORY)
    h = newest.groupBy("store_id", "product_id").agg(F.array_sort(F.collect_list(F.struct("t", "price"))).alias("h"))
    return h.select("store_id", "product_id", F.explode(readpath.tail("h", 3)).alias("p")).select("store_id", "product_id", _day("p.t").alias("day"), "p.price")


def price_range(spark, d):
    h = observations(tables.by_product(read(spark, d, "lineitem"))).groupBy("store_id", "product_id")
    return h.agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("n"), F.max_by("price", "t").alias("last"))


def snapshot_retention(spark, d):
    months = _months(spark, d).select("store_id", "month").distinct()
    s = months.select(F.col("store_id").alias("origin"), F.col("month").alias("finished_at"), (F.col("month") % 12 == 0).alias("full"))
    return sinks.retained_snapshots(s)


def _events(spark, d):
    c = _changes(_obs(spark, d))
    kind = F.when(F.col("first").isNull(), "added").when(F.col("first") != F.col("price"), "price_changed").when(F.col("was_available") != F.col("available"), "stock_changed")
    return c.select(
        F.concat_ws("-", "store_id", "product_id", _day()).alias("event_id"), F.concat(F.lit("store"), F.col("store_id"), F.lit(".example")).alias("key"), kind.alias("type"),
        F.concat(F.lit("product "), F.col("product_id")).alias("name"), F.struct(F.col("first").alias("price"), F.col("was_available").alias("available")).alias("old"),
        F.struct("price", "available").alias("new"), F.col("t").alias("at"),
    ).where("type IS NOT NULL")


def alerts_feed(spark, d):
    a = alerts.render(_events(spark, d)).orderBy(F.desc("at"), "event_id").limit(200)
    return a.select("event_id", "competitor", _day("at").alias("day"), "type", "severity", "title", "detail", half_up(F.col("change_pct"), 1).alias("pct"))


def alert_counts(spark, d):
    return alerts.render(_events(spark, d)).groupBy("type", "severity").agg(F.count("*").alias("n"))


def alerts_undismissed(spark, d):
    events = _events(spark, d)
    mark = lambda k, v: F.when(F.col("event_id").endswith(k), F.lit(v))
    states = events.select("event_id", F.lit("u1").alias("user_id"), mark("-01", 1).alias("dismissed_at"), mark("-02", 1).alias("read_at")).where("dismissed_at IS NOT NULL OR read_at IS NOT NULL")
    return alerts.feed(events, states, F.lit("u1"), "price_drop").groupBy("severity", "read").agg(F.count("*").alias("n"))


def event_ttl(spark, d):
    kept = sinks.unexpired(_events(spark, d), "at", 90, F.lit("2001-12-01").cast("timestamp_ntz"))
    return kept.groupBy("type").agg(F.count("*").alias("n"))


def state_upsert(spark, d):
    """Stored products of the years before 2000, with those that four of the stores showed since in
    their place."""
    obs, keys = _obs(spark, d), ["store_id", "product_id"]
    old = analytics.latest(obs.where(F.year("t") < 2000), keys)
    new = analytics.latest(obs.where((F.year("t") >= 2000) & (F.col("store_id") < 4)), keys)
    return sinks.upsert(old, new, keys).select(*keys, _day().alias("day"), "price")


def crawl_totals(spark, d):
    m = _months(spark, d).groupBy("store_id", "month").agg(F.count("*").alias("products"), F.count_if(~F.col("available")).alias("failures"))
    s = m.select(F.col("store_id").alias("key"), F.col("month").alias("finished_at"), F.col("month").alias("snapshot_id"), "products", (F.col("products") * 2).alias("discovered"), "failures", (F.col("month") % 12 == 0).alias("full"))
    return metrics.crawl_totals(s)


def last_seen_text(spark, d):
    p = _products(spark, d).groupBy("store_id").agg(F.max("t").alias("t"))
    as_of = F.lit("2001-12-01 00:00:00").cast("timestamp_ntz")
    return p.select("store_id", times.since(F.col("t"), as_of).alias("seen"))


QUERIES = {f.__name__: f for f in (
    price_changes, stock_changes, crawl_diff_month, crawl_events, multi_store_events, multi_store_snapshots, biggest_movers, active_since_full, active_not_purged, price_asof_snapshot, market_trend,
    store_price_index, dashboard_kpis, market_product_rollup, price_usd, fx_gap, price_history_tail, price_range, snapshot_retention, alerts_feed, alert_counts,
    alerts_undismissed, event_ttl, state_upsert, crawl_totals, last_seen_text,
)}

_LAG = OBS + ", c AS (SELECT *, lag(price) OVER w AS first, lag(available) OVER w AS was_available FROM obs WINDOW w AS (PARTITION BY store_id, product_id ORDER BY t))"
_PRODUCTS = OBS + ", p AS (SELECT store_id, product_id, max(t) AS t, arg_max(price, t) AS price, arg_max(available, t) AS available FROM obs GROUP BY 1, 2)"
_AVGS = OBS + """,
snaps AS (SELECT DISTINCT store_id, date_trunc('year', t)::TIMESTAMP AS t FROM obs),
probes AS (SELECT s.store_id, s.t, k.product_id FROM snaps s JOIN (SELECT DISTINCT store_id, product_id FROM obs) k USING (store_id)),
avgs AS (SELECT p.store_id, p.t, avg(round(o.price * 100)) / 100 AS avg_price, count(*) AS n FROM probes p ASOF JOIN obs o
         ON p.store_id = o.store_id AND p.product_id = o.product_id AND p.t >= o.t WHERE o.price > 0 GROUP BY 1, 2)"""
_PRICED = _PRODUCTS + """, r(currency, rate) AS (VALUES ('AED', 3.6725::DOUBLE), ('OMR', 0.3845), ('SAR', 3.75), ('QAR', 3.64), ('KWD', 0.307), ('USD', 1.0)),
c AS (SELECT *, ['USD', 'AED', 'OMR', 'SAR', 'QAR', 'XXX', 'KWD', ''][store_id % 8 + 1] AS currency FROM p),
q AS (SELECT c.*, CASE WHEN price > 0 AND c.currency = 'USD' THEN price WHEN price > 0 AND rate > 0 THEN floor(price / rate * 100 + 0.5) / 100 END AS usd FROM c LEFT JOIN r USING (currency))"""
_EVENTS = _LAG + """, e AS (
  SELECT concat_ws('-', store_id, product_id, strftime(t, '%Y-%m-%d')) AS event_id, concat('store', store_id, '.example') AS key, concat('product ', product_id) AS name, t, first, price, was_available, available,
         CASE WHEN first IS NULL THEN 'added' WHEN first <> price THEN 'price_changed' WHEN was_available <> available THEN 'stock_changed' END AS kind FROM c),
a AS (SELECT *, CASE WHEN kind = 'added' THEN 'new_product' WHEN kind = 'price_changed' THEN CASE WHEN price < first THEN 'price_drop' ELSE 'price_rise' END ELSE 'stock' END AS type,
  CASE WHEN kind = 'price_changed' AND first <> 0 THEN (price - first) / abs(first) * 100 END AS raw_pct FROM e WHERE kind IS NOT NULL),
s AS (SELECT *, CASE WHEN kind = 'added' THEN 'low' WHEN kind = 'price_changed' THEN CASE WHEN abs(coalesce(raw_pct, 0)) >= 15 THEN 'high' WHEN abs(coalesce(raw_pct, 0)) >= 5 THEN 'medium' ELSE 'low' END
  WHEN available THEN 'low' ELSE 'medium' END AS severity FROM a)"""
_STORES = MONTHS + f""", b AS (SELECT store_id, product_id, max(month) AS month, arg_max(price, month) AS price, arg_max(available, month) AS available FROM months WHERE month < {MONTH} GROUP BY 1, 2),
n AS (SELECT * FROM months WHERE month = {MONTH}), f AS (SELECT DISTINCT store_id AS s, store_id % 2 = 0 AND store_id % 5 <> 4 AS ok FROM months),
a AS (SELECT store_id AS s, max(month) AS anchor FROM months WHERE month < {MONTH} AND (month + store_id) % 3 = 0 GROUP BY 1),
j AS (SELECT coalesce(b.store_id, n.store_id) AS s, coalesce(b.product_id, n.product_id) AS p, b.price AS op, n.price AS np, b.available AS oa, n.available AS na, b.month AS bm, n.month AS nm FROM b FULL JOIN n ON b.store_id = n.store_id AND b.product_id = n.product_id),
e AS (SELECT *, 'added' AS type FROM j WHERE bm IS NULL UNION ALL SELECT *, 'price_changed' FROM j WHERE bm IS NOT NULL AND nm IS NOT NULL AND op <> np UNION ALL SELECT *, 'stock_changed' FROM j WHERE bm IS NOT NULL AND nm IS NOT NULL AND oa <> na
  UNION ALL SELECT j.*, 'removed' FROM j JOIN f USING (s) LEFT JOIN a USING (s) WHERE nm IS NULL AND ok AND s IN (SELECT store_id FROM n) AND bm >= coalesce(anchor, 0))"""

ORACLES = {
    "price_changes": f"WITH {_LAG} SELECT store_id, product_id, strftime(t, '%Y-%m-%d') AS day, first, price AS latest, CASE WHEN first <> 0 THEN floor((price - first) / abs(first) * 100 * 10 + 0.5) / 10 END AS pct FROM c WHERE first <> price",
    "stock_changes": f"WITH {_LAG} SELECT store_id, product_id, strftime(t, '%Y-%m-%d') AS day, was_available, available FROM c WHERE was_available <> available",
    "crawl_diff_month": f"""WITH {MONTHS}, seen AS (SELECT month, count(*) FILTER (prev_month IS NULL) AS added, count(*) FILTER (prev_price <> price) AS price_changed, count(*) FILTER (prev_available <> available) AS stock_changed FROM hist GROUP BY 1),
      gone AS (SELECT month + 1 AS month, count(*) AS removed FROM hist WHERE coalesce(next_month > month + 1, true) AND month < (SELECT max(month) FROM months) GROUP BY 1)
      SELECT month, added, price_changed, stock_changed, coalesce(removed, 0) AS removed FROM seen LEFT JOIN gone USING (month)""",
    "crawl_events": f"""WITH {MONTHS}, b AS (SELECT store_id, product_id, max(month) AS month, arg_max(price, month) AS price, arg_max(available, month) AS available FROM months WHERE month < {MONTH} GROUP BY 1, 2),
      n AS (SELECT * FROM months WHERE month = {MONTH}), j AS (SELECT coalesce(b.store_id, n.store_id) AS s, coalesce(b.product_id, n.product_id) AS p, b.price AS op, n.price AS np, b.available AS oa, n.available AS na, b.month AS bm, n.month AS nm
      FROM b FULL JOIN n ON b.store_id = n.store_id AND b.product_id = n.product_id)
      SELECT s::VARCHAR AS origin, p::VARCHAR AS identity_key, type, op AS old_price, np AS new_price FROM (
        SELECT *, 'added' AS type FROM j WHERE bm IS NULL UNION ALL SELECT *, 'price_changed' FROM j WHERE bm IS NOT NULL AND nm IS NOT NULL AND op <> np
        UNION ALL SELECT *, 'stock_changed' FROM j WHERE bm IS NOT NULL AND nm IS NOT NULL AND oa <> na UNION ALL SELECT *, 'removed' FROM j WHERE nm IS NULL AND bm >= {MONTH - 1})""",
    "multi_store_events": f"WITH {_STORES} SELECT s::VARCHAR AS origin, p::VARCHAR AS identity_key, type, op AS old_price, np AS new_price, md5(s || '|{MONTH}') AS snapshot_id FROM e",
    "multi_store_snapshots": f"""WITH {_STORES}, c AS (SELECT s, count(*) FILTER (type = 'added') AS added, count(*) FILTER (type = 'removed') AS removed, count(*) FILTER (type = 'price_changed') AS price_changed, count(*) FILTER (type = 'stock_changed') AS stock_changed FROM e GROUP BY 1),
      k AS (SELECT store_id AS s, count(*) AS products FROM n GROUP BY 1)
      SELECT md5(f.s || '|{MONTH}') AS snapshot_id, f.s::VARCHAR AS origin, f.s::VARCHAR AS key, {MONTH}::BIGINT AS finished_at, f.ok AND k.s IS NOT NULL AS "full", coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(price_changed, 0) AS price_changed,
      coalesce(stock_changed, 0) AS stock_changed, 0::BIGINT AS renamed, coalesce(products, 0) AS products, coalesce(added + removed + price_changed + stock_changed, 0) > 0 AS rematch FROM f LEFT JOIN c USING (s) LEFT JOIN k USING (s)""",
    "biggest_movers": f"""WITH {_LAG}, n AS (SELECT * FROM c WHERE first <> price ORDER BY t DESC, store_id, product_id LIMIT 500)
      SELECT store_id, product_id, strftime(t, '%Y-%m-%d') AS day, first, price AS latest, floor((price - first) * 100 + 0.5) / 100 AS change FROM n ORDER BY abs(floor((price - first) * 100 + 0.5) / 100) DESC, day DESC, store_id, product_id LIMIT 20""",
    "active_since_full": f"WITH {MONTHS}, s AS (SELECT store_id, product_id, max(month) AS m FROM months GROUP BY 1, 2), a AS (SELECT store_id, max(m) AS anchor FROM s GROUP BY 1) SELECT store_id, count(*) AS active FROM s JOIN a USING (store_id) WHERE m >= anchor GROUP BY 1",
    "active_not_purged": f"WITH {_PRODUCTS} SELECT store_id, count(*) AS active FROM p GROUP BY 1",
    "price_asof_snapshot": f"WITH {_AVGS} SELECT store_id, strftime(t, '%Y-%m-%d') AS day, n, floor(avg_price * 1000000 + 0.5) / 1000000 AS avg_price FROM avgs",
    "market_trend": f"""WITH {_AVGS}, grid AS (SELECT e.t, h.store_id FROM (SELECT DISTINCT t FROM avgs) e, (SELECT DISTINCT store_id FROM avgs) h),
      k AS (SELECT g.t, g.store_id, a.avg_price FROM grid g ASOF JOIN avgs a ON g.store_id = a.store_id AND g.t >= a.t),
      pts AS (SELECT t, strftime(t, '%Y') AS label, floor(max(avg_price) FILTER (store_id = 0) * 100 + 0.5) / 100 AS you, floor(avg(avg_price) * 100 + 0.5) / 100 AS market, floor(min(avg_price) * 100 + 0.5) / 100 AS cheapest FROM k GROUP BY 1)
      SELECT strftime(t, '%Y-%m-%d') AS day, label, you, market, cheapest FROM (SELECT *, lead(label) OVER (ORDER BY t) AS nxt FROM pts) WHERE nxt IS DISTINCT FROM label""",
    "store_price_index": f"""WITH {_PRODUCTS}, s AS (SELECT store_id, count(*) AS products, avg(CASE WHEN price > 0 THEN round(price * 100) END) AS a FROM p GROUP BY 1)
      SELECT store_id, products, floor(a / 100 * 1000000 + 0.5) / 1000000 AS avg_price, CASE WHEN a IS NULL THEN 100 ELSE floor(a / (SELECT avg(a) FROM s) * 100 + 0.5) END::BIGINT AS price_index FROM s""",
    "dashboard_kpis": f"""WITH {_PRODUCTS}, s AS (SELECT 'store ' || store_id AS name, avg(coalesce(price, 0)) AS a FROM p WHERE store_id <> 0 GROUP BY 1)
      SELECT (SELECT count(*) FROM p WHERE store_id <> 0 AND NOT available) AS out_of_stock, (SELECT floor(sum(price) / count(*) * 1000000 + 0.5) / 1000000 FROM p WHERE store_id <> 0) AS market_avg,
      (SELECT name FROM s WHERE a > 0 ORDER BY a, name DESC LIMIT 1) AS cheapest, (SELECT name FROM s WHERE a > 0 ORDER BY a DESC, name DESC LIMIT 1) AS most_expensive""",
    "market_product_rollup": f"WITH {_PRODUCTS} SELECT product_id, count(DISTINCT store_id) AS store_count, min(price) AS min_price, max(price) AS max_price, floor(avg(round(price * 100)) / 100 * 1000000 + 0.5) / 1000000 AS avg_price, string_agg(store_id, ',' ORDER BY store_id) AS stores FROM p GROUP BY 1",
    "price_usd": f"WITH {_PRICED} SELECT store_id, product_id, currency, price, usd FROM q",
    "fx_gap": f"""WITH {_PRICED}, j AS (SELECT q.store_id, q.product_id, coalesce(CASE WHEN m.usd > 0 THEN m.usd END, CASE WHEN q.currency = m.currency AND m.price > 0 THEN m.price END) AS mine,
      coalesce(CASE WHEN q.usd > 0 THEN q.usd END, CASE WHEN q.currency = m.currency AND q.price > 0 THEN q.price END) AS theirs FROM q JOIN q m ON q.product_id = m.product_id AND m.store_id = 0 WHERE q.store_id <> 0)
      SELECT *, CASE WHEN mine < theirs THEN 'mine' WHEN mine > theirs THEN 'theirs' WHEN mine = theirs THEN 'equal' END AS cheaper, CASE WHEN mine <> 0 THEN floor(abs((theirs - mine) / mine) * 100 * 10 + 0.5) / 10 END AS gap_pct FROM j""",
    "price_history_tail": f"WITH {OBS} SELECT store_id, product_id, strftime(t, '%Y-%m-%d') AS day, price FROM obs QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY t DESC) <= 3",
    "price_range": f"WITH {OBS} SELECT store_id, product_id, min(price) AS low, max(price) AS high, count(*) AS n, arg_max(price, t) AS last FROM obs GROUP BY 1, 2",
    "snapshot_retention": f"""WITH {MONTHS}, s AS (SELECT DISTINCT store_id AS origin, month AS finished_at, month % 12 = 0 AS "full" FROM months)
      SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY origin ORDER BY finished_at DESC) <= 10 OR ("full" AND row_number() OVER (PARTITION BY origin, "full" ORDER BY finished_at DESC) = 1)""",
    "alerts_feed": f"""WITH {_EVENTS}, x AS (SELECT *, printf('%.1f', abs(raw_pct)) AS pt, printf('%.2f', first) AS o, printf('%.2f', price) AS n FROM s)
      SELECT event_id, key AS competitor, strftime(t, '%Y-%m-%d') AS day, type, severity,
      CASE type WHEN 'new_product' THEN 'New product' WHEN 'price_drop' THEN 'Price drop' WHEN 'price_rise' THEN 'Price rise' ELSE CASE WHEN available THEN 'Back in stock' ELSE 'Out of stock' END END || ' — ' || name AS title,
      CASE WHEN type = 'new_product' THEN key || ' added ' || name || ' to their catalogue.' WHEN kind = 'price_changed' THEN key || CASE WHEN type = 'price_drop' THEN ' dropped ' ELSE ' raised ' END || name || ' from ' || o || ' to ' || n
      || coalesce(' (' || CASE WHEN type = 'price_drop' THEN '−' ELSE '+' END || pt || '%)', '') || '.' ELSE name || CASE WHEN available THEN ' is back in stock' ELSE ' went out of stock' END || ' at ' || key || '.' END AS detail,
      floor(raw_pct * 10 + 0.5) / 10 AS pct FROM x ORDER BY t DESC, event_id LIMIT 200""",
    "alert_counts": f"WITH {_EVENTS} SELECT type, severity, count(*) AS n FROM s GROUP BY 1, 2",
    "alerts_undismissed": f"WITH {_EVENTS} SELECT severity, suffix(event_id, '-02') AS read, count(*) AS n FROM s WHERE type = 'price_drop' AND NOT suffix(event_id, '-01') GROUP BY 1, 2",
    "event_ttl": f"WITH {_EVENTS} SELECT kind AS type, count(*) AS n FROM s WHERE t >= TIMESTAMP '2001-12-01' - INTERVAL 90 DAY GROUP BY 1",
    "state_upsert": f"WITH {OBS} SELECT store_id, product_id, strftime(max(t), '%Y-%m-%d') AS day, arg_max(price, t) AS price FROM obs WHERE year(t) < 2000 OR store_id < 4 GROUP BY 1, 2",
    "crawl_totals": f"""WITH {MONTHS}, m AS (SELECT store_id, month, count(*) AS products, count(*) FILTER (NOT available) AS failures FROM months GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY month DESC) = 1 AS latest FROM m)
      SELECT (sum(products) FILTER (latest))::BIGINT AS products, (sum(products * 2) FILTER (latest))::BIGINT AS discovered, sum(failures)::BIGINT AS failures, count(*) FILTER (month % 12 <> 0) AS shallow, count(*) FILTER (month % 12 = 0) AS deep FROM l""",
    "last_seen_text": f"WITH {_PRODUCTS}, x AS (SELECT store_id, floor(epoch(TIMESTAMP '2001-12-01' - max(t)) / 86400)::BIGINT AS days FROM p GROUP BY 1) SELECT store_id, CASE WHEN days < 1 THEN 'just now' ELSE days || ' day' || CASE WHEN days > 1 THEN 's' ELSE '' END || ' ago' END AS seen FROM x",
}
