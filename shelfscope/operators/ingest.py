"""A finished crawl against the stored state: change log, new state, snapshot.

Times come in as arguments. A crawl's rows are normalised and, where an identity key repeats, only
the first row counts. A batch may hold crawls of several origins: facts() tells for each when it
ended, whether it is full, and when the last full crawl before it ended (its anchor). Stored products
of other origins take no part. Removals are only read off full crawls that found products, and of
products seen since the anchor, so that each is reported once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import names, prices, urls

HISTORY = 90
EPOCH = "1970-01-01T00:00:00Z"


def guarded(raw: DataFrame) -> DataFrame:
    """Without rows whose URL is a page of another kind and that have no code of their own."""
    return raw.where(names.matchable(F.col("gtin"), F.col("sku"), F.col("url")))


def normalised(raw: DataFrame, rates: DataFrame) -> DataFrame:
    """Raw rows (with `ord`, their order) to keyed product rows, the first of each key."""
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "brand", "url")}
    currency = F.nullif(F.upper(F.trim(F.col("currency"))), F.lit(""))
    rows = guarded(raw).select(
        "origin",
        urls.host_key(F.col("origin")).alias("key"),
        names.identity_key(F.col("gtin"), F.col("sku"), F.col("url"), F.col("name")).alias("identity_key"),
        *(c.alias(n) for n, c in text.items()),
        F.col("price").cast("double").alias("price"),
        currency.alias("currency"),
        F.coalesce("available", F.lit(True)).alias("available"),
        F.nullif(names.gtin(F.col("gtin")), F.lit("")).alias("gtin"),
        F.nullif(names.sku(F.col("sku")), F.lit("")).alias("sku"),
        F.nullif(urls.slug(F.col("url")), F.lit("")).alias("slug"),
        names.tokens(F.col("name")).alias("tokens"),
        names.trigrams(F.col("name")).alias("trigrams"),
        "ord",
    )
    first = Window.partitionBy("origin", "identity_key").orderBy("ord")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "ord")
    rows = rows.join(rates, "currency", "left")
    return rows.withColumn("price_usd", prices.to_usd(F.col("price"), F.col("currency"), F.col("rate"))).drop("rate")


def facts(crawls: DataFrame, crawl: DataFrame, snapshots: DataFrame, start: Column | None = None) -> DataFrame:
    """(origin, at, full, anchor), a row for each origin crawled. crawls: origin, at, full_crawl,
    capped; snapshots: the earlier ones. Without a full one before, the anchor is `start`."""
    since = snapshots.where("full").groupBy("origin").agg(F.max("finished_at").alias("anchor"))
    rows = crawl.groupBy("origin").agg(F.lit(True).alias("some"))
    full = F.coalesce("full_crawl", F.lit(True)) & ~F.coalesce("capped", F.lit(False)) & F.col("some").isNotNull()
    first = F.timestamp_seconds(F.lit(0)) if start is None else start
    return crawls.join(rows, "origin", "left").join(since, "origin", "left").select("origin", "at", full.alias("full"), F.coalesce("anchor", first).alias("anchor"))


def compared_by_origin(state: DataFrame, crawl: DataFrame, facts: DataFrame) -> DataFrame:
    """compared() of the origins in facts alone, with their facts beside it."""
    own = state.join(facts.select("origin"), "origin", "left_semi")
    return compared(own, crawl).join(facts, "origin")


def snapshot_id(origin: Column, at: Column) -> Column:
    """The id of the snapshot of an origin's crawl; its events carry it from the start."""
    return F.md5(F.concat_ws("|", origin, at.cast("string")))


def stamped(log: DataFrame) -> DataFrame:
    return log.withColumn("snapshot_id", snapshot_id(F.col("origin"), F.col("at")))


def snapshots_of(both: DataFrame, log: DataFrame, facts: DataFrame) -> DataFrame:
    """The snapshot row of each origin crawled, from compared_by_origin() and its change log."""
    types = ("added", "removed", "price_changed", "stock_changed")
    counts = log.groupBy("origin").agg(*(F.count_if(F.col("type") == t).alias(t) for t in types))
    seen = both.groupBy("origin").agg(
        F.count_if(F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("now.name") != F.col("was.name"))).alias("renamed"), F.count_if(F.col("now").isNotNull()).alias("products")
    )
    rows = facts.join(counts, "origin", "left").join(seen, "origin", "left")
    numbers = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*types, "renamed", "products"))
    return rows.select(snapshot_id(F.col("origin"), F.col("at")).alias("snapshot_id"), "origin", urls.host_key(F.col("origin")).alias("key"), F.col("at").alias("finished_at"), "full", *numbers)


def changed(snapshots: DataFrame) -> DataFrame:
    """The origins whose crawl changed anything: those whose matches have to be formed anew."""
    return snapshots.where("added + removed + price_changed + stock_changed + renamed > 0").select("origin")


def compared(state: DataFrame, crawl: DataFrame) -> DataFrame:
    """State and crawl side by side: structs `was` and `now`, either null."""
    keys = ["origin", "identity_key"]
    was = state.select(*keys, F.struct(*state.columns).alias("was"))
    now = crawl.select(*keys, F.struct(*crawl.columns).alias("now"))
    return was.join(now, keys, "full_outer")


def price_moved(now: Column, was: Column) -> Column:
    """A price that was read and differs; zero is a price, null is none."""
    return now.isNotNull() & ~now.eqNullSafe(was)


def events(both: DataFrame, at: Column, anchor: Column, full: bool | Column) -> DataFrame:
    """The change log of a crawl. anchor: when the last full crawl before it ended."""
    point = {side: F.when(F.col(side).isNotNull(), F.struct(F.col(f"{side}.price").alias("price"), F.col(f"{side}.available").alias("available"))) for side in ("was", "now")}
    new, gone = F.col("was").isNull(), F.col("now").isNull() & F.lit(full) & (F.col("was.last_seen_at") >= anchor)
    kept = F.col("was").isNotNull() & F.col("now").isNotNull()
    types = F.array_compact(
        F.array(
            F.when(new, "added"),
            F.when(kept & price_moved(F.col("now.price"), F.col("was.price")), "price_changed"),
            F.when(kept & (F.col("now.available") != F.col("was.available")), "stock_changed"),
            F.when(gone, "removed"),
        )
    )
    rows = both.select("*", F.explode(types).alias("type"))
    shown = F.coalesce("now", F.struct(*(F.col(f"was.{f}").alias(f) for f in rows.schema["now"].dataType.names)))
    return rows.select("origin", shown["key"].alias("key"), "identity_key", "type", shown["name"].alias("name"), shown["url"].alias("url"), point["was"].alias("old"), point["now"].alias("new"), at.alias("at"))


def next_state(both: DataFrame, at: Column, history: int = HISTORY) -> DataFrame:
    """The stored products after a crawl: new rows whole, known rows only in what a crawl refreshes."""
    now, was = (lambda f: F.col(f"now.{f}")), (lambda f: F.col(f"was.{f}"))
    seen, known = F.col("now").isNotNull(), F.col("was").isNotNull()
    moved = price_moved(now("price"), was("price"))
    changed = seen & known & (moved | (now("available") != was("available")))
    point = F.array(F.struct(at.cast("timestamp").alias("t"), now("price").alias("price"), now("available").alias("available")))
    empty = F.expr("CAST(array() AS array<struct<t:timestamp,price:double,available:boolean>>)")
    longer = F.concat(F.coalesce(was("price_history"), empty), point)
    kept = F.slice(longer, F.greatest(F.size(longer) - history, F.lit(0)) + 1, history)
    priced = now("price").isNotNull()

    def refreshed(f: str) -> Column:
        return F.when(seen, F.coalesce(now(f), was(f))).otherwise(was(f)).alias(f)

    def first(f: str) -> Column:
        return F.when(known, was(f)).otherwise(now(f)).alias(f)

    return both.select(
        "origin",
        first("key"),
        "identity_key",
        refreshed("name"),
        refreshed("brand"),
        F.when(seen & (~known | (changed & priced)), now("price")).otherwise(was("price")).alias("price"),
        refreshed("currency"),
        refreshed("price_usd"),
        refreshed("available"),
        *(first(f) for f in ("url", "gtin", "sku", "slug")),
        F.when(seen & (~known | (now("name") != was("name"))), now("tokens")).otherwise(was("tokens")).alias("tokens"),
        F.when(seen & (~known | (now("name") != was("name"))), now("trigrams")).otherwise(was("trigrams")).alias("trigrams"),
        F.when(known, was("first_seen_at")).otherwise(at).alias("first_seen_at"),
        F.when(seen, at).otherwise(was("last_seen_at")).alias("last_seen_at"),
        F.when(changed, at).otherwise(was("price_updated_at")).alias("price_updated_at"),
        F.when(~known & priced, point).when(~known, empty).when(changed & priced, kept).otherwise(was("price_history")).alias("price_history"),
    )


def counters(log: DataFrame, both: DataFrame) -> DataFrame:
    """One row of counts: added, removed, price_changed, stock_changed, renamed."""
    counts = log.agg(*(F.count_if(F.col("type") == t).alias(t) for t in ("added", "removed", "price_changed", "stock_changed")))
    renamed = both.agg(F.count_if(F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("now.name") != F.col("was.name"))).alias("renamed"))
    return counts.join(renamed)


def is_full(full_crawl: bool, capped: bool, rows: int) -> bool:
    """Whether a crawl stands for the whole store."""
    return full_crawl and not capped and rows > 0


def anchor(snapshots: DataFrame, at: str = "finished_at") -> DataFrame:
    """When the last full crawl of each origin ended."""
    return snapshots.where("full").groupBy("origin").agg(F.max(at).alias("anchor"))


def active(products: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """With snapshots: products seen since their origin's last full crawl. Without: all not purged."""
    if snapshots is None:
        return products.where(F.col("last_seen_at") > F.timestamp_seconds(F.lit(0)))
    since = products.join(anchor(snapshots), "origin", "left")
    return since.where(F.col("last_seen_at") >= F.coalesce("anchor", F.timestamp_seconds(F.lit(0)))).drop("anchor")


def with_vocabulary(products: DataFrame) -> DataFrame:
    """Fills the word and trigram lists of rows that lack them."""
    out = products
    for c, make in (("tokens", names.tokens), ("trigrams", names.trigrams)):
        out = out.withColumn(c, F.when(F.col(c).isNull() | (F.size(c) == 0), make(F.col("name"))).otherwise(F.col(c)))
    return out


def history_changes(months: DataFrame) -> DataFrame:
    """Changes between consecutive crawls of a product, from its history alone: one row for each
    crawl that saw it, with the values before."""
    order = Window.partitionBy("store_id", "product_id").orderBy("month")
    return months.select("*", *(F.lag(c).over(order).alias(f"prev_{c}") for c in ("month", "price", "available")), F.lead("month").over(order).alias("next_month"))
