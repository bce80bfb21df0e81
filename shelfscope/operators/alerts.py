"""Change events as alerts, and each user's view of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.numbers import fixed
from shelfscope.functions.prices import MINUS, change_percent, change_severity

#: Alert filters a user can choose, as predicates over events; any other shows all.
FILTERS = {
    "new_product": lambda: F.col("type") == "added",
    "removed": lambda: F.col("type") == "removed",
    "stock": lambda: F.col("type") == "stock_changed",
    "price_drop": lambda: (F.col("type") == "price_changed") & (F.col("new.price") < F.col("old.price")),
    "price_rise": lambda: (F.col("type") == "price_changed") & (F.col("new.price") > F.col("old.price")),
}


def chosen(events: DataFrame, kind: str) -> DataFrame:
    return events.where(FILTERS[kind]()) if kind in FILTERS else events


def render(events: DataFrame) -> DataFrame:
    """Events to alerts; events without what an alert needs are left out."""
    old, new, was, now = F.col("old.price"), F.col("new.price"), F.col("old.available"), F.col("new.available")
    kind, name, key = F.col("type"), F.coalesce(F.nullif("name", F.lit("")), F.lit("a product")), F.col("key")
    pct, drop = change_percent(old, new), new < old
    moved, stock = (kind == "price_changed") & (old != new), (kind == "stock_changed") & now.isNotNull()
    alert = (
        F.when(kind == "added", "new_product").when(kind == "removed", "removed").when(moved, F.when(drop, "price_drop").otherwise("price_rise")).when(stock, "stock")
    )
    severity = F.when(kind == "added", "low").when(kind == "removed", "high").when(moved, change_severity(pct)).when(stock, F.when(now, "low").otherwise("medium"))
    head = (
        F.when(kind == "added", "New product").when(kind == "removed", "Product removed").when(moved, F.when(drop, "Price drop").otherwise("Price rise")).when(stock, F.when(now, "Back in stock").otherwise("Out of stock"))
    )
    sign = F.when(drop, MINUS).otherwise("+")
    share = F.coalesce(F.concat(F.lit(" ("), sign, fixed(F.abs(pct), 1), F.lit("%)")), F.lit(""))
    detail = (
        F.when(kind == "added", F.concat(key, F.lit(" added "), name, F.lit(" to their catalogue.")))
        .when(kind == "removed", F.concat(name, F.lit(" is no longer listed at "), key, F.lit(".")))
        .when(moved, F.concat(key, F.when(drop, " dropped ").otherwise(" raised "), name, F.lit(" from "), fixed(old, 2), F.lit(" to "), fixed(new, 2), share, F.lit(".")))
        .when(stock, F.concat(name, F.when(now, " is back in stock").otherwise(" went out of stock"), F.lit(" at "), key, F.lit(".")))
    )
    rows = events.withColumn("alert", alert).where("alert IS NOT NULL")
    return rows.select(
        "event_id", key.alias("competitor"), "at", F.col("alert").alias("type"), severity.alias("severity"), F.concat(head, F.lit(" — "), name).alias("title"), detail.alias("detail"),
        F.when(moved, pct).alias("change_pct"), F.when(moved, new - old).alias("change_amount"),
    )


def feed(events: DataFrame, states: DataFrame, user: Column, kind: str = "all") -> DataFrame:
    """A user's alerts: without those dismissed, with a read mark. Order and page them afterwards."""
    own = states.where(F.col("user_id") == user)
    shown = chosen(events, kind).join(own.where("dismissed_at IS NOT NULL").select("event_id"), "event_id", "left_anti")
    read = own.where("read_at IS NOT NULL").select("event_id", F.lit(True).alias("read"))
    return render(shown).join(read, "event_id", "left").withColumn("read", F.coalesce("read", F.lit(False)))


def unread(events: DataFrame, states: DataFrame, user: Column) -> DataFrame:
    """Events less the user's read or dismissed ones, as one count."""
    own = states.where((F.col("user_id") == user) & (F.col("read_at").isNotNull() | F.col("dismissed_at").isNotNull()))
    return events.agg(F.count("*").alias("n")).join(own.agg(F.count_distinct("event_id").alias("seen"))).select((F.col("n") - F.col("seen")).alias("unread"))
