"""Market analytics: averages, indices, as-of prices, trends, movers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.numbers import half_up
from shelfscope.operators import readpath
from shelfscope.sources.stored import checkpointed


def known_average(price: Column) -> Column:
    """Average over positive prices."""
    return F.avg(F.when(price > 0, price))


def zero_average(price: Column) -> Column:
    """Average that counts unknown prices as zero."""
    return F.avg(F.coalesce(price, F.lit(0.0)))


def price_index(products: DataFrame, store: str = "store_id") -> DataFrame:
    """Each store's average against the mean of all stores' averages, 100 being level; stores without
    a price are at 100."""
    stores = products.groupBy(store).agg(F.count("*").alias("products"), known_average(F.col("price")).alias("avg_price"))
    market = F.avg("avg_price").over(Window.partitionBy(F.lit(1)))
    index = F.when((market > 0) & F.col("avg_price").isNotNull(), half_up(F.col("avg_price") / market * 100)).otherwise(F.lit(100))
    return stores.withColumn("price_index", index.cast("long"))


def latest(obs: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """The last row of each key, by aggregation without a sort."""
    rest = [c for c in obs.columns if c not in keys]
    return obs.groupBy(*keys).agg(F.max_by(F.struct(*rest), t).alias("v")).select(*keys, "v.*")


def as_of(probes: DataFrame, points: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """For each probe the last point at or before its time: one union, one sort by key and time."""
    both = probes.withColumn("_probe", F.lit(1)).unionByName(points.select(*keys, t, *values).withColumn("_probe", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(t, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    point = F.last(F.when(F.col("_probe") == 0, F.struct(*values)), ignorenulls=True).over(order)
    out = both.withColumn("_v", point).where("_probe = 1").drop("_probe")
    return out.drop(*values).select("*", *(F.col("_v")[v].alias(v) for v in values)).drop("_v")


def running(rows: DataFrame, key: str, part: Column, order: list[str], values: list[str]) -> DataFrame:
    """rows with the running sums of values in each key's order. part, rising with the order, cuts each
    key's rows: each part is summed by itself and goes on from the sums of those before it, so that a
    key with most of the rows is not in one task. Equal places in the order must not occur."""
    dealt = rows.withColumn("_part", part)
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", key).agg(*(F.sum(v).alias(v) for v in values))
    bases = totals.select("_part", key, *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    own = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *(F.sum(v).over(own).alias(f"_own_{v}") for v in values)).join(bases, ["_part", key])
    return out.select(*(c for c in rows.columns if c not in values), *((F.col(f"_own_{v}") + F.col(f"_{v}")).alias(v) for v in values))


def store_averages_at(snapshots: DataFrame, obs: DataFrame) -> DataFrame:
    """For each snapshot (store_id, t) the average of its products' last known positive prices, and of
    how many products; no row where there is none. A product has one price at a time, in whole units
    (cents), so that sums don't depend on the order of rows.

    Each price is a change of its store's sum and number of prices; the changes are summed in order of
    time, month by month, and each snapshot reads the sums at its time. No row is made for a snapshot and a product.
    """
    known = F.when(F.col("price") > 0, F.col("price"))
    before = F.lag(known).over(Window.partitionBy("store_id", "product_id").orderBy("t"))
    some = lambda c: F.when(c.isNull(), 0).otherwise(1)
    moves = obs.select("store_id", "t", (F.coalesce(known, F.lit(0)) - F.coalesce(before, F.lit(0))).alias("total"), (some(known) - some(before)).alias("n"))
    moves = moves.groupBy("store_id", "t").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("total <> 0 OR n <> 0")
    reads = snapshots.select("store_id", "t", F.lit(0).alias("total"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("read"))
    summed = running(moves.withColumn("read", F.lit(0)).unionByName(reads), "store_id", F.date_trunc("month", "t"), ["t", "read"], ["total", "n"])
    return summed.where("read = 1 AND n > 0").select("store_id", "t", (F.col("total") / F.col("n")).alias("avg_price"), "n")


def blocks(low: Column, high: Column, levels: int) -> Column:
    """The fewest aligned blocks (level, index) of 2 ** level places each that make up [low, high]."""
    node = "struct<level:int,index:bigint>"
    start = F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.array().cast(f"array<{node}>").alias("nodes"))

    def step(acc: Column, level: Column) -> Column:
        odd = (acc["low"] <= acc["high"]) & (acc["low"] % 2 == 1)
        left = acc["low"] + odd.cast("long")
        even = (left <= acc["high"]) & (acc["high"] % 2 == 0)
        right = acc["high"] - even.cast("long")
        one = lambda wanted, index: F.when(wanted, F.array(F.struct(level.alias("level"), index.alias("index")))).otherwise(F.array().cast(f"array<{node}>"))
        rest = left <= right  # else nothing is left on higher levels
        low, high = F.when(rest, F.shiftright(left, 1)).otherwise(1), F.when(rest, F.shiftright(right, 1)).otherwise(0)
        return F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"), F.concat(acc["nodes"], one(odd, acc["low"]), one(even, acc["high"])).alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["nodes"])


def trend(averages: DataFrame, mine: int, label: Column) -> DataFrame:
    """Carries each store's last average forward over all snapshots: market mean, cheapest and mine at
    the last snapshot of each label, neighbouring snapshots of one label being one.

    A store's average holds from its snapshot to the store's next one. That stretch of the distinct
    times is cut into aligned blocks, of which there are few however long it is; a time then needs
    only the blocks that it lies in. So no row is made for each store and time.
    """
    averages = checkpointed(averages)
    times = checkpointed(readpath.numbered(averages.select("t").distinct(), ["t"]).withColumn("label", label))
    last = times.count() - 1
    levels = max(0, last).bit_length()
    later = times.select((F.col("rn") - 1).alias("rn"), F.col("label").alias("_next"))
    ends = times.join(later, "rn", "left").where(~F.col("label").eqNullSafe(F.col("_next")) | (F.col("rn") == last)).drop("_next")
    placed = averages.join(times.select("t", "rn"), "t")
    until = F.coalesce(F.lead("rn").over(Window.partitionBy("store_id").orderBy("rn")) - 1, F.lit(last))
    held = placed.withColumn("until", until).withColumn("node", F.explode(blocks(F.col("rn"), F.col("until"), levels)))
    own = F.when(F.col("store_id") == mine, F.col("avg_price"))
    nodes = held.groupBy("node").agg(F.sum("avg_price").alias("total"), F.count("*").alias("n"), F.min("avg_price").alias("least"), F.max(own).alias("own"))
    above = ends.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    reads = above.select("t", "label", F.struct("level", F.expr("shiftright(rn, level)").alias("index")).alias("node"))
    return reads.join(nodes, "node").groupBy("t", "label").agg(
        half_up(F.max("own"), 2).alias("you"),
        half_up(F.sum("total") / F.sum("n"), 2).alias("market"),
        half_up(F.min("least"), 2).alias("cheapest"),
    )


def movers(changes: DataFrame, newest: int = 500, ties: tuple[str, ...] = ("store_id", "product_id")) -> DataFrame:
    """The newest price changes, largest first; changes without both prices go only afterwards."""
    recent = changes.orderBy(F.desc("t"), *ties).limit(newest)
    return recent.where("first IS NOT NULL AND latest IS NOT NULL").withColumn("change", F.col("latest") - F.col("first"))


def extremes(averages: DataFrame, name: str, value: str) -> DataFrame:
    """Names of the least and greatest positive value; of equals the last by name."""
    some = averages.where(F.col(value) > 0)
    return some.agg(F.max_by(name, F.struct(-F.col(value), F.col(name))).alias("cheapest"), F.max_by(name, F.struct(F.col(value), F.col(name))).alias("most_expensive"))


def rollup(products: DataFrame, key: str = "product_id", store: str = "store_id") -> DataFrame:
    """One row for each product over all stores."""
    return products.groupBy(key).agg(
        F.count_distinct(store).alias("store_count"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.avg("price").alias("avg_price"),
        F.array_sort(F.collect_list(F.struct(store, "price"))).alias("stores"),
    )


def matching_kpis(matches: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Matched, only-you and only-they counts, match rate in per cent, and the mean price gap over
    pairs with both prices. matches: mine_id, theirs_id, mine_price, theirs_price."""
    both = (F.col("mine_price") > 0) & (F.col("theirs_price") > 0)
    m = matches.agg(F.count_distinct("mine_id").alias("matched"), F.count_distinct("theirs_id").alias("matched_theirs"), F.avg(F.when(both, F.col("theirs_price") - F.col("mine_price"))).alias("gap"))
    n = mine.agg(F.count("*").alias("n_mine")).join(theirs.agg(F.count("*").alias("n_theirs")))
    out = m.join(n)
    return out.select(
        "matched",
        (F.col("n_mine") - F.col("matched")).alias("only_you"),
        (F.col("n_theirs") - F.col("matched_theirs")).alias("only_they"),
        F.when(F.col("n_mine") > 0, half_up(F.col("matched") / F.col("n_mine") * 100)).otherwise(F.lit(0)).alias("match_rate"),
        half_up(F.col("gap"), 2).alias("avg_price_gap"),
    )


def competitors(stores: DataFrame, snapshots: DataFrame, manual: DataFrame, products: DataFrame, my_host: str | None, my_origin: str | None = None) -> DataFrame:
    """The competitor list: crawled stores with their last crawl, then manual stores and, with
    my_origin, the own one that have not been crawled, by number of products, most first.

    stores: host, origin; snapshots: host, finished_at, fetched; manual: host, name, origin; products:
    host, price, available. The dimension tables have a row for each store.
    """
    last = latest(snapshots.select("host", "finished_at", "fetched"), ["host"], "finished_at")
    counted = products.groupBy("host").agg(F.count("*").alias("products"), F.count_if(~F.col("available")).alias("out_of_stock"), known_average(F.col("price")).alias("avg_price"))
    mine = F.coalesce(F.col("host") == F.lit(my_host), F.lit(False))
    named = manual.select("host", F.col("name").alias("manual_name"))
    crawled = stores.join(last, "host", "left").join(named, "host", "left").join(counted, "host", "left")
    crawled = crawled.select(
        "host",
        F.coalesce("manual_name", "host").alias("name"),
        "origin",
        (F.col("manual_name").isNotNull() & ~mine).alias("manual"),
        mine.alias("is_mine"),
        F.when(F.coalesce("fetched", F.lit(0)) > 0, "active").otherwise("error").alias("status"),
        F.coalesce("products", F.lit(0)).alias("products"),
        F.coalesce("out_of_stock", F.lit(0)).alias("out_of_stock"),
        "avg_price",
    )
    waiting = manual.join(stores.select("host"), "host", "left_anti")
    waiting = waiting.select("host", "name", "origin", F.lit(True).alias("manual"), F.lit(False).alias("is_mine"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("products"), F.lit(0).cast("long").alias("out_of_stock"), F.lit(None).cast("double").alias("avg_price"))
    out = crawled.unionByName(waiting)
    if my_host is not None and my_origin is not None:
        own = stores.sparkSession.createDataFrame([(my_host, my_host, my_origin)], "host string, name string, origin string")
        own = own.join(out.select("host"), "host", "left_anti")
        rest = {"manual": F.lit(False), "is_mine": F.lit(True), "status": F.lit("pending"), "products": F.lit(0).cast("long"), "out_of_stock": F.lit(0).cast("long"), "avg_price": F.lit(None).cast("double")}
        out = out.unionByName(own.withColumns(rest))
    return out.orderBy(F.desc("products"), "host")


def gap_order(gaps: DataFrame, gap: str, name: str, largest: bool = True) -> DataFrame:
    """Category and brand gaps largest first, price gaps smallest first; unknown ones last."""
    return gaps.orderBy(F.col(gap).desc_nulls_last() if largest else F.col(gap).asc_nulls_last(), name)


def row_class(rows: DataFrame, kind: str, threshold: int = 90) -> DataFrame:
    """Rows of a compared catalogue (mine, theirs prices and confidence) of one class: cheaper (theirs
    is), missing (no match), low-confidence; any other kind is all of them."""
    both = F.col("mine").isNotNull() & F.col("theirs").isNotNull()
    wanted = {"cheaper": both & (F.col("theirs") < F.col("mine")), "missing": F.col("confidence").isNull(), "low-confidence": F.col("confidence") < threshold}
    return rows.where(wanted[kind]) if kind in wanted else rows


def client_diff(log: DataFrame, most: int | None = None) -> DataFrame:
    """Of each origin's change log: names added and removed, in order (the first `most`), and how many
    prices changed."""
    listed = lambda t: F.array_sort(F.collect_list(F.when(F.col("type") == t, F.col("name"))))
    cut = (lambda c: F.slice(c, 1, most)) if most else (lambda c: c)
    return log.groupBy("origin").agg(cut(listed("added")).alias("added"), cut(listed("removed")).alias("removed"), F.count_if(F.col("type") == "price_changed").alias("price_changed"))
