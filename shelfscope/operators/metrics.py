"""Job metrics, schedules and state changes of jobs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions.numbers import half_up, percent
from shelfscope.functions.times import backoff_ms, millis

STATUSES = ("queued", "claimed", "retrying", "done", "failed", "dead", "cancelled")
FINISHED = ("done", "failed", "dead", "cancelled")


def duration_ms() -> Column:
    ms = millis(F.col("finished_at")) - millis(F.col("started_at"))
    return F.when(ms >= 0, ms)


def placed(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column], width: int = 4096) -> DataFrame:
    """by and, for each name of ranks, the value at that place (from 0, in terms of n, the number of
    values) of the group's values in order; null places give null. Values are whole numbers, not null.

    First values are counted in ranges of `width`, then one by one in the ranges alone in which a place
    lies. So no task holds a group's values, only counts: of its ranges, and of the values in one range.
    """
    rows = rows.select(*by, F.col(value).cast("long").alias("_v")).withColumn("_range", F.floor(F.col("_v") / width))
    same = lambda a, b, cols: reduce(and_, (a[c].eqNullSafe(b[c]) for c in cols), F.lit(True))

    def counted(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        """With _upto, the number of values up to and with each of them in order."""
        upto = Window.partitionBy(F.lit(1), *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.groupBy(*keys, order).agg(F.count("*").alias("_k")).withColumn("_upto", F.sum("_k").over(upto))

    ranges = counted(rows, by, "_range").withColumn("n", F.sum("_k").over(Window.partitionBy(F.lit(1), *by)))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in ranks.items())))
    hits = ranges.withColumn("_w", wanted).where("_w.place >= _upto - _k AND _w.place < _upto")
    hits = hits.select(*by, "_range", "_w.name", (F.col("_w.place") - (F.col("_upto") - F.col("_k"))).alias("_place"))
    few = hits.select(*by, "_range").distinct()
    values = counted(rows.join(few, same(rows, few, [*by, "_range"]), "left_semi"), [*by, "_range"], "_v")
    found = values.join(hits, same(values, hits, [*by, "_range"])).where("_place >= _upto - _k AND _place < _upto")
    return found.select(*(values[c] for c in by), "name", "_v").groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks))


def window_summary(jobs: DataFrame, since: Column, *by: str) -> DataFrame:
    """Counts, rates and durations of jobs finished since a time. Median is the mean of the middle
    two, p95 the value at the nearest rank above."""
    rows = jobs.where(F.col("status").isin(*FINISHED) & (F.col("finished_at") >= since)).withColumn("ms", duration_ms())
    bad = F.col("status").isin("failed", "dead")
    n, done = F.count("*"), F.count_if(F.col("status") == "done")
    told = rows.groupBy(*by).agg(
        n.alias("total"),
        *(F.count_if(F.col("status") == s).alias(s) for s in FINISHED),
        F.count_if(F.col("type") == "shallow").alias("shallow"),
        F.count_if(~F.coalesce(F.col("type") == "shallow", F.lit(False))).alias("deep"),
        percent(done, n).alias("success_rate"),
        percent(F.count_if(bad), n).alias("failure_rate"),
        F.count("ms").alias("timed"),
        half_up(F.avg("ms")).alias("avg_ms"),
        half_up(F.avg(F.when(bad, F.col("ms")))).alias("failed_avg_ms"),
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
    )
    places = {"_low": F.expr("(n - 1) div 2"), "_high": F.expr("n div 2"), "p95_ms": F.expr("(95 * n + 99) div 100 - 1")}
    at = placed(rows.where("ms IS NOT NULL"), list(by), "ms", places).withColumn("median_ms", (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")
    at = at.withColumnsRenamed({c: f"_{c}" for c in by})
    return told.join(at, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True)), "left").drop(*(f"_{c}" for c in by))


def queue_depth(jobs: DataFrame) -> DataFrame:
    """One row: the number of jobs in each state, and those in flight."""
    counts = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    return jobs.agg(*(c.alias(s) for s, c in counts.items()), (counts["queued"] + counts["claimed"] + counts["retrying"]).alias("in_flight"))


def liveness(jobs: DataFrame, as_of: Column, timeout_ms: int = 60_000) -> DataFrame:
    """Workers with claimed jobs: alive if any heartbeat is fresh, and how many are stale."""
    fresh = F.coalesce(millis(as_of) - millis(F.col("heartbeat_at")) <= timeout_ms, F.lit(False))
    claimed = jobs.where("status = 'claimed' AND worker_id IS NOT NULL").withColumn("fresh", fresh)
    return claimed.groupBy("worker_id").agg(F.bool_or("fresh").alias("alive"), F.count("*").alias("jobs"), F.count_if(~F.col("fresh")).alias("stale"), F.array_sort(F.collect_list("job_id")).alias("job_ids"))


def released(jobs: DataFrame, as_of: Column, timeout_ms: int = 60_000, most_ms: int = 6 * 3_600_000, attempts: int = 3) -> DataFrame:
    """Claimed jobs whose heartbeat stopped or that ran too long go back to the queue with a waiting
    time, or are given up after the last attempt."""
    silent = millis(as_of) - millis(F.coalesce("heartbeat_at", "started_at")) > timeout_ms
    stale = (F.col("status") == "claimed") & F.coalesce(silent | (millis(as_of) - millis(F.col("started_at")) > most_ms), F.lit(False))
    status = F.when(stale & (F.col("attempts") >= attempts), "dead").when(stale, "retrying").otherwise(F.col("status"))
    again = F.when(stale & (F.col("attempts") < attempts), F.timestamp_millis(millis(as_of) + backoff_ms(F.col("attempts"))))
    return jobs.withColumn("stale", stale).withColumn("status", status).withColumn("scheduled_at", F.coalesce(again, "scheduled_at"))


def next_claims(jobs: DataFrame, as_of: Column, n: int = 1) -> DataFrame:
    """The due jobs that come first."""
    due = jobs.where(F.col("status").isin("queued", "retrying") & (F.col("scheduled_at") <= as_of))
    return due.orderBy("scheduled_at", "job_id").limit(n)


def recent(jobs: DataFrame, as_of: Column, active: int = 50, finished: int = 15, within_ms: int = 900_000) -> DataFrame:
    """The newest active jobs, then the newest that finished a short while ago."""
    going = jobs.where(~F.col("status").isin(*FINISHED)).orderBy(F.desc("scheduled_at"), "job_id").limit(active)
    ended = jobs.where(F.col("status").isin(*FINISHED) & (millis(as_of) - millis(F.col("finished_at")) <= within_ms))
    return going.unionByName(ended.orderBy(F.desc("finished_at"), "job_id").limit(finished))


# Hours between the crawls of each frequency; a deep crawl waits 6 at least.
EVERY_H = {"hourly": 1, "daily": 24, "weekly": 168}
DEEP_H = 6


def due(stores: DataFrame, active: DataFrame, as_of: Column) -> DataFrame:
    """Stores to crawl now. stores: store_id, frequency, last_deep_at, last_shallow_at; active: the
    store_id of jobs under way."""
    hours = F.lit(None).cast("int")
    for name, n in EVERY_H.items():
        hours = F.when(F.col("frequency") == name, n).otherwise(hours)
    waited = lambda c: (millis(as_of) - millis(F.col(c))) / 3_600_000.0
    deep = F.col("last_deep_at").isNull() | (waited("last_deep_at") >= F.greatest(hours, F.lit(DEEP_H)))
    shallow = waited("last_shallow_at").isNull() | (waited("last_shallow_at") >= hours)
    free = stores.join(active.select("store_id"), "store_id", "left_anti").where(hours.isNotNull())
    return free.select("store_id", F.when(deep, "deep").when(shallow, "shallow").alias("due")).where("due IS NOT NULL")


def miss_streaks(runs: DataFrame, key: str, order: str, ok: str, limit: int = 25) -> DataFrame:
    """Longest run of misses without a success between, and whether it reached the limit."""
    by = Window.partitionBy(key).orderBy(order)
    island = F.sum(F.col(ok).cast("int")).over(by)
    streaks = runs.withColumn("island", island).where(~F.col(ok)).groupBy(key, "island").agg(F.count("*").alias("misses"))
    return streaks.groupBy(key).agg(F.max("misses").alias("longest")).withColumn("tripped", F.col("longest") >= limit)


def store_order(snapshots: DataFrame) -> DataFrame:
    """Snapshots with the time of their store's newest one, to order store groups by."""
    return snapshots.withColumn("newest", F.max("finished_at").over(Window.partitionBy("key")))


def crawl_totals(snapshots: DataFrame) -> DataFrame:
    """Products and discovered URLs over the latest snapshot of each store, failures over all."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("finished_at"), "snapshot_id"))
    rows = snapshots.withColumn("latest", nth == 1)
    return rows.agg(
        F.coalesce(F.sum(F.when(F.col("latest"), F.col("products"))), F.lit(0)).alias("products"),
        F.coalesce(F.sum(F.when(F.col("latest"), F.col("discovered"))), F.lit(0)).alias("discovered"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"),
        F.count_if(F.col("full") == F.lit(False)).alias("shallow"),
        F.count_if(~F.col("full").eqNullSafe(F.lit(False))).alias("deep"),
    )


def parse_rate(products: Column, fetched: Column) -> Column:
    return F.when(fetched > 0, half_up(products / fetched * 100))


def failure_split(failures: DataFrame) -> DataFrame:
    """Failures by kind; those without a kind count as http."""
    return failures.agg(F.count_if(F.col("kind") == "extraction").alias("extraction"), F.count_if(~F.col("kind").eqNullSafe(F.lit("extraction"))).alias("http"))
