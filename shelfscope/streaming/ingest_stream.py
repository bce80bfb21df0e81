"""Structured Streaming variants of the incremental steps.

Crawl rows arrive as files; each micro-batch is merged into the stored state and appends its change
log. Event counts by window use a watermark; duplicates within it are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfscope.operators import ingest
from shelfscope.sources import tables
from shelfscope.sources.stored import checkpointed


def stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by type and tumbling window; those later than the watermark don't count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"))


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each event once, as far as its repeats come within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


class StateTable:
    """The stored products, each origin in the version of the batch that crawled it last.

    A micro-batch writes the products of its own origins only, under its number, with its events and
    snapshots, and then in `heads` which version each origin is in. The newest heads below a batch's
    number are the state before it, so a batch that is run again starts from the same state and
    replaces its own result. Versions that neither the new heads nor the ones before name are deleted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self, name: str, schema: str) -> DataFrame:
        """All versions of a table; empty before the first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return self.spark.createDataFrame([], f"{schema}, version LONG")
        return self.spark.read.schema(f"{schema}, version LONG").parquet(f"{self.path}/{name}")

    def heads(self, version: int) -> DataFrame:
        """(origin, at_version) after the last batch up to this one; a row for each origin."""
        table = self._table("heads", "origin STRING, at_version LONG").where(F.col("version") <= version)
        newest = table.agg(F.max("version")).first()[0]
        return table.where(F.col("version") == newest).drop("version") if newest is not None else table.drop("version")

    def read(self, version: int, origins: DataFrame | None = None) -> DataFrame:
        """The products after a batch, of these origins alone if given."""
        heads = self.heads(version)
        if origins is not None:
            heads = heads.join(origins.select("origin"), "origin", "left_semi")
        rows = self._table("state", tables.PRODUCT)
        return rows.join(heads.withColumnRenamed("at_version", "version"), ["origin", "version"]).select(*(c for c in rows.columns if c != "version"))

    def snapshots(self, version: int | None = None) -> DataFrame:
        rows = self._table("snapshots", tables.SNAPSHOT)
        return (rows if version is None else rows.where(F.col("version") <= version)).drop("version")

    def events(self) -> DataFrame:
        return self._table("events", f"{tables.EVENT}, snapshot_id STRING").drop("version")

    def apply(self, version: int, crawl: DataFrame, crawls: DataFrame) -> DataFrame:
        """Merges the crawls of some origins (origin, at, full_crawl, capped) and returns the origins
        that changed."""

        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

        facts = checkpointed(ingest.facts(crawls, crawl, self.snapshots(version - 1)))
        both = checkpointed(ingest.compared_by_origin(self.read(version - 1, facts), crawl, facts))
        log = ingest.stamped(ingest.events(both, F.col("at"), F.col("anchor"), F.col("full")))
        put(log, "events")
        put(ingest.next_state(both, F.col("at")), "state")
        put(ingest.snapshots_of(both, log, facts), "snapshots")
        before = self.heads(version - 1)
        put(before.join(facts, "origin", "left_anti").unionByName(facts.select("origin", F.lit(version).cast("long").alias("at_version"))), "heads")
        self._clean(version, before)
        return ingest.changed(self._table("snapshots", tables.SNAPSHOT).where(F.col("version") == version))

    def _clean(self, version: int, before: DataFrame) -> None:
        named = {r[0] for r in self.heads(version).unionByName(before).select("at_version").distinct().collect()}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        files = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for entry in files.listStatus(root):
            kind, _, number = entry.getPath().getName().partition("=")
            if kind == "version" and int(number) < version and int(number) not in named:
                files.delete(entry.getPath(), True)


def merge_crawls(
    raw: DataFrame,
    rates: DataFrame,
    table: StateTable,
    checkpoint: str,
    clock: Callable[[int], object],
    full: bool = False,
    crawls: Callable[[int, DataFrame], DataFrame] | None = None,
    reconcile: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Applies each micro-batch of raw crawl rows to the state, then stops when all input is read.

    clock gives the time of a batch from its number. crawls gives the facts of its crawls (origin, at,
    full_crawl, capped) from number and rows, also of origins of which it has no row; by default each
    origin in it has been crawled at the batch's time, fully or not as `full` says. An empty batch
    writes nothing. reconcile is called with the origins whose crawl changed something, if there are any.
    """

    def told(number: int, batch: DataFrame) -> DataFrame:
        at = F.lit(clock(number)).cast("timestamp")
        return batch.select("origin").distinct().select("origin", at.alias("at"), F.lit(full).alias("full_crawl"), F.lit(False).alias("capped"))

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            own = (crawls or told)(number, batch)
            if own.isEmpty():
                return
            moved = table.apply(number, ingest.normalised(batch, rates), own)
            if reconcile is not None and not moved.isEmpty():
                reconcile(moved)
        finally:
            batch.unpersist()

    return raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
