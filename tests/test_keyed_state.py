"""Keyed state in streams: the same changes and products as the batch merge, restarts, and expiry."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from shelfscope.operators import ingest
from shelfscope.sources import tables
from shelfscope.streaming import ingest_stream, keyed

CRAWL = "origin string, at timestamp, full_crawl boolean, capped boolean"


def crawls(seed):
    """Crawls of three stores in batches: renamed, repriced, sold out and vanishing products."""
    rng, out = random.Random(seed), []
    for n in range(7):
        rows, told = [], []
        for s in rng.sample("abc", rng.randint(1, 3)):
            found = [k for k in range(12) if rng.random() < 0.7] if rng.random() < 0.9 else []
            rows += [(f"https://{s}.com", f"Thing {k}{rng.choice(['', '', ' new'])}", "B", rng.choice([1.0, 2.0, None, 3.5]), "USD", rng.random() < 0.8, f"https://{s}.com/p/{k}", f"SKU{k}", "", k) for k in found]
            rows += rows[-1:]
            told.append((f"https://{s}.com", dt.datetime(2024, 1, 1 + n), rng.random() < 0.7, rng.random() < 0.2))
        out.append((rows, told))
    return out


def test_keyed_ingest_equals_the_batch_merge(spark, tmp_path):
    batches, where = crawls(1), str(tmp_path)
    rates = tables.rates(spark, {"AED": 3.6})
    table = ingest_stream.StateTable(spark, f"{where}/table")
    schema = None
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for n, (rows, told) in enumerate(batches):
            frame = spark.createDataFrame(rows, tables.RAW_ROW)
            facts = spark.createDataFrame(told, CRAWL)
            normal = ingest.normalised(frame, rates)
            table.apply(n, normal, facts)
            found = normal.select("origin").distinct().withColumn("found", F.lit(True))
            facts.join(found, "origin", "left").withColumn("found", F.coalesce("found", F.lit(False))).coalesce(1).write.parquet(f"{where}/told/{n}")
            timed = normal.join(facts.select("origin", "at"), "origin")
            timed.coalesce(1).write.parquet(f"{where}/rows/{n}")
            schema = timed.schema
            if n in (2, 4, len(batches) - 1):  # stopped and started again from the checkpoint
                products = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{where}/rows")
                marks = spark.readStream.schema(f"{CRAWL}, found boolean").option("recursiveFileLookup", True).parquet(f"{where}/told")
                full = F.col("full_crawl") & ~F.col("capped") & F.col("found")
                out = keyed.ingested(products, marks.select("origin", "at", full.alias("full")), buckets=3)
                out.writeStream.format("parquet").option("checkpointLocation", f"{where}/c").trigger(availableNow=True).start(f"{where}/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    out = spark.read.parquet(f"{where}/out")
    columns = ["origin", "key", "identity_key", "type", "name", "url", "old", "new", "at"]
    log = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert log(keyed.events(out)) == log(table.events()) and table.events().select("type").distinct().count() == 4
    last = keyed.state(out).groupBy("origin", "identity_key").agg(F.max_by(F.struct(*(c for c in columns[1:2]), "name", "brand", "price", "currency", "price_usd", "available", "url", "sku", "slug", "tokens", "trigrams", "first_seen_at", "last_seen_at", "price_updated_at", "price_history"), "last_seen_at").alias("p"))
    stored = table.read(len(batches) - 1).select("origin", "identity_key", F.struct("key", "name", "brand", "price", "currency", "price_usd", "available", "url", "sku", "slug", "tokens", "trigrams", "first_seen_at", "last_seen_at", "price_updated_at", "price_history").alias("p"))
    assert sorted(map(repr, last.collect())) == sorted(map(repr, stored.collect()))


def test_rows_expire_by_event_time(spark, tmp_path):
    day, at = dt.timedelta(days=1), dt.datetime(2024, 6, 1)
    batches = [
        [("u", "e1", "event", at), ("u", "j1", "job", at), ("v", "c1", "checkpoint", at)],
        [("u", "e2", "event", at + day), ("w", "a1", "alert", at - 20 * day)],  # the job and the checkpoint are over
        [("u", "e3", "event", at + 91 * day)],  # so are the first two events, and the alert's state
        [("u", "e4", "event", at + 92 * day), ("v", "c2", "checkpoint", at + 90 * day)],  # comes too late
        [("x", "e5", "event", at + 92 * day)],
    ]
    schema = "key string, id string, kind string, at timestamp"
    got = {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            keyed.expiring(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
            for r in spark.read.parquet(f"{tmp_path}/out").collect():
                got.setdefault((r.id, r.status), n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {k: v for k, v in got.items() if k[1] == "kept"} == {(i, "kept"): n for i, n in (("e1", 0), ("j1", 0), ("c1", 0), ("e2", 1), ("a1", 1), ("e3", 2), ("e4", 3), ("e5", 4))}
    assert [k[0] for k in got if k[1] == "late"] == ["c2"]
    assert {k[0] for k in got if k[1] == "expired"} == {"j1", "c1", "e1", "a1", "e2"}
    assert got["j1", "expired"] <= 2 and got["a1", "expired"] <= 3
