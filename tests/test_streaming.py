from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfscope.sources import tables
from shelfscope.streaming import ingest_stream


def test_replayed_crawls_equal_batch_merges(spark, tmp_path):
    rows = lambda price: [("https://s.com", "A", "B", price, "USD", True, "https://s.com/p/aaa", "A1", "", 0)]
    for n, price in enumerate((10.0, 10.0, 12.0)):
        spark.createDataFrame(rows(price), tables.RAW_ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    table = ingest_stream.StateTable(spark, str(tmp_path / "t"))
    raw = ingest_stream.stream(spark, str(tmp_path / "raw"), tables.RAW_ROW)
    query = ingest_stream.merge_crawls(raw, tables.rates(spark, {"AED": 3.6}), table, str(tmp_path / "c"), lambda n: dt.datetime(2024, 1, 1 + n))
    query.awaitTermination()
    log = sorted(r.type for r in table.events().collect())
    assert log == ["added", "price_changed"]
    last = table.read(2).first()
    assert last.price == 12.0 and [p.price for p in last.price_history] == [10.0, 12.0]


def test_windowed_counts_and_distinct_events(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 4), "click") for i in range(8)] + [(7, dt.datetime(2024, 1, 2), "click")]
    schema = "event_id long, ts timestamp, event_type string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    for name, df, mode in (("counts", ingest_stream.windowed_counts(source), "complete"), ("distinct", ingest_stream.distinct_events(source), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [4, 5]
    assert spark.table("distinct").agg(F.count("*"), F.count_distinct("event_id")).first() == (8, 8)


def test_crawls_of_several_stores_keep_apart(spark, tmp_path):
    """Partial, full and empty crawls of two stores: removals by each store's own anchor, once."""
    row = lambda s, k, price=1.0: (f"https://{s}.com", f"Thing {k}", "B", price, "USD", True, f"https://{s}.com/p/{k}", f"SKU{k}", "", 0)
    batches = [
        ([row("a", 1), row("a", 2)], [("a", True, False)]),
        ([row("b", 1), row("b", 2), row("b", 3)], [("b", True, False)]),
        ([row("b", 1)], [("b", True, True)]),
        ([row("b", 1, 2.0), row("a", 1)], [("b", True, False), ("a", False, False)]),
        ([row("b", 1, 2.0)], [("b", True, False), ("a", True, False)]),
        ([row("a", 1)], [("a", True, False)]),
        ([row("a", 1)], [("a", True, False)]),
    ]
    for rows, _ in batches:
        spark.createDataFrame(rows, tables.RAW_ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    clock = lambda n: dt.datetime(2024, 1, 1 + n)

    def crawls(number, batch):
        rows = [(f"https://{s}.com", clock(number), full, capped) for s, full, capped in batches[number][1]]
        return spark.createDataFrame(rows, "origin string, at timestamp, full_crawl boolean, capped boolean")

    moved = []
    table = ingest_stream.StateTable(spark, str(tmp_path / "t"))
    raw = ingest_stream.stream(spark, str(tmp_path / "raw"), tables.RAW_ROW)
    ingest_stream.merge_crawls(raw, tables.rates(spark, {"AED": 3.6}), table, str(tmp_path / "c"), clock, crawls=crawls, reconcile=lambda o: moved.append(sorted(r.origin for r in o.collect()))).awaitTermination()
    log = sorted((r["at"].day - 1, r.key, r.type, r.name) for r in table.events().collect())
    assert log == [
        (0, "a.com", "added", "Thing 1"),
        (0, "a.com", "added", "Thing 2"),
        (1, "b.com", "added", "Thing 1"),
        (1, "b.com", "added", "Thing 2"),
        (1, "b.com", "added", "Thing 3"),
        (3, "b.com", "price_changed", "Thing 1"),
        (3, "b.com", "removed", "Thing 2"),
        (3, "b.com", "removed", "Thing 3"),
        (5, "a.com", "removed", "Thing 2"),
    ]
    assert moved == [["https://a.com"], ["https://b.com"], ["https://b.com"], ["https://a.com"]]
    shots = {(r.finished_at.day - 1, r.key): r for r in table.snapshots().collect()}
    assert {k for k, r in shots.items() if r.full} == {(0, "a.com"), (1, "b.com"), (3, "b.com"), (4, "b.com"), (5, "a.com"), (6, "a.com")}
    assert (shots[4, "a.com"].products, shots[4, "a.com"].removed, shots[3, "b.com"].removed) == (0, 0, 2)
    assert {r.snapshot_id for r in table.events().collect()} <= {r.snapshot_id for r in shots.values()}
    assert table.read(6).groupBy("key").count().orderBy("key").collect() == [("a.com", 2), ("b.com", 3)]
    kept = {p.name for p in (tmp_path / "t" / "state").iterdir()}
    assert kept == {"version=4", "version=5", "version=6"}
