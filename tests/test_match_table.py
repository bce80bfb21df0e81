"""The match table after crawls: only changed stores' files change, and the content is a full rematch's."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelfscope.operators import matching
from shelfscope.operators.match_table import MatchTable
from tests.test_operators import catalogue

SCHEMA = "store string, id long, ord long, name string, sku string, gtin string, url string"


def products(rng, n):
    return [(i, i, rng.choice(["red mug", "blue mug", "steel lamp", "cotton shirt"]) + rng.choice(["", " new", f" {i}"]), f"S{rng.randint(1, 30)}", "", "") for i in range(1, n + 1)]


def files(path):
    return {p.parent.name: sorted((q.name, q.stat().st_mtime_ns) for q in p.parent.glob("*.parquet")) for p in path.glob("store=*/*.parquet")}


def test_only_changed_stores_are_replaced(spark, tmp_path):
    rng = random.Random(6)
    mine = catalogue(spark, [(o, n, s, g, u) for o, _, n, s, g, u in products(rng, 25)])
    stores = {k: products(rng, 20) for k in "abcd"}
    table = MatchTable(spark, str(tmp_path / "m"), pair_limit=None)
    listed = lambda: spark.createDataFrame([(k, *r) for k, rows in stores.items() for r in rows], SCHEMA)
    whole = lambda: sorted(map(tuple, matching.match(mine, listed(), pair_limit=None, by=("store",)).select("store", "mine", "theirs", "method", "confidence").collect()))
    read = lambda: sorted(map(tuple, table.read().collect()))
    table.refresh(mine, listed())
    assert read() == whole() and {r[0] for r in read()} == set("abcd")
    before = files(tmp_path / "m")
    stores["b"] = products(rng, 20)
    stores["c"] = []  # all products are gone
    reconcile = table.reconciler(lambda: mine, listed, "https://me.example")
    reconcile(spark.createDataFrame([("b",), ("c",)], "origin string"))
    after = files(tmp_path / "m")
    assert read() == whole() and {r[0] for r in read()} == set("abd")
    assert {k for k in before if before[k] == after[k]} == {"store=a", "store=d"}
    mine = mine.where(F.col("id") > 3)
    del stores["d"]
    reconcile(spark.createDataFrame([("https://me.example",)], "origin string"))
    assert read() == whole() and {r[0] for r in read()} == set("ab")
