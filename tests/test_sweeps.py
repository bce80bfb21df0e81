"""As-of averages, trends and order statistics against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import analytics, metrics

DAY = dt.datetime(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n, seconds=n % 7)


def history(seed, stores=4, products=6, days=400):
    rng = random.Random(seed)
    obs = {(s, p, rng.randrange(days)): rng.choice([None, 0.0, float(rng.randint(1, 900)), 50.0]) for s in range(stores) for p in range(products) for _ in range(rng.randint(0, 12))}
    snaps = {(s, rng.randrange(days)) for s in range(stores + 1) for _ in range(15)} | {(0, d) for d in range(0, days, 9)}
    return obs, sorted(snaps)


def averages(obs, snaps):
    out = {}
    for s, t in snaps:
        last = {}
        for (store, p, d), price in sorted(obs.items(), key=lambda x: x[0][2]):
            if store == s and d <= t:
                last[p] = price
        known = [x for x in last.values() if x and x > 0]
        if known:
            out[s, t] = (sum(known) / len(known), len(known))
    return out


def tables(spark, obs, snaps):
    o = spark.createDataFrame([(s, p, day(t), x) for (s, p, t), x in obs.items()], "store_id long, product_id long, t timestamp_ntz, price double")
    return spark.createDataFrame([(s, day(t)) for s, t in snaps], "store_id long, t timestamp_ntz"), o


@pytest.mark.parametrize("seed", [1, 2])
def test_averages_at_snapshots(spark, seed):
    obs, snaps = history(seed)
    got = analytics.store_averages_at(*tables(spark, obs, snaps))
    assert {(r.store_id, r.t): (r.avg_price, r.n) for r in got.collect()} == {(s, day(t)): v for (s, t), v in averages(obs, snaps).items()}


def test_no_grid_of_snapshots_and_products(spark, capsys):
    """Neither a join of snapshots with products nor a row for each of their pairs."""
    obs, snaps = history(3, stores=1, products=40)
    table, o = tables(spark, obs, snaps)
    analytics.store_averages_at(table, o).explain("formatted")
    plan = capsys.readouterr().out
    joins = [line for line in plan.splitlines() if "keys" in line]
    assert joins and not any("product_id" in line for line in joins)


@pytest.mark.parametrize("label", ["yyyy-MM", "E", "yyyy"])
def test_trend(spark, label):
    obs, snaps = history(4)
    known = averages(obs, snaps)
    table = spark.createDataFrame([(s, day(t), v[0]) for (s, t), v in known.items()], "store_id long, t timestamp_ntz, avg_price double")
    got = {r.t: (r.label, r.you, r.market, r.cheapest) for r in analytics.trend(table, 1, F.date_format("t", label)).collect()}
    times = sorted({t for _, t in known})
    name = {r.t: r.label for r in table.select("t", F.date_format("t", label).alias("label")).distinct().collect()}
    want, held = {}, {}
    up = lambda x: math.floor(x * 100 + 0.5) / 100
    for k, t in enumerate(times):
        held |= {s: v[0] for (s, u), v in known.items() if u == t}
        if k + 1 == len(times) or name[day(times[k + 1])] != name[day(t)]:
            want[day(t)] = (name[day(t)], up(held[1]) if 1 in held else None, up(sum(held.values()) / len(held)), up(min(held.values())))
    assert got.keys() == want.keys()
    for t in want:
        assert got[t][0] == want[t][0] and got[t][1:] == pytest.approx(want[t][1:], abs=0.011)


def test_aligned_blocks(spark):
    pairs = [(a, b) for a in range(18) for b in range(a, 18)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    for r in frame.select("a", "b", analytics.blocks(F.col("a"), F.col("b"), 5).alias("blocks")).collect():
        cover = sorted(x for level, k in r.blocks for x in range(k << level, (k + 1) << level))
        assert cover == list(range(r.a, r.b + 1)) and len(r.blocks) <= 8


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_places_in_order(spark, width):
    rng = random.Random(width)
    rows = [(g, rng.choice([rng.randint(-50, 50), 10**7 + rng.randint(0, 10**6), 3])) for g in ["a", "b", None] for _ in range(rng.randint(1, 90))]
    got = metrics.placed(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", {"least": F.lit(0), "middle": F.expr("n div 2"), "none": F.col("n")}, width)
    for r in got.collect():
        own = sorted(v for g, v in rows if g == r.g)
        assert (r.least, r.middle, r.none) == (own[0], own[len(own) // 2], None)
    assert got.count() == 3


def test_no_buffer_holds_the_durations_of_a_group(spark, capsys):
    jobs = spark.createDataFrame([("done", "deep", DAY, DAY, 1, "w")], "status string, type string, started_at timestamp, finished_at timestamp, requests long, worker string")
    metrics.window_summary(jobs, F.lit("2019-01-01").cast("timestamp"), "worker").explain()
    plan = capsys.readouterr().out
    assert not any(f in plan for f in ("percentile", "median(", "collect_"))
