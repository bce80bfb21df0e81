"""Jobs' lives and pagers against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import jobs, pagers

T0 = dt.datetime(2024, 1, 1)
ACTIONS = ["enqueue", "claim", "heartbeat", "complete", "fail", "pause", "resume", "cancel", "nonsense"]


def life(events, now, beat, most, attempts, wait, longest):
    """One job, moment by moment: time is looked at in every millisecond that matters."""
    s = {"status": None, "attempts": 0, "control": None, "worker": None, "scheduled": None, "started": None, "beat": None, "finished": None, "moves": 0}

    def go(status, **kw):
        s.update(status=status, moves=s["moves"] + 1, **kw)

    def miss(at):
        s["attempts"] += 1
        s.update(worker=None, beat=None)
        if s["attempts"] >= attempts:
            go("dead", finished=at, control=None)
        else:
            go("retrying", scheduled=at + min(wait * 2 ** s["attempts"], longest))

    def clock(at):
        if s["status"] == "claimed":
            for moment in sorted((s["beat"] + beat, s["started"] + most)):
                if moment < at and s["status"] == "claimed":
                    miss(moment)

    for at, action, worker in events:
        clock(at)
        mine = s["status"] == "claimed" and s["worker"] == worker
        if action == "enqueue" and s["status"] is None:
            go("queued", scheduled=at)
        if action == "claim" and s["status"] in ("queued", "retrying") and s["scheduled"] <= at and s["control"] != "pause":
            go("claimed", worker=worker, started=at, beat=at)
            continue
        if action == "heartbeat" and mine:
            if s["control"] == "cancel":
                go("cancelled", finished=at, control=None)
            else:
                s["beat"] = at
        if action == "complete" and mine:
            go("done", finished=at, control=None)
        if action == "fail" and mine:
            miss(at)
        if s["status"] in ("queued", "retrying", "claimed"):
            if action in ("pause", "resume"):
                s["control"] = "pause" if action == "pause" else None
            if action == "cancel":
                if s["status"] == "claimed":
                    s["control"] = "cancel"
                else:
                    go("cancelled", finished=at, control=None)
    clock(now)
    return tuple(s.values())


@pytest.mark.parametrize("parts", [1, 5])
def test_lives_equal_a_plain_loop_over_shuffled_events(spark, parts):
    rng = random.Random(4)
    rules = jobs.Rules(beat_ms=4000, most_ms=15_000, attempts=3, wait_ms=500, longest_ms=3000)
    rows, want = [], {}
    for job in range(250):
        at, events = 0, []
        for k in range(rng.randint(1, 40)):
            at += rng.choice([0, 100, 1000, 5000])
            action = "enqueue" if k == 0 and rng.random() < 0.95 else rng.choice(ACTIONS + ["claim", "claim", "heartbeat", "heartbeat"])
            events.append((at, action, rng.choice(["a", "a", "b"])))
        rows += [(job, T0 + dt.timedelta(milliseconds=a), k, x, w) for k, (a, x, w) in enumerate(events)]
        want[job] = life(events, 60_000_000, 4000, 15_000, 3, 500, 3000)
    rows += [(None, T0, 0, "enqueue", "a")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "job_id long, at timestamp, seq long, action string, worker string").repartition(parts)
    got = jobs.lives(frame, F.lit(str(T0 + dt.timedelta(milliseconds=60_000_000))).cast("timestamp"), rules).collect()
    start = spark.range(1).select(F.unix_millis(F.lit(str(T0)).cast("timestamp"))).first()[0]
    less = lambda x: None if x is None else x - start
    assert {r.job_id: (r.status, r.attempts, r.control, r.worker, less(r.scheduled_ms), less(r.started_ms), less(r.beat_ms), less(r.finished_ms), r.moves) for r in got} == want
    assert {r.status for r in got} >= {"queued", "claimed", "retrying", "done", "dead", "cancelled"} - {"claimed"}


def test_no_events_no_jobs(spark):
    none = spark.createDataFrame([], "job_id long, at timestamp, seq long, action string, worker string")
    assert jobs.lives(none, F.lit("2024-01-01").cast("timestamp")).count() == 0


def walk(pages, size, most):
    read, items, why = 0, 0, "end"
    for n in range(1, max(pages) + 1):
        if n not in pages:
            break
        count, total = pages[n]
        if most is not None and items >= most:
            why = "limit"
            break
        if total is not None and n > total:
            why = "total"
            break
        read, items = read + 1, items + count
        if count == 0 or (total is None and count < size):
            why = "empty" if count == 0 else "short"
            break
    return read, items, why


@pytest.mark.parametrize("most", [None, 25, 10_000])
def test_pagers_stop_as_a_plain_walk(spark, most):
    rng = random.Random(2)
    stores = {}
    for s in range(150):
        total = rng.choice([None, None, rng.randint(1, 6)])
        n = rng.randint(1, 9)
        stores[s] = {k: (rng.choice([10, 10, 10, 10, 7, 0]), total) for k in range(1, n + 1) if k == 1 or rng.random() < 0.95}
    rows = [(s, k, c, t) for s, pages in stores.items() for k, (c, t) in pages.items()]
    frame = spark.createDataFrame(rows, "origin long, page long, items long, total_pages long").orderBy(F.rand(1))
    want = {s: walk(p, 10, most) for s, p in stores.items()}
    got = {r.origin: (r.pages, r.items, r.stop) for r in pagers.stops(frame, 10, most).collect()}
    assert got == want and len({w[2] for w in want.values()}) >= 4
    read = pagers.read_pages(frame, 10, most).groupBy("origin").agg(F.count("*").alias("n"), F.sum("items").alias("items")).collect()
    assert {r.origin: (r.n, r["items"]) for r in read} == {s: w[:2] for s, w in want.items() if w[0]}
