"""Ingest and expiry as keyed state in a stream's state store.

Products live in map state on disk (RocksDB), keyed by origin and one of `buckets` hash buckets, so
that a store with most of the products is spread. Two kinds of rows reach a key: product rows of a
crawl, and the crawl itself (when it ended, whether it stands for the whole store), which goes to all
buckets of its origin. The key compares the rows with its products as the batch merge does, puts the
new state in their place, and emits the change log and the products as they are now. When a full
crawl ended is value state, the anchor of the next one's removals. A batch touches the buckets of the
origins in it alone, and the state is never rewritten; restarts go on from the checkpoint.

Expiry uses event time: a row is held under its key until the newest time seen passes its own by the
retention of its kind, then goes out as expired. What is older than that on arrival is late. The
watermark stays behind by the longest retention, so that no row is dropped that any kind would keep.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfscope.operators.ingest import HISTORY
from shelfscope.sources import tables

#: Milliseconds that each kind of row is kept.
RETENTION = {"event": 90 * 86_400_000, "alert": 95 * 86_400_000, "checkpoint": 6 * 3_600_000, "job": 3_600_000}
_LONGEST = max(RETENTION.values())
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_OUT = "kind string, body string"
_TEXTS = ("key", "name", "url")


def _stamp(ms: int | None) -> str | None:
    return None if ms is None else dt.datetime.fromtimestamp(ms / 1000, dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def merged(was: dict | None, now: dict | None, at: int, anchor: int, full: bool, history: int = HISTORY) -> tuple[dict | None, list[tuple[str, dict | None, dict | None]]]:
    """The product after a crawl and what happened to it: (type, old, new) with price and available.
    Times are milliseconds. was: as stored; now: as crawled; either may be None."""
    point = lambda p: p and {"price": p["price"], "available": p["available"]}
    if now is None:
        gone = full and was["last_seen_at"] >= anchor
        return None, [("removed", point(was), None)] if gone else []
    price = {"t": at, "price": now["price"], "available": now["available"]}
    if was is None:
        seen = dict.fromkeys(("first_seen_at", "last_seen_at"), at)
        return now | seen | {"price_updated_at": None, "price_history": [] if now["price"] is None else [price]}, [("added", None, point(now))]
    moved = now["price"] is not None and now["price"] != was["price"]
    stock = now["available"] != was["available"]
    out = was | {f: now[f] if now[f] is not None else was[f] for f in ("name", "brand", "currency", "price_usd", "available")}
    if now["name"] != was["name"]:
        out |= {f: now[f] for f in ("tokens", "trigrams")}
    if moved or stock:
        out["price_updated_at"] = at
        if now["price"] is not None:
            out |= {"price": now["price"], "price_history": [*was["price_history"], price][-history:]}
    out["last_seen_at"] = at
    events = [(t, point(was), point(now)) for t, some in (("price_changed", moved), ("stock_changed", stock)) if some]
    return out, events


class Products(StatefulProcessor):
    """The products of one bucket of an origin."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._products = handle.getMapState("products", "identity_key string", "product string")
        self._anchor = handle.getValueState("anchor", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        crawls: dict[int, tuple[dict[str, dict], list[bool]]] = {}
        for frame in rows:
            for at, full, body in zip(frame["at_ms"], frame["full"], frame["body"], strict=True):
                products, marks = crawls.setdefault(int(at), ({}, []))
                if body is None:
                    marks.append(bool(full))
                else:
                    product = json.loads(body)
                    products.setdefault(product["identity_key"], product)
        out: list[tuple[str, str]] = []
        for at in sorted(crawls):
            out += self._crawled(key[0], at, *crawls[at])
        yield pd.DataFrame(out, columns=["kind", "body"])

    def _crawled(self, origin: str, at: int, products: dict[str, dict], marks: list[bool]) -> list[tuple[str, str]]:
        anchor, full, out = self._anchor.get()[0] if self._anchor.exists() else 0, any(marks), []
        gone = []
        if full:  # only then every product of the bucket is looked at
            gone = [(k[0], json.loads(v[0])) for k, v in self._products.iterator() if k[0] not in products]
        found = [(k, json.loads(self._products.getValue((k,))[0]) if self._products.containsKey((k,)) else None, now) for k, now in products.items()]
        for k, was, now in [*found, *((k, was, None) for k, was in gone)]:
            after, events = merged(was, now, at, anchor, full)
            shown = now or was
            for kind, old, new in events:
                out.append(("event", json.dumps({"origin": origin, "identity_key": k, "type": kind, "old": old, "new": new, "at": _stamp(at)} | {f: shown[f] for f in _TEXTS})))
            if after is not None:
                self._products.updateValue((k,), (json.dumps(after),))
                times = {f: _stamp(after[f]) for f in ("first_seen_at", "last_seen_at", "price_updated_at")}
                points = [p | {"t": _stamp(p["t"])} for p in after["price_history"]]
                out.append(("product", json.dumps(after | times | {"price_history": points})))
        if full:
            self._anchor.update((at,))
        return out


def _millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def ingested(products: DataFrame, crawls: DataFrame, buckets: int = 64) -> DataFrame:
    """(kind, body): the change log ('event') and the products as they are after it ('product') of
    crawls in a stream, as JSON; events() and state() read them.

    products: normalised rows with `at`, when their crawl ended; crawls: (origin, at, full), one for
    each crawl, also of those that found nothing. Both may come in any batches, but a crawl's own rows
    not after it. The first row of a key and crawl counts.
    """
    products.sparkSession.conf.set(_PROVIDER, _ROCKS)
    fields = [c for c in products.columns if c not in ("at", "ord")]
    # Nulls are written too, so that a row always has all fields.
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    bucket = F.pmod(F.xxhash64("identity_key"), F.lit(buckets)).cast("int")
    one = products.select("origin", bucket.alias("bucket"), _millis("at").alias("at_ms"), F.lit(False).alias("full"), body.alias("body"))
    every = F.explode(F.array(*(F.lit(k).cast("int") for k in range(buckets))))
    two = crawls.select("origin", every.alias("bucket"), _millis("at").alias("at_ms"), "full", F.lit(None).cast("string").alias("body"))
    return one.unionByName(two).groupBy("origin", "bucket").transformWithStateInPandas(Products(), _OUT, "Append", "None")


def events(out: DataFrame) -> DataFrame:
    """The change log of ingested()."""
    return out.where("kind = 'event'").select(F.from_json("body", tables.EVENT).alias("e")).select("e.*")


def state(out: DataFrame) -> DataFrame:
    """The products of ingested(), a row for each crawl that saw one."""
    return out.where("kind = 'product'").select(F.from_json("body", tables.PRODUCT).alias("p")).select("p.*")


class Expiry(StatefulProcessor):
    """Rows of one key, each until its time and the retention of its kind have passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getMapState("held", "due long, id string", "kind string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = timerValues.getCurrentWatermarkInMs() + _LONGEST, []
        for frame in rows:
            for row, kind, at in zip(frame["id"], frame["kind"], frame["at_ms"], strict=True):
                due = int(at) + RETENTION[kind]
                if due <= now:
                    out.append((key[0], row, kind, "late"))
                    continue
                self._held.updateValue((due, row), (kind, int(at)))
                self._handle.registerTimer(due - _LONGEST)
                out.append((key[0], row, kind, "kept"))
        yield pd.DataFrame(out, columns=["key", "id", "kind", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, out = expiredTimerInfo.getExpiryTimeInMs() + _LONGEST, []
        for (at, row), (kind, _) in list(self._held.iterator()):
            if at == due:
                out.append((key[0], row, kind, "expired"))
        for _, row, _, _ in out:
            self._held.removeKey((due, row))
        yield pd.DataFrame(out, columns=["key", "id", "kind", "status"])


def expiring(rows: DataFrame) -> DataFrame:
    """(key, id, kind, status) from rows (key, id, kind, at): kept or late when a row comes, expired when
    rows as much newer as its kind's retention have come. Rows older than any retention are dropped.
    A key holds its unexpired rows alone."""
    rows.sparkSession.conf.set(_PROVIDER, _ROCKS)
    timed = rows.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", f"{_LONGEST} milliseconds").withColumn("at_ms", _millis("at"))
    return timed.groupBy("key").transformWithStateInPandas(Expiry(), "key string, id string, kind string, status string", "Append", "EventTime")
