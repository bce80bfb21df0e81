from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import alerts, analytics, discovery, ingest, matching, metrics, readpath
from shelfscope.plans import extraction
from shelfscope.sources import extract, platforms, sinks, sitemaps, tables

T0, T1, T2 = "2024-01-01", "2024-02-01", "2024-03-01"
RAW = "origin string, name string, brand string, price double, currency string, available boolean, url string, sku string, gtin string, ord long"


def raw(spark, *rows):
    return spark.createDataFrame([("https://s.com", n, "B", p, c, a, u, k, "", i) for i, (n, p, c, a, u, k) in enumerate(rows)], RAW)


def crawl(spark, state, rows, at, anchor=ingest.EPOCH, full=True):
    at, anchor = F.lit(at).cast("timestamp"), F.lit(anchor).cast("timestamp")
    rates = tables.rates(spark, {"AED": 3.6725})
    both = ingest.compared(state, ingest.normalised(raw(spark, *rows), rates))
    return ingest.events(both, at, anchor, full), ingest.next_state(both, at)


def kinds(events):
    return sorted((r.identity_key, r.type) for r in events.collect())


def test_crawls_in_turn(spark):
    empty = spark.createDataFrame([], tables.PRODUCT)
    one = [("A", 10.0, "AED", True, "https://s.com/p/aaa", "A1"), ("B", 5.0, None, True, "https://s.com/p/bbb", ""), ("Junk", 1.0, None, True, "https://s.com/blog/x", "")]
    log, state = crawl(spark, empty, one, T0)
    assert kinds(log) == [("sku:a1", "added"), ("slug:bbb", "added")]
    assert crawl(spark, state, one, T1)[0].count() == 0
    two = [("A renamed", 12.0, None, False, "https://s.com/p/aaa", "A1")]
    log, after = crawl(spark, state, two, T1, T0)
    assert kinds(log) == [("sku:a1", "price_changed"), ("sku:a1", "stock_changed"), ("slug:bbb", "removed")]
    assert kinds(crawl(spark, state, two, T1, T0, full=False)[0]) == [("sku:a1", "price_changed"), ("sku:a1", "stock_changed")]
    a = after.where("identity_key = 'sku:a1'").first()
    assert (a.name, a.price, a.currency, a.available, len(a.price_history)) == ("A renamed", 12.0, "AED", False, 2)
    again = crawl(spark, after, one, T2, T1)[0]
    assert ("slug:bbb", "added") not in kinds(again)
    missing = crawl(spark, state, [("A", None, None, True, "https://s.com/p/aaa", "A1")], T1, full=False)
    assert missing[0].count() == 0 and missing[1].where("identity_key = 'sku:a1'").first().price == 10.0


def test_repeated_keys_in_a_crawl_count_once(spark):
    rows = [("A", 1.0, None, True, "https://s.com/p/aaa", "A1"), ("A", 2.0, None, True, "https://s.com/p/aaa", "A1")]
    assert [r.price for r in ingest.normalised(raw(spark, *rows), tables.rates(spark, {"AED": 3.6})).collect()] == [1.0]


def test_history_is_capped(spark):
    empty = spark.createDataFrame([], tables.PRODUCT)
    state = crawl(spark, empty, [("A", 1.0, None, True, "", "A1")], T0)[1]
    both = ingest.compared(state, ingest.normalised(raw(spark, ("A", 2.0, None, True, "", "A1")), tables.rates(spark, {"AED": 3.6})))
    assert [p.price for p in ingest.next_state(both, F.lit(T1).cast("timestamp"), history=1).first().price_history] == [2.0]


def test_snapshot_retention(spark):
    rows = [("o", dt.datetime(2024, 1, d), d == 1) for d in range(1, 15)]
    kept = sinks.retained_snapshots(spark.createDataFrame(rows, "origin string, finished_at timestamp, full boolean"))
    assert sorted(r.finished_at.day for r in kept.collect()) == [1, *range(5, 15)]


MINE = [(1, "Wireless Mouse", "WIDGET-1", "0621148211434", "https://a.com/products/wireless-mouse"), (2, "Mechanical Keyboard", "KBD-102", "", "https://a.com/products/mechanical-keyboard"), (3, "4K Monitor", "", "9876543210987", "https://a.com/products/4k-monitor"), (4, "USB-C Cable 2m", "", "", "https://a.com/products/usb-c-cable-2m"), (5, "Laptop Stand", "", "", "https://a.com/products/stand"), (6, "Gaming Headset", "", "", "https://a.com/products/headset")]
THEIRS = [(1, "Wireless Mouse", "WIDGET-1", "0621148211434", "https://b.com/p/123"), (2, "Mech Keyboard Pro", "KBD-102", "", "https://b.com/p/456"), (3, "4K Ultra Monitor", "", "9876543210987", "https://b.com/p/789"), (4, "USB C Cable 2m", "", "", "https://b.com/p/abc"), (5, "Laptop Stand", "", "", "https://b.com/p/stand"), (6, "Only They Sell Widget", "THEIR-X1", "", "https://b.com/p/xyz"), (7, "Gaming Headset RGB", "", "", "https://b.com/p/rgb")]


def catalogue(spark, rows):
    return spark.createDataFrame([(o, o, n, s, g, u) for o, n, s, g, u in rows], "id long, ord long, name string, sku string, gtin string, url string")


def matched(spark, mine, theirs):
    return sorted((r.mine, r.theirs, r.method, r.confidence) for r in matching.match(catalogue(spark, mine), catalogue(spark, theirs)).collect())


def test_all_tiers(spark):
    want = [(1, 1, "GTIN", 100), (2, 2, "SKU", 100), (3, 3, "GTIN", 100), (4, 4, "fuzzy", 100), (5, 5, "URL slug", 100), (6, 7, "fuzzy", 87)]
    assert matched(spark, MINE, THEIRS) == want


def test_earlier_rows_take_first(spark):
    mine = [(1, "", "S1", "", ""), (2, "", "", "11111111", "")]
    assert matched(spark, mine, [(1, "", "S1", "11111111", "")]) == [(1, 1, "SKU", 100)]
    assert matched(spark, [(1, "", "S", "", ""), (2, "", "S", "", "")], [(1, "", "S", "", "")]) == [(1, 1, "SKU", 100)]
    both = [(1, "", "", "11111111", ""), (2, "", "S2", "11111111", "")]
    assert matched(spark, both, [(1, "", "", "11111111", ""), (2, "", "S2", "", "")]) == [(1, 1, "GTIN", 100), (2, 2, "SKU", 100)]


def test_many_stores_as_each_by_itself(spark):
    second = [(o, n + " new" * (o % 2), s * (o % 3 > 0), g, u) for o, n, s, g, u in THEIRS]
    third = [(o, n, "", "", f"https://c.com/{o}") for o, n, s, g, u in reversed(THEIRS)]
    stores = {"b": THEIRS, "c": second, "d": third, "e": [(1, "", "", "", "")]}
    want = sorted((k, *row) for k, rows in stores.items() for row in matched(spark, MINE, rows))
    listed = spark.createDataFrame([(k, o, o, n, s, g, u) for k, rows in stores.items() for o, n, s, g, u in rows], "store string, id long, ord long, name string, sku string, gtin string, url string")
    out = matching.match(catalogue(spark, MINE), listed, by=("store",))
    assert sorted(map(tuple, out.collect())) == want and len({r[0] for r in want}) == 3


def test_assignment_equals_the_greedy_loop(spark):
    import random

    rng = random.Random(3)
    edges = [(m, t, [float(rng.randint(0, 3)), float(t)], rng.random() < 0.8) for m in range(30) for t in rng.sample(range(20), 5)]
    used, want = set(), []
    for m in range(30):
        free = sorted((e for e in edges if e[0] == m and e[1] not in used), key=lambda e: e[2])
        if free and free[0][3]:
            used.add(free[0][1])
            want.append((m, free[0][1]))
    frame = spark.createDataFrame(edges, "mine long, theirs long, pref array<double>, passes boolean")
    assert sorted((r.mine, r.theirs) for r in matching.assigned(frame).collect()) == want


def similarity(a, b):
    one, two, short, long = set(a.split(" ")), set(b.split(" ")), min(len(a), len(b)), max(len(a), len(b))
    if not a or not b or a == b:
        return float(bool(a) and a == b)
    if len(one & two) / len(one | two) >= 0.75:
        return len(one & two) / len(one | two)
    if a in b or b in a:
        return 0.6 + 0.35 * (short / long)
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return 1 - row[-1] / long


def matched_in_turn(mine, theirs, pair_limit):
    """The tiers by plain loops over rows (ord, plain name, sku, gtin)."""
    half_up = lambda x: int(x + 0.5)
    grams = lambda s: {f" {s} "[i : i + 3] for i in range(len(s))}
    out, used = {}, set()

    def take(m, t, method, confidence):
        out[m] = (t, method, confidence)
        used.add(t)

    for m, _, sku, gtin in mine:
        for method, at, key in (("GTIN", 3, gtin), ("SKU", 2, sku)):
            owner = next((t[0] for t in theirs if key and t[at] == key), None)
            if owner is not None and owner not in used:
                take(m, owner, method, 100)
                break
    rest = [t for t in theirs if t[0] not in used]
    if (len(mine) - len(out)) * len(rest) <= pair_limit:
        for m, a, *_ in mine:
            bands = range(half_up(max(0, len(a) - 15) / 5), half_up((len(a) + 15) / 5) + 1)
            found = [(-similarity(a, b), half_up(len(b) / 5), t) for t, b, *_ in rest if m not in out and t not in used and half_up(len(b) / 5) in bands]
            if found and min(found)[0] <= -0.8:
                take(m, min(found)[2], "fuzzy", half_up(-min(found)[0] * 100))
    rest = [t for t in theirs if t[0] not in used]
    rare = {g for g in set().union(*(grams(b) for _, b, *_ in rest)) if sum(g in grams(b) for _, b, *_ in rest) <= 200}
    for m, a, *_ in mine:
        found, own = [], grams(a) & rare
        for t, b, *_ in rest:
            shared = len(own & grams(b))
            if m not in out and t not in used and shared >= 2 and shared / (len(own) + len(grams(b)) - shared) >= 0.3:
                found.append((-shared / (len(own) + len(grams(b)) - shared), t, b))
        if found and similarity(a, min(found)[2]) >= 0.8:
            take(m, min(found)[1], "trigram", half_up(similarity(a, min(found)[2]) * 100))
    return sorted((m, *x) for m, x in out.items())


@pytest.mark.parametrize("pair_limit", [10**9, 0])
def test_matching_by_plain_loops(spark, pair_limit):
    import random

    rng = random.Random(11)
    words = ["red", "blue", "shirt", "cotton", "mug", "large", "small", "steel", "bottle", "travel", "organic", "lamp"]

    def name():
        out = " ".join(rng.sample(words, rng.randint(2, 6)))
        if rng.random() < 0.4:
            i = rng.randrange(len(out))
            out = " ".join((out[:i] + rng.choice("xyz") + out[i + 1 :]).split())
        return out

    def side():
        return [(i, name(), rng.choice(["", "", f"s{rng.randint(1, 12)}"]), rng.choice(["", "", "", str(10**8 + rng.randint(1, 12))])) for i in range(1, 61)]

    mine, theirs = side(), side()
    theirs[40:] = [(t, rng.choice(mine)[1] + rng.choice(["", " new", "s"]), sku, gtin) for t, _, sku, gtin in theirs[40:]]
    want = matched_in_turn(mine, theirs, pair_limit)
    one, two = (catalogue(spark, [(o, n, s, g, "") for o, n, s, g in rows]) for rows in (mine, theirs))
    got = matching.match(one, two, pair_limit=pair_limit).collect()
    assert sorted((r.mine, r.theirs, r.method, r.confidence) for r in got) == want
    assert {"GTIN", "SKU", "fuzzy" if pair_limit else "trigram"} <= {x[2] for x in want}


EVENT = "event_id string, key string, type string, name string, old struct<price:double,available:boolean>, new struct<price:double,available:boolean>, at string"


def test_alert_texts(spark):
    rows = [("1", "s", "added", "N", None, (10.0, True), ""), ("2", "s", "removed", "N", (10.0, True), None, ""), ("3", "s", "price_changed", "N", (100.0, True), (80.0, True), ""), ("4", "s", "price_changed", "N", (100.0, True), (125.0, True), ""), ("5", "s", "stock_changed", "N", (10.0, False), (10.0, True), ""), ("6", "s", "stock_changed", "N", (10.0, True), (10.0, False), ""), ("7", "s", "price_changed", "N", (100.0, True), (None, True), ""), ("8", "s", "nope", "N", None, None, "")]
    out = {r.event_id: r for r in alerts.render(spark.createDataFrame(rows, EVENT)).collect()}
    assert set(out) == {"1", "2", "3", "4", "5", "6"}
    assert [(out[i].type, out[i].severity) for i in "123456"] == [("new_product", "low"), ("removed", "high"), ("price_drop", "high"), ("price_rise", "high"), ("stock", "low"), ("stock", "medium")]
    assert "−20.0%" in out["3"].detail and "+25.0%" in out["4"].detail and out["3"].change_amount == -20 and out["6"].title.startswith("Out of stock")


@pytest.mark.parametrize("n", [0, 1, 2, 20, 21])
def test_job_summary_edges(spark, n):
    base = dt.datetime(2024, 1, 2)
    rows = [("done", "deep", base, base + dt.timedelta(seconds=i), 1) for i in range(1, n + 1)]
    jobs = spark.createDataFrame(rows, "status string, type string, started_at timestamp, finished_at timestamp, requests long")
    s = metrics.window_summary(jobs, F.lit("2024-01-01").cast("timestamp")).first()
    ms = [1000 * i for i in range(1, n + 1)]
    assert s.total == n and s.success_rate == (100.0 if n else 0)
    if n:
        mid = (ms[(n - 1) // 2] + ms[n // 2]) / 2
        assert (s.median_ms, s.p95_ms) == (mid, ms[-(-95 * n // 100) - 1])
    else:
        assert s.median_ms is None and s.p95_ms is None


def test_keyset_pages_make_up_the_whole_order(spark):
    rows = [(i % 4, f"{i:024d}") for i in range(23)]
    df = spark.createDataFrame(rows, "ts long, id string")
    after, seen = None, []
    while True:
        page = sorted(readpath.keyset_page(df, "ts", "id", 5, after).collect(), key=lambda r: r.n)
        seen += [(r.ts, r.id) for r in page]
        if not page or not page[0].has_more:
            break
        after = (page[-1].ts, page[-1].id)
    assert seen == sorted(rows, reverse=True)


def test_as_of_takes_the_last_point_at_or_before(spark):
    points = spark.createDataFrame([("k", 1, 1.0), ("k", 5, 5.0)], "k string, t long, v double")
    probes = spark.createDataFrame([("k", 0), ("k", 1), ("k", 4), ("k", 9), ("x", 9)], "k string, t long")
    out = {(r.k, r.t): r.v for r in analytics.as_of(probes, points, ["k"], "t", ["v"]).collect()}
    assert out == {("k", 0): None, ("k", 1): 1.0, ("k", 4): 1.0, ("k", 9): 5.0, ("x", 9): None}


def test_sitemap_leaves(spark):
    locs = ["https://s.com/shoes", "https://s.com/shoes/red", "https://s.com/shoes/red/xl", "https://s.com/blog", "https://s.com/blog/a", "https://s.com/hats/x", "https://s.com/shoes/x-in-dubai", "https://s.com/product/p"]
    df = spark.createDataFrame([("s", u) for u in locs], "origin string, loc string")
    assert sorted(r.loc for r in discovery.product_entries(df).collect()) == ["https://s.com/product/p", "https://s.com/shoes/red/xl"]


def test_base_dominance_needs_more_than_sixty_per_cent(spark):
    rows = [("a", f"https://s.com/product/{i}") for i in range(6)] + [("a", f"https://s.com/x{i}") for i in range(4)] + [("b", "https://s.com/product/1")]
    out = {r.origin: r.dominant for r in discovery.base_share(spark.createDataFrame(rows, "origin string, loc string"), "origin").collect()}
    assert out == {"a": False, "b": True}


def test_extraction_cases(spark):
    texts = {"root": "1,400.00", "nested_price": "1.400,00", "aggregate": "10", "meta": "12.5", "text": "90", "text_symbol": "65.00"}
    pages = []
    for k, html in extraction.TEMPLATES.items():
        for mark in ("DOT", "COMMA", "TEXT"):
            html = html.replace(mark, texts.get(k, "9"))
        pages.append((k, html.replace("NAME", k.title()).replace("KEY", "5")))
    out = {r.url: r.product for r in extract.products(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert (out["root"].price, out["root"].currency) == (1400.0, "OMR")
    assert (out["graph"].name, out["graph"].brand, out["graph"].price) == ("Graph", "Acme", 9.0)
    assert (out["main_entity"].sku, out["main_entity"].gtin) == ("S5", "00012345")
    assert out["aggregate"].price == 10.0 and out["nested_price"].price == 1400.0 and out["broken_then_good"].name == "Broken_Then_Good"
    assert (out["meta"].price, out["meta"].currency, out["meta"].availability) == (12.5, "USD", "in_stock")
    assert (out["text"].name, out["text"].price, out["text"].currency, out["text"].availability) == ("Text item", 90.0, "OMR", "in_stock")
    assert (out["text_symbol"].price, out["text_symbol"].availability) == (65.0, "out_of_stock") and out["nothing"] is None


def test_json_ld_to_any_depth(spark):
    leaf = {"@type": "Product", "name": "Deep", "offers": {"price": "3.50", "priceCurrency": "OMR"}}
    docs = {"flat": [leaf]}
    for n in (1, 2, 3, 4, 40):
        doc = leaf
        for i in range(n):
            doc = {"@type": "WebPage", "mainEntity": [{"@type": "Thing"}, doc]} if i % 2 else {"@graph": [{"@type": "Thing"}, doc]}
        docs[f"nested {n}"] = doc
    docs["lists"] = [[[leaf]]]
    docs["in order"] = {"@graph": [{"mainEntity": {"@graph": [{"mainEntity": leaf}]}}, {"@type": "Product", "name": "Later"}]}
    docs["not down"] = {"@type": "WebPage", "about": leaf, "note": "@graph @graph mainEntity"}
    rows = [(k, extraction._ld(v)) for k, v in docs.items()] + [("none", None), ("empty", "")]
    out = {r.url: r.product for r in extract.products(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert {k for k, v in out.items() if v is None} == {"not down", "none", "empty"}
    assert all((v.name, v.price, v.currency) == ("Deep", 3.5, "OMR") for v in out.values() if v is not None)


def test_platform_rows(spark):
    shop = {"id": 1, "title": "Tee", "handle": "tee", "vendor": "V", "tags": "a, b,", "variants": [{"price": "0"}, {"price": "5.50", "compare_at_price": "8", "inventory_quantity": 2, "sku": "X"}]}
    woo = {"id": 2, "name": " Mat ", "slug": "mat", "price": "1,200", "regular_price": "1,500", "meta_data": [{"key": "_ean", "value": "4006381333931"}], "stock_status": "outofstock"}
    big = {"id": 3, "name": "Ball!", "price": 20, "calculated_price": 15, "availability": "available", "custom_url": {"url": "/ball/"}}
    of = lambda x: spark.createDataFrame([("https://s.example", json.dumps(x))], "origin string, json string")
    every = platforms.shopify(of(shop)).unionByName(platforms.woocommerce(of(woo))).unionByName(platforms.bigcommerce(of(big)))
    out = {r.name: r for r in every.withColumn("tags", F.size("tags")).collect()}
    assert (out["Tee"].price, out["Tee"].compare_at, out["Tee"].available, out["Tee"].tags) == (5.5, 8.0, True, 2)
    assert (out["Mat"].price, out["Mat"].gtin, out["Mat"].available) == (1200.0, "4006381333931", False)
    assert (out["Ball!"].price, out["Ball!"].compare_at, out["Ball!"].url) == (15.0, 20.0, "https://s.example/ball/")
    rows = spark.createDataFrame([("https://s.com", "https://s.com/p/x", 7, "https://m.com/", '{"en":{"product_name":"X"},"basic":{"product_sku":" K "}}')], "origin string, url string, product_id long, media_base string, json string")
    fetched = spark.createDataFrame([(7, "100", "90", "95", 0, True)], "product_id long, item_retail_price string, item_sale_price string, price_with_tax string, website_stock long, serviceable boolean")
    r = platforms.storefront(rows, platforms.storefront_prices(fetched)).first()
    assert (r.name, r.price, r.compare_at, r.available, r.sku) == ("X", 95.0, 100.0, True, "K")


def test_sitemap_bodies(spark):
    bodies = [
        ("https://s.example/sitemap.xml", "<?xml version='1.0'?><sitemapindex><sitemap><loc>https://s.example/product-sitemap.xml</loc></sitemap><sitemap><loc>https://s.example/image-sitemap.xml</loc></sitemap></sitemapindex>"),
        ("https://s.example/product-sitemap.xml", "<urlset><url><loc><![CDATA[https://s.example/product/a]]></loc><lastmod>2024-01-01</lastmod></url><url><loc>https://s.example/product/b</loc></url></urlset>"),
        ("https://s.example/page.xml", "<!DOCTYPE html><html><loc>https://s.example/x</loc></html>"),
    ]
    docs = spark.createDataFrame(bodies, "url string, body string")
    assert sorted(tuple(r) for r in sitemaps.entries(docs).select("loc", "lastmod").collect()) == [("https://s.example/product/a", "2024-01-01"), ("https://s.example/product/b", None)]
    found = sitemaps.reached(docs, docs.where("url LIKE '%/sitemap.xml'").select("url"))
    assert sorted((r.url[18:], r.depth) for r in found.collect()) == [("product-sitemap.xml", 1), ("sitemap.xml", 0)]
    assert {r.outcome for r in sitemaps.outcome(docs.withColumn("error", F.lit(None).cast("string"))).collect()} == {"ok", "html"}
    roots = docs.select("url").limit(1)
    assert sitemaps.product_only(docs, docs.where("url LIKE '%/sitemap.xml'").select("url")).first().product_only
    assert roots.count() == 1


def test_samples(spark):
    df = spark.range(100)
    assert [r.id for r in readpath.stratified(df, ["id"], 4).orderBy("id").collect()] == [0, 25, 50, 75]
    assert len(readpath.spread(df, ["id"]).collect()) == 25
