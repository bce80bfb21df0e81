from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import cursors, names, numbers, prices, times, urls

GTIN = "0012345678905"


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_identity_key_takes_the_first_usable_code(spark):
    rows = [
        (GTIN, None, "ABC-1", "https://x/p/blue-tshirt", None),
        (None, GTIN, None, None, None),
        ("123", None, "Xyz-123", "https://x/p/b", None),
        (None, None, "Xyz-123!", "https://x/p/b", None),
        (None, None, None, "https://x/p/Blue-Tshirt", None),
        (None, None, None, "https://x/p", "n"),
    ]
    key = names.identity_key(F.col("g"), F.col("s"), F.col("u"), F.col("n"), F.col("b"))
    out = values(spark, key, rows, "g string, b string, s string, u string, n string")
    assert out[:5] == [f"gtin:{GTIN}", f"gtin:{GTIN}", "sku:xyz123", "sku:xyz123", "slug:blue-tshirt"]
    assert out[5].startswith("url:") and len(out[5]) == 44


def test_host_key_and_origin_host(spark):
    rows = [("https://www.shop.example.com/x",), ("shop.example.com",), ("not a url",), ("https://www.Shop.com:8080/p q|r",)]
    assert values(spark, urls.host_key(F.col("u")), rows, "u string") == ["shop.example.com", "shop.example.com", "not a url", "shop.com"]
    assert values(spark, urls.origin_host(F.col("u")), rows[3:], "u string") == ["shop.com:8080"]


def test_url_classes(spark):
    rows = [("https://x.com/uae-en/blog/x",), ("https://x.com/t/treadmills-in-dubai",), ("https://x.com/product/x",), ("https://x.com/a/includes-in-it",), (None,)]
    assert values(spark, urls.has_junk(F.col("u")), rows, "u string")[:4] == [True, True, False, False]
    assert values(spark, urls.is_product(F.col("u")), rows, "u string") == [False, False, True, False, False]


def test_tokens_and_trigrams(spark):
    rows = [("USB-C Cable 2m",), ("  Blue T-Shirt  ",), ("",), (None,)]
    assert values(spark, names.tokens(F.col("n")), rows, "n string") == [["usb", "c", "cable", "2m"], ["blue", "t", "shirt"], [], []]
    grams = values(spark, names.trigrams(F.col("n")), [("Nike Air",), ("",)], "n string")
    assert "nik" in grams[0] and "air" in grams[0] and len(grams[0]) == len(set(grams[0])) and grams[1] == []


@pytest.mark.parametrize(("a", "b", "want"), [("", "x", 0.0), ("a b", "a b", 1.0), ("a b c d", "a b c", 0.75), ("gaming headset", "gaming headset rgb", 0.6 + 0.35 * 14 / 18), ("abcd", "abxd", 0.75)])
def test_similarity_rules(spark, a, b, want):
    assert values(spark, names.similarity(F.col("a"), F.col("b")), [(a, b)], "a string, b string")[0] == pytest.approx(want)


def test_half_up_and_percent(spark):
    assert values(spark, numbers.half_up(F.col("x")), [(-2.5,), (2.5,), (0.49,)], "x double") == [-2, 3, 0]
    assert values(spark, numbers.percent(F.col("a"), F.col("b")), [(1, 3), (1, 0)], "a int, b int") == [33.3, 0.0]
    assert [numbers.clamp_int(v, f, lo, hi) for v, f, lo, hi in ((50, 50, 1, 200), (0, 50, 1, 200), (999, 50, 1, 200), ("abc", 25, 1, 200))] == [50, 50, 200, 25]


def test_usd_and_changes(spark):
    rows = [(100.0, "USD", None), (367.25, "AED", 3.6725), (0.0, "AED", 3.6725), (5.0, "", 1.0), (5.0, "XXX", None)]
    assert values(spark, prices.to_usd(F.col("p"), F.col("c"), F.col("r")), rows, "p double, c string, r double") == [100.0, 100.0, None, None, None]
    change = prices.change_percent(F.col("a"), F.col("b"))
    assert values(spark, change, [(100.0, 80.0), (100.0, 115.0), (0.0, 10.0), (100.0, float("nan"))], "a double, b double") == [-20.0, 15.0, None, None]
    assert values(spark, prices.change_severity(F.col("p")), [(-25.0,), (15.0,), (-8.0,), (4.9,), (None,)], "p double") == ["high", "high", "medium", "low", "low"]


def test_cursor_round_trip_and_rejection(spark):
    made = values(spark, cursors.encode(F.col("t"), F.col("i")), [(1700000000000, "64b000000000000000000001")], "t long, i string")
    back = spark.createDataFrame([(made[0],), ("",), ("not-base64!!",), ("bm8tc2VwYXJhdG9y",), ("YWJjfG5vdGFuaWQ",), (None,)], "c string").select(cursors.decode(F.col("c")).alias("d")).collect()
    assert back[0].d.ts == 1700000000000 and back[0].d.id == "64b000000000000000000001"
    assert all(r.d is None for r in back[1:])


def test_store_keys_and_patterns(spark):
    rows = [("Shop.Example.COM ",), ("localhost",), ("a.b.c",), ("https://x",), ("x/y",), ("x:80",), ("",), ("bad_host",)]
    assert values(spark, urls.store_key(F.col("k")), rows, "k string") == ["shop.example.com", "localhost", "a.b.c", None, None, None, None, None]
    assert urls.literal_pattern("nike (air) [2024] +$") == r"nike \(air\) \[2024\] \+\$"
    assert values(spark, numbers.string_hash(F.col("s")), [("abc",)], "s string") == [96354]


def test_times(spark):
    assert values(spark, times.backoff_ms(F.col("n")), [(0,), (3,), (20,)], "n int") == [15000, 120000, 900000]
    asked = times.retry_after_ms(F.col("v"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert values(spark, asked, [("120",), ("Mon, 01 Jan 2024 00:00:30 GMT",)], "v string") == [120000, 30000]


def test_links_resolve_against_their_page(spark):
    rows = [("/a", "https://x.com/p/q?z"), ("b", "https://x.com/p/q"), ("//y.com/c", "https://x.com/"), ("?k=1", "https://x.com/p"), ("mailto:a@b", "https://x.com/"), ("d#e", "https://x.com")]
    assert values(spark, urls.absolute(F.col("h"), F.col("b")), rows, "h string, b string") == ["https://x.com/a", "https://x.com/p/b", "https://y.com/c", "https://x.com/p?k=1", None, "https://x.com/d"]


def test_crawl_request_is_brought_within_its_limits():
    from shelfscope.functions.requests import SWITCHES, crawl_request

    r = crawl_request({"origin": " https://s.example ", "type": "shallow", "delay_ms": 5, "concurrency": "99", "max_pages": "0", "pattern": "x" * 300, "locale": " EN-us-Long-Tag", "collections": ["a", 1], "use_browser": False, "user_agent": "browser"})
    assert (r.origin, r.type, r.full_crawl, r.delay_ms, r.concurrency, r.max_pages) == ("https://s.example", "shallow", False, 100, 12, 1)
    assert (len(r.pattern), r.locale, r.collections, r.browser_agent) == (200, "en-us-long", ("a",), True)
    assert r.flags == {s: s != "use_browser" for s in SWITCHES}
    d = crawl_request({"origin": "http://s", "delay_ms": "soon", "max_pages": ""})
    assert (d.type, d.full_crawl, d.delay_ms, d.concurrency, d.max_pages, d.pattern, d.locale, d.proxy) == ("deep", True, 1000, 2, None, None, None, None)
    for bad in ({}, {"origin": "ftp://x"}, {"origin": "http://s", "proxy": "p"}, {"origin": "http://s", "max_pages": "many"}):
        with pytest.raises(ValueError):
            crawl_request(bad)
