"""Every registered query of the library against its SQL on the smallest test data."""

from __future__ import annotations

import math
import re
from urllib.parse import urldefrag, urljoin, urlsplit

import duckdb
import pytest

from shelfscope import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in records], key=repr)


def same(spark, query, sql, data=DATA):
    out = query(spark, data)
    relation = connect(data).sql(sql)
    assert sorted(out.columns) == sorted(relation.columns)
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == rows(relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, plans.queries()[name], plans.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_link_bfs_by_brute_force(spark, tmp_path):
    a = lambda *links: "".join(f'<a class="x" href="{x}">l</a>' for x in links)
    pages = [
        ("https://a.example/", a("/1", "https://other.example/x", "mailto:a@b", "shop/3", "HTTPS://A.example/4", "//a.example/ü", "#top")),
        ("https://a.example/shop/3", a("5", "../6?q=1", "./deep/", "?page=2", "/1")),
        ("https://a.example/shop/5#top", a("/7")),
        ("https://a.example/shop/deep/", a("..", "8", "9", "10")),
        ("https://a.example/7", a("/too-deep")),
        ("https://a.example/lost", a("/lost/2")),
        ("http://b.example/x", a("y", "z", "w")),
        ("http://b.example/w", a("/x", "v")),
        ("http://c.example/2", a("/1")),
        ("http://c.example/1", a("/2", "/3", "/3")),
        ("http://many.example", a(*(f"/{i:03}" for i in range(90)))),
        (None, a("/none")),
    ]
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    known = {}
    for url, html in pages[:-1]:
        url = urldefrag(urljoin(url, urlsplit(url).path or "/"))[0]
        found = [urldefrag(urljoin(url, x))[0].replace("ü", "%C3%BC") for x in re.findall('href="([^"#]+)"', html)]
        known[url] = [re.sub("(?i)^https://a.example", "https://a.example", x) for x in found]
    site = lambda u: "/".join(u.split("/")[:3])
    want = {}
    for root in ("https://a.example/", "http://b.example/w", "http://c.example/1", "http://many.example/"):
        level, seen = [root], {root: 0}
        for depth in (1, 2, 3):
            level = sorted({x for u in level for x in known.get(u, []) if site(x) == site(root)} - set(seen))
            seen |= dict.fromkeys(level, depth)
        want |= dict(sorted(seen.items(), key=lambda x: x[::-1])[:60])
    got = plans.queries()["link_bfs"](spark, str(tmp_path)).collect()
    assert {r.url: r.depth for r in got} == want and len(got) == len(want)
    assert "https://a.example/shop/deep/10" in want and "https://a.example/6?q=1" in want and "https://a.example/too-deep" not in want
