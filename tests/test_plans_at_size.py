"""Plans of steps that larger tables showed to be too dear: broadcasts of growing tables, values computed more than once."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfscope import plans
from shelfscope.operators import assign, matching
from shelfscope.plans import catalogue
from shelfscope.sources import extract
from tests.test_queries import DATA


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_matched_by_merge_joins(spark):
    mine, theirs = (matching.keyed(x) for x in catalogue._catalogues(spark, DATA))
    for df in (matching.exact_edges(mine, theirs), matching.unmatched(mine, mine.select(F.col("ord").alias("mine")), "mine")):
        assert "SortMergeJoin" in physical(df) and "BroadcastHashJoin" not in physical(df)


def test_names_meet_rows_in_merge_joins(spark, monkeypatch):
    mine, theirs = (matching.keyed(x) for x in catalogue._catalogues(spark, DATA))
    plans_, whole = [], assign.checkpointed
    monkeypatch.setattr(assign, "checkpointed", lambda df: plans_.append((df.columns, physical(df))) or whole(df))
    assert matching.fuzzy_matches(mine, theirs).count() > 0
    (both,) = (plan for columns, plan in plans_ if "side" in columns)
    assert both.count("SortMergeJoin") >= 4 and "BroadcastHashJoin" not in both


def test_estimates_do_not_grow_with_the_rounds(spark):
    """Each round joins the last one's table with itself; its digits were cubed with it, and filled the driver."""
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "u long, v long")
    found = assign.components(chain)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
    assert found.select("component").distinct().count() == 1 and found.count() == 61


def test_a_page_has_its_offers_found_once_and_parts_go_to_all_cores(spark):
    out = extract.products(spark.createDataFrame([("u", "<h1>x</h1>")], "url string, html string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_min(") == 1
    for name in ("page_extraction", "extracted_products"):
        assert "REPARTITION_BY_NUM" in physical(plans.queries()[name](spark, DATA))


def test_prices_of_a_product_meet_in_one_shuffle_of_all_its_parts(spark):
    shuffles = [line for line in physical(plans.queries()["price_range"](spark, DATA)).splitlines() if "Exchange" in line]
    assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0] and "l_suppkey" in shuffles[0] and "l_shipdate" not in shuffles[0]
