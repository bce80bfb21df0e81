"""Where the walk through a store's pages of products stops.

Pages of a store (origin, page from 1, items, total_pages or null) are read in order while none of
these has happened: the products read so far have reached the bound, the reported number of pages is
used up (both before a page is read), a page was empty, or, where no number of pages is reported, a
page was shorter than asked for (both after it was read). Missing pages end the walk too.

A window finds the first stop of each store; its running sums go over one store's pages, of which the
bound allows few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: products after which a walk stops.
MOST = 10_000


def _marked(pages: DataFrame, size: int, most: int | None) -> DataFrame:
    """pages with stop_before and stop_after, why the walk ends before or after a page, if it does."""
    earlier = Window.partitionBy("origin").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("page") != F.coalesce(F.max("page").over(earlier), F.lit(0)) + 1
    full = F.coalesce(F.sum("items").over(earlier), F.lit(0)) >= F.lit(most) if most is not None else F.lit(False)
    before = F.when(gap, "end").when(full, "limit").when(F.col("page") > F.col("total_pages"), "total")
    after = F.when(F.col("items") == 0, "empty").when(F.col("total_pages").isNull() & (F.col("items") < size), "short")
    return pages.withColumns({"stop_before": before, "stop_after": after})


def _walked(pages: DataFrame, size: int, most: int | None) -> DataFrame:
    """_marked() with the pages that are read, and the one before which the walk stops."""
    marked = _marked(pages, size, most)
    upto = Window.partitionBy("origin").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.col("stop_before").isNotNull() | F.col("stop_after").isNotNull()).over(upto), F.lit(False))
    return marked.withColumn("_over", stopped).where("NOT _over").drop("_over")


def read_pages(pages: DataFrame, size: int, most: int | None = None) -> DataFrame:
    """The pages that the walk reads. size: products that each page was asked for; most: the bound on
    products, none if None."""
    return _walked(pages, size, most).where("stop_before IS NULL").drop("stop_before", "stop_after")


def stops(pages: DataFrame, size: int, most: int | None = MOST) -> DataFrame:
    """(origin, pages, items, stop) of each store: how many pages are read, their products, and why the
    walk stops (limit, total, empty, short, or end of what is there)."""
    walked = _walked(pages, size, most)
    read = F.col("stop_before").isNull()
    return walked.groupBy("origin").agg(
        F.count_if(read).alias("pages"),
        F.coalesce(F.sum(F.when(read, F.col("items"))), F.lit(0)).alias("items"),
        F.coalesce(F.max("stop_before"), F.max("stop_after"), F.lit("end")).alias("stop"),
    )
