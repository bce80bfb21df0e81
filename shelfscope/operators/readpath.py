"""Reading pages of rows: offset and keyset paging, search, top lists, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import cursors
from shelfscope.functions.times import millis
from shelfscope.sources.stored import checkpointed


def offset_page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of a total order; the size is kept within 1 to 100, the page within those there are."""
    size = max(1, min(100, size))
    if page > 0:
        page = min(page, max(0, -(-df.count() // size) - 1))
    return df.orderBy(*order).offset(max(0, page) * size).limit(size)


def picker(df: DataFrame, taken: DataFrame, text: str, name: str, n: str) -> DataFrame:
    """What can still be picked: not taken yet, with the text in its name in any case, most first."""
    free = df.join(taken.select(name), name, "left_anti")
    return free.where(F.contains(F.lower(name), F.lower(F.lit(text.strip())))).orderBy(F.desc(n), name)


def keyset_page(df: DataFrame, ts: str, key: str, size: int, after: tuple[object, str] | None = None) -> DataFrame:
    """The rows after a cursor in the order (ts desc, key desc), one more than asked for, with
    `has_more` on each: drop the row numbered size + 1."""
    rows = df
    if after is not None:
        t, k = F.lit(after[0]), F.lit(after[1])
        rows = df.where((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) < k)))
    top = rows.orderBy(F.desc(ts), F.desc(key)).limit(size + 1)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(ts), F.desc(key))
    numbered = top.withColumn("n", F.row_number().over(order)).withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > size)
    return numbered.where(F.col("n") <= size)


def next_cursor(page: DataFrame, ts: str, key: str) -> DataFrame:
    """The cursor that continues a page; null on the last one."""
    last = F.max_by(F.struct(ts, key, "has_more"), "n")
    end = page.agg(last.alias("e")).select(millis(F.col(f"e.{ts}")).alias("ms"), F.col(f"e.{key}").alias("id"), "e.has_more")
    return end.select(F.when(F.col("has_more"), cursors.encode(F.col("ms"), F.col("id"))).alias("cursor"))


def search(df: DataFrame, query: str, *columns: str, most: int = 200) -> DataFrame:
    """Rows in one of whose columns, taken together, the query occurs literally, in any case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(query[:most]))))


def tail(values: str | Column, n: int) -> Column:
    """The last n elements of an array."""
    a = F.col(values) if isinstance(values, str) else values
    return F.slice(a, F.greatest(F.size(a) - n, F.lit(0)) + 1, n)


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with rn, its place in a total order from 0: rows are dealt out by ranges of the order, and
    each range counts on from the sizes of those before it, so that no task has all rows."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(bases), "_part").withColumn("rn", F.col("_base") + own - 1).drop("_part", "_base")  # a row for each part


def stratified(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """k rows spread evenly: those at floor(i * n / k). All rows if there are no more than k."""
    n = df.count()
    wanted = df.sparkSession.range(min(k, n)).select((F.floor(F.col("id") * n / min(k, n)) if n else F.col("id")).cast("long").alias("rn"))
    return numbered(df, order).join(F.broadcast(wanted), "rn", "left_semi")  # k rows


def spread(df: DataFrame, order: Sequence[str], most: int = 25) -> DataFrame:
    """Every so many rows, `most` at most."""
    step = max(1, df.count() // most)
    return numbered(df, order).where(F.col("rn") % step == 0).orderBy("rn").limit(most)


def ranked(df: DataFrame, column: str, ranks: dict[str, int], *ties: Column) -> DataFrame:
    """Ordered by the rank of a label, unknown labels last."""
    rank = F.lit(None).cast("int")
    for label, n in ranks.items():
        rank = F.when(F.col(column) == label, n).otherwise(rank)
    return df.orderBy(rank.asc_nulls_last(), *ties)


def embedded(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Parents with their children as an ordered array."""
    own = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in children.columns if c not in (key, order))))).alias(name))
    return parents.join(own, key, "left")
