"""Mixing sources to target weights, with DataFrame functions alone.

1. Each source's documents, in a fixed order, form one stream of words; it is cut into blocks of
   `block` words, of which the last may be shorter. A source too small for LEAST_BLOCKS such blocks
   has shorter ones, of one word at least.
2. Sources, by code point with null last, have the weights in turn and share `budget` of all words;
   a target stops at `cap` times its source's size and the excess goes to the others by weight.
3. The output is shards of `shard` slots, a block each. For each shard the source counts are drawn
   from the multinomial of the quotas. A quota is the target in the source's own mean block, rounded.
   Draws beyond it are void, and what is missing at the end comes in one more shard, so that each
   source ends within a block or so of its target.
4. A source's slots are numbered through all shards; slot r is block perm(r mod blocks) of pass
   r div blocks. Each pass has its own pseudorandom permutation (the swap-or-not shuffle, a
   bijection for any number of blocks), so a block comes again only after all others have come.
5. Blocks are joined to the documents they hold by index.

Every draw is a hash of its place and the seed, and a document's place follows from its id, size and the
hash of its text alone: reruns agree, however the files are split. Rows equal in all of these, which
cannot be told apart, are placed as runs of up to COPIES and unfolded afterwards. Offsets in a stream
are prefix sums in two steps over as many parts as the square root of the rows, so that a source with
a third of all rows is never sorted in one task. What is kept for each source, one row, is ordered in one task.

packed() gives the mix itself, the pieces of documents in every slot of every shard; mix() how much of
each document it takes.

A null text has size 0 and is never taken. Null ids are kept and come first in their part. Repeated
rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Tables that have been counted to have no more rows than this are broadcast.
SMALL = 50_000
#: Equal rows whose offsets are counted as one run.
COPIES = 1024
#: Blocks into which a source is cut at least, as far as it has words.
LEAST_BLOCKS = 16


def small(df: DataFrame) -> DataFrame:
    """df for a broadcast join if its rows, counted, have the bound; else for a shuffle join."""
    return F.broadcast(df) if df.count() <= SMALL else df


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size) to these with number, weight and target; a row for each source.

    In order of how soon sources reach their cap, the first that stays below it at the level left
    by the earlier ones sets the level of all later ones.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") % len(weights)) + 1).cast("int"))
    rows = sizes.withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    rows = rows.withColumn("most", cap * F.col("source_size"))
    soon = Window.orderBy(F.col("most") / F.col("weight"), "number")
    whole = Window.partitionBy(F.lit(1))
    rows = (
        rows.withColumn("before", F.coalesce(F.sum("most").over(soon.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(soon.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(soon))
        .withColumn("level", (budget * F.sum("source_size").over(whole) - F.col("before")) / F.col("rest"))
        .withColumn("turn", F.min(F.when(F.col("weight") * F.col("level") <= F.col("most"), F.struct("place", "level"))).over(whole))
    )
    below = F.col("place") >= F.col("turn.place")
    return rows.select("source", "source_size", "number", "weight", F.when(below, F.col("weight") * F.col("turn.level")).otherwise(F.col("most")).cast("double").alias("target"))


def permuted(x: Column, n: Column, salt: Column, rounds: int = 12) -> Column:
    """x in [0, n) under a pseudorandom permutation of [0, n) that salt chooses (swap-or-not)."""

    def step(acc: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(salt, i), n) - acc, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(acc, other), salt, i, F.lit("swap")), F.lit(2)) == 1, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def draws(plan: DataFrame, seed: int, shard: int) -> DataFrame:
    """(number, quota) to (shard, number, n): multinomial source counts of each shard, and the last
    shard's that fill the quotas."""
    spark = plan.sparkSession
    total, sources = plan.agg(F.sum("quota"), F.count("*")).first()
    total = total or 0
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    spans = plan.withColumn("high", F.sum("quota").over(upto)).withColumn("low", F.col("high") - F.col("quota")).where("quota > 0")
    # A draw is a point of [0, total); cells of equal width lead to the few sources that it can hit.
    width = max(1, total // max(1, 4 * sources))
    cells = small(spans.withColumn("cell", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}")))).select("cell", "number", "low", "high"))
    slots = spark.range(total).select(F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit("draw")), F.lit(total)).alias("point"))
    hit = slots.withColumn("cell", F.expr(f"point div {width}")).join(cells, "cell").where("low <= point AND point < high")
    counts = hit.groupBy("shard", "number").agg(F.count("*").alias("n"))
    drawn = counts.groupBy("number").agg(F.sum("n").alias("drawn"))
    missing = plan.join(drawn, "number", "left").select(F.lit(-(-total // shard)).cast("long").alias("shard"), "number", (F.col("quota") - F.coalesce("drawn", F.lit(0))).alias("n"))
    return counts.unionByName(missing.where("n > 0"))


def _laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], budget: float, cap: int, block: int, shard: int, part: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """The pieces of documents in each block: doc_id, digest, copy (the number among equal rows), source, size, source_size, target, number,
    index, skip (words of the document before the piece) and words; a document without words has one
    piece without index. And the slots: number, shard, slot, index."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("digest"))
    rows = scratch.save(rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("copies")), "mix-sizes")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    parts = total // part + 1 if part else math.isqrt(total) + 1
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    plan = targets(sizes, weights, budget, cap).withColumn("block", F.expr(f"least({block}L, greatest(1L, source_size div {LEAST_BLOCKS}))"))
    plan = plan.withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    wanted = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0)
    plan = scratch.save(plan.withColumn("quota", F.least(wanted, cap * F.col("blocks"))), "mix-plan")

    known = plan.select(F.col("source").alias("name"), "number", "source_size", "target", "block")
    rows = rows.join(small(known), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    rows = rows.withColumn("copies", F.least(F.col("copies") - F.col("nth"), F.lit(COPIES))).withColumn("part", F.pmod(F.xxhash64("doc_id", "digest", "nth"), F.lit(parts)))
    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("size") * F.col("copies")
    bases = rows.groupBy("number", "part").agg(F.sum(run).alias("total")).select("number", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("number", "part").orderBy("doc_id", "size", "digest", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum(run).over(within), F.lit(0))).join(bases, ["number", "part"])
    placed = placed.withColumn("more", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("copy", F.col("nth") + F.col("more"))
    placed = placed.withColumn("start", F.col("base") + F.col("ahead") + F.col("more") * F.col("size"))
    cut = placed.withColumn("index", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr("start div block"), F.expr("(start + size - 1) div block")))))
    first = F.greatest("start", F.col("index") * F.col("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * F.col("block")) - first
    pieces = cut.select("doc_id", "digest", "copy", "source", "size", "source_size", "target", "number", "index", (first - F.col("start")).alias("skip"), words.alias("words"))

    counts = draws(plan.select("number", "quota"), seed, shard)
    earlier = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("from", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(small(plan.select("number", "quota", "blocks")), "number")
    runs = runs.withColumn("to", F.least(F.col("from") + F.col("n"), F.col("quota"))).where("from < to")
    # The few runs stand for many slots, so they are dealt out before they are unfolded.
    runs = runs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "number", "shard")
    slots = runs.select("number", "blocks", "shard", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("slot"))
    salt = F.xxhash64("number", F.expr("slot div blocks"), F.lit(seed))
    return pieces, slots.select("number", "shard", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), salt).alias("index"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: int = 2, block: int = 256, shard: int = 8192, part: int | None = None, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes, repeats counted), a
    row for each row of docs. part: rows whose offsets are summed in one task, about; the square root
    of all if None."""
    pieces, slots = _laid_out(docs, id_col, text_col, source_col, weights, budget, cap, block, shard, part, seed)
    times = slots.groupBy("number", "index").agg(F.count("*").alias("times"))
    joined = pieces.join(times, ["number", "index"], "left").withColumn("words", F.coalesce(F.col("words") * F.col("times"), F.lit(0)))
    keys = ["doc_id", "digest", "copy", "source", "size", "source_size", "target"]
    return joined.groupBy(*keys).agg(F.sum("words").cast("long").alias("taken")).drop("digest", "copy")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: int = 2, block: int = 256, shard: int = 8192, part: int | None = None, seed: int = 1) -> DataFrame:
    """The mix: shard, source, slot (of its source, through all shards), doc_id, skip and words (the
    piece of the document that stands there), one row for each piece of each slot's block."""
    pieces, slots = _laid_out(docs, id_col, text_col, source_col, weights, budget, cap, block, shard, part, seed)
    return slots.join(pieces, ["number", "index"]).select("shard", "source", "slot", "doc_id", "skip", "words")
