"""One-to-one assignment by the greedy rule "each of mine, in order, takes the best of theirs that is free".

Three steps, each on what the one before left:

1. An edge that both ends like best is taken: the row of mine prefers it and no earlier row of mine
   has an edge to its other end. Where all are like that, as with unique keys, one pass is all.
2. The edges left fall into components, found by contraction: in each round every node joins the
   neighbour of least hash, joined nodes become one, and edges inside are dropped, which leaves a
   constant share of the nodes; hashes are new in each round, so a chain shrinks as fast as a star. The
   greedy rule in one component owes nothing to another. Components of no more than `most` edges are
   dealt into groups of about that size, and each group is solved in one task in order of mine.
   No more edges than that in all are one group.
3. Larger components go through rounds in which every row of mine asks for its best edge and an edge
   goes when an earlier row holds its other end, until they have fallen apart into small ones.

What a round leaves is written as a table of known size, and rows meet their keys in merge joins: the
driver neither holds estimates that grow with each round nor rows to broadcast.

Nodes are told by 64-bit hashes when components are found. Two of equal hash would at most join two
components, which changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.sources.stored import removed
from shelfscope.sources.stored import written as checkpointed

#: Edges that one task solves, about.
GROUP = 100_000
#: Rounds of asking between two searches for components.
ROUNDS = 4
#: Pairs of rows for each row and edge of a component of names, up to which it is unfolded into them.
COPIES = 4


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of a graph given by its edges between whole numbers."""
    spark, levels, n = edges.sparkSession, [], 0
    left = checkpointed(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    nodes = edges.select(F.col(u).alias("node")).union(edges.select(v)).distinct()
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c, n=n: F.xxhash64(c, F.lit(n))
        least = both.groupBy("u").agg(F.min_by("v", F.struct(rank("v"), "v")).alias("v"))
        own, other = F.struct(rank("u"), "u"), F.struct(rank("v"), "v")
        joined = checkpointed(least.select(F.col("u").alias("node"), F.when(other < own, F.col("v")).otherwise(F.col("u")).alias("into")))
        levels.append(joined)
        moved = left.join(joined.withColumnsRenamed({"node": "u", "into": "_u"}).hint("merge"), "u").join(joined.withColumnsRenamed({"node": "v", "into": "_v"}).hint("merge"), "v")
        before, left = left, checkpointed(moved.where("_u <> _v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct())
        removed(before)
        n += 1
    if not levels:
        return nodes.withColumn("component", F.col("node"))
    # From the last level back: levels shrink by a constant share, so all of them are about one table.
    known = spark.createDataFrame([], "node long, component long")
    for level in reversed(levels):
        up = known.withColumnsRenamed({"node": "into"})
        before, known = known, checkpointed(level.join(up.hint("merge"), "into", "left").select("node", F.coalesce("component", "into").alias("component")))
        removed(before, level)
        # A node into which others went but which itself went on is in the level, one that stayed is too.
    return nodes.join(known.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _node(side: int, by: Sequence[str], column: str) -> Column:
    return F.xxhash64(F.lit(side), *by, column)


def _solved(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """The greedy rule in each group (_group) of whole components."""
    out = edges.drop("pref", "passes", "_group").schema
    keys = list(by)

    def solve(group: pa.Table) -> pa.Table:
        stores = list(zip(*(group.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * group.num_rows
        mine, theirs, pref, passes = (group.column(c).to_pylist() for c in ("mine", "theirs", "pref", "passes"))
        first = {s: k for k, s in enumerate(dict.fromkeys(stores))}
        taken, done, rows = set(), set(), []
        for k in sorted(range(len(mine)), key=lambda k: (first[stores[k]], mine[k], pref[k])):
            asks, wants = (stores[k], mine[k]), (stores[k], theirs[k])
            if asks in done or wants in taken:
                continue
            done.add(asks)  # the best that is free decides, whether it passes or not
            if passes[k]:
                taken.add(wants)
                rows.append(k)
        return group.select([f.name for f in out]).take(pa.array(rows, pa.int64()))

    return edges.groupBy("_group").applyInArrow(solve, out)


def assigned(edges: DataFrame, by: Sequence[str] = (), most: int = GROUP) -> DataFrame:
    """One-to-one pairs by the greedy rule in each store, from edges (by, mine, theirs, pref, passes,
    ...): columns but pref and passes. Of a pair's edges the preferred one counts; equal preferences
    of a row of mine must not occur. most: edges that one task solves."""
    edges = checkpointed(edges)
    best = Window.partitionBy(*by, "mine").orderBy("pref")
    earliest = Window.partitionBy(*by, "theirs")
    marked = edges.withColumn("_n", F.row_number().over(best)).withColumn("_first", F.min("mine").over(earliest) == F.col("mine"))
    sure = checkpointed(marked.where("_n = 1 AND _first AND passes").select(*edges.columns))
    out = sure.drop("pref", "passes")
    left = edges.join(sure.select(*by, "mine").hint("merge"), [*by, "mine"], "left_anti").join(sure.select(*by, "theirs").hint("merge"), [*by, "theirs"], "left_anti")
    names, before = edges.columns, edges
    left = checkpointed(left.select(*names))
    removed(before)
    while n := left.count():
        if n <= most:
            return out.unionByName(checkpointed(_solved(left.withColumn("_group", F.lit(0)), by)))
        ends = checkpointed(left.withColumn("u", _node(0, by, "mine")).withColumn("v", _node(1, by, "theirs")))
        parts = ends.join(components(ends).withColumnRenamed("node", "u").hint("merge"), "u").drop("u", "v")
        sizes = parts.groupBy("component").agg(F.count("*").alias("_size"))
        parts = checkpointed(parts.join(sizes.hint("merge"), "component"))
        removed(left, ends)
        small = parts.where(F.col("_size") <= most)
        groups = max(1, 2 * small.count() // most)
        solved = small.withColumn("_group", F.pmod(F.xxhash64("component"), F.lit(groups))).drop("component", "_size")
        out = out.unionByName(checkpointed(_solved(solved, by)))
        left = checkpointed(parts.where(F.col("_size") > most).select(*names))
        removed(parts)
        settled, left = _asked(left, by)
        out = out.unionByName(settled)
    return out


def _asked(edges: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Some rounds of asking: the pairs that are settled, and the edges that are left."""
    best = Window.partitionBy(*by, "mine").orderBy("pref")
    earliest = Window.partitionBy(*by, "theirs")
    out, names = None, edges.columns
    for _ in range(ROUNDS):
        marked = edges.withColumn("_n", F.row_number().over(best)).withColumn("_first", F.min("mine").over(earliest) == F.col("mine"))
        marked = checkpointed(marked.withColumn("_asked", (F.col("_n") == 1) & F.col("passes")))
        removed(edges)
        sure = checkpointed(marked.where("_asked AND _first").select(*names))
        # A row of mine whose best edge left doesn't pass gets nothing.
        ended = marked.where("_n = 1 AND NOT passes AND _first").select(*by, "mine")
        held = marked.where("_asked").groupBy(*by, "theirs").agg(F.min("mine").alias("_holder"))
        gone = sure.select(*by, "mine").unionByName(ended)
        left = marked.join(gone.hint("merge"), [*by, "mine"], "left_anti").join(sure.select(*by, "theirs").hint("merge"), [*by, "theirs"], "left_anti")
        left = left.join(held.hint("merge"), [*by, "theirs"], "left").where("_holder IS NULL OR _holder >= mine")
        edges = checkpointed(left.select(*names))
        removed(marked)
        own = sure.drop("pref", "passes")
        out = own if out is None else out.unionByName(own)
    return out, edges


def _tied(edges: list[tuple]) -> dict[tuple, list[tuple[dict, list[tuple]]]]:
    """For each class of mine the classes of theirs that it may take, those of equal rank together."""
    out: dict[tuple, list[tuple[dict, list[tuple]]]] = {}
    for a, b, rank, told in sorted(edges, key=lambda e: (e[0], e[2])):
        groups = out.setdefault(a, [])
        if groups and groups[-1][0]["rank"] == rank:
            groups[-1][1].append((b, told))
        else:
            groups.append(({"rank": rank}, [(b, told)]))
    return out


def _taken(mine: list[tuple], theirs: list[tuple], edges: list[tuple]) -> list[tuple]:
    """(mine, theirs, what the edge tells): the greedy rule over rows (order, class) of both sides. The
    rows of a class of theirs go in their order, so the first that is free stands for all."""
    free: dict[tuple, list] = {}
    for order, b in sorted(theirs, key=lambda t: t[0], reverse=True):
        free.setdefault(b, []).append(order)
    choice, out = _tied(edges), []
    at = dict.fromkeys(choice, 0)
    for order, a in sorted(mine, key=lambda m: m[0]):
        groups = choice.get(a, [])
        while at.get(a, 0) < len(groups):
            group = groups[at[a]][1]
            open_ = [(free[b][-1], b, told) for b, told in group if free.get(b)]
            if open_:
                first, b, (passes, *told) = min(open_, key=lambda x: x[0])
                if passes:  # else the row gets nothing, and leaves what it asked for
                    free[b].pop()
                    out.append((order, first, told))
                break
            at[a] += 1  # what is used up stays so
    return out


def _solved_classes(rows: DataFrame, by: Sequence[str], schema: str) -> DataFrame:
    keys = list(by)
    names = [*keys, "mine", "theirs", "method", "confidence"]

    def solve(group: pa.Table) -> pa.Table:
        out, stores = [], {}
        for r in group.to_pylist():
            store = stores.setdefault(tuple(r[k] for k in keys), ([], [], []))
            if r["side"] == 2:
                store[2].append((r["a"], r["b"], tuple(r["rank"]), (r["passes"], r["method"], r["confidence"])))
            else:
                store[r["side"]].append((r["ord"], r["a"] if r["side"] == 0 else r["b"]))
        for key, (mine, theirs, edges) in stores.items():
            out += [(*key, m, t, *told) for m, t, told in _taken(mine, theirs, edges)]
        types = [group.schema.field(k).type for k in keys] + [pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=names)

    return rows.groupBy("_group").applyInArrow(solve, schema)


def assigned_classes(mine: DataFrame, theirs: DataFrame, edges: DataFrame, by: Sequence[str] = (), most: int = 10 * GROUP) -> DataFrame:
    """(by, mine, theirs, method, confidence): the greedy rule where a row's name alone decides.

    mine (by, ord, a) and theirs (by, ord, b) are rows with their names, edges (by, a, b, rank, method,
    confidence) tell once for a pair of names what all their rows share; of theirs with equal rank the
    first in order is best. A column `passes` tells edges that end a row's search without a pair; without
    it all pass. So copies of a name cost a row each and not a pair each. Components of no
    more than `most` rows and edges are solved in a task each or together. A larger one is unfolded into
    pairs of rows if these are no more than COPIES times its rows and edges, else its rows of mine are
    solved in portions, one after the other.
    """
    passes = F.col("passes") if "passes" in edges.columns else F.lit(True).alias("passes")
    edges = checkpointed(edges.select(*by, "a", "b", "rank", "method", "confidence", passes))
    ends = edges.select(*by, "a", "b", _node(0, by, "a").alias("u"), _node(1, by, "b").alias("v"))
    parts = components(ends)
    blank = {"ord": "long", "a": "string", "b": "string", "rank": "array<double>", "method": "string", "confidence": "long", "passes": "boolean"}

    def rows(df: DataFrame, side: int, node: Column) -> DataFrame:
        own = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()]
        return df.select(*by, *own, F.lit(side).alias("side"), node.alias("node")).join(parts.hint("merge"), "node").drop("node")

    both = rows(mine, 0, _node(0, by, "a")).unionByName(rows(theirs, 1, _node(1, by, "b"))).unionByName(rows(edges, 2, _node(0, by, "a")))
    both = checkpointed(both)
    sizes = checkpointed(both.groupBy("component").agg(F.count("*").alias("_size")))
    groups = max(1, 2 * (sizes.where(F.col("_size") <= most).agg(F.sum("_size")).first()[0] or 0) // most)
    # Large components are few: no more than all rows by `most`.
    large = sizes.where(F.col("_size") > most).select("component")
    small = both.join(large, "component", "left_anti").withColumn("_group", F.pmod(F.xxhash64("component"), F.lit(groups)))
    schema = ", ".join([*(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in by), "mine long, theirs long, method string, confidence long"])
    out = _solved_classes(small.drop("component"), by, schema)
    if large.isEmpty():
        return checkpointed(out)
    rest = checkpointed(both.join(large, "component", "left_semi"))
    told = _told(rest, by)
    counts = checkpointed(told.groupBy("component").agg(F.sum(F.col("_mine") * F.col("_theirs")).alias("_pairs"), F.sum("_mine").alias("_wanted")).join(sizes.hint("merge"), "component"))
    many = counts.where(F.col("_pairs") > COPIES * F.col("_size"))
    out = checkpointed(out)
    if not many.isEmpty():
        out = out.unionByName(_in_turn(rest.join(many.select("component"), "component", "left_semi"), many, by, schema, most))
        rest = rest.join(many.select("component"), "component", "left_anti")
    one, two = rest.where("side = 0").select(*by, "a", F.col("ord").alias("mine")), rest.where("side = 1").select(*by, "b", F.col("ord").alias("theirs"))
    pairs = rest.where("side = 2").select(*by, "a", "b", "rank", "method", "confidence", "passes").join(one.hint("merge"), [*by, "a"]).join(two.hint("merge"), [*by, "b"])
    pairs = pairs.select(*by, "mine", "theirs", F.concat("rank", F.array(F.col("theirs").cast("double"))).alias("pref"), "method", "confidence", "passes")
    return out.unionByName(assigned(pairs, by))


def _told(rest: DataFrame, by: Sequence[str]) -> DataFrame:
    """Edges between names with the rows that have these: _mine and _theirs."""
    key = ["component", *by]
    one = rest.where("side = 0").groupBy(*key, "a").agg(F.count("*").alias("_mine"))
    two = rest.where("side = 1").groupBy(*key, "b").agg(F.count("*").alias("_theirs"))
    return rest.where("side = 2").drop("ord").join(one.hint("merge"), [*key, "a"]).join(two.hint("merge"), [*key, "b"])


def _in_turn(rest: DataFrame, counts: DataFrame, by: Sequence[str], schema: str, most: int) -> DataFrame:
    """The greedy rule in components of many copies: rows of mine in portions by their order, each with no
    more of theirs than it can take, the first that are free, so that a task holds about `most` rows."""
    key, names = ["component", *by], rest.columns
    share = counts.select("component", F.greatest(F.lit(1), F.floor(most / (1 + 2 * F.col("_wanted") / F.col("_size")))).alias("_portion"))
    turn, first = Window.partitionBy("component").orderBy("ord"), Window.partitionBy(*key, "b").orderBy("ord")
    one = rest.where("side = 0").withColumn("_n", F.row_number().over(turn)).join(share.hint("merge"), "component")
    one = checkpointed(one.withColumn("_turn", F.floor((F.col("_n") - 1) / F.col("_portion"))).drop("_n", "_portion"))
    two, edges, out = checkpointed(rest.where("side = 1")), checkpointed(rest.where("side = 2")), None
    for k in range(one.agg(F.max("_turn")).first()[0] + 1):
        own = one.where(F.col("_turn") == k).drop("_turn")
        wants = own.groupBy(*key, "a").agg(F.count("*").alias("_n"))
        asked = edges.join(wants.hint("merge"), [*key, "a"])
        room = asked.groupBy(*key, "b").agg(F.sum("_n").alias("_n"))
        near = two.withColumn("_place", F.row_number().over(first)).join(room.hint("merge"), [*key, "b"]).where("_place <= _n")
        rows = own.unionByName(near.select(*names)).unionByName(asked.select(*names))
        got = checkpointed(_solved_classes(rows.withColumnRenamed("component", "_group"), by, schema))
        out = got if out is None else out.unionByName(got)
        before, two = two, checkpointed(two.join(got.select(*by, F.col("theirs").alias("ord")).hint("merge"), [*by, "ord"], "left_anti"))
        removed(before)
    return out
