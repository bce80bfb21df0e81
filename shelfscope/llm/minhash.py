"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct five-word shingles (A-Z lower-cased; fewer words make one
shingle). Instead of computing the minhashes of every table, two collections of `half_keys` keys
of two minhashes each are computed, and every pair of a key of the first and one of the second
forms a table key: 4 * half_keys minhashes serve half_keys**2 tables of four minhashes. With 16
half keys a pair of similarity 0.75 shares no table with a probability of 4e-6.

1. Documents with equal shingle sets form a class; only the smallest id goes on.
2. Classes that share no half key with another in either collection drop out before tables are
   formed; the tables hold the rest.
3. Candidates from each table bucket: every member with the bucket's least id, then, of those still
   in different components, with its greatest. So a bucket of thousands of copies costs one or two
   comparisons a member. Members that still lie in different components are then compared through
   what tells them from a common pivot (see _across): no link between components is left untested,
   and no pair is formed that shares nothing else.
4. Candidates are confirmed on the full shingle sets; confirmed links are joined to components by
   alternating star operations, all as shuffles by key.

Null or empty texts have an empty set and are linked with nothing. Rows with a null id come back
with null component and are kept. Repeated rows each come back. Rows with one id must have one
text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm import scratch
from shelfscope.llm.textbytes import SPACES, Words, lower, mix, slices, word_prefix

SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, a array<long>, b array<long>"


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice, repeats included, and the len(docs)+1 offsets of the documents."""
    words = Words(lower(buf), offsets, SPACES)
    prefix = word_prefix(words.hash)
    n = np.diff(words.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=bounds[1:])
    start = np.repeat(words.first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    return prefix.spans(start, start + np.repeat(np.minimum(n, size), count)), bounds


def _signatures(size: int, half_keys: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.Generator(np.random.PCG64(5))
        factor = draw.integers(1, 1 << 63, 4 * half_keys, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = draw.integers(1, 1 << 63, 4 * half_keys, dtype=np.uint64)
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column(1)):
                hashes, bounds = shingles(buf, offsets, size)
                docs = np.flatnonzero(np.diff(bounds))
                starts = bounds[:-1][docs]
                keys = np.zeros((2 * half_keys, j - i), np.uint64)
                for k in range(2 * half_keys if len(docs) else 0):
                    one, two = (np.minimum.reduceat(hashes * factor[x] + shift[x], starts) for x in (2 * k, 2 * k + 1))
                    keys[k, docs] = mix(mix(one) * np.uint64(3) + two + np.uint64(k))
                digests, n = np.zeros((j - i, 2), np.int64), np.zeros(j - i, np.int64)
                for d in docs.tolist():
                    distinct = np.unique(hashes[bounds[d] : bounds[d + 1]])
                    n[d] = len(distinct)
                    digests[d] = np.frombuffer(blake2b(distinct.tobytes(), digest_size=16).digest(), np.int64)
                flat = np.ascontiguousarray(keys.T).view(np.int64)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), half_keys).cast(pa.list_(pa.int64())) for x in (flat[:, :half_keys], flat[:, half_keys:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *lists], ["doc_id", "n_shingles", "s1", "s2", "a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column(1)):
                hashes, bounds = shingles(buf, offsets, size)
                sets = [np.unique(hashes[bounds[d] : bounds[d + 1]]).tobytes() for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(sets, pa.binary())], ["doc_id", "items"])

    return run


def _confirm(part: int, whole: int):
    """Pairs with both sets to the pairs whose similarity is at least part / whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for r, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([one, two])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good[r] = whole * common >= part * (len(both) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], ["x", "y"])

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(x, y) edges to (node, root) with the least node of each component, roots left out.

    Alternates large-star and small-star until every component is a star of its least node.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.select(F.col("x").alias("u"), F.col("y").alias("v"))
        if not small:
            both = both.unionByName(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        out = joined.select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y"))
        if small:
            out = out.unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
        else:
            out = joined.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(least.where("m < u").select(F.col("u").alias("x"), F.col("m").alias("y")))
        return out.where("x > y")

    def settled(e: DataFrame) -> bool:
        """Every node has one root, and no root has another."""
        ends = e.select(F.col("x").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("y").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()

    e = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x > y").distinct()
    last = None
    for _ in range(rounds):
        # A pair that the first star repeats can't change the second's minima, so one distinct serves both.
        e = scratch.save(star(star(e, small=False), small=True).distinct(), "star")
        if last is not None:
            scratch.drop(last)
        last = e
        if settled(e):
            return e.select(F.col("x").alias("node"), F.col("y").alias("root"))
    raise RuntimeError("components did not settle")


def _deltas(part: int, whole: int):
    """Adds to a document what tells it from the pivot: its missing and added shingles (delta), their
    weighed number (base), and by how much it falls short of a link with the pivot (gap)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps, bases, deltas = [], [], []
            for cluster, own, pivot in zip(batch.column("cluster").to_pylist(), batch.column("items"), batch.column("pivot"), strict=True):
                x, r = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(pivot.as_buffer(), np.uint64)
                added, missing = np.setdiff1d(x, r, assume_unique=True), np.setdiff1d(r, x, assume_unique=True)
                gaps.append(part * (len(r) + len(added)) - whole * (len(x) - len(added)))
                bases.append(part * len(added) + whole * len(missing))
                salt = np.uint64(cluster & 0xFFFFFFFFFFFFFFFF)
                deltas.append(np.concatenate([mix(added * np.uint64(2) + np.uint64(1) ^ salt), mix(missing * np.uint64(2) ^ salt)]).view(np.int64))
            sizes = np.r_[0, np.cumsum([len(d) for d in deltas])].astype(np.int32)
            flat = np.concatenate(deltas) if deltas else np.zeros(0, np.int64)
            delta = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "cluster", "root", "away")), pa.array(gaps, pa.int64()), pa.array(bases, pa.int64()), delta], ["doc_id", "cluster", "root", "away", "gap", "base", "delta"])

    return run


def _across(rows: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Candidates (x, y) among members (key, doc_id, root) of one bucket but different components.

    Testing all of them would cost the square of a group of copies. Instead each cluster of mixed
    buckets gets a pivot r, its most central document. Let x not be linked to r, with i common and u
    united shingles, so that its gap g = part * u - whole * i is positive, and let y have D added and
    M missing shingles relative to r. If x and y share s of what tells them from r, their similarity
    is (i - M + s) / (u + D - s): a link needs s >= (part * D + whole * M + g) / (part + whole), about
    half of what tells y from r and more. So one of the rarest rest of y's differences must be among
    x's: mostly added words, which hardly any other copy has. The rest is smaller the greater g is;
    gaps are classed by powers of two for the join, and compared exactly in it. Pairs found so are all
    that can be linked.
    """
    ends = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("doc_id").alias("head"), F.count("*").alias("n")).where("low < high")
    mixed = scratch.save(rows.join(ends.select("key", "head", "n"), "key"), "mixed")
    clusters = components(mixed.select(F.col("doc_id").alias("x"), F.col("head").alias("y"))).withColumnRenamed("root", "cluster")
    members = mixed.groupBy("doc_id", "root").agg(F.sum("n").alias("mates")).join(clusters, F.col("doc_id") == F.col("node"), "left")
    members = scratch.save(members.select("doc_id", "root", "mates", F.coalesce("cluster", "doc_id").alias("cluster")), "members")
    pivots = members.groupBy("cluster").agg(F.max_by(F.struct("doc_id", "root"), F.struct("mates", -F.col("doc_id"))).alias("p")).select("cluster", F.col("p.doc_id").alias("r"), F.col("p.root").alias("r_root"))
    pivots = pivots.join(sets.select(F.col("doc_id").alias("r"), F.col("items").alias("pivot")), "r")
    told = members.join(pivots, "cluster").withColumn("away", F.col("root") != F.col("r_root")).join(sets, "doc_id")
    deltas = told.select("doc_id", "cluster", "root", "away", "items", "pivot").mapInArrow(_deltas(part, whole), "doc_id long, cluster long, root long, away boolean, gap long, base long, delta array<long>")
    deltas = scratch.save(deltas, "deltas")
    to_pivot = deltas.where("away AND gap <= 0").join(pivots.select("cluster", "r"), "cluster").select(F.least("doc_id", "r").alias("x"), F.greatest("doc_id", "r").alias("y"))

    def bits(n: Column) -> Column:
        return F.length(F.bin(n))

    each = deltas.withColumn("apart", F.col("away") & (F.col("gap") > 0)).select("doc_id", "root", "apart", "gap", "base", F.size("delta").alias("size"), F.explode("delta").alias("e"))
    often = each.groupBy("e").agg(F.count("*").alias("n"), F.bool_or("apart").alias("useful"))
    ranked = each.join(often, "e").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "e")))
    # The n-th rarest difference need only be looked up for gaps below this.
    room = (part + whole) * (F.col("size") - F.col("nth") + 1) - F.col("base")
    low = F.when(F.col("apart"), bits(F.col("gap"))).otherwise(F.lit(1))
    shared = ranked.where("n > 1 AND useful")
    probes = shared.withColumn("room", room).where("room > 0").withColumn("low", low).withColumn("high", bits(F.col("room"))).where("low <= high")
    probes = probes.select("e", F.explode(F.sequence("low", "high")).alias("class"), *(F.col(c).alias(f"b_{c}") for c in ("doc_id", "root", "apart", "gap", "base", "size", "nth")))
    index = shared.where("apart").select("e", bits(F.col("gap")).alias("class"), *(F.col(c).alias(f"a_{c}") for c in ("doc_id", "root", "gap", "size", "nth")))
    # Exactly, for both sides: what they share cannot all come later than this place. Of two that are
    # both apart, the one with the greater gap is looked up.
    need = F.ceil((F.col("b_base") + F.col("a_gap")) / (part + whole))
    near = (F.col("b_nth") + need <= F.col("b_size") + 1) & (F.col("a_nth") + need <= F.col("a_size") + 1)
    once = ~F.col("b_apart") | (F.struct("a_gap", "a_doc_id") > F.struct(F.col("b_gap"), F.col("b_doc_id")))
    differ = (F.col("a_doc_id") != F.col("b_doc_id")) & (F.col("a_root") != F.col("b_root"))
    met = probes.alias("p").join(index.alias("i"), (F.col("p.e") == F.col("i.e")) & (F.col("p.class") == F.col("i.class")) & near & once & differ)
    found = met.select(F.least("a_doc_id", "b_doc_id").alias("x"), F.greatest("a_doc_id", "b_doc_id").alias("y"))
    return found.unionByName(to_pivot).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, part: int = 75, whole: int = 100, half_keys: int = 16) -> DataFrame:
    """Groups documents linked by a similarity of at least part / whole.

    Returns doc_id, n_shingles, component_id (least id reachable) and kept (doc_id is that id), a
    row for each row of docs.
    """
    scratch.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.save(docs.mapInArrow(_signatures(shingle, half_keys), SIGNATURE), "signatures")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")), "classes")
    reps = known.dropDuplicates(["doc_id"]).join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")

    one, two = (reps.select("doc_id", F.explode(c).alias("key"), F.lit(side).alias("side")) for side, c in enumerate("ab"))
    keys = one.unionByName(two)
    # Counted before the shuffle, so that a key of a third of all documents is no task's burden.
    twice = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = keys.join(twice.hint("merge"), "key", "left_semi")
    halves = shared.groupBy("doc_id").agg(*(F.collect_set(F.when(F.col("side") == side, F.col("key"))).alias(c) for side, c in enumerate("ab")))
    halves = scratch.save(halves.where((F.size("a") > 0) & (F.size("b") > 0)), "half-keys")
    sizes = classes.select(F.col("rep").alias("doc_id"), "n")
    tables = halves.select("doc_id", F.explode("a").alias("left"), "b").select("doc_id", "left", F.explode("b").alias("right")).select("doc_id", F.xxhash64("left", "right").alias("key"))

    wanted = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").join(halves.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = scratch.save(wanted.mapInArrow(_sets(shingle), "doc_id long, items binary"), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        for c in "xy":
            pairs = pairs.join(sizes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}")), c)
        near = pairs.where(whole * F.least("nx", "ny") >= part * F.greatest("nx", "ny")).select("x", "y")
        for c in "xy":
            near = near.join(sets.select(F.col("doc_id").alias(c), F.col("items").alias(f"set_{c}")), c)
        near = near.select("x", "y", "set_x", "set_y")
        return scratch.save(near.mapInArrow(_confirm(part, whole), "x long, y long"), name)

    def labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "doc_id").alias("root"))

    def starred(rows: DataFrame, pick) -> DataFrame:
        """Each member of a bucket that holds several components with the bucket's picked member."""
        heads = rows.groupBy("key").agg(pick(F.struct("doc_id", "root")).alias("head"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        pairs = rows.join(heads, "key").where("head.root <> root")
        return pairs.select(F.least("head.doc_id", "doc_id").alias("x"), F.greatest("head.doc_id", "doc_id").alias("y")).distinct()

    links = confirmed(starred(tables.withColumn("root", F.col("doc_id")), F.min), "links")
    roots = components(links)
    for candidates in (lambda rows: starred(rows, F.max), lambda rows: _across(rows, sets, part, whole)):
        found = confirmed(candidates(labelled(tables, roots)), "links")
        if not found.isEmpty():
            # Known components stand for their links, so only what is new has to be joined.
            links = roots.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(found)
            roots = components(links)

    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"], "left")
    out = out.join(roots, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.col("doc_id").isNull()).alias("kept"))
