"""All pairs of names whose similarity reaches a threshold, from an inverted index instead of all pairs.

Each rule of `names.similarity` that can reach the threshold has a filter that no pair passes by:

- common words: with the words of both names ordered by rarity, names that share `t` of their words
  share one of their first n - ceil(t n) + 1 words;
- edit distance: an edit touches q of a name's q-grams, so of names that are k edits apart the
  q k + 1 rarest q-grams of one and of the other have one in common, no more than k places apart; the
  lengths differ by no more than k;
- containment: the rarest trigram of the shorter name is in the longer one; the lengths' ratio is bounded.

So each name has few postings, rare ones first, and names meet in a join on these. Long names use
trigrams, shorter ones bigrams or letters, as far as a name has more q-grams than k edits can touch.
What meets is scored once. Equal names count as one, so that copies of a name are never paired here.

Names are plain ones (a-z, 0-9 and single blanks), so there are no more than 37 ** 3 different q-grams
and their counts can be broadcast. Below a threshold of a half edit distances exclude nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions import names
from shelfscope.sources.stored import checkpointed

#: Counted tables of no more rows are broadcast.
SMALL = 50_000
#: Names longer than this are taken to be so when the least lengths of q-grams are found.
LONGEST = 4096
_SLACK = 1e-9


def edits(n: Column, threshold: float) -> Column:
    """How many edits a name of this length can be from a similar one."""
    return F.floor(n * ((1 - threshold) / threshold) + _SLACK)


def classes(threshold: float) -> list[tuple[int, int, int]]:
    """(q, low, high): q-grams serve pairs whose shorter name has low to high - 1 characters."""
    out, high = [], 1 << 30
    for q in (3, 2, 1):
        if threshold <= q / (q + 1):
            continue
        enough = [n - q + 1 > q * math.floor(n * (1 - threshold) / threshold + _SLACK) for n in range(LONGEST + 1)]
        low = max((n for n in range(1, LONGEST + 1) if not enough[n]), default=0) + 1
        if low < high:
            out.append((q, low, high))
            high = low
    return out


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _grams(listed: DataFrame, threshold: float, within: float) -> DataFrame:
    """plain, n, mine, theirs, q, grams: the q-grams of each name (df, gram, pos), rarest first."""
    made = []
    for q in (3, 2, 1):
        own = [F.lit(False)]
        own += [(F.col("n") >= low) & (F.col("n") * threshold < high) for r, low, high in classes(threshold) if r == q]
        if within <= 1:  # the shorter name as a whole, or a longer one in which it may be
            own.append(F.lit(True) if q == 3 else F.col("n") * within <= q + _SLACK)
        wanted = own[0]
        for c in own[1:]:
            wanted = wanted | c
        some = listed.where((F.col("n") >= q) & wanted).withColumn("q", F.lit(q))
        grams = F.transform(F.sequence(F.lit(1), F.col("n") - q + 1), lambda i: F.struct(F.substring(F.col("plain"), i, F.col("q")).alias("gram"), i.alias("pos")))
        made.append(some.withColumn("g", F.explode(grams)))
    each = made[0].unionByName(made[1]).unionByName(made[2]).select("plain", "n", "mine", "theirs", "q", "g.gram", "g.pos")
    counts = F.broadcast(each.groupBy("gram").agg(F.count("*").alias("df")))  # no more than 37 + 37 ** 2 + 37 ** 3 rows
    return each.join(counts, "gram").groupBy("plain", "n", "mine", "theirs", "q").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "pos"))).alias("grams"))


def _postings(grams: DataFrame, threshold: float, within: float, side: str) -> DataFrame:
    """plain, n, pos and the kind, key and bucket by which a name of one side meets those of the other.
    Kinds below 10 are of edit distance, above 10 of a name of mine in one of theirs, above 20 of one
    of theirs in one of mine."""
    mine = side == "mine"
    post = lambda kind, gram, pos, bucket: F.struct(kind.cast("int").alias("kind"), gram.alias("key"), bucket.cast("int").alias("bucket"), pos.cast("int").alias("pos"))
    q, n, g = F.col("q"), F.col("n"), F.col("grams")
    near = F.lit(False)
    for r, low, high in classes(threshold):
        near = near | ((q == r) & (n >= low) & (n * threshold < high))
    edge = F.element_at(g, F.least(q * edits(n, threshold) + 1, F.size(g)).cast("int"))
    # All places of the last q-gram belong to the prefix, so that no pair depends on which place it is.
    prefix = F.filter(g, lambda x: F.struct(x["df"], x["gram"]) <= F.struct(edge["df"], edge["gram"]))
    bucket = F.floor(F.log(n) / math.log(1 / threshold) + _SLACK) if threshold < 1 else n
    shifts = F.array(*map(F.lit, (0,) if mine else (-1, 0, 1)))
    lists = [F.when(near, F.flatten(F.transform(prefix, lambda x: F.transform(shifts, lambda s: post(q, x["gram"], x["pos"], bucket + s)))))]
    if within <= 1:
        whole = (q == 3) | (n == q)
        rarest = F.when(whole, F.array(post(q + (10 if mine else 20), g[0]["gram"], F.lit(0), F.lit(0))))
        distinct = F.array_distinct(F.transform(g, lambda x: x["gram"]))
        every = F.transform(distinct, lambda x: post(q + (20 if mine else 10), x, F.lit(0), F.lit(0)))
        lists += [rarest, F.when((q == 3) | (n * within <= q + _SLACK), every)]
    none = F.array().cast("array<struct<kind:int,key:string,bucket:int,pos:int>>")
    return grams.where(side).select("plain", "n", F.explode(F.concat(*(F.coalesce(x, none) for x in lists))).alias("p")).select("plain", "n", "p.*")


def _worded(listed: DataFrame, threshold: float, side: str) -> DataFrame:
    """plain, words (their number) and word: the rarest words of each name of a side."""
    share = max(0.75, threshold)
    each = listed.select("plain", "mine", "theirs", F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))
    counts = _sized(checkpointed(each.groupBy("word").agg(F.count("*").alias("df"))))
    ordered = each.where(side).join(counts, "word").groupBy("plain").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    keep = F.size("w") - F.ceil(F.size("w") * share - _SLACK) + 1
    return ordered.select("plain", F.size("w").alias("words"), F.explode(F.slice("w", 1, keep.cast("int"))).alias("x")).select("plain", "words", F.col("x.word").alias("word"))


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b): distinct pairs of left's and right's names (plain) that share a posting."""
    if not 0.5 < threshold <= 1:
        raise ValueError("edit distances exclude pairs above a threshold of a half only")
    within = (threshold - 0.6) / 0.35
    sides = left.select("plain", F.lit(True).alias("mine"), F.lit(False).alias("theirs")).unionByName(right.select("plain", F.lit(False).alias("mine"), F.lit(True).alias("theirs")))
    listed = checkpointed(sides.where("plain <> ''").groupBy("plain").agg(F.bool_or("mine").alias("mine"), F.bool_or("theirs").alias("theirs")).withColumn("n", F.length("plain")))
    grams = checkpointed(_grams(listed, threshold, within))
    one = _postings(grams, threshold, within, "mine").select("kind", "key", "bucket", F.col("plain").alias("a"), F.col("n").alias("m"), F.col("pos").alias("i"))
    two = _postings(grams, threshold, within, "theirs").select("kind", "key", "bucket", F.col("plain").alias("b"), F.col("n"), F.col("pos").alias("j"))
    short, long = F.least("m", "n"), F.greatest("m", "n")
    most = F.floor(long * (1 - threshold) + _SLACK)
    served = F.lit(False)
    for q, low, high in classes(threshold):
        served = served | ((F.col("kind") == q) & (short >= low) & (short < high))
    edited = served & (F.abs(F.col("i") - F.col("j")) <= most) & (long - short <= most)
    order = ((F.col("kind") < 20) & (F.col("m") <= F.col("n"))) | ((F.col("kind") > 20) & (F.col("m") >= F.col("n")))
    inside = (F.col("kind") > 10) & order & (short + _SLACK >= long * within)
    met = one.join(two, ["kind", "key", "bucket"]).where(edited | inside).select("a", "b")
    words = _worded(listed, threshold, "mine").select("word", F.col("plain").alias("a"), F.col("words").alias("m"))
    others = _worded(listed, threshold, "theirs").select("word", F.col("plain").alias("b"), F.col("words").alias("n"))
    share = max(0.75, threshold)
    worded = words.join(others, "word").where(F.least("m", "n") + _SLACK >= F.greatest("m", "n") * share).select("a", "b")
    return met.unionByName(worded).distinct()


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): all pairs of a plain name of left and one of right with similarity of at least
    threshold, above a half; equal names of a side count once, empty ones are similar to nothing."""
    pairs = candidates(left, right, threshold)
    return pairs.withColumn("score", names.similarity(F.col("a"), F.col("b"))).where(F.col("score") >= threshold)
