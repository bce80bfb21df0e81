"""Matching my catalogue with those of other stores: exact keys, then similar names, one to one.

Both sides have `id`, `ord` (their order, a whole number), name, gtin, sku and url. Candidates come
from joins on keys, words and q-grams, never from all pairs. Columns `by` of theirs name the store of a
row: each store is matched with mine by itself, all of them in one job. The greedy rule "in my order,
take the best of theirs that is still free" is that of `assign`. Joins on rows or their keys are merge
joins: by the size of their compressed files such tables would be broadcast, and fill the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.functions import names, urls
from shelfscope.functions.numbers import half_up
from shelfscope.operators import similar
from shelfscope.operators.assign import assigned, assigned_classes
from shelfscope.sources.stored import checkpointed, written

TIERS = (("gtin", "GTIN"), ("sku", "SKU"), ("slug", "URL slug"))
THRESHOLD = 0.8
BAND = 15
#: Above this many pairs of leftovers the name tier is skipped for a store.
PAIR_LIMIT = 50_000
#: A trigram is rare in a store if no more products have it, and is one of the rarest so many; above
#: this many pairs that share rare trigrams their tier is skipped for a store.
GRAM_MOST, GRAM_TOP, GRAM_PAIRS = 200, 8000, 50_000


def keyed(products: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Products with their normalised keys and plain name; empty keys are null."""
    key = {"gtin": names.gtin(F.col("gtin")), "sku": names.sku(F.col("sku")), "slug": urls.slug(F.col("url"))}
    return products.select(*by, "id", "ord", *(F.nullif(c, F.lit("")).alias(k) for k, c in key.items()), names.plain(F.col("name")).alias("plain"))


def candidates(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows of theirs that share a key or a word with any of mine."""
    found = [theirs.join(mine.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_semi").select(*theirs.columns) for k, _ in TIERS]
    words = mine.select(F.explode(F.split("plain", " ")).alias("word")).where("word <> ''").distinct()
    worded = theirs.withColumn("word", F.explode(F.array_distinct(F.split("plain", " ")))).join(words, "word", "left_semi").select(*theirs.columns)
    out = worded
    for f in found:
        out = out.unionByName(f)
    return out.dropDuplicates(["id"])


def exact_edges(mine: DataFrame, theirs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, mine, theirs, pref, method): pairs with an equal key, of theirs the first that owns it."""
    out = None
    for n, (key, method) in enumerate(TIERS):
        first = Window.partitionBy(*by, key).orderBy("ord")
        owner = theirs.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1")
        edges = mine.select(key, F.col("ord").alias("mine")).join(owner.select(*by, key, F.col("ord").alias("theirs")).hint("merge"), key)
        edges = edges.select(*by, "mine", "theirs", F.array(F.lit(n).cast("double")).alias("pref"), F.lit(method).alias("method"), F.lit(100).cast("long").alias("confidence"), F.lit(True).alias("passes"))
        out = edges if out is None else out.unionByName(edges)
    return out


def band(n: Column) -> Column:
    return half_up(n / 5)


def band_pairs(mine: DataFrame, theirs: DataFrame, budget: int = BAND, by: Sequence[str] = ()) -> DataFrame:
    """Pairs whose names' lengths lie in neighbouring bands: (by, mine, theirs, a, b, band)."""
    low = F.greatest(band(F.length("plain") - budget), F.lit(0).cast("long"))
    one = mine.where("plain <> ''").select(F.col("ord").alias("mine"), F.col("plain").alias("a"), F.explode(F.sequence(low, band(F.length("plain") + budget))).alias("band"))
    two = theirs.where("plain <> ''").select(*by, F.col("ord").alias("theirs"), F.col("plain").alias("b"), band(F.length("plain")).alias("band"))
    return one.join(two, "band")


def band_counts(mine: DataFrame, theirs: DataFrame, budget: int = BAND) -> DataFrame:
    """How many pairs band_pairs makes in each band, from the numbers of names of each length."""
    low = F.greatest(band(F.col("n") - budget), F.lit(0).cast("long"))
    lengths = lambda df: df.where("plain <> ''").groupBy(F.length("plain").alias("n")).agg(F.count("*").alias("k"))
    one = lengths(mine).select("k", F.explode(F.sequence(low, band(F.col("n") + budget))).alias("band")).groupBy("band").agg(F.sum("k").alias("k"))
    two = lengths(theirs).groupBy(band(F.col("n")).alias("band")).agg(F.sum("k").alias("l"))
    return one.join(two, "band").select("band", (F.col("k") * F.col("l")).alias("pairs"))


def similar_names(mine: DataFrame, theirs: DataFrame, threshold: float = THRESHOLD, budget: int = BAND) -> DataFrame:
    """(a, b, score, band): the distinct names of both sides that are similar enough and whose lengths
    lie in neighbouring bands."""
    if threshold > 0.5:
        scored = similar.similar_pairs(mine, theirs, threshold)
    else:  # no name rules out another of like length then
        one, two = (df.select("plain").distinct().withColumn("ord", F.lit(0)) for df in (mine, theirs))
        scored = band_pairs(one, two, budget).select("a", "b", names.similarity(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= threshold)
    low = F.greatest(band(F.length("a") - budget), F.lit(0).cast("long"))
    return scored.withColumn("band", band(F.length("b"))).where((F.col("band") >= low) & (F.col("band") <= band(F.length("a") + budget)))


def fuzzy_matches(mine: DataFrame, theirs: DataFrame, threshold: float = THRESHOLD, by: Sequence[str] = (), done: DataFrame | None = None) -> DataFrame:
    """(by, mine, theirs, method, confidence): the greedy rule over similar names, preferred by score,
    then band, then order of theirs. Rows of mine that `done` has matched with a store are left out
    there. A pair of names is compared once, whatever stores and rows have them."""
    near = checkpointed(similar_names(mine, theirs, threshold))
    edges = near.join(theirs.select(*by, F.col("plain").alias("b")).distinct().hint("merge"), "b")
    edges = edges.select(*by, "a", "b", F.array(-F.col("score"), F.col("band").cast("double")).alias("rank"), F.lit("fuzzy").alias("method"), half_up(F.col("score") * 100).alias("confidence"))
    return named_matches(mine, theirs, edges, by, done)


def gram_counts(products: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """In how many products each trigram occurs."""
    return products.select(*by, "ord", F.explode(names.trigrams(F.col("plain"))).alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias("n"))


def rare_grams(products: DataFrame, most: int | None = GRAM_MOST, top: int | None = GRAM_TOP, by: Sequence[str] = ()) -> DataFrame:
    """The rarest trigrams of each store. A store has no more than the alphabet allows, 37 ** 3."""
    counts = gram_counts(products, by)
    if most is not None:
        counts = counts.where(F.col("n") <= most)
    if top is None:
        return counts
    if not by:
        return counts.orderBy("n", "gram").limit(top)
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("n", "gram"))).where(F.col("_n") <= top).drop("_n")


def gram_edges(mine: DataFrame, theirs: DataFrame, least: float = 0.3, threshold: float = THRESHOLD, most_pairs: int | None = GRAM_PAIRS, by: Sequence[str] = (), done: DataFrame | None = None, most: int | None = GRAM_MOST, top: int | None = GRAM_TOP) -> DataFrame:
    """(by, a, b, rank, method, confidence, passes): pairs of names that share two rare trigrams and
    overlap enough, preferred by overlap. A pair whose names are not similar enough still ends the search
    of a row of mine: `passes` is false. A store with more than most_pairs pairs of rows gives none, those
    of mine that `done` has matched with it left out; most and top bound the rare trigrams. None lifts
    each of the three."""
    rare = checkpointed(rare_grams(theirs, most, top, by).select(*by, "gram"))
    grams = F.explode(names.trigrams(F.col("plain"))).alias("gram")
    one = mine.select("plain").distinct().select(F.col("plain").alias("a"), grams).join(rare.hint("merge"), "gram")
    two = theirs.select(*by, "plain").distinct().select(*by, F.col("plain").alias("b"), F.size(names.trigrams(F.col("plain"))).alias("grams"), grams).join(rare.hint("merge"), [*by, "gram"])
    one = checkpointed(one)
    own = one.groupBy(*by, "a").agg(F.count("*").alias("rare"))
    pairs = one.join(two.hint("merge"), [*by, "gram"]).groupBy(*by, "a", "b").agg(F.count("*").alias("shared"), F.first("grams").alias("grams")).where("shared >= 2").join(own.hint("merge"), [*by, "a"])
    overlap = F.col("shared") / (F.col("rare") + F.col("grams") - F.col("shared"))
    found = pairs.withColumn("overlap", overlap).where(F.col("overlap") >= least)
    if most_pairs is not None:
        found = checkpointed(found)
        all_ = mine.groupBy(F.col("plain").alias("a")).agg(F.count("*").alias("_mine"))
        both = theirs.groupBy(*by, F.col("plain").alias("b")).agg(F.count("*").alias("_theirs"))
        rows = found.join(all_.hint("merge"), "a").join(both.hint("merge"), [*by, "b"])
        if done is not None:
            gone = mine.select("ord", F.col("plain").alias("a")).join(done.select(*by, F.col("mine").alias("ord")).hint("merge"), "ord").groupBy(*by, "a").agg(F.count("*").alias("_gone"))
            rows = rows.join(gone.hint("merge"), [*by, "a"], "left").withColumn("_mine", F.col("_mine") - F.coalesce("_gone", F.lit(0)))
        few = rows.groupBy(*by).agg(F.sum(F.col("_mine") * F.col("_theirs")).alias("_all")).where(F.col("_all") <= most_pairs).drop("_all")
        found = found.join(few, list(by), "left_semi") if by else found.where(F.lit(not few.isEmpty()))
    score = names.similarity(F.col("a"), F.col("b"))
    return found.select(*by, "a", "b", F.array(-F.col("overlap")).alias("rank"), F.lit("trigram").alias("method"), half_up(score * 100).alias("confidence"), (score >= threshold).alias("passes"))


def named_matches(mine: DataFrame, theirs: DataFrame, edges: DataFrame, by: Sequence[str] = (), done: DataFrame | None = None) -> DataFrame:
    """(by, mine, theirs, method, confidence): the greedy rule over edges between names. Rows of mine that
    `done` has matched with a store are left out there."""
    rows = edges.select(*by, "a").distinct().join(mine.select(F.col("plain").alias("a"), "ord").hint("merge"), "a")
    if done is not None:
        rows = rows.join(done.select(*by, F.col("mine").alias("ord")).hint("merge"), [*by, "ord"], "left_anti")
    return assigned_classes(rows, theirs.select(*by, "ord", F.col("plain").alias("b")), edges, by)


def unmatched(rows: DataFrame, matches: DataFrame, side: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.join(matches.select(*by, F.col(side).alias("ord")).hint("merge"), [*by, "ord"], "left_anti")


def within_limit(mine: DataFrame, theirs: DataFrame, done: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """Stores whose unmatched rows make no more than `limit` pairs with mine."""
    per = theirs.groupBy(*by).agg(F.count("*").alias("_n")).join(done.groupBy(*by).agg(F.count("*").alias("_m")), list(by), "left")
    m = F.coalesce("_m", F.lit(0))
    return per.where((F.lit(mine.count()) - m) * (F.col("_n") - m) <= limit).select(*by)


def match(mine: DataFrame, theirs: DataFrame, threshold: float = THRESHOLD, pair_limit: int | None = PAIR_LIMIT, trigrams: bool = True, by: Sequence[str] = (), gram_most: int | None = GRAM_MOST, gram_top: int | None = GRAM_TOP, gram_pairs: int | None = GRAM_PAIRS) -> DataFrame:
    """(by, mine, theirs, method, confidence): all tiers in turn, each on what the ones before left.

    Columns `by` of theirs, not null, tell its stores apart; without them all of theirs is one store.
    The four limits skip a tier or leave trigrams out, as the defaults say; with None nothing is.
    """
    key = list(by) or ["_store"]
    if not by:
        theirs = theirs.withColumn("_store", F.lit(0))
    mine, theirs = written(keyed(mine)), written(keyed(theirs, key))  # read by every tier: small plans, and no key is made twice
    done = assigned(exact_edges(mine, theirs, key), key)
    free = unmatched(theirs, done, "theirs", key)
    near = free if pair_limit is None else free.join(within_limit(mine, theirs, done, key, pair_limit), key, "left_semi")
    if pair_limit != 0:
        done = done.unionByName(fuzzy_matches(mine, near, threshold, key, done))
    if trigrams:
        free = written(unmatched(theirs, done, "theirs", key))
        edges = checkpointed(gram_edges(mine, free, threshold=threshold, by=key, done=done, most_pairs=gram_pairs, most=gram_most, top=gram_top))
        done = done.unionByName(named_matches(mine, free, edges, key, done))
    return done.select(*by, "mine", "theirs", "method", "confidence")


def method_histogram(matches: DataFrame) -> DataFrame:
    """How many pairs each method has found."""
    return matches.groupBy("method").agg(F.count("*").alias("n"))


def looked_up(matches: DataFrame, mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Matches with both products; those of which one is gone drop out."""
    one = mine.select(F.col("ord").alias("mine"), F.struct(*mine.columns).alias("my_product"))
    two = theirs.select(F.col("ord").alias("theirs"), F.struct(*theirs.columns).alias("their_product"))
    return matches.join(one, "mine").join(two, "theirs")


def price_differs(pairs: DataFrame) -> DataFrame:
    """How many pairs have two known prices that differ; USD where known, else native."""
    m, t = F.coalesce("my_usd", "my_price"), F.coalesce("their_usd", "their_price")
    return pairs.agg(F.count_if((m > 0) & (t > 0) & (m != t)).alias("differ"))


def competitor_origins(crawled: DataFrame, manual: DataFrame, my_host: str) -> DataFrame:
    """Origins to compare with: crawled and manual ones, without my own host."""
    both = crawled.select("origin").unionByName(manual.select("origin")).distinct()
    return both.where(urls.origin_host(F.col("origin")) != my_host)
