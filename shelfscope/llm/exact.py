"""Exact dedup as stateful streaming.

The documents' digests are streamed through keyed state on disk (RocksDB, checkpointed in the shared
folder, without watermark or expiry). The state of a digest holds the stable identifier (the largest
id so far), the number of rows, and the content locator: the file in which the keeper's text stands.
Each micro-batch emits the states it changed; the last state of a digest is the decision.

A digest met more than once is a hit. Its texts in this call are compared in full, and, if earlier calls
met the digest, the keeper of then with them: its text is read from the file that its locator names, so
that no other file of the earlier documents is opened. Only where texts differ, so that digests merely
collide, are the groups formed anew by whole texts; such digests are noted beside the state.

With a `state` folder the index lasts: a later call streams its own rows alone through the state that
the earlier ones left, and the decisions of its rows count all rows so far. A call that failed may
leave its rows in that folder's feed, so repeat it on a copy of the folder from before.

A null text counts as empty. Null ids never beat an id; a group of null ids alone keeps its rows.
Repeated rows with one id and text are one document: each of them gets the same result. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm import scratch

_FEED = "doc_id LONG, digest LONG, file STRING, text_sha256 BINARY"
_STATE = "digest LONG, keep_id LONG, n LONG, file STRING"
#: Digests, counted, that are broadcast; more are met by a merge join.
FEW = 1_000_000
#: Files of keepers that are listed for one read; for more, the whole corpus is read.
FILES = 10_000
#: State lives in RocksDB; a partition's store is closed once its part of a micro-batch is committed
#: to the shared folder, so that executors hold few open stores and little disk at a time.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def _among(rows: DataFrame, keys: DataFrame, few: int) -> DataFrame:
    """The rows whose digest is one of keys' (saved, each once); rows stay where they are if keys are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= few else keys.hint("merge"), "digest", "left_semi")


def stream_states(own: DataFrame, state: str, per_trigger: int, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Streams what is new in the state's feed through the state. Returns the state of each of own's
    digests, and what it was before this call, for the digests that earlier calls met."""
    spark, updates = own.sparkSession, f"{state}/updates"

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    def latest(apart: bool) -> DataFrame:
        seen = spark.read.schema(f"{_STATE}, batch LONG").parquet(updates)
        return (_among(seen, mine, few) if apart else seen).groupBy("digest").agg(F.max_by(F.struct("keep_id", "n", "file"), "batch").alias("s")).select("digest", "s.*")

    mine = scratch.save(own.select("digest").distinct(), "exact-digests")
    spark.createDataFrame([], _STATE).write.mode("overwrite").parquet(f"{updates}/batch=-1")  # an empty feed runs no batch
    went_on = not spark.read.schema(_STATE).parquet(updates).isEmpty()  # a new state holds own's digests alone
    earlier = scratch.save(latest(went_on), "exact-earlier")
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(_FEED).option("maxBytesPerTrigger", per_trigger).parquet(f"{state}/feed")
        states = stream.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"), F.max_by("file", "doc_id").alias("file"))
        query = states.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    states = scratch.save(latest(went_on), "exact-states")
    scratch.drop(mine)
    return states, earlier


def located(places: DataFrame, read: Callable[[list[str]], DataFrame], whole: DataFrame, most: int = FILES) -> DataFrame:
    """The rows of the files that places names: these files alone, or the whole corpus if they are more
    than `most` or some place has none, for its row came from no file."""
    files = [r[0] for r in places.select("file").distinct().limit(most + 1).collect()]
    if len(files) > most or not all(files):
        return whole
    return read([re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(f)) for f in files])


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_trigger: int = 1 << 28, state: str | None = None, corpus: DataFrame | None = None, digest: Callable[[Column], Column] = F.xxhash64, few: int = FEW, read: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """Groups equal texts; the row with the largest id of each group stays.

    Returns doc_id, keep_id, group_size, kept and text_sha256 (binary), a row for each row of docs.
    per_trigger bounds the bytes of digests that a micro-batch takes. state: a shared folder that
    lasts, with corpus: all documents so far, docs included, which is read in full where digests
    collide. read: how files of earlier documents are read, as Parquet if None; they must still stand
    where they were, else an error is raised. few bounds the digests that are broadcast; results don't
    depend on it.
    """
    spark = docs.sparkSession

    def told(df: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.input_file_name().alias("file")).withColumn("digest", digest(F.col("text")))

    source = docs if corpus is None else corpus
    docs, whole, lasting = told(docs), told(source), state is not None
    feed = docs.select("doc_id", "digest", "file", F.unhex(F.sha2("text", 256)).alias("text_sha256"))
    if not lasting:
        state = scratch.path(spark, "exact")
        feed.write.parquet(f"{state}/feed")
        own = spark.read.schema(_FEED).parquet(f"{state}/feed")
    else:
        own = scratch.save(feed, "exact-own")
        own.write.mode("append").parquet(f"{state}/feed")
    states, earlier = stream_states(own, state, per_trigger, few)
    hits = scratch.save(states.where("n > 1").select("digest"), "exact-hits")
    some = hits.count()

    if some <= few:
        texts = docs.join(F.broadcast(hits), "digest", "left_semi")
    else:
        # Many hits are looked up by id, so that a group with a third of all rows is spread over all
        # tasks, and equal texts meet in full in each task before they are shuffled.
        hit_ids = own.join(hits.hint("merge"), "digest", "left_semi").select(F.col("doc_id").alias("hit")).distinct()
        texts = docs.join(hit_ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("hit")), "left_semi").select("digest", "text").distinct().join(hits.hint("merge"), "digest", "left_semi")
    variants = texts.select("digest", "text")
    past = earlier.count()
    if past:
        place = earlier.select(F.col("digest").alias("d"), F.col("keep_id").alias("k"), "file")
        rows = told(located(place, read or (lambda files: spark.read.parquet(*files)), source)).drop("file")
        keepers = rows.join(F.broadcast(place) if past <= few else place.hint("merge"), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("k")))
        keepers = scratch.save(keepers.select("digest", "text").distinct(), "exact-keepers")
        found = keepers.select("digest").distinct().count()
        if found < past:
            raise ValueError(f"{past - found} texts of earlier calls no longer stand in the files where they were")
        variants = variants.unionByName(keepers)
    variants = variants.groupBy("digest", "text").agg(F.lit(1).alias("one"))
    collided = variants.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    if lasting:
        known = f"{state}/collided"
        spark.createDataFrame([], "digest LONG").write.mode("append").parquet(known)  # so that there is a table to read
        again = spark.read.schema("digest LONG").parquet(known).join(hits.hint("merge"), "digest", "left_semi")
        collided = collided.unionByName(again).distinct()
    collided = scratch.save(collided, "exact-collided")
    if lasting:
        collided.write.mode("append").parquet(known)

    decided = states.select("digest", "keep_id", F.col("n").alias("group_size"))
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    if collided.isEmpty():
        out = own.join(decided.hint("merge"), "digest").select(*columns)
    else:
        regrouped = whole.join(collided.hint("merge"), "digest", "left_semi").groupBy("digest", F.unhex(F.sha2("text", 256)).alias("text_sha256"), "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("text")
        regrouped = scratch.save(regrouped, "exact-regrouped")
        alone = own.join(collided.hint("merge"), "digest", "left_anti").join(decided.hint("merge"), "digest").select(*columns)
        out = alone.unionByName(own.join(regrouped.hint("merge"), ["digest", "text_sha256"]).select(*columns))
    scratch.drop(hits, earlier)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
