"""Substring dedup over word windows with a log-structured fingerprint index.

Every window of `window` consecutive words belongs to its anchor, the `gram`-word stretch of least
hash in it. Windows that follow each other and share an anchor form a run; the index keeps one row
per distinct run: anchor hash `fp`, digest `dig` of the run's words, the document that had it
first, and its place there. Equal windows always have equal anchors, so two documents share a
window only if they have an `fp` in common.

The index is log-structured: each batch adds one immutable table, bucketed and sorted by `fp` and
`dig`. A new batch is reduced to its distinct runs, dealt to the same buckets and merge-joined with
each earlier table, bucket by bucket: history is neither shuffled nor sorted again. Runs whose digest
is known from an earlier document are repeats as a whole. Where only the anchor is known, both places
are looked up in the texts and their windows compared by digests of the words themselves
(verification). When more than `fan_in` tables have gathered, the next batch first compacts the two
latest, again bucket by bucket.

Each batch's texts are stored once beside its run, bucketed and sorted by id. Only batches that hold
a document to look up are read again; their texts meet the wanted places bucket by bucket and are
never shuffled a second time. Batches come in ascending order of ids; one that does not is refused.

The tables and a manifest lie in a folder; open() goes on from it in a later session. A batch that
fails or is refused leaves the manifest, and so the index, as it was.

Null or empty texts have no words. Texts of fewer words than the window have no windows. Rows with
a null id are never compared: they keep their words. Rows with one id must have one text; repeated
rows each come back, all with what one of them would keep. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import scratch
from shelfscope.llm.textbytes import SPACES, Words, anchors, slices, word_prefix

PRINTS = "doc_id long, fp long, dig long, span long"
WINDOWS = "doc_id long, h1 long, h2 long, start long, fresh boolean"
MANIFEST = "window long, gram long, buckets long, runs array<string>, texts array<struct<name:string,low:long,high:long>>"
#: A span packs its first window start and the number of further starts below this.
SPAN = 1 << 12


def spaced(buf: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each followed by one space, and where each word starts in them."""
    sizes = words.end - words.start
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    out = np.full(at[-1], 32, np.uint8)
    total = int(sizes.sum())
    word = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at[word] + inner] = buf[words.start[word] + inner]
    return out, at


def digests(raw: memoryview, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each stretch of bytes, as two columns of int64."""
    out = bytearray()
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        out += blake2b(raw[a:b], digest_size=16).digest()
    return np.frombuffer(bytes(out), np.int64).reshape(-1, 2)


def _prints(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, offsets in slices(batch.column(1)):
                words = Words(buf, offsets, SPACES)
                doc, lo, hi, fp = anchors(word_prefix(words.hash), words.first, window, gram)
                if not len(doc):
                    continue
                raw, at = spaced(buf, words)
                dig = digests(memoryview(raw), at[lo], at[hi + window] - 1)[:, 0]
                span = (lo - words.first[doc]) * SPAN + (hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + doc]), pa.array(fp.view(np.int64)), pa.array(dig), pa.array(span)], ["doc_id", "fp", "dig", "span"])

    return run


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and len+1 offsets of an Arrow list<int64> column; null counts as empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets


def expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo+1, ... for n steps each."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _windows(window: int):
    """(doc_id, text, spans, fresh) to a row for each window that the spans name."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            fresh = batch.column(3).to_numpy(zero_copy_only=False)
            spans, cut = list_column(batch.column(2))
            for i, j, buf, offsets in slices(batch.column(1)):
                words = Words(buf, offsets, SPACES)
                own = spans[cut[i] : cut[j]]
                doc = np.repeat(np.arange(j - i), np.diff(cut[i : j + 1]))
                n = own % SPAN + 1
                start = expand(own // SPAN, n)
                doc = np.repeat(doc, n)
                raw, at = spaced(buf, words)
                place = start + words.first[doc]
                h = digests(memoryview(raw), at[place], at[place + window] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + doc]), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(start), pa.array(fresh[i + doc].astype(bool))], ["doc_id", "h1", "h2", "start", "fresh"])

    return run


def _cut(window: int):
    """(doc_id, text, spans) to the text without the words that the spans' windows cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, where = list_column(batch.column(2))
            for i, j, buf, offsets in slices(batch.column(1)):
                words = Words(buf, offsets, SPACES)
                own = spans[where[i] : where[j]]
                doc = np.repeat(np.arange(j - i), np.diff(where[i : j + 1]))
                first = own // SPAN + words.first[doc]
                depth = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(depth, first, 1)
                np.add.at(depth, first + own % SPAN + window, -1)
                kept = np.cumsum(depth)[:-1] == 0
                raw, at = spaced(buf, words)
                hold = np.repeat(kept, np.diff(at))
                count = np.zeros(len(kept) + 1, np.int64)
                np.cumsum(kept, out=count[1:])
                n_words, n_kept = np.diff(words.first), np.diff(count[words.first])
                some = n_kept > 0
                last = np.flatnonzero(kept)[count[words.first[1:]][some] - 1]
                hold[at[last + 1] - 1] = False
                size = np.zeros(len(hold) + 1, np.int64)
                np.cumsum(hold, out=size[1:])
                bounds = size[at[words.first]].astype(np.int32)
                text = pa.StringArray.from_buffers(j - i, pa.py_buffer(bounds), pa.py_buffer(raw[hold].tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], text, pa.array(n_words), pa.array(n_words - n_kept)], ["doc_id", "text", "n_words", "n_removed"])

    return run


@contextmanager
def _bucketwise(spark: SparkSession) -> Iterator[None]:
    """Joins on (fp, dig) take the buckets and the order of tables that are bucketed by fp and sorted
    by both as they are."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class FingerprintIndex:
    """Incremental index of word-window fingerprints; see the module's docstring.

    runs: the names of the tables of runs; texts: those of each batch's texts, with their range of ids.
    """

    def __init__(self, spark: SparkSession, window: int = 50, gram: int = 25, fan_in: int = 1, folder: str | None = None, buckets: int | None = None):
        if not 1 <= gram <= window <= SPAN:
            raise ValueError(f"1 <= gram <= window <= {SPAN} must hold")
        self.spark, self.window, self.gram, self.fan_in = spark, window, gram, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or scratch.path(spark, "substring-index")
        self.runs: list[str] = []
        self.texts: list[tuple[str, int, int]] = []
        self.version = 0
        scratch.small_batches(spark)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fan_in: int = 1) -> FingerprintIndex:
        """The index as its last finished batch left it in the folder."""
        last = spark.read.schema(f"{MANIFEST}, version long").parquet(f"{folder}/manifest").orderBy(F.desc("version")).first()
        index = cls(spark, last["window"], last["gram"], fan_in, folder, last["buckets"])
        index.runs, index.texts, index.version = list(last["runs"]), [tuple(t) for t in last["texts"]], last["version"]
        runs = [(name, "fp BIGINT, dig BIGINT, doc_id BIGINT, span BIGINT, n BIGINT, head BIGINT", "fp", "fp, dig") for name in index.runs]
        for name, columns, key, order in [*runs, *((name, "doc_id BIGINT, text STRING", "doc_id", "doc_id") for name, _, _ in index.texts)]:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({order}) INTO {index.buckets} BUCKETS LOCATION '{folder}/{name}'")
        return index

    def _write(self, df: DataFrame, kind: str, *order: str) -> str:
        """Writes a table bucketed by the first of the columns and sorted by all of them."""
        name = f"substring_{kind}_{uuid.uuid4().hex}"
        with scratch.freed_shuffles(self.spark), _bucketwise(self.spark):
            df.write.bucketBy(self.buckets, order[0]).sortBy(*order).format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.remove(self.spark, f"{self.folder}/{name}")

    def _finish(self, runs: list[str], texts: list[tuple[str, int, int]]) -> None:
        self.runs, self.texts, self.version = runs, texts, self.version + 1
        state = [(self.window, self.gram, self.buckets, runs, texts)]
        self.spark.createDataFrame(state, MANIFEST).coalesce(1).write.parquet(f"{self.folder}/manifest/version={self.version}")

    def _stored(self, batch: DataFrame) -> list[tuple[str, int, int]]:
        """Stores a batch's texts; empty if there are none. An id that is not above all earlier ones is refused."""
        rows = batch.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
        name = self._write(rows.repartition(self.buckets, "doc_id"), "texts", "doc_id")
        low, high = self.spark.table(name).agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None and (not self.texts or low > self.texts[-1][2]):
            return [(name, low, high)]
        self._remove(name)
        if low is None:
            return []
        raise ValueError(f"ids of a batch must be above all earlier ones: {low} is not above {self.texts[-1][2]}")

    def lookup(self, probes: DataFrame, texts: list[tuple[str, int, int]]) -> DataFrame | None:
        """The texts of the probed documents with their spans, from the batches that hold any."""
        held = probes.agg(F.lit(0), *(F.count_if(F.col("doc_id").between(low, high)) for _, low, high in texts)).first()[1:]
        parts = []
        for (name, low, high), n in zip(texts, held, strict=True):
            if n:
                wanted = probes.where(F.col("doc_id").between(low, high)).groupBy("doc_id").agg(F.collect_list("span").alias("spans"), F.max("fresh").alias("fresh"))
                parts.append(self.spark.table(name).join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "spans", "fresh"))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _history(self) -> list[DataFrame]:
        """The distinct runs of each table: those that no earlier one had."""
        return [self.spark.table(x).where("head IS NULL").select("fp", "dig", "doc_id", "span") for x in self.runs]

    def merged(self, prints: DataFrame) -> DataFrame:
        """A batch's distinct runs with the first place and number of each, and as head the earlier
        document that has it. Only the batch is shuffled."""
        place = F.min(F.struct("doc_id", "span")).alias("p")
        rows = prints.groupBy("fp", "dig").agg(place, F.count("*").alias("n")).repartition(self.buckets, "fp").select("fp", "dig", "p.doc_id", "p.span", "n", F.lit(None).cast("long").alias("head"))
        for past in self._history():
            known = past.select("fp", "dig", F.col("doc_id").alias("known")).hint("merge")
            rows = rows.join(known, ["fp", "dig"], "left").withColumn("head", F.coalesce("head", "known")).drop("known")
        return rows

    def _probes(self, run: str) -> DataFrame:
        """Places whose windows have to be compared: runs that share an anchor with another of which
        one at least is new. (doc_id, span, fresh)"""
        new = self.spark.table(run).where("head IS NULL").select("fp", "doc_id", "span")
        per = new.groupBy("fp").agg(F.count("*").alias("own"))
        mixed = new.join(per.hint("merge"), "fp").withColumn("company", F.col("own") > 1)
        out = None
        for past in self._history():
            old = past.join(per.select("fp").hint("merge"), "fp", "left_semi").select("doc_id", "span", F.lit(False).alias("fresh"))
            out = old if out is None else out.unionByName(old)
            there = past.groupBy("fp").agg(F.lit(True).alias("there"))
            mixed = mixed.join(there.hint("merge"), "fp", "left").withColumn("company", F.col("company") | F.col("there").isNotNull()).drop("there")
        fresh = mixed.where("company").select("doc_id", "span", F.lit(True).alias("fresh"))
        return fresh if out is None else out.unionByName(fresh)

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, text) and returns its marks (doc_id, spans): windows that an
        earlier document has. Raises ValueError if an id is not above those of all earlier batches."""
        if len(self.runs) > self.fan_in:
            self.compact()
        stored = self._stored(batch)
        texts = [*self.texts, *stored]
        rows = self.spark.table(stored[0][0]) if stored else self.spark.createDataFrame([], "doc_id long, text string")
        prints = scratch.save(rows.mapInArrow(_prints(self.window, self.gram), PRINTS), "substring-prints")
        run = self._write(self.merged(prints), "run", "fp", "dig")
        # Rows of one passage meet only its head; a passage of very many rows is split by the join.
        heads = self.spark.table(run).where("head IS NOT NULL OR n > 1").select("fp", "dig", F.coalesce("head", "doc_id").alias("first"))
        known = prints.join(heads.hint("merge"), ["fp", "dig"]).where(F.col("first") < F.col("doc_id")).select("doc_id", "span")
        known = scratch.save(known, "substring-known")
        with _bucketwise(self.spark):
            probes = scratch.save(self._probes(run), "substring-probes")
            found, spans, done = self.lookup(probes, texts), known, [prints, known, probes]
            if found is not None:
                windows = scratch.save(found.mapInArrow(_windows(self.window), WINDOWS), "substring-windows")
                done.append(windows)
        if found is not None:
            first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
            repeats = windows.where("fresh").join(first.hint("merge"), ["h1", "h2"]).where(F.col("first") < F.col("doc_id"))
            spans = known.unionByName(repeats.select("doc_id", (F.col("start") * SPAN).alias("span")))
        marks = scratch.save(spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans")), "substring-marks")
        self._finish([*self.runs, run], texts)
        scratch.drop(*done)
        return marks

    def compaction(self) -> DataFrame:
        """The rows of the two latest tables, whose runs are distinct, in their buckets' order."""
        one, two = (past.select("fp", "dig", F.struct("doc_id", "span").alias(c)).hint("merge") for c, past in zip("ab", self._history()[-2:], strict=True))
        both = one.join(two, ["fp", "dig"], "full_outer").withColumn("p", F.coalesce("a", "b"))
        return both.select("fp", "dig", "p.doc_id", "p.span", F.lit(1).cast("long").alias("n"), F.lit(None).cast("long").alias("head"))

    def compact(self) -> None:
        """Merges the two latest tables into one until fan_in are left."""
        while len(self.runs) > max(self.fan_in, 1):
            old = self.runs[-2:]
            self._finish([*self.runs[:-2], self._write(self.compaction(), "run", "fp", "dig")], self.texts)
            for name in old:
                self._remove(name)

    def close(self) -> None:
        """Forgets the index and its runs but leaves the files of the stored texts to plans that read them."""
        for name in self.runs:
            self._remove(name)
        for name, _, _ in self.texts:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs, self.texts = [], []

    def drop(self) -> None:
        for name in [*self.runs, *(name for name, _, _ in self.texts)]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs, self.texts = [], []
        scratch.remove(self.spark, self.folder)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 25, batches: int = 3) -> DataFrame:
    """Removes every word covered by a window that also starts in a document with a smaller id.

    The documents go through a FingerprintIndex in `batches` batches by id. Returns doc_id, text
    (the kept words joined by one space), n_words and n_removed, a row for each row of docs.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    cuts = texts.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    index = FingerprintIndex(spark, window, gram)
    # Rows without id or text have no marks; the others are read from the index, in the buckets of
    # their batch, so that marks alone are shuffled. The result is lazy: stored texts outlast this call.
    cut = docs.where("doc_id IS NULL OR text IS NULL").withColumn("spans", F.lit(None).cast("array<long>"))
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            batch = texts if high is None else texts.where(F.col("doc_id") <= high)
            before = len(index.texts)
            marks = index.add(batch if low is None else batch.where(F.col("doc_id") > low))
            for name, _, _ in index.texts[before:]:
                cut = cut.unionByName(spark.table(name).join(marks.hint("merge"), "doc_id", "left"))
    except BaseException:
        index.drop()
        raise
    index.close()
    return cut.mapInArrow(_cut(window), "doc_id long, text string, n_words long, n_removed long")
