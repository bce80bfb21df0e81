"""Byte-level substring dedup by prefix-free parsing.

A rolling hash over `gram` bytes sets triggers: the places where it is least in some window of
`window` bytes. Triggers cut every text into phrases, so that each window of `window` bytes starts
in exactly one phrase; a phrase is all windows of one trigger with all the bytes that they reach.

- Parse: the corpus as a sequence of phrases. As a phrase holds every byte that its windows reach, a
  suffix of the parse that is cut at the window never reads beyond its first phrase: the parse's
  suffix array is the list of each phrase's occurrences in corpus order (document, start). All
  windows of any but the first occurrence start earlier too.
- Dictionary: the distinct phrases, each at its first occurrence. Equal windows have equal triggers,
  so only phrases with a common trigger can share some; only these go on. They are dealt out by
  trigger with their bytes, and each task builds the suffix array of the phrases it has: all
  suffixes in the order of their bytes, cut at the window, by doubling the compared length.
- Combination: equal suffixes stand together in that array; in corpus order of their phrases' first
  occurrences all but the first of them start earlier too.

Repeated text so costs one dictionary entry, and unrepeated text none. No row stands for a suffix
outside a task, but for triggers of more than `most` phrases: these are dealt to several tasks, and
each task's first of equal suffixes meets the other tasks' by a 128-bit digest of its bytes. Triggers
of very many occurrences are counted before anything is shuffled, and their occurrences are
compared by phrase instead of by trigger.

Null or empty texts have no bytes; rows with a null id are never compared and keep their bytes.
Rows with one id must have one text; repeated rows are parsed once and each keep what one would. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm import scratch
from shelfscope.llm.substring import PRINTS, SPAN, digests, expand, list_column
from shelfscope.llm.textbytes import anchors, byte_prefix, slices

ENTRIES = "fp long, chunk long, apart boolean, doc_id long, start long, phrase binary"
LATER = "doc_id long, start long, h1 long, h2 long"
#: Bytes of phrases whose suffixes are ordered at once, about.
ARRAY_BYTES = 1 << 19


def _parse(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, offsets in slices(batch.column(1)):
                doc, lo, hi, fp = anchors(byte_prefix(buf), offsets, window, gram)
                if len(doc):
                    raw = memoryview(np.ascontiguousarray(buf))
                    dig = np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(lo.tolist(), (hi + window).tolist(), strict=True)), np.int64)
                    span = (lo - offsets[doc]) * SPAN + (hi - lo)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + doc]), pa.array(fp.view(np.int64)), pa.array(dig), pa.array(span)], ["doc_id", "fp", "dig", "span"])

    return run


def _phrases(window: int):
    """(doc_id, text, entries) to a row for each dictionary entry, with its bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            inner, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            span = inner.field("span").to_numpy(zero_copy_only=False)
            start, size = span // SPAN, span % SPAN + window
            for i, j, buf, offsets in slices(batch.column(1)):
                here = np.flatnonzero((row >= i) & (row < j))
                for k in range(0, len(here), 1 << 12):
                    own = here[k : k + (1 << 12)]
                    first = start[own] + offsets[row[own] - i]
                    cuts = np.zeros(len(own) + 1, np.int32)
                    np.cumsum(size[own], out=cuts[1:])
                    data = buf[expand(first, size[own])].tobytes()
                    phrase = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
                    took = pa.array(own)
                    yield pa.RecordBatch.from_arrays([*(inner.field(c).take(took) for c in ("fp", "chunk", "apart")), batch.column(0).take(pa.array(row[own])), pa.array(start[own]), phrase], ["fp", "chunk", "apart", "doc_id", "start", "phrase"])

    return run


def suffix_array(raw: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `starts`, cut at `window` bytes, and the class of each of starts:
    equal for equal suffixes, ascending with their bytes. Each must have `window` bytes.

    Bytes are compared eight at a time; then the compared length is doubled from the ranks of two
    stretches, the last time with an overlap so that exactly the window is compared.
    """
    n, length = len(raw), min(8, window)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = raw
    key = np.zeros(n, np.uint64)
    for k in range(length):
        key = key << np.uint64(8) | padded[k : n + k]
    if length == window:
        key = key[starts]
    while length < window:
        rank = np.unique(key, return_inverse=True)[1]
        ahead = min(length, window - length)
        length += ahead
        at = starts if length == window else np.arange(n)
        second = np.where(at + ahead < n, rank[np.minimum(at + ahead, n - 1)] + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + second
    same = np.unique(key, return_inverse=True)[1]
    return np.argsort(same, kind="stable"), same


def _later(window: int):
    """Dictionary entries, those of a trigger together, to the suffixes of which an equal one starts
    earlier (h1, h2 null), and of triggers dealt to several tasks the first of equal ones, by digest."""

    def order(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        phrase = rows.column("phrase").combine_chunks()
        cuts = np.frombuffer(phrase.buffers()[1], np.int32)[phrase.offset : phrase.offset + len(phrase) + 1].astype(np.int64)
        raw = np.frombuffer(phrase.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
        cuts -= cuts[0]
        n = np.diff(cuts) - window + 1
        entry, place = np.repeat(np.arange(len(n)), n), expand(cuts[:-1], n)
        doc, start = (rows.column(c).to_numpy() for c in ("doc_id", "start"))
        doc, start = doc[entry], start[entry] + place - cuts[entry]
        _, same = suffix_array(raw, place, window)
        sort = np.lexsort((start, doc, same))  # corpus order among equal suffixes
        first = np.ones(len(sort), bool)
        first[1:] = same[sort[1:]] != same[sort[:-1]]
        late, lead = sort[~first], sort[first]
        lead = lead[rows.column("apart").to_numpy()[entry[lead]]]
        h = digests(memoryview(raw), place[lead], place[lead] + window)
        none = np.zeros(len(late), np.int64)
        known = np.r_[np.ones(len(late), bool), np.zeros(len(lead), bool)]
        both = np.r_[late, lead]
        keys = [pa.array(np.r_[none, h[:, c]], mask=known) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(doc[both]), pa.array(start[both]), *keys], ["doc_id", "start", "h1", "h2"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= ARRAY_BYTES:
                # The last group may go on in the next batch.
                rows = pa.Table.from_batches(held)
                fp, chunk = (rows.column(c).to_numpy() for c in ("fp", "chunk"))
                whole = int(np.flatnonzero((fp != fp[-1]) | (chunk != chunk[-1])).max(initial=-1)) + 1
                if whole:
                    yield order(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                    size = sum(b.nbytes for b in held)
        if size:
            yield order(pa.Table.from_batches(held))

    return run


def _cut(window: int):
    """(doc_id, text, spans) to the bytes that no span's window covers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, where = list_column(batch.column(2))
            for i, j, buf, offsets in slices(batch.column(1)):
                own = spans[where[i] : where[j]]
                doc = np.repeat(np.arange(j - i), np.diff(where[i : j + 1]))
                first = own // SPAN + offsets[doc]
                depth = np.zeros(len(buf) + 1, np.int32)
                np.add.at(depth, first, 1)
                np.add.at(depth, first + own % SPAN + window, -1)
                gone = np.cumsum(depth)[:-1] > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                edges = offsets[:-1][np.diff(offsets) > 0]
                begins[edges] = gone[edges]
                lost, spots = np.zeros(len(buf) + 1, np.int64), np.zeros(len(buf) + 1, np.int64)
                np.cumsum(gone, out=lost[1:])
                np.cumsum(begins, out=spots[1:])
                bounds = (offsets - lost[offsets]).astype(np.int32)
                kept = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(bounds), pa.py_buffer(buf[~gone].tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], kept, pa.array(np.diff(offsets)), pa.array(np.diff(lost[offsets])), pa.array(np.diff(spots[offsets]))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def _once(texts: DataFrame) -> DataFrame:
    """texts with each (id, text) once; only texts of repeated ids are shuffled for it."""
    again = scratch.save(texts.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return texts
    return texts.join(again, "doc_id", "left_anti").unionByName(texts.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def _occurrences(parse: DataFrame, busy: int) -> DataFrame:
    """(doc_id, fp, span, known, variants): each phrase occurrence that an earlier one makes known, and
    each phrase's first one, with how many phrases its trigger has, where these are several.

    Occurrences of one trigger are ordered in one task, but for those triggers that have more than
    `busy` of them: there each phrase's first one is found before the shuffle, and the others meet it
    by a join that splits what is too large.
    """
    hot = parse.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > busy).select("fp")
    hot = scratch.save(hot, "busy-triggers")
    some = hot.count()
    hot = F.broadcast(hot) if some <= 50_000 else hot.hint("merge")
    phrase, trigger = Window.partitionBy("fp", "dig").orderBy("doc_id", "span"), Window.partitionBy("fp")
    calm = (parse.join(hot, "fp", "left_anti") if some else parse).repartition("fp")
    calm = calm.withColumn("nth", F.row_number().over(phrase)).withColumn("variants", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(trigger))
    out = calm.where("nth > 1 OR variants > 1").select("doc_id", "fp", "span", (F.col("nth") > 1).alias("known"), "variants")
    if some:
        crowded = scratch.save(parse.join(hot, "fp", "left_semi"), "busy-occurrences")
        heads = scratch.save(crowded.groupBy("fp", "dig").agg(F.min(F.struct("doc_id", "span")).alias("head"), F.count("*").alias("n")), "busy-phrases")
        per = heads.groupBy("fp").agg(F.count("*").alias("variants"))
        firsts = heads.join(F.broadcast(per) if some <= 50_000 else per.hint("merge"), "fp").where("variants > 1")
        firsts = firsts.select("head.doc_id", "fp", "head.span", F.lit(False).alias("known"), "variants")
        again = crowded.join(heads.where("n > 1").drop("n").hint("merge"), ["fp", "dig"]).where(F.struct("doc_id", "span") > F.col("head"))
        out = out.unionByName(firsts).unionByName(again.select("doc_id", "fp", "span", F.lit(True).alias("known"), F.lit(0).cast("long").alias("variants")))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, gram: int = 50, busy: int = 1000, most: int = 500) -> DataFrame:
    """Removes every byte covered by a `window`-byte string that also starts earlier: in a document
    of smaller id, or in the same one at an earlier start.

    Returns doc_id, kept (binary), n_bytes, n_removed and n_spans (maximal removed runs), a row for
    each row of docs. busy and most bound what a trigger brings to one task; results don't depend on
    them.
    """
    scratch.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # A repeated row must not stand before itself.
    texts = _once(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"))
    parse = scratch.save(texts.mapInArrow(_parse(window, gram), PRINTS), "parse")
    rows = scratch.save(_occurrences(parse, busy), "phrases")
    scratch.drop(parse)

    chunks = F.floor((F.col("variants") - 1) / most) + 1
    entry = F.struct("fp", F.pmod(F.xxhash64("doc_id", "span"), chunks).alias("chunk"), (chunks > 1).alias("apart"), "span")
    wanted = rows.where("NOT known").select("doc_id", entry.alias("entry")).groupBy("doc_id").agg(F.collect_list("entry").alias("entries"))
    phrases = texts.join(wanted.hint("merge"), "doc_id").select("doc_id", "text", "entries").mapInArrow(_phrases(window), ENTRIES)
    dealt = phrases.repartition("fp", "chunk").sortWithinPartitions("fp", "chunk")
    later = scratch.save(dealt.mapInArrow(_later(window), LATER), "later-suffixes")
    leads = later.where("h1 IS NOT NULL")
    first = leads.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    across = leads.join(first.hint("merge"), ["h1", "h2"]).where(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "start")
    starts = later.where("h1 IS NULL").select("doc_id", "start").unionByName(across)
    spans = rows.where("known").select("doc_id", "span").unionByName(starts.select("doc_id", (F.col("start") * SPAN).alias("span")))
    marks = scratch.save(spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans")), "suffix-marks")
    scratch.drop(rows, later)
    marked = docs.join(marks, "doc_id", "left").select("doc_id", "text", "spans")
    return marked.mapInArrow(_cut(window), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
