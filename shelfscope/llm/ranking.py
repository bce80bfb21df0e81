"""Ranked lexical search: a sparse matrix product in blocks.

One factor has a row for each item of the query set and the multiplicity of each term in it, the other
a row for each term and its impact, a 64-bit whole number, in each document. Their product, the scores
of all documents for all items, is formed block by block (some documents by some items) by merging the
rows of the second factor that an item's terms name (Gustavson), and each block keeps the `top`
documents of each item alone.

1. Items go to the tasks in blocks of at most `block_terms` distinct terms, so what is sent has a fixed
   bound. A block's terms are counted in whole texts: a pass writes each document's length and its
   counts of these terms.
2. Over that table: the number of documents and terms, and in how many documents each term is.
3. A second pass turns counts into impacts and forms the product; a window keeps the best of what the
   tasks have found.

A term is a longest match of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z in lower case. Its
weight w is floor(1000 ln((2N+2)/(2df+1))); a document of n terms has m = 100-90+(90nN div L), and the
impact of a term with tf occurrences is w * (1000000000 tf div (1000 tf + 8m)). N: documents with a
term, L: all their terms, df: documents with the term.

Null and empty texts have no terms and are in no statistic. Each row is a document, repeated ids and
null ids included; of equal scores the least id comes first, null last, then any of its rows. Rows of
items with equal item_id are one item with the terms of all; null is an item of its own. Items without
a term that a document has give no row. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm import scratch
from shelfscope.llm.textbytes import ALNUM, Words, lower, slices

COUNTS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"
#: Distinct terms of a block of items, about.
BLOCK_TERMS = 200_000
#: Counts of terms in documents, and documents, from which a block of the product is formed.
BLOCK_COUNTS, BLOCK_DOCS = 1 << 21, 1 << 16
_LAST = np.int64((1 << 63) - 1)


def list_array(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def terms_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a slice of texts and where each text's begin."""
    low = lower(buf)
    words = Words(low, offsets, ALNUM, hashed=False)
    return words.strings(low), words.first


def _counted(vocabulary: pa.Array) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column("text")):
                terms, first = terms_of(buf, offsets)
                coded = terms.dictionary_encode()
                known = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False)
                term = known[coded.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, np.int64)
                home = np.repeat(np.arange(j - i), np.diff(first))[term >= 0]
                cell, count = np.unique(home * size + term[term >= 0], return_counts=True)
                ends = np.searchsorted(cell, np.arange(j - i + 1) * size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(np.diff(first), pa.int64()), list_array(cell % size, ends, pa.int32()), list_array(count, ends, pa.int32())],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return counted


class Items:
    """The first factor: for each item its terms and their multiplicities, in rows."""

    def __init__(self, rows: list[list[str]], once: bool):
        texts = [sorted(r) for r in rows]
        self.vocabulary = pa.array(sorted({t for r in texts for t in r}), pa.large_string())
        place = {t: k for k, t in enumerate(self.vocabulary.to_pylist())}
        self.rows = []
        for r in texts:
            term, times = np.unique(np.array([place[t] for t in r], np.int64), return_counts=True)
            self.rows.append((term, np.ones_like(times) if once else times))


def best(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """The places of the `top` highest scores, equal ones by least id."""
    if len(scores) > top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        ties = ties[np.argsort(ids[ties], kind="stable")[: top - len(above)]]
        return np.concatenate([above, ties])
    return np.arange(len(scores))


def product(items: Items, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Iterator[np.ndarray]:
    """For each item the scores of a block's documents: its rows of the second factor, merged."""
    order = np.argsort(term, kind="stable")
    doc, impact = doc[order], impact[order]
    start = np.searchsorted(term[order], np.arange(len(items.vocabulary) + 1))
    for terms, times in items.rows:
        row = np.zeros(docs, np.int64)
        for t, k in zip(terms, times, strict=True):
            a, b = start[t], start[t + 1]
            row[doc[a:b]] += k * impact[a:b]  # a document stands once in a term's row
        yield row


def _scored(items: Items, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [np.zeros(0, np.int64) for _ in items.rows]
        scores = [np.zeros(0, np.int64) for _ in items.rows]
        for some in blocks(batches):
            own = np.concatenate([pc.fill_null(b.column("doc_id"), _LAST).to_numpy(zero_copy_only=False) for b in some])
            n = np.concatenate([b.column("n").to_numpy(zero_copy_only=False) for b in some]).astype(np.int64)
            size = np.concatenate([pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False) for b in some])
            term, tf = (np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in some]).astype(np.int64) for c in ("terms", "counts"))
            doc = np.repeat(np.arange(len(own)), size)
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            for k, row in enumerate(product(items, len(own), doc, term, impact)):
                hit = np.flatnonzero(row)
                all_ids, all_scores = np.concatenate([ids[k], own[hit]]), np.concatenate([scores[k], row[hit]])
                few = best(all_ids, all_scores, top)
                ids[k], scores[k] = all_ids[few], all_scores[few]
        found = np.concatenate([np.zeros(0, np.int64), *ids])
        item = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(found, pa.int64(), mask=found == _LAST), pa.array(np.concatenate(scores), pa.int64())], names=["item", "doc_id", "score"])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        counts = docs = 0
        for batch in batches:
            held.append(batch)
            counts += len(batch.column("terms").flatten())
            docs += batch.num_rows
            if counts >= BLOCK_COUNTS or docs >= BLOCK_DOCS:
                yield held
                held, counts, docs = [], 0, 0
        if held:
            yield held

    return scored


def _blocks(items: DataFrame, block_terms: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Names and terms of the items, in blocks of at most block_terms terms, about; an item is never split."""
    names: list = []
    rows: list[list[str]] = []
    held: set[str] = set()
    for name, text in items.orderBy("item_id").toLocalIterator():
        raw = (text or "").encode()
        own = terms_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].to_pylist()
        if names and names[-1] == name:
            rows[-1] += own
        else:
            if len(held) >= block_terms:
                yield names, rows
                names, rows, held = [], [], set()
            names.append(name)
            rows.append(own)
        held.update(own)
    if names:
        yield names, rows


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = 10, once: bool = True, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the `top` documents of highest score above 0.

    once: each of an item's terms counts once; else as often as the item has it.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for names, rows in _blocks(items, block_terms):
        one = _searched(texts, names, kind, Items(rows, once), top)
        out = out.unionByName(one)
    return out


def _searched(texts: DataFrame, names: list, kind: T.DataType, factor: Items, top: int) -> DataFrame:
    """The result for one block of items, written."""
    spark = texts.sparkSession
    counts = scratch.save(texts.mapInArrow(_counted(factor.vocabulary), COUNTS), "search-counts")
    n_docs, n_terms = counts.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(max(1, len(factor.vocabulary)), np.int64)
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for batch in held.toArrow().to_batches():  # no more rows than the block has terms
        df[batch.column("term").to_numpy()] = batch.column("df").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    found = counts.where(F.size("terms") > 0).mapInArrow(_scored(factor, weight, n_docs, n_terms or 1, top), FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    known = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {kind.simpleString()}")
    result = scratch.save(ranked.join(known, "item").select("item_id", "rank", "doc_id", "score"), "search-found")
    scratch.drop(counts)
    return result
