"""Benchmark decontamination by suffix arrays of the training text.

Each slice of documents (a shard) gets a suffix array over its words: A-Z lower-cased, words of
letters and digits, ordered by word hashes and compared over `depth` words, built by doubling the
compared length and sorting only suffixes that still tie. Every test suffix is looked up in every
shard by binary search; equal ones are looked up once. The ranges of suffixes that begin with
different windows are disjoint, so that all places found in a shard are no more than its words for
each window length, however repetitive both sides are. A place's longest verbatim match is that with
one of the two test suffixes that would stand next to it in the array.

Words are compared verbatim: every word of a place found is compared byte by byte with the
benchmark's word of the same hash. One that differs is taken out and the shard is searched again.

An item with fewer words than the window is one window of that length. The benchmark is a stated
query set: it goes to the tasks in blocks of at most about `block_words` words, so what is sent has a
fixed bound and the training side is never shuffled. With several blocks each is searched in a pass
of its own over the rows and what the earlier passes found in them, saved before the next block is
loaded.

Null or empty texts have no words; null or empty items never occur. Repeated items each count by
their own id; null item ids are left out of the list of items but still mark words. Rows are kept
apart, null and repeated ids included. An empty benchmark marks nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm import scratch
from shelfscope.llm.substring import expand, list_column
from shelfscope.llm.textbytes import ALNUM, Prefix, Words, column_bytes, lower, slices, word_prefix

SLICE = 3 << 20
#: A run of hit words packs its start and, below this, its length.
RUN = 1 << 31
FOUND = "doc_id long, n_words long, n_hit long, items array<string>, longest long"
_SHIFT = np.uint64(34)


def codes(hashes: np.ndarray) -> np.ndarray:
    """The 30 bits of a word's hash by which suffixes are ordered; 0 is kept for the end."""
    return (hashes >> _SHIFT).astype(np.int64) + 1


@dataclass
class SuffixArray:
    """Suffixes of a word sequence, ordered by up to `depth` words. pairs: the first two of each."""

    code: np.ndarray
    order: np.ndarray
    pairs: np.ndarray

    @classmethod
    def build(cls, words: np.ndarray, depth: int) -> SuffixArray:
        n = len(words)
        code = np.zeros(n + 2, np.int64)
        code[:n] = codes(words)
        key = code[:n] << 32 | code[1 : n + 1]
        order = np.argsort(key)
        pairs = key[order]
        head = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        rank = np.zeros(n, np.int64)
        rank[order] = np.repeat(head, np.diff(np.r_[head, n])) + 1
        span = 2
        while span < depth:
            size = np.diff(np.r_[head, n])
            spots = np.flatnonzero(np.repeat(size > 1, size))
            if not len(spots):
                break
            who = order[spots]
            ahead = np.zeros(len(who), np.int64)
            inside = who + span < n
            ahead[inside] = rank[who[inside] + span]
            again = np.lexsort((ahead, rank[who]))
            who, ahead = who[again], ahead[again]
            group = rank[who]
            order[spots] = who
            new = np.r_[True, (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])]
            rank[who] = np.repeat(spots[new], np.diff(np.r_[np.flatnonzero(new), len(who)])) + 1
            head = np.union1d(head, spots[new])
            span *= 2
        return cls(code, order, pairs)

    def search(self, queries: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query stretch (codes) the range of the order whose suffixes begin with it.

        The first two words are looked up at once; then each further word narrows the ranges that
        are left, by a binary search in all of them together.
        """
        first = queries[start] << 32
        second = np.where(length > 1, queries[np.minimum(start + 1, len(queries) - 1)], 0)
        low = np.searchsorted(self.pairs, first | second, side="left")
        high = np.searchsorted(self.pairs, np.where(length > 1, (first | second) + 1, first + (1 << 32)), side="left")
        last = len(self.code) - 1
        for k in range(2, int(length.max(initial=0))):
            live = np.flatnonzero((low < high) & (length > k))
            if not len(live):
                break
            wanted = queries[start[live] + k]
            for end, aim in ((low, wanted), (high, wanted + 1)):
                a, b = low[live].copy(), high[live].copy()
                while (open_ := np.flatnonzero(a < b)).size:
                    mid = (a[open_] + b[open_]) // 2
                    less = self.code[np.minimum(self.order[mid] + k, last)] < aim[open_]
                    a[open_[less]] = mid[less] + 1
                    b[open_[~less]] = mid[~less]
                if end is low:
                    fresh_low = a
                else:
                    high[live] = a
            low[live] = fresh_low
        return low, high


@dataclass
class Block:
    """Items of the benchmark: their words, distinct windows, and which items have each window."""

    text: np.ndarray
    words: Words
    start: np.ndarray  # of one occurrence of each distinct window
    length: np.ndarray
    names: list[list[str]]
    vocabulary: tuple[np.ndarray, np.ndarray]  # sorted hashes, and a word that has each
    shared: np.ndarray  # hashes that several words of the benchmark have

    @classmethod
    def build(cls, items: list, texts: pa.Array, window: int) -> Block:
        buf, offsets = column_bytes(texts)
        text = lower(buf)
        words = Words(text, offsets, ALNUM)
        sizes = np.diff(words.first)
        count = np.where(sizes >= window, sizes - window + 1, np.minimum(sizes, 1))
        item = np.repeat(np.arange(len(sizes)), count)
        start = expand(words.first[:-1], count)
        length = np.minimum(sizes[item], window)
        key = word_prefix(words.hash).spans(start, start + length)
        _, one, same = np.unique(key, return_index=True, return_inverse=True)
        names: list[set[str]] = [set() for _ in one]
        for w, x in zip(same.tolist(), item.tolist(), strict=True):
            if items[x] is not None:
                names[w].add(str(items[x]))
        hashes, some = np.unique(words.hash, return_index=True)
        out = cls(text, words, start[one], length[one], [sorted(n) for n in names], (hashes, some), hashes[:0])
        out.shared = np.unique(words.hash[out.unlike(text, words, np.arange(len(words.hash)))])
        return out

    def unlike(self, text: np.ndarray, words: Words, at: np.ndarray) -> np.ndarray:
        """Of these words of a shard, those that have the hash of another word of the benchmark."""
        hashes, some = self.vocabulary
        if not len(hashes):
            return at
        spot = some[np.minimum(np.searchsorted(hashes, words.hash[at]), len(hashes) - 1)]
        size, other = words.end[at] - words.start[at], self.words.end[spot] - self.words.start[spot]
        wrong = (size != other) | (self.words.hash[spot] != words.hash[at])
        alike = np.flatnonzero(~wrong)
        n = size[alike]
        differ = text[expand(words.start[at[alike]], n)] != self.text[expand(self.words.start[spot[alike]], n)]
        wrong[np.repeat(alike, n)[differ]] = True
        return at[wrong & ~np.isin(words.hash[at], self.shared)]

    def ordered(self) -> tuple[SuffixArray, Prefix, np.ndarray, np.ndarray]:
        """The suffix array of all items with a mark after each; their hashes; the items' ends."""
        sizes = np.diff(self.words.first)
        marked = np.insert(self.words.hash, self.words.first[1:], np.uint64(0))
        ends = np.cumsum(sizes + 1) - 1
        return SuffixArray.build(marked, len(marked)), word_prefix(marked), ends, np.searchsorted(ends, np.arange(len(marked)))


def common(one: Prefix, at: np.ndarray, two: Prefix, start: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from each place `at` of one sequence equal those from `start` of the other, up
    to `most`: by bisection over the hashes of stretches."""
    low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_] + 1) // 2
        same = one.spans(at[open_], at[open_] + mid) == two.spans(start[open_], start[open_] + mid)
        low[open_[same]] = mid[same]
        high[open_[~same]] = mid[~same] - 1
    return low


def _places(block: Block, words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in a shard windows stand, and which: equal in all hashes and within one document."""
    if not len(words.hash) or not len(block.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    array = SuffixArray.build(words.hash, window)
    low, high = array.search(codes(block.words.hash), block.start, block.length)
    which = np.repeat(np.arange(len(low)), high - low)
    at = array.order[expand(low, high - low)]
    fits = at + block.length[which] <= words.first[np.searchsorted(words.first, at, side="right")]
    at, which = at[fits], which[fits]
    if not len(at):
        return at, which
    first, size = block.start[which], block.length[which]
    fits = word_prefix(words.hash).spans(at, at + size) == word_prefix(block.words.hash).spans(first, first + size)
    return at[fits], which[fits]


def _longest(tests: tuple, words: Words, place: np.ndarray) -> np.ndarray:
    """The longest match of each place with any item: in the order of all test suffixes it is with
    one of the two beside the place."""
    array, prefix, ends, item = tests
    own = word_prefix(words.hash)
    room = words.first[np.searchsorted(words.first, place, side="right")] - place
    spot, _ = array.search(codes(words.hash), place, room)
    out = np.zeros(len(place), np.int64)
    for side in (spot - 1, spot):
        near = array.order[np.clip(side, 0, len(array.order) - 1)]
        out = np.maximum(out, common(own, place, prefix, near, np.minimum(ends[item[near]] - near, room)))
    return out


def _find(block: Block, window: int, text_at: int, fields: list[str], last: bool = False):
    """Adds to each row's spans, items and longest what the block's items have in its text. The last
    pass returns what the runs come to, without texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = None
        cut = {c: k for k, c in enumerate(fields)}
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column(text_at), SLICE):
                text = lower(buf)
                words = Words(text, offsets, ALNUM)
                total = len(words.hash)
                while True:
                    at, which = _places(block, words, window)
                    cover = np.zeros(total + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + block.length[which], -1)
                    covered = np.cumsum(cover)[:-1] > 0
                    wrong = block.unlike(text, words, np.flatnonzero(covered))
                    if not len(wrong):
                        break
                    words.hash[wrong] = _free(block.vocabulary[0])
                place = np.unique(at)
                if len(place) and tests is None:
                    tests = block.ordered()
                doc = np.searchsorted(words.first, at, side="right") - 1
                edge = np.zeros(total + 1, np.int8)
                edge[:-1] = covered
                edge[words.first] *= 2  # a run ends where its document ends
                begin = np.flatnonzero(covered & ((edge[:-1] == 2) | ~np.r_[False, covered[:-1]]))
                stop = np.r_[begin[1:], total]
                hits = np.zeros(total + 1, np.int64)
                np.cumsum(covered, out=hits[1:])
                home = np.searchsorted(words.first, begin, side="right") - 1
                packed = (begin - words.first[home]) * RUN + np.minimum(hits[stop[: len(begin)]] - hits[begin], RUN - 1)
                rest = batch.slice(i, j - i)
                was, had = list_column(rest.column(cut["spans"]))
                owner = np.r_[np.repeat(np.arange(j - i), np.diff(had)), home]
                order = np.argsort(owner, kind="stable")
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[order], np.arange(j - i + 1)).astype(np.int32)), pa.array(np.r_[was, packed][order]))
                most = np.array(rest.column(cut["longest"]).to_numpy(zero_copy_only=False), np.int64)
                if len(place):
                    np.maximum.at(most, np.searchsorted(words.first, place, side="right") - 1, _longest(tests, words, place))
                found = [set(x) for x in rest.column(cut["items"]).to_pylist()]
                for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
                    found[d].update(block.names[w])
                new = {"spans": spans, "items": pa.array([sorted(x) for x in found], pa.list_(pa.string())), "longest": pa.array(most)}
                if "n_words" in cut:
                    new["n_words"] = pa.array(np.diff(words.first))
                out = pa.RecordBatch.from_arrays([new.get(c, rest.column(k)) for c, k in cut.items()], fields)
                yield _counted(out) if last else out

    return run


def _free(taken: np.ndarray) -> np.uint64:
    """A hash that no word of the benchmark has."""
    x = np.uint64(1)
    while len(taken) and taken[np.minimum(np.searchsorted(taken, x), len(taken) - 1)] == x:
        x += np.uint64(1)
    return x


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """With n_hit, the number of words in the union of each row's runs, in place of these."""
    sizes = []
    for runs in batch.column("spans").to_pylist():
        end = total = 0
        for start, n in sorted(divmod(x, RUN) for x in runs):
            total += max(0, start + n - max(start, end))
            end = max(end, start + n)
        sizes.append(total)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(sizes, pa.int64()), batch.column("items"), batch.column("longest")], ["doc_id", "n_words", "n_hit", "items", "longest"])


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_words: int) -> Iterator[tuple[int, int, Block]]:
    """(number, how many, block) of about block_words words each; one is on the driver at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    n_words = F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")).cast("long")
    n = max(1, -(-(items.agg(F.sum(n_words)).first()[0] or 0) // block_words))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        table = (items if n == 1 else items.where(part == k)).toArrow().combine_chunks()
        text = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        yield k, n, Block.build(table.column("item").to_pylist(), text, window)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), longest (words of the longest verbatim
    match) and contaminated, a row for each row of docs."""
    scratch.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.expr("CAST(array() AS array<long>)"), "items": F.expr("CAST(array() AS array<string>)"), "longest": F.lit(0).cast("long")})
    before = None
    for k, n, block in _blocks(benchmark, item_col, item_text_col, window, block_words):
        last = k == n - 1
        found = rows.mapInArrow(_find(block, window, 1, rows.columns, last), FOUND if last else rows.schema)
        if not last:
            found = scratch.save(found, "decontam-block")
            if before is not None:
                scratch.drop(before)
            before = found
        rows = found
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 2_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that contamination() doesn't mark. No row moves
    between tasks."""
    scratch.small_batches(docs.sparkSession)
    at, schema, before = docs.columns.index(text_col), docs.schema, None
    for k, n, block in _blocks(benchmark, item_col, item_text_col, window, block_words):
        docs = docs.mapInArrow(_unmarked(block, window, at), schema)
        if k < n - 1:
            docs = scratch.save(docs, "decontam-clean")
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs


def _unmarked(block: Block, window: int, at: int):
    find = _find(block, window, 0, ["text", "spans", "items", "longest"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            empty = [pa.array([[]] * n, pa.list_(kind)) for kind in (pa.int64(), pa.string())]
            texts = pa.RecordBatch.from_arrays([batch.column(at), *empty, pa.array(np.zeros(n, np.int64))], ["text", "spans", "items", "longest"])
            hit = [x for out in find([texts]) for x in pc.list_value_length(out.column("spans")).to_pylist()]
            yield batch.filter(pa.array([n == 0 for n in hit], pa.bool_()))

    return run
