"""Periodic runs in linear time over an ordered alphabet, without suffix arrays or hashes.

A run is a stretch of words that repeats with period q (the least one), at least twice, and that no
neighbouring word extends. Each run has a Lyndon root, in the order of the words or in the opposite
one: the longest Lyndon word at the root's start, which reaches to the next smaller suffix. So both
Lyndon arrays are computed, and each of their words is extended to both sides as far as the period
holds.

- `lyndon()` goes through the words from left to right and compares each suffix with the chain of
  previous smaller ones. A comparison never looks again at words that an earlier one has matched:
  while the position lies inside the farthest match, the comparisons are those of the position
  mirrored into the match's other half, whose extensions are known; only one that reaches the
  match's end goes on from there. Along a chain the matched length is handed on. So each word is
  newly matched once.
- `left_extensions()` does the same leftwards. It goes through the words from right to left and
  stops at a full period, since then an earlier root stands for the run.

Words become ranks by an exact dictionary, so that comparisons are those of whole numbers. Before,
words that cannot be in a run of `least` words are put aside: in such a run each word lies in a
sequence of least // 2 words that occurs twice in the document, told by ranks of sequences of growing
length. The stretches of words that are left hold all runs whole, and each is searched by itself.

A text is handled in one task, as its result is one row, in memory proportional to its length. Null
and empty texts, and those without words, have no runs, nulls for the longest run, and the digests of
empty strings. Rows are kept apart, repeated and null ids included; a row with a null id is not made
periodic. Ties for the longest run go to the least start, then the least period. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm import scratch
from shelfscope.llm.textbytes import SPACES, Words, slices

FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Run(NamedTuple):
    start: int
    length: int
    period: int


def lyndon(t: list[int]) -> tuple[list[int], list[int]]:
    """For each position the start of the next smaller suffix (len(t) if none), and how many words
    both suffixes have in common. The end is smaller than any word."""
    n = len(t)
    after, common = [n] * n, [0] * n  # next smaller suffix, and the match with it
    before, shared = [-1] * n, [0] * n  # previous smaller suffix, and the match with it
    most = [0] * n  # the longest match in which the position was the right one
    shift = end = 0  # the farthest match so far: t[k - shift] == t[k] from its right start to end
    for i in range(1, n):
        j, b = i - 1, 0
        if i < end:
            twin, limit = i - shift, end - shift
            if twin + most[twin] < limit:  # decided inside the match: all as at the twin
                stop = before[twin] + shift
                while j != stop:
                    after[j], common[j] = i, common[j - shift]
                    j = before[j]
                before[i], shared[i], most[i] = j, shared[twin], most[twin]
                continue
            stop = before[twin]
            while True:
                b = shared[twin] if j - shift == stop else common[j - shift]
                if twin + b >= limit:
                    break
                after[j], common[j] = i, b
                j = before[j]
            b = end - i
        while True:
            while i + b < n and t[j + b] == t[i + b]:
                b += 1
            if i + b < n and t[j + b] < t[i + b]:
                before[i], shared[i] = j, b
                break
            after[j], common[j] = i, b
            k = before[j]
            if k < 0 or shared[j] < b:
                before[i], shared[i] = k, shared[j]
                break
            j = k
        most[i] = b
        shift, end = i - j, i + b
    return after, common


def left_extensions(t: list[int], after: list[int], common: list[int]) -> list[int]:
    """For each position i how many words before it equal those before after[i], up to a period; 0
    where the suffixes there have nothing in common, so that no run has its first root at i."""
    n = len(t)
    left = [0] * n
    shift, floor, right = 0, n, n  # the farthest match so far: t[k] == t[k + shift] from floor to right
    for i in range(n - 1, -1, -1):
        if not common[i]:
            continue
        period = after[i] - i
        b = 0
        if i > floor and after[i] <= right:
            b = left[i + shift]
            if i - b > floor:
                left[i] = b
                continue
            b = min(b, period, i - floor)
        while b < period and i - b > 0 and t[i - b - 1] == t[i + period - b - 1]:
            b += 1
        left[i] = b
        if i - b < floor or i <= floor:
            shift, floor, right = period, i - b, i
    return left


def runs_of(t: list[int], least: int = 2) -> list[Run]:
    """All runs of at least `least` words and two periods, by start, then period."""
    found = set()
    for order in (t, [-w for w in t]):
        after, common = lyndon(order)
        left = left_extensions(order, after, common)
        for i, (c, b) in enumerate(zip(common, left, strict=True)):
            if c and b < (p := after[i] - i) <= b + c and p + b + c >= least:
                found.add(Run(i - b, p + b + c, p))
    return sorted(found, key=lambda r: (r.start, r.period))


def stretches(t: np.ndarray, home: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of which each word lies in a sequence of k words that
    occurs twice in its document. home: the document of each word."""
    n = len(t)
    none = np.zeros(0, np.int64)
    if n < k + 1:
        return none, none
    at, rank, size = np.arange(n), t.astype(np.int64), 1

    def again(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose key is not alone, with the key's rank."""
        _, rank, count = np.unique(key, return_inverse=True, return_counts=True)
        many = count[rank] > 1
        return at[many], rank[many]

    at, rank = again(at, home * (int(rank.max()) + 1) + rank)  # alike in one document alone
    while size < k and len(at):
        step = min(size, k - size)  # the sequence from at, and the one `step` on, make a longer one
        place = np.searchsorted(at, at + step)
        there = place < len(at)
        there[there] = at[place[there]] == at[there] + step
        at, rank = again(at[there], rank[there] * n + rank[place[there]])
        size += step
    if not len(at):
        return none, none
    first = np.r_[True, (at[1:] > at[:-1] + k) | (home[at[1:]] != home[at[:-1]])]
    last = np.r_[first[1:], True]
    return at[first], at[last] + k


def periodic(n: int, h: int) -> np.ndarray:
    """The original word at each of n places where, from a place that h gives on, words repeat with a
    period that h gives too."""
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def _search(least: int, summary: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = max(1, least // 2)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column("text")):
                yield found(batch.column("doc_id")[i:j], batch.column("h")[i:j].to_pylist(), buf, offsets)

    def found(ids: pa.Array, seeds: list[int | None], buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        words = Words(buf, offsets, SPACES, hashed=False)
        first, size = words.first, np.diff(words.first)
        order = np.arange(first[-1])
        for d, h in enumerate(seeds):
            if h is not None and size[d]:
                order[first[d] : first[d + 1]] = first[d] + periodic(int(size[d]), h)
        text = words.strings(buf).take(pa.array(order))
        rank = text.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        home = np.repeat(np.arange(len(seeds)), size)
        runs: list[list[Run]] = [[] for _ in seeds]
        keep = np.ones(len(order), bool)
        for a, b in zip(*stretches(rank, home, k), strict=True):
            doc = int(home[a])
            for run in runs_of(rank[a:b].tolist(), least):
                keep[a + run.start + run.period : a + run.start + run.length] = False
                runs[doc].append(Run(int(a - first[doc]) + run.start, run.length, run.period))
        left = np.r_[0, np.cumsum(keep)][first]
        kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), text.filter(pa.array(keep))), pa.scalar(" ", pa.large_string()))
        best = [max(r, key=lambda x: (x.length, -x.start, -x.period), default=None) for r in runs]
        told = [pa.array([None if r is None else r[c] for r in best], pa.int64()) for c in range(3)]
        told.append(pa.array([None if r is None else 1000 * r.length // r.period for r in best], pa.int64()))
        if summary:
            listed = [hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in r).encode()).hexdigest() for r in runs]
            rest = [pa.array(listed), pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in kept])]
            names = ["runs_sha256", "collapsed_sha256"]
        else:
            rest = [pa.array([[r._asdict() for r in x] for x in runs], pa.list_(pa.struct({f: pa.int64() for f in Run._fields}))), kept.cast(pa.string())]
            names = ["runs", "collapsed"]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(r) for r in runs], pa.int64()), *told, *rest], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", *names])

    return search


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, repeat: Column | None = None, summary: bool = False) -> DataFrame:
    """For each row the number of its runs of at least `least` words, the longest one (start, length,
    period, exponent_milli), all runs by start and period, and the text without what repeats in them.
    With `summary` the last two are digests (runs_sha256, collapsed_sha256).

    repeat: where it isn't null, the row's words are first made periodic as this whole number says.
    """
    scratch.small_batches(docs.sparkSession)
    h = F.lit(None) if repeat is None else repeat
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), h.cast("long").alias("h"))
    return rows.mapInArrow(_search(least, summary), DIGESTS if summary else FOUND)
