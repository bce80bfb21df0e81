"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Tokens are runs of letters and digits (bytes from 0x80 up count as letters) and runs of other
visible characters. N-grams: each token and each pair of tokens, A-Z lower-cased, and each triple of
token shapes (lower, capital, upper, number, mixed; signs keep their characters). All are hashed to
`dims` places. A text is the relative frequency of each of the three kinds; its score is the
logistic of a sparse dot product with the weights, between 0 and 1. A text without tokens, null or
empty, gets the score of the intercept.

Training takes at most about `sample` labelled rows, chosen by a hash of the id, and makes `epochs`
passes over them; only their hashed features reach the driver. A document with several labels takes
the least. Rows with a null label or id never train. An empty table gives an empty result; without
labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.textbytes import ALNUM, SPACES, Prefix, byte_prefix, lower, mix, slices

_SHAPE_BASE = 0xB5297A4D3F84D5B5
_KIND = np.zeros(256, np.int8)
_KIND[SPACES] = 2
_KIND[ALNUM] = 1
_KIND[65:91] = 1


def features(buf: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed places, their weights (which sum to 1 for each kind in a text) and the row of each."""
    kind = _KIND[buf]
    change = np.ones(len(buf) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    cut = np.flatnonzero(change)
    start, end = cut[:-1], cut[1:]
    some = kind[start] > 0
    start, end = start[some], end[some]
    first = np.searchsorted(start, offsets)
    token = byte_prefix(lower(buf)).spans(start, end)
    digit, upper = (buf >= 48) & (buf <= 57), (buf >= 65) & (buf <= 90)
    sums = [np.r_[0, np.cumsum(x)] for x in (digit, upper)]
    n_digit, n_upper = ((s[end] - s[start]) for s in sums)
    size = end - start
    shape = np.where(n_digit == size, 1, np.where(n_digit > 0, 2, np.where((n_upper == size) & (size > 1), 3, np.where((n_upper == 1) & upper[start], 4, np.where(n_upper > 0, 5, 6))))).astype(np.uint64)
    shape = np.where(kind[start] == 2, token, mix(shape))
    shapes = Prefix(shape, _SHAPE_BASE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    places, weights, rows = [], [], []
    for salt, (hashes, n) in enumerate(((token, 1), (mix(token[:-1] * np.uint64(3) + token[1:]) if len(token) > 1 else token[:0], 2), (shapes.windows(3), 3))):
        inside = row[: len(hashes)] == row[n - 1 : n - 1 + len(hashes)]
        own = row[: len(hashes)][inside]
        places.append((mix(hashes[inside] + np.uint64(salt + 1)) % np.uint64(dims)).astype(np.int64))
        weights.append(1.0 / np.maximum(np.bincount(own, minlength=len(offsets) - 1), 1)[own])
        rows.append(own)
    return np.concatenate(places), np.concatenate(weights), np.concatenate(rows)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    scale: float

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        places, values, rows = features(buf, offsets, len(self.weights))
        dot = np.bincount(rows, self.weights[places] * values, minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.scale * dot, -30, 30)))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader over (places, values) examples; the last place is the intercept."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    draw = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        for e in draw.permutation(len(examples)).tolist():
            at, x = examples[e]
            w = weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[e]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(dims + 1))
    return w[:dims], float(w[dims])


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, dims: int = 1 << 18, epochs: int = 5, scale: float = 8.0, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> Model:
    """docs: doc_id, text; labels: doc_id, quality."""
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("quality").cast("double"))
    total = labels.count()
    parts = 1 << 30
    share = min(parts, int(parts * sample * 0.9 / max(total, 1)) + 1)
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share).groupBy("doc_id").agg(F.min("quality").alias("quality")).limit(sample)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column(2)):
                places, values, rows = features(buf, offsets, dims)
                order = np.lexsort((places, rows))
                places, values, rows = places[order], values[order], rows[order]
                new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (places[1:] != places[:-1])]) if len(rows) else np.zeros(0, int)
                summed = np.add.reduceat(values, new) if len(new) else values
                cuts = np.searchsorted(rows[new], np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (places[new].astype(np.int32), summed.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], *lists], ["doc_id", "quality", "places", "weights"])

    # The sample has a fixed bound of rows, so it may be broadcast.
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    table = rows.mapInArrow(extract, "doc_id long, quality double, places array<int>, weights array<float>").toPandas().sort_values("doc_id", kind="stable")
    if not len(table):
        return Model(np.zeros(dims), 0.0, scale)
    examples = [(np.append(p, dims).astype(np.int64), np.append(np.asarray(v, float) * scale, 1.0)) for p, v in zip(table["places"], table["weights"], strict=True)]
    weights, intercept = ftrl(examples, table["quality"].to_numpy(float), dims, epochs, alpha, beta, l1, l2)
    return Model(weights, intercept, scale)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row of docs, from its text alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(model.score(buf, offsets))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
