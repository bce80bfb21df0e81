"""Language identification by nearest centroids.

A text becomes the TF-IDF vector of its byte trigrams over letters (A-Z lower-cased, runs of other
bytes one blank), hashed to `dims` places and scaled to length one. Each language has up to
`per_language` centroids, found by spherical k-means over a bounded sample of its labelled texts
(at most `sample` of them, chosen by a hash of the id; one language is one task's group, as large as
its sample); document frequencies are counted over all labelled texts. A text takes the language of
the centroid of greatest cosine. There is no limit on languages.

Rejection: a text whose greatest cosine lies below a threshold is marked rejected; its nearest
language is still named. Short texts have smaller cosines, so each class of lengths (powers of two of
trigram counts) has a threshold of its own: the cosine with their own language that all but a share
`tail` of all labelled texts of that class reach. A class of fewer than 2 / tail texts takes
its neighbours' texts in, one class on each side at a time, until there are that many or no more.

The score is the nearest language's share among the languages' best cosines after a soft maximum,
between 0 and 1. A text that is null or has no letter gets `und`, score 0, rejected. Rows with null
language never train. Repeated rows each come back. An empty table gives an empty result; without any
labelled text all is `und`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm import scratch
from shelfscope.llm.textbytes import lower, slices

_LETTERS = np.zeros(256, bool)
_LETTERS[list(range(97, 123)) + list(range(128, 256))] = True
_CLASSES = 32
#: Cosines are counted in bins of this width's inverse.
_BINS = 512


def trigrams(buf: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram places of a slice, the places' document offsets, and which texts have a letter.

    Each text stands between two blanks, so that one letter makes a trigram. Texts without A-Z are
    asked for any other letter character by character.
    """
    small = lower(buf)
    letter = _LETTERS[small]
    code = np.where(letter, small, 32)
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1]
    total = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    sizes, n = np.diff(total[offsets]), len(offsets) - 1
    padded = np.full(int(sizes.sum()) + 2 * n, 32, np.uint32)
    padded[np.arange(int(sizes.sum())) + 2 * np.repeat(np.arange(n), sizes) + 1] = code[keep]
    bounds = total[offsets] + 2 * np.arange(n + 1)
    m = max(0, len(padded) - 2)
    packed = padded[:m] | padded[1 : m + 1] << np.uint32(8) | padded[2 : m + 2] << np.uint32(16)
    places = (packed * np.uint32(2654435761)) >> np.uint32(33 - dims.bit_length())
    plain = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(letter & (small < 128), out=plain[1:])
    lettered = np.diff(plain[offsets]) > 0
    for d in np.flatnonzero(~lettered & (np.diff(offsets) > 0)).tolist():
        lettered[d] = any(c.isalpha() for c in buf[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "ignore"))
    return places, bounds, lettered


def vectors(places: np.ndarray, bounds: np.ndarray, lettered: np.ndarray, dims: int) -> np.ndarray:
    """Trigram counts of each document, all zero where it has no letter."""
    out = np.zeros((len(bounds) - 1, dims), np.float32)
    for d in np.flatnonzero(lettered).tolist():
        out[d] = np.bincount(places[bounds[d] : bounds[d + 1] - 2], minlength=dims)
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray
    sharpness: float

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        w = np.log1p(counts)
        w *= self.idf
        w /= np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-9)[:, None]
        return w

    def best(self, counts: np.ndarray) -> np.ndarray:
        """The greatest cosine with each language."""
        cosines = self.weigh(counts) @ self.centroids.T
        return np.stack([cosines[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(axis=1) + 1).astype(int), _CLASSES - 1)


def _blocks(batches: Iterable[pa.RecordBatch], column: int, dims: int, rows: int = 64):
    """(batch, first row, end row, counts) over whole texts, a few documents at a time."""
    for batch in batches:
        for i, j, buf, offsets in slices(batch.column(column)):
            places, bounds, lettered = trigrams(buf, offsets, dims)
            for a in range(0, j - i, rows):
                b = min(a + rows, j - i)
                yield batch, i + a, i + b, vectors(places, bounds[a : b + 1], lettered[a:b], dims)


def document_frequencies(texts: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """In how many texts each place occurs, over all texts; only `dims` sums reach the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims + 1, np.int64), 0
        for _, a, b, counts in _blocks(batches, 0, dims):
            df[:dims] += (counts > 0).sum(axis=0)
            df[dims] += b - a
            n += b - a
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["place", "n"])

    rows = texts.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(dims + 1, np.int64)
    out[rows["place"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:dims], int(out[dims])


def own_cosines(labelled: DataFrame, model: Model) -> np.ndarray:
    """How many of all labelled texts of each length class have a cosine with their own language in
    each bin; only these sums reach the driver."""
    dims, number = len(model.idf), {k: i for i, k in enumerate(model.languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((_CLASSES, _BINS + 1), np.int64)
        for batch, a, b, counts in _blocks(batches, 0, dims):
            own = np.array([number.get(x, -1) for x in batch.column(1)[a:b].to_pylist()])
            some = (own >= 0) & (counts.sum(axis=1) > 0)
            if some.any():
                fit = np.take_along_axis(model.best(counts[some]), own[some, None], axis=1)[:, 0]
                np.add.at(seen, (length_class(counts[some]), (np.clip(fit, 0, 1) * _BINS).astype(int)), 1)
        cls, at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(at), pa.array(seen[cls, at])], ["class", "bin", "n"])

    rows = labelled.select("text", "lang").mapInArrow(count, "class long, bin long, n long").groupBy("class", "bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((_CLASSES, _BINS + 1), np.int64)
    out[rows["class"].to_numpy(np.int64), rows["bin"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _cluster(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from spread-out rows."""
    draw = np.random.Generator(np.random.PCG64(seed))
    centers = x[draw.integers(0, len(x), 1)]
    while len(centers) < min(k, len(x)):
        centers = np.vstack([centers, x[np.argmin((x @ centers.T).max(axis=1))][None]])
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        sums = np.stack([x[near == c].sum(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centers.astype(np.float32)


def _sparse(dims: int):
    """(lang, pick, text) to these with the places and counts of the text's trigrams."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, counts in _blocks(batches, 2, dims):
            row, place = np.nonzero(counts)
            cuts = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (place.astype(np.int32), counts[row, place])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *lists], ["lang", "pick", "places", "counts"])

    return run


def _centroids(model: Model, sample: int, per_language: int):
    """One language's sampled texts to its centroids."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pick").slice(0, sample)
        x = np.zeros((group.num_rows, len(model.idf)), np.float32)
        for r, (at, n) in enumerate(zip(group.column("places"), group.column("counts"), strict=True)):
            x[r, at.values.to_numpy()] = n.values.to_numpy()
        centers = _cluster(model.weigh(x), per_language, 1)
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(centers), "centroid": pa.array(list(centers), pa.list_(pa.float32()))})

    return run


def floors(seen: np.ndarray, tail: float) -> np.ndarray:
    """The rejection threshold of each length class from the counts by class and cosine bin."""
    out, upto = np.zeros(_CLASSES), np.vstack([np.zeros(seen.shape[1], np.int64), np.cumsum(seen, axis=0)])
    for c in range(_CLASSES):
        for reach in range(_CLASSES):
            pooled = upto[min(c + reach, _CLASSES - 1) + 1] - upto[max(c - reach, 0)]
            if pooled.sum() >= 2 / tail:
                break
        if pooled.sum():
            out[c] = (np.cumsum(pooled) > tail * pooled.sum()).argmax() / _BINS
    return out


def train(labelled: DataFrame, sample: int = 600, per_language: int = 4, dims: int = 8192, tail: float = 0.001) -> Model:
    """labelled: doc_id, text, lang. Fits on at most `sample` texts of each language."""
    scratch.small_batches(labelled.sparkSession)
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").cast("long"), "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    df, n = document_frequencies(labelled, dims)
    model = Model([], (np.log((n + 1) / (df + 1)) + 1).astype(np.float32), np.zeros((0, dims), np.float32), np.zeros(0, int), np.zeros(_CLASSES), 20.0)
    # A share of the hash range that leaves about nine tenths of `sample` of each language, then a firm bound.
    scale = 1 << 30
    share = F.least(F.lit(scale), F.floor(F.lit(scale * sample * 0.9) / F.col("n")) + 1)
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    # As many rows as there are languages, so that they may be broadcast.
    chosen = labelled.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where(pick < F.col("share"))
    rows = chosen.select("lang", pick.alias("pick"), "text").mapInArrow(_sparse(dims), "lang string, pick long, places array<int>, counts array<float>").where(F.size("places") > 0)
    found = rows.groupBy("lang").applyInArrow(_centroids(model, sample, per_language), "lang string, centroid array<float>").toArrow()
    if not found.num_rows:
        return model
    own = np.array(found.column("lang").to_pylist(), object)
    order = np.argsort(own, kind="stable")
    model.languages = sorted(set(own))
    model.centroids = np.stack(found.column("centroid").to_numpy())[order]
    model.owner = np.searchsorted(model.languages, own[order].astype(str))
    model.floor = floors(own_cosines(labelled, model), tail)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cosine and rejected for each row of docs, from its text alone."""
    dims = len(model.idf)
    scratch.small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, counts in _blocks(batches, 1, dims):
            names, score, cosine, rejected = np.full(b - a, "und", object), np.zeros(b - a), np.zeros(b - a), np.ones(b - a, bool)
            some = counts.sum(axis=1) > 0
            if model.languages and some.any():
                best = model.best(counts[some])
                near = best.argmax(axis=1)
                soft = np.exp(model.sharpness * (best - best.max(axis=1, keepdims=True)))
                names[some] = np.array(model.languages, object)[near]
                score[some] = soft.max(axis=1) / soft.sum(axis=1)
                cosine[some] = best.max(axis=1)
                rejected[some] = best.max(axis=1) < model.floor[length_class(counts[some])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(names, pa.string()), pa.array(score), pa.array(cosine), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cosine", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose language is recognised: those that predict()
    doesn't mark rejected. No row moves between tasks."""
    dims, at = len(model.idf), docs.columns.index(text_col)
    scratch.small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, counts in _blocks(batches, at, dims):
            good = np.zeros(b - a, bool)
            some = np.flatnonzero(counts.sum(axis=1) > 0)
            if model.languages and len(some):
                good[some] = model.best(counts[some]).max(axis=1) >= model.floor[length_class(counts[some])]
            yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
