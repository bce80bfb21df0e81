"""Vectorised byte and word hashing shared by the text operators.

All helpers work on one slice of concatenated UTF-8 documents inside a Spark task. Hashes are
polynomials modulo 2**64 read off prefix sums, then mixed, so that the hash of any stretch costs
two lookups. They are the same in every process and on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
MANY = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
#: Positions whose powers are tabled; longer sequences are hashed block by block with a carry, so that
#: a worker keeps these tables alone however long a text it has met.
BLOCK = 1 << 13
_tables: dict[int, tuple[np.ndarray, np.ndarray, int, int]] = {}
_byte_codes = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _series(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64."""
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _powers(base: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The powers of base and of its inverse within a block, and both to the size of a block."""
    if base not in _tables:
        back = pow(base, -1, 1 << 64)
        _tables[base] = (_series(base, BLOCK), _series(back, BLOCK), pow(base, BLOCK, 1 << 64), pow(back, BLOCK, 1 << 64))
    return _tables[base]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Prefix:
    """Prefix sums from which the hash of any stretch [start, end) of a sequence follows.

    values: the sequence's numbers, or with `codes` the places of its numbers in codes.
    """

    def __init__(self, values: np.ndarray, base: int, codes: np.ndarray | None = None):
        n = len(values)
        power, self._inverse, step, back = _powers(base)
        scale = _series(step, n // BLOCK + 1)
        self._unscale = _series(back, n // BLOCK + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        for b in range(n // BLOCK + 1):
            own = values[b * BLOCK : (b + 1) * BLOCK]
            own = (own if codes is None else codes[own]) * power[: len(own)]
            own *= scale[b]
            if len(own):
                own[:1] += self.sums[b * BLOCK]
                np.cumsum(own, out=self.sums[b * BLOCK + 1 : b * BLOCK + 1 + len(own)])

    def _back(self, at: np.ndarray) -> np.ndarray:
        return self._inverse[at % BLOCK] * self._unscale[at // BLOCK]

    def windows(self, k: int) -> np.ndarray:
        """The hashes of all stretches of k items."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.sums[k:] - self.sums[:n]
        for b in range(n // BLOCK + 1):
            own = out[b * BLOCK : (b + 1) * BLOCK]
            own *= self._inverse[: len(own)]
            own *= self._unscale[b]
        out += np.uint64(k)
        return mix(out)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self._back(start) + length)


def byte_prefix(buf: np.ndarray) -> Prefix:
    return Prefix(buf, _BYTE_BASE, _byte_codes)


def word_prefix(hashes: np.ndarray) -> Prefix:
    return Prefix(hashes, _WORD_BASE)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its len+1 offsets; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about `most` bytes.

    A document longer than that is a run of its own, so that whole texts are always kept together.
    """
    buf, offsets = column_bytes(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_table(pattern_bytes: str) -> np.ndarray:
    """True for each byte that belongs to a word; the argument lists the separators."""
    table = np.ones(256, bool)
    table[np.frombuffer(pattern_bytes.encode("latin-1"), np.uint8)] = False
    return table


#: Bytes between words for the class [^\x20\x09-\x0D]+.
SPACES = word_table(" \t\n\x0b\x0c\r")
#: Bytes between words for [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
ALNUM = word_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes, and so all other characters, stay as they are."""
    return _LOWER[buf]


class Words:
    """The words of a slice: byte ranges, hashes if wanted, and the word range of every document."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True):
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = table[buf]
        # A document's end also ends a word, so mark starts from both sides.
        edge = np.diff(inside)
        starts = edge[:-1] == 1
        cut = offsets[1:-1]
        cut = cut[cut < len(buf)]
        inner = cut[(inside[cut + 1] == 1)]
        starts[inner] = True
        self.start = np.flatnonzero(starts)
        ends = edge == -1
        joined = inner[inner > 0]
        joined = joined[inside[joined] == 1]
        ends[joined] = True
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)  # len(docs) + 1 word offsets
        self._inside = inside[1:-1].view(bool)
        self.hash = byte_prefix(buf).spans(self.start, self.end) if hashed and len(self.start) else np.zeros(0, np.uint64)

    def strings(self, buf: np.ndarray) -> pa.Array:
        """The words themselves; buf: the bytes of the slice, or others of the same places."""
        ends = np.r_[0, np.cumsum(self.end - self.start)]
        return pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(ends), pa.py_buffer(buf[self._inside]))


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive keys, in linear time."""
    n = len(keys)
    if n < w:
        return np.zeros(0, keys.dtype)
    if w == 1:
        return keys
    m = -(-n // w)
    pad = np.full(m * w, MANY, np.uint64)
    pad[:n] = keys
    block = pad.reshape(m, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(prefix: Prefix, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Splits all windows of `window` items into runs that share an anchor.

    The anchor of a window is its k-gram of least hash (the leftmost of equals), a function of the
    window's own items: equal windows have equal anchors wherever they stand. Returns the document
    index, first and last window start (positions in the slice) and anchor hash of each run.
    bounds: the item offsets of the documents.
    """
    sizes = np.diff(bounds)
    docs = np.flatnonzero(sizes >= window)
    empty = np.zeros(0, np.int64)
    if not len(docs):
        return empty, empty, empty, np.zeros(0, np.uint64)
    grams = prefix.windows(k)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keys, window - k + 1)
    owner = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(owner) + 1, np.int8)
    np.add.at(valid, bounds[docs], 1)
    np.add.at(valid, bounds[docs + 1] - window + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    at = np.flatnonzero(valid)
    own, home = owner[at], np.searchsorted(bounds, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (home[1:] != home[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return home[first], at[first], at[last], grams[own[first]]
