"""BPE encoding by a transducer with bounded lookahead, and decoding by a byte-to-text state machine.

The files are those of byte-level BPE in the tokenizers library's JSON format; their path is a
parameter. A text is cut at the added tokens, the rest into pieces by the pre-tokenizer's pattern, and
each piece's bytes go through the transducer.

Lookahead. Merges act in their order. Compare a text's merges with those of a longer text that begins
with it: at first all tokens of the shorter one agree. A merge (u, v) can move the end of what agrees
back only if the last token that agrees is u and a token after it, in one of the two, is v. So it moves
back by the length of u, and the tokens after it begin with u from then on. The next merge that moves
it must be a later one whose right part begins with u. The longest such chain, summed over the bytes
of its left parts, is the sufficient lookahead of the merge list: a token that ends as many bytes
before the end of what has been read stays, whatever follows. `lookahead()` computes it in one pass
over the merges. It holds if a merge's parts are bytes or made by earlier merges and no token is made
by two merges; any other list is refused.

The transducer reads a piece in portions of `PORTION` bytes, merges what it holds, emits the tokens
that are stable and keeps the bytes of the rest, no more than the lookahead and a token. So what it
holds is constant, however long a piece is, and its time is linear. Pieces of no more than `SHORT`
bytes are whole before the lookahead is reached; the distinct ones of some texts are merged side by
side, a merge of each at a time.

The decoder feeds the bytes of the tokens, some thousands at a time, to a state machine that holds the
bytes of an unfinished character between calls; bytes that are no UTF-8 become U+FFFD.

Null counts as empty and gives no tokens and an empty text. A text is handled in one task, as its
result is one row. Rows are kept apart, repeated and null ids included; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm import scratch
from shelfscope.llm.textbytes import column_bytes

#: Bytes of a piece that the transducer reads at once.
PORTION = 2048
#: Bytes of a piece up to which it is merged side by side with others.
SHORT = 64
#: Tokens whose bytes the decoder reads at once.
DECODED = 1 << 16
#: Characters of texts whose pieces are held at once; only a longer piece takes more.
STRETCH = 1 << 20
#: Characters after a piece on which its end can depend.
BEYOND = 3
_NONE = np.int64(1 << 62)

#: Fixed value: the pattern of byte-level pre-tokenizers.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, ids array<int>, decoded string"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the files: printable ones for themselves, the others
    by the characters from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if chr(b) not in out]
    return out | {chr(256 + k): b for k, b in enumerate(hidden)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """The sufficient lookahead in bytes: the longest chain of merges that move the end of what agrees
    back, summed over their left parts."""
    made = {bytes([b]) for b in range(256)}
    farthest: dict[bytes, int] = {}
    for u, v in merges:
        if u not in made or v not in made or u + v in made:
            raise ValueError("a merge's parts must be made before it, and each token by one merge")
        made.add(u + v)
        back = len(u) + max((farthest.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        farthest[u] = max(farthest.get(u, 0), back)
    return max(farthest.values(), default=0)


class Transducer:
    """Bytes of one piece in, stable tokens out."""

    def __init__(self, tokenizer: Tokenizer):
        self._pairs, self._single, self._ahead = tokenizer.pairs, tokenizer.single, tokenizer.ahead
        self._sizes, self._held = tokenizer.sizes, b""

    def merged(self, raw: bytes) -> list[int]:
        """The tokens of all of raw, merged in the list's order, leftmost first."""
        token, pairs = [self._single[b] for b in raw], self._pairs
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(pairs[p][0], k, p) for k, p in enumerate(zip(token, token[1:], strict=False)) if p in pairs]
        heapq.heapify(queue)
        while queue:
            _, k, pair = heapq.heappop(queue)
            r = after[k] if token[k] >= 0 else n
            if r >= n or (token[k], token[r]) != pair:
                continue
            token[k], token[r], after[k] = pairs[pair][1], -1, after[r]
            if after[k] < n:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (p := (token[left], token[right])) in pairs:
                    heapq.heappush(queue, (pairs[p][0], left, p))
        return [t for t in token if t >= 0]

    def feed(self, raw: bytes) -> list[int]:
        """The tokens that are stable once raw has been read too."""
        held = self._held + raw
        tokens, end = self.merged(held), 0
        for count, t in enumerate(tokens):
            if end + self._sizes[t] > len(held) - self._ahead:
                break
            end += self._sizes[t]
        else:
            count = len(tokens)
        self._held = held[end:]
        return tokens[:count]

    def finish(self) -> list[int]:
        """The tokens that were held back; the transducer is then as new."""
        held, self._held = self._held, b""
        return self.merged(held)


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at start and have these sizes, one after another."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


class Tokenizer:
    """A byte-level BPE file, ready to encode and to decode."""

    def __init__(self, spec: str):
        told = json.loads(spec)
        if told["normalizer"] or told["post_processor"] or (told["pre_tokenizer"]["type"], told["decoder"]["type"]) != ("ByteLevel", "ByteLevel") or told["pre_tokenizer"]["add_prefix_space"] or not told["pre_tokenizer"]["use_regex"]:
            raise ValueError("only byte-level files without normalizer, post-processor and prefix space")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in told["added_tokens"]):
            raise ValueError("added tokens that reach beyond their own text")
        code, model = byte_characters(), told["model"]
        plain = lambda s: bytes(code[c] for c in s)
        ids = {plain(s): i for s, i in model["vocab"].items()}
        split = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]]
        merges = [(plain(u), plain(v)) for u, v in split]
        self.ahead = lookahead(merges)
        self.single = [ids[bytes([b])] for b in range(256)]
        self.pairs = {(ids[u], ids[v]): (rank, ids[u + v]) for rank, (u, v) in enumerate(merges)}
        self.added = {a["content"]: a["id"] for a in told["added_tokens"]}
        known = ids | {s.encode(): i for s, i in self.added.items()}
        self.bytes = [b""] * (1 + max(known.values()))
        for raw, i in known.items():
            self.bytes[i] = raw
        self.sizes = [len(b) for b in self.bytes]
        self._size = len(self.bytes)
        keyed = sorted((u * self._size + v, rank, new) for (u, v), (rank, new) in self.pairs.items())
        self._keys, self._ranks, _ = np.array(keyed + [(_NONE, 0, 0)], np.int64).T.copy()
        self._made = np.array([new for _, new in sorted(self.pairs.values())] or [0], np.int64)
        self._byte = np.array(self.single, np.int64)
        longest = sorted(self.added, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self._piece = regex.compile(PIECE)
        self._transducer = Transducer(self)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, some at a time; an added token is a piece of its own."""
        for part in self._cut.split(text) if self._cut else [text]:
            if part in self.added:
                yield [part]
                continue
            start, most = 0, STRETCH
            while start < len(part):
                some = self._piece.findall(part, start, start + most)
                end = sum(map(len, some))
                if start + most < len(part):  # pieces whose end may depend on what comes next are read again
                    while some and end > most - BEYOND:
                        end -= len(some.pop())
                    most = STRETCH if some else 2 * most
                start += end
                yield some

    def side_by_side(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of pieces that stand one after another in raw, and how many each piece has."""
        token, piece = self._byte[raw], np.repeat(np.arange(len(size)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranked(at: np.ndarray) -> np.ndarray:
            """The ranks of the pairs that begin at these places; no pair goes beyond its piece."""
            right = np.minimum(at + 1, len(token) - 1)
            key = np.where((piece[right] == piece[at]) & (right > at), token[at] * self._size + token[right], -1)
            place = np.searchsorted(self._keys, key)
            return np.where(self._keys[place] == key, self._ranks[place], _NONE)

        rank = ranked(np.arange(len(token)))
        while len(token):
            head = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.r_[head, len(token)]))
            over = least == _NONE
            if over.any():
                done.append((token[over], piece[over]))
            hit = np.flatnonzero((rank == least) & ~over)
            new = np.r_[True, hit[1:] != hit[:-1] + 1]  # of overlapping ones every second, from the left
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[: len(hit)]
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            token[hit] = self._made[rank[hit]]
            stay = ~over
            stay[hit + 1] = False
            token, piece, rank = token[stay], piece[stay], rank[stay]
            place = (np.cumsum(stay) - 1)[hit]
            rank[place] = ranked(place)
            place = place[place > 0] - 1
            rank[place] = ranked(place)
        tokens, pieces = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (raw[:0].astype(np.int64), raw[:0].astype(np.int64))
        return tokens[np.argsort(pieces, kind="stable")], np.bincount(pieces, minlength=len(size))

    def transduced(self, raw: bytes) -> list[int]:
        """The tokens of one piece, read in portions."""
        out: list[int] = []
        for k in range(0, len(raw), PORTION):
            out += self._transducer.feed(raw[k : k + PORTION])
        return out + self._transducer.finish()

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of some pieces, and how many each has. Each distinct piece is merged once."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        raw, offsets = column_bytes(coded.dictionary)
        size, code = np.diff(offsets), coded.indices.to_numpy(zero_copy_only=False)
        special = {i: [self.added[s]] for s in self.added if (i := coded.dictionary.index(s).as_py()) >= 0}
        alone = special | {int(i): self.transduced(raw[offsets[i] : offsets[i + 1]].tobytes()) for i in np.flatnonzero(size > SHORT) if int(i) not in special}
        short = np.ones(len(size), bool)
        short[list(alone)] = False
        tokens, some = self.side_by_side(raw[np.repeat(short, size)], size[short])
        count = np.zeros(len(size), np.int64)
        count[short] = some
        start = np.cumsum(count) - count
        for i, own in alone.items():
            start[i], count[i] = len(tokens), len(own)
            tokens = np.append(tokens, own)
        return gathered(tokens, start[code], count[code]), count[code]

    def decoder(self) -> TextDecoder:
        return TextDecoder(self)


class TextDecoder:
    """Tokens in, text out; an unfinished character waits for the bytes that complete it."""

    def __init__(self, tokenizer: Tokenizer):
        self._bytes = tokenizer.bytes
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self._state.decode(b"".join(map(self._bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self._state.decode(b"", final=True)


@lru_cache(maxsize=1)
def _loaded(spec: str) -> Tokenizer:
    """A worker that serves several tasks reads the file once."""
    return Tokenizer(spec)


class _Row:
    """What becomes of one text: numbers and digests, or all tokens and the whole text."""

    def __init__(self, tokenizer: Tokenizer, summary: bool):
        self._back, self._summary = tokenizer.decoder(), summary
        self._n, self._of_ids, self._of_text = 0, hashlib.sha256(), hashlib.sha256()
        self._ids: list[np.ndarray] = []
        self._text: list[str] = []

    def _read(self, text: str) -> None:
        if self._summary:
            self._of_text.update(text.encode())
        else:
            self._text.append(text)

    def add(self, ids: np.ndarray) -> None:
        self._n += len(ids)
        if self._summary:
            self._of_ids.update(ids.astype("<u4").tobytes())
        else:
            self._ids.append(ids.astype(np.int32))
        for k in range(0, len(ids), DECODED):
            self._read(self._back.feed(ids[k : k + DECODED].tolist()))

    def told(self) -> tuple:
        self._read(self._back.finish())
        if self._summary:
            return self._n, self._of_ids.hexdigest(), self._of_text.hexdigest()
        return np.concatenate([np.zeros(0, np.int32), *self._ids]), "".join(self._text)


def _coded(spec: str, summary: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if summary else ["doc_id", "ids", "decoded"]
    types = [pa.int64(), pa.string(), pa.string()] if summary else [pa.list_(pa.int32()), pa.string()]

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _loaded(spec)
        for batch in batches:
            rows = [_Row(tokenizer, summary) for _ in range(batch.num_rows)]
            held: list[str] = []
            marks: list[tuple[_Row, int]] = []
            chars = 0

            def flush() -> None:
                ids, count = tokenizer.encode(held)
                ends, at, done = np.r_[0, np.cumsum(count)], 0, 0
                for row, n in marks:
                    at += n
                    row.add(ids[done : ends[at]])
                    done = ends[at]
                held.clear()
                marks.clear()

            for row, text in zip(rows, batch.column("text"), strict=True):
                for some in tokenizer.pieces(text.as_py() or ""):
                    held += some
                    marks.append((row, len(some)))
                    chars += sum(map(len, some))
                    if chars > STRETCH:
                        flush()
                        chars = 0
            flush()
            told = [row.told() for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[c] for r in told], t) for c, t in enumerate(types))], names=names)

    return coded


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", summary: bool = False) -> DataFrame:
    """For each row the tokens of its text and the text decoded from them, or with `summary` their
    number and digests (n_tokens, ids_sha256 over little-endian 32-bit numbers, decoded_sha256).

    path: the tokenizer's file, read by the driver; its text goes to the tasks with their code.
    """
    scratch.small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_coded(spec, summary), DIGESTS if summary else TOKENS)
