"""Periodic runs, BPE and ranked search against brute force, the tokenizers library and their edge cases."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import bpe, ranking, runs
from tests.llm.test_operators import corpus, frame, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_runs(t, least):
    """By trying every start and period."""
    out, n = [], len(t)
    for s in range(n):
        for p in range(1, (n - s) // 2 + 1):
            if s and t[s - 1] == t[s - 1 + p]:
                continue
            e = s
            while e + p < n and t[e] == t[e + p]:
                e += 1
            size = e - s + p
            if size >= max(2 * p, least) and not any(t[s : s + size - q] == t[s + q : s + size] for q in range(1, p)):
                out.append((s, size, p))
    return out


def sequences(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        k, size, t = rng.choice([1, 2, 2, 3, 4]), rng.randint(0, 40), []
        while len(t) < size:
            fresh = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
            t += (fresh if not t or rng.random() < 0.5 else t[rng.randrange(len(t)) :][:12]) * rng.randint(1, 4)
        yield t


def test_runs_equal_brute_force():
    for t in sequences(3, 3000):
        for least in (2, 12):
            assert runs.runs_of(t, least) == brute_runs(t, least), t


def test_next_smaller_suffixes_and_matches():
    for t in sequences(4, 500):
        after, common = runs.lyndon(t)
        for i in range(len(t)):
            j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            same = next((k for k in range(len(t) - j) if t[i + k] != t[j + k]), len(t) - j)
            assert (after[i], common[i]) == (j, same)


def test_runs_take_linear_time():
    """Comparisons of words, counted, stay below a few for each word."""
    made = [0]

    class Word(int):
        __hash__ = int.__hash__

        def __eq__(self, other):
            made[0] += 1
            return int(self) == int(other)

    fibonacci = [0], [0, 1]
    for _ in range(16):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    ruler = [0]
    for k in range(1, 12):
        ruler = [*ruler, k, *ruler]
    for t in ([1] * 4000, [0, 1] * 2000, fibonacci[1], ruler, [-x for x in ruler], [random.Random(1).randrange(2) for _ in range(4000)]):
        made[0] = 0
        own = [Word(x) for x in t]
        after, common = runs.lyndon(own)
        assert made[0] <= 4 * len(t)
        made[0] = 0
        runs.left_extensions(own, after, common)
        assert made[0] <= 3 * len(t)


def test_stretches_keep_all_runs():
    rng = random.Random(6)
    for _ in range(300):
        docs = list(sequences(rng.random(), 3))
        flat, home = np.array([x for d in docs for x in d], np.int64), np.repeat(np.arange(3), [len(d) for d in docs])
        first = np.r_[0, np.cumsum([len(d) for d in docs])]
        least = rng.choice([4, 6, 12])
        found = [[], [], []]
        for a, b in zip(*runs.stretches(flat, home, least // 2), strict=True):
            assert home[a] == home[b - 1]
            found[home[a]] += [(a - first[home[a]] + s, n, p) for s, n, p in runs.runs_of(flat[a:b].tolist(), least)]
        assert [sorted(f, key=lambda r: (r[0], r[2])) for f in found] == [brute_runs(d, least) for d in docs]


def test_periodic_runs(spark):
    rng = random.Random(2)
    rows = corpus(5) + [(100, "a b " * 40 + "c " + "x y z " * 9), (101, "w " * 4000), (101, "w " * 4000), (None, "p q " * 20)]
    rows += [(200 + k, " ".join(rng.choice("ab") for _ in range(60))) for k in range(30)]
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = frame(spark, rows).repartition(5)
    got = runs.periodic_runs(docs, repeat=F.when(h % 10 == 0, h)).collect()
    digests = runs.periodic_runs(docs, repeat=F.when(h % 10 == 0, h), summary=True).collect()
    wanted, told = Counter(), Counter()
    changed = 0
    for i, text in rows:
        own = words(text)
        c, n = crc32(str(i).encode()), len(own)
        if i is not None and c % 10 == 0 and n:
            a = (c // 10) % n
            p = 1 + (n - a) // (3 + c // 10 % 8)
            own = [own[k] if k < a else own[a + (k - a) % p] for k in range(n)]
            changed += 1
        if len(own) > 900 and len(set(own)) == 1:
            found = [(0, n, 1)]
        elif len(own) > 900:
            found = [tuple(r) for r in runs.runs_of([sorted(set(own)).index(w) for w in own], 12)]  # checked above
        else:
            found = brute_runs(own, 12)
        gone = {k for s, size, p in found for k in range(s + p, s + size)}
        top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        listed = "".join(f"{s},{size},{p}\n" for s, size, p in found)
        wanted[i, len(found), *longest, tuple(found), kept] += 1
        told[i, len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert changed > 2
    assert Counter((*r[:6], tuple(tuple(x) for x in r.runs), r.collapsed) for r in got) == wanted
    assert Counter(tuple(r) for r in digests) == told
    assert runs.periodic_runs(docs.limit(0)).count() == 0


# BPE

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Tokenizer(file.read())


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(PATH)


def awkward(tokenizer):
    rng = random.Random(8)
    out = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endoftext", "'s 'T I'll  \n\n x　 y \x85 z\x1c\x1d", "​﻿ ½²Ⅷ ٣", "\x00\x01", "é'", "x'r", "x're"]
    out += ["a" * 5000, "=-" * 3000, " " * 4099, "\n" * 3000, "é" * 4001, "漢字" * 3000, "🙂" * 999, "ab" * 40]
    for letters in ("ab", "abcde ", "-=_*", "ÃÂ", "aA0 .\n'", "éèü漢🙂 "):
        out += ["".join(rng.choice(letters) for _ in range(n)) for n in (5, 60, 70, 3000)]
    known = [s for s in (b.decode("utf-8", "ignore").strip() for b in tokenizer.bytes) if s]
    return out + ["".join(rng.choice(known) for _ in range(900)) for _ in range(20)]


def encoded(tokenizer, text):
    return tokenizer.encode([p for some in tokenizer.pieces(text) for p in some])[0].tolist()


def test_tokens_are_those_of_the_library(tokenizer, library):
    for text in awkward(tokenizer):
        assert encoded(tokenizer, text) == library.encode(text, add_special_tokens=False).ids, text[:60]


def test_pieces_do_not_depend_on_stretches(tokenizer, monkeypatch):
    texts = [t for t in awkward(tokenizer) if "<|" not in t]
    whole = [tokenizer._piece.findall(t) for t in texts]
    for size in (4, 7, 64):
        monkeypatch.setattr(bpe, "STRETCH", size)
        assert [[p for some in tokenizer.pieces(t) for p in some] for t in texts] == whole


def test_lookahead_is_sufficient(tokenizer):
    """With any portions, and with short lists whose lookahead is tight, what is emitted early stays."""
    rng = random.Random(3)
    for _ in range(300):
        made, merges = [b"a", b"b", b"c"], []
        while len(merges) < 12:
            u, v = rng.choice(made), rng.choice(made)
            if u + v not in made:
                merges.append((u, v))
                made.append(u + v)
        ids = {bytes([b]): b for b in range(256)} | {u + v: 256 + k for k, (u, v) in enumerate(merges)}

        class Small:
            single, ahead = list(range(256)), bpe.lookahead(merges)
            pairs = {(ids[u], ids[v]): (k, ids[u + v]) for k, (u, v) in enumerate(merges)}
            sizes = [len(b) for b in ids]

        raw = bytes(rng.choice(b"abc") for _ in range(200))
        machine, whole = bpe.Transducer(Small), bpe.Transducer(Small).merged(raw)
        k, out, most = 0, [], 0
        while k < len(raw):
            n = rng.randint(1, 9)
            out += machine.feed(raw[k : k + n])
            most, k = max(most, len(machine._held)), k + n
        assert out + machine.finish() == whole
        assert most <= Small.ahead + max(Small.sizes) + 9
    raw = b"".join(rng.choice(tokenizer.bytes[:50_000]) for _ in range(3000))
    machine, out = bpe.Transducer(tokenizer), []
    for k in range(0, len(raw), 100):
        out += machine.feed(raw[k : k + 100])
    assert out + machine.finish() == bpe.Transducer(tokenizer).merged(raw)


def test_lists_without_a_lookahead_are_refused():
    with pytest.raises(ValueError):
        bpe.lookahead([(b"ab", b"c")])
    with pytest.raises(ValueError):
        bpe.lookahead([(b"a", b"b"), (b"ab", b"c"), (b"b", b"c"), (b"a", b"bc")])


def test_decoder_keeps_unfinished_characters(tokenizer, library):
    rng = random.Random(1)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 80))]
        state, k, out = tokenizer.decoder(), 0, ""
        while k < len(ids):
            n = rng.randint(1, 4)
            out, k = out + state.feed(ids[k : k + n]), k + n
        assert out + state.finish() == library.decode(ids, skip_special_tokens=False)


def test_bpe_over_rows(spark, tokenizer, library, tmp_path):
    rows = [*corpus(4), (50, None), (50, None), (None, "null id"), (60, "a" * 70_000)]
    rows += [(70 + k, t) for k, t in enumerate(awkward(tokenizer)) if "\x00" not in t]
    got = bpe.coded(frame(spark, rows).repartition(3), PATH).collect()
    digests = bpe.coded(frame(spark, rows).repartition(3), PATH, summary=True).collect()
    wanted = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=key) == sorted(wanted, key=key)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = Counter((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode())) for i, ids, text in wanted)
    assert Counter(tuple(r) for r in digests) == told
    assert bpe.coded(frame(spark, rows).limit(0), PATH).count() == 0
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Tokenizer((tmp_path / "other.json").read_text())


# Ranked search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_search(docs, items, top=10, once=True):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    wanted = {}
    for name, text in items:
        wanted.setdefault(name, Counter()).update(terms(text))
    out = []
    for name, query in wanted.items():
        found = []
        for i, c in own:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t, k in query.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += (1 if once else k) * w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(name, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return out


def test_ranked_search(spark):
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "e1", "Ünder", "zz", "rare", "漢"]
    docs = [*corpus(7), (500, "alpha alpha beta"), (501, "alpha alpha beta"), (501, "alpha alpha beta"), (None, "ALPHA alpha, beta"), (None, "!!"), (502, "gamma " * 20_000)]
    docs += [(600 + k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for k in range(60)]
    items = [("i1", "alpha beta beta"), ("i2", "rare-gamma"), ("i3", None), ("i4", "unheard"), (None, "zz E1"), ("i5", "alpha"), ("i5", "漢 Ünder"), ("i6", "x" * 500)]
    queries = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, score long")
    spread = frame(spark, docs).repartition(6)
    key = lambda r: (r[0] is None, r[0] or "", r[1])
    for kw in ({}, {"top": 3}, {"once": False}, {"block_terms": 2}):
        got = ranking.search(spread, queries, **kw)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        wanted = brute_search(docs, items, **{k: v for k, v in kw.items() if k != "block_terms"})
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(wanted, key=key)
    assert ranking.search(spread, queries.limit(0)).count() == 0
    assert ranking.search(spread.limit(0), queries).count() == 0


def test_blocks_of_the_product(spark, monkeypatch):
    """Blocks of one batch each, in tasks of several: the same rows."""
    docs = [(k, " ".join(f"t{(k * j) % 17}" for j in range(1, 20))) for k in range(400)]
    queries = spark.createDataFrame([(k, f"t{k} t{k + 3} t5") for k in range(12)], "item_id int, text string")
    items = ranking.Items([[f"t{k}", f"t{k + 3}", "t5"] for k in range(12)], True)
    table = frame(spark, docs).coalesce(1)
    whole = sorted(map(tuple, ranking.search(table, queries).collect()))
    import pyarrow as pa

    counted = ranking._counted(items.vocabulary)([pa.record_batch({"doc_id": pa.array([d for d, _ in docs]), "text": pa.array([t for _, t in docs])})])
    batches = [b.slice(k, 7) for b in counted for k in range(0, b.num_rows, 7)]
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 7)
    df = Counter(t for _, text in docs for t in set(text.split()))
    weight = np.array([math.floor(1000 * math.log((2 * 400 + 2) / (2 * df[t] + 1))) for t in items.vocabulary.to_pylist()])
    (out,) = ranking._scored(items, weight, 400, 400 * 19, 10)(batches)
    rows = sorted(zip(*(c.to_pylist() for c in out.columns), strict=True), key=lambda r: (r[0], -r[2], r[1]))
    assert [(i, d, s) for i, _, d, s in whole] == rows
