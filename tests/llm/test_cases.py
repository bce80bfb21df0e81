"""Cases of single operators that the comparison with brute force in test_operators leaves out."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfscope.llm import chat, decontam, exact, langid, mixing, scratch, urlgraph
from shelfscope.llm.queries import RULES, op8_url_filter
from shelfscope.llm.textbytes import BLOCK, byte_prefix
from tests.llm.test_operators import brute_hits, brute_targets, corpus, frame


def test_hashes_do_not_depend_on_blocks():
    raw = np.frombuffer(random.Random(1).randbytes(3 * BLOCK + 7), np.uint8)
    whole, start = byte_prefix(raw), np.array([0, 5, BLOCK - 3, 2 * BLOCK, 3 * BLOCK - 50])
    end = start + np.array([9, BLOCK + 2, 40, BLOCK, 57])
    assert [byte_prefix(raw[a:b]).spans(np.array([0]), np.array([b - a]))[0] for a, b in zip(start, end, strict=True)] == whole.spans(start, end).tolist()
    assert (whole.windows(60) == whole.spans(np.arange(len(raw) - 59), np.arange(60, len(raw) + 1))).all()


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        scratch.path(Session(), "x")


PART = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)


def test_chat_parts_read_back(spark):
    turns = [
        [PART("text", "a <|image|> b"), PART("image", None, "i.png", 400), PART("text", "c")],
        [PART("im_start", None, "x", 3), PART(None, "plain"), PART("im_end|>\n<|im_start|>assistant\n", "y")],
        None,
        [None, PART("text", None), PART("document", None, None, None)],
        [PART("text", "<"), PART("text", "|im_end|>"), PART("text", "<\\"), PART("text", "|x")],
        [],
    ]
    rows = [(1, n, "assistant" if n == 4 else "user", p) for n, p in enumerate(turns)]
    made = chat.render(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}"))
    row, back = made.first(), chat.read_back(made).first()
    want = [
        [("text", "a <|image|> b"), ("image", None), ("text", "c")],
        [("other", None), ("text", "plain"), ("other", None)],
        [],
        [("document", None)],
        [("text", "<|im_end|><\\|x")],
        [],
    ]
    assert [[(p.kind, p.text) for p in t.parts] for t in back.turns] == want
    assert [t.text for t in back.turns] == ["a <|image|> bc", "plain", "", "", "<|im_end|><\\|x", ""]
    assert back.loss_text == "<|im_end|><\\|x" and row.formatted.count(chat.START) == row.formatted.count(chat.END) == 6
    assert [(a.turn_number, a.part, a.placeholder, a.kind, a.tokens) for a in row.attachments] == [(1, 1, 1, "image", 100), (2, 0, 2, "im_start", 1), (2, 2, 3, "im_end|>\n<|im_start|>assistant\n", 1), (4, 2, 4, "document", 1)]


@pytest.mark.parametrize("block_words", [10**6, 7])
def test_decontamination_keeps_rows_apart(spark, block_words):
    leak, clean = " ".join(f"b{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    rows = [(None, leak), (None, clean), (1, leak), (1, clean), (1, leak), (2, None)]
    bench = spark.createDataFrame([(1, leak), (2, "one two"), (None, "c3"), (4, leak + " more")], "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.longest) for r in decontam.contamination(frame(spark, rows), bench, block_words=block_words).collect())
    hit, seen = (30, 30, ("1", "4"), 30), (30, 1, (), 1)
    assert got == {(None, *hit): 1, (None, *seen): 1, (1, *hit): 2, (1, *seen): 1, (2, 0, 0, (), 0): 1}
    assert decontam.clean(frame(spark, rows), bench, block_words=block_words).count() == 1


def test_decontamination_of_repetitive_texts(spark):
    """Places are bounded by the text's words, however often both sides repeat themselves."""
    rows = [(0, "a " * 20_000), (1, "a b " * 3000), (2, " ".join(f"w{i % 7}" for i in range(9000))), (3, "x")]
    items = [(0, "a " * 2000), (1, "b a " * 700), (2, " ".join(f"w{i % 7}" for i in range(3, 1500)))]
    got = decontam.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == brute_hits(rows, items, 10)
    assert {r.doc_id: r.longest for r in got} == {0: 2000, 1: 1400, 2: 1497, 3: 0}


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    """With hashes of the words' lengths alone, only the comparison of bytes is left."""
    real = decontam.Words

    def crude(*args):
        words = real(*args)
        words.hash = (words.end - words.start).astype(np.uint64) << np.uint64(40)
        return words

    monkeypatch.setattr(decontam, "Words", crude)
    items = [(1, "a bb ccc dddd eeeee")]
    block = decontam.Block.build([1], __import__("pyarrow").array([items[0][1]]), 10)
    find = decontam._find(block, 10, 0, ["text", "spans", "items", "longest"])
    pa = __import__("pyarrow")
    texts = ["x a bb ccc dddd eeeee", "a bb ccc dddX eeeee", "a bb ccc dddd"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([[]] * 3, pa.list_(pa.int64())), pa.array([[]] * 3, pa.list_(pa.string())), pa.array([0] * 3, pa.int64())], ["text", "spans", "items", "longest"])
    assert [x for out in find([batch]) for x in out.column("items").to_pylist()] == [["1"], [], []]


def sizes_of(rows, so_far):
    """By brute force: keep_id and group_size of each row, counting all rows so far."""
    n, best = Counter(t or "" for _, t in so_far), {}
    for i, t in so_far:
        best[t or ""] = max(i, best.get(t or "", i))
    return sorted((i, best[t or ""], n[t or ""]) for i, t in rows)


def test_exact_dedup_goes_on_from_stored_state(spark, tmp_path):
    def save(rows, name):
        frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    first, second = [(1, "a"), (2, "b"), (3, "a"), (4, None)], [(5, "a"), (6, "c"), (0, "b"), (7, ""), (8, "d")]
    one, two = save(first, "one"), save(second, "two")
    take = lambda out: sorted((r.doc_id, r.keep_id, r.group_size) for r in out.collect())
    state = str(tmp_path / "state")
    assert take(exact.duplicates(one, state=state)) == sizes_of(first, first)
    both = one.unionByName(two)
    assert take(exact.duplicates(two, state=state, corpus=both)) == sizes_of(second, first + second)
    empty = two.where("doc_id > 99")
    assert take(exact.duplicates(empty, state=state, corpus=both)) == []


def test_exact_dedup_opens_only_the_files_of_keepers(spark, tmp_path):
    """Earlier keepers are compared byte for byte, from their own files; the others are not there any more."""
    state, parts, take = str(tmp_path / "state"), {}, lambda out: sorted((r.doc_id, r.keep_id, r.group_size) for r in out.collect())
    for k, rows in enumerate([[(1, "a"), (2, "b")], [(3, "c"), (4, "d")], [(5, "e")]]):
        parts[k] = str(tmp_path / f"part {k} [{k}]")
        frame(spark, rows).coalesce(1).write.parquet(parts[k])
    for k in range(3):
        exact.duplicates(spark.read.parquet(re.sub(r"([\[\]])", r"\\\1", parts[k])), state=state).collect()
    opened = []

    def read(files):
        opened.extend(files)
        return spark.read.parquet(*files)

    new = frame(spark, [(9, "c"), (10, "x")])
    assert take(exact.duplicates(new, state=state, read=read)) == [(9, 9, 2), (10, 10, 1)]
    assert len(opened) == 1 and "part 1" in opened[0]
    with pytest.raises(ValueError, match="no longer stand"):
        exact.duplicates(frame(spark, [(11, "e")]), state=state, read=lambda files: new.where("doc_id < 0"))


@pytest.mark.parametrize("few", [0, 1000])
def test_exact_dedup_sees_collisions_with_texts_of_earlier_calls(spark, tmp_path, few):
    def save(rows, name):
        frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    calls = [[(1, "aa"), (2, "b")], [(3, "cc"), (4, "b")], [(5, "cc"), (6, "aa"), (7, "ddd")], [(9, None)], [(8, "aa"), (10, "")]]
    state, so_far, tables = str(tmp_path / "state"), [], None
    for k, rows in enumerate(calls):
        docs = save(rows, f"call{k}")
        so_far, tables = so_far + rows, docs if tables is None else tables.unionByName(docs)
        out = exact.duplicates(docs, state=state, corpus=tables, digest=lambda c: F.length(c).cast("long"), few=few)
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out.collect()) == sizes_of(rows, so_far)


@pytest.mark.parametrize("few", [0, 1000])
def test_exact_dedup_tells_collisions_apart(spark, few):
    rows = corpus(4) + [(100, "One two  three"), (101, "a")]
    out = exact.duplicates(frame(spark, rows), digest=lambda c: F.length(c).cast("long") % 7, few=few)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out.collect()) == sizes_of(rows, rows)


def test_language_of_no_learned_kind_is_rejected(spark):
    """Texts of a language that wasn't learned but has the same letters; all learned ones stay."""
    rng = random.Random(3)
    stems = {k: ["".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(40)] for k in ("aa", "bb", "cc", "zz")}
    text = lambda k, n: " ".join(rng.choice(stems[k]) + rng.choice(stems[k]) for _ in range(n))
    rows = [(i, text(k, rng.randint(20, 200)), k) for i, k in enumerate(["aa", "bb", "cc"] * 200)]
    other = [(10_000 + i, text("zz", rng.randint(20, 200)), None) for i in range(60)]
    docs = spark.createDataFrame(rows + other, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 450"), sample=100)
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert np.mean([out[i].rejected for i, *_ in other]) > 0.95
    assert np.mean([out[i].rejected for i, *_ in rows]) < 0.01 and all(out[i].lang_pred == k for i, _, k in rows)


def test_every_language_is_learned(spark):
    name = lambda k: f"{chr(97 + k // 16)}{chr(97 + k % 16)}"
    rows = [(3 * k + n, (name(k) * 3 + " ") * (n + 4), name(k)) for k in range(256) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, per_language=1)
    assert len(model.languages) == 256
    assert langid.predict(docs, model).join(docs, "doc_id").where("lang_pred = lang").count() == len(rows)


def test_mix_can_be_read(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 90))), rng.choice(["a", "a", "b", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r for r in mixing.mix(docs, block=16, shard=64).collect()}
    pieces = mixing.packed(docs, block=16, shard=64).collect()
    words = Counter()
    for p in pieces:
        words[p.doc_id] += p.words
        assert 0 <= p.skip and p.words > 0 and p.skip + p.words <= taken[p.doc_id].size
    assert {i: r.taken for i, r in taken.items() if r.taken} == dict(words)
    slots = Counter()
    for p in pieces:
        slots[(p.shard, p.source, p.slot)] += p.words
    assert max(slots.values()) <= 16 and {p.shard for p in pieces} == set(range(max(p.shard for p in pieces) + 1))
    want = brute_targets(Counter({s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", None)}))
    assert sum(words.values()) == pytest.approx(sum(want.values()), abs=48)


def test_url_filter_by_brute_force(spark, tmp_path):
    """The whole query against ranks of a dense power iteration."""
    rng = random.Random(4)
    hosts = ["a.example.com", "www.example.com", "b.example.net", "c.example.net", "d.example.org", "e.example.org", "f.other.io", "lone.dev"]
    rows = []
    for i in range(300):
        host = rng.choice(hosts[:6] if i % 3 else hosts)
        links = rng.sample(hosts[:7], rng.randint(0, 3)) if host != "lone.dev" else []
        near = [h for h in links if (h.endswith("net")) == (host.endswith("net"))]
        rows.append((i, f"https://{host}/{rng.choice(['en', 'es', 'fr', 'x'])}/{i}", "".join(f'<a href="http://{h}/">x</a>' for h in near)))
    rows += [(900, None, "<a href='http://a.example.com/'>"), (901, "nothing", None), (902, "http://new.example.com", None), rows[0]]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = op8_url_filter(spark, str(tmp_path)).collect()

    def rule(host, path):
        fit = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else None

    parts = lambda u: (u.split("://")[1].partition("/")[0], "/" + u.split("://")[1].partition("/")[2] if "/" in u.split("://")[1] else "") if u and "://" in u else ("", "")
    names, edges = set(), Counter()
    for _, u, html in rows:
        src = parts(u)[0]
        names |= {src} - {""}
        for dst in (x.split("/")[0] for x in (html or "").split("http://")[1:]):
            if src and src != dst:
                edges[src, dst] += 1
                names |= {dst}
    for x in {".".join(n.split(".")[i:]) for n in names for i in range(n.count(".") + 1)}:
        up = x.partition(".")[2]
        if "." in up:
            names |= {x, up}
            edges[x, up] += 1
            edges[up, x] += 1
    at = {n: i for i, n in enumerate(sorted(names))}
    seed, rank = {}, {}
    for v in ("allow", "block"):
        s = np.zeros(len(at))
        for _, u, _ in rows:
            if (f := rule(*parts(u))) and f[1] == v:
                s[at[parts(u)[0]]] += 1
        seed[v] = s / s.sum()
        w = np.zeros((len(at), len(at)))
        for (a, b), n in edges.items():
            w[(at[a], at[b]) if v == "allow" else (at[b], at[a])] += n
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
        x = seed[v]
        for _ in range(300):
            x = 0.15 * seed[v] + 0.85 * x @ w
        rank[v] = x
    seen = set()
    for r in got:
        host, path = parts(next(u for i, u, _ in rows if i == r.page_id))
        fit = rule(host, path)
        t, d = (rank[v][at[host]] if host in at else 0.0 for v in ("allow", "block"))
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[0])
        assert r.trust == pytest.approx(t, rel=0.05, abs=2e-3) and r.distrust == pytest.approx(d, rel=0.05, abs=2e-3)
        if fit or abs(d - t) > 0.02 * (d + t):
            assert r.verdict == (fit[1] if fit else "block" if d > t else "allow")
        if not fit:
            seen.add(r.verdict)
    assert len(got) == len(rows) and seen == {"allow", "block"}


def test_mixing_does_not_depend_on_the_layout_of_files(spark, tmp_path):
    """Split sizes, numbers of files, order of rows and partitions of shuffles change nothing."""
    rows = [(i, t, None, f"s{i % 4}") for i, t in corpus(3)] + [(i % 50, f"w{i} " * (i % 90), None, "s9") for i in range(2000)]
    rows += [(7, "same text " * 5, None, "s1")] * 2500 + [(None, "no id " * 4, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    results, packs = [], []
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    try:
        for n, (files, split, parts) in enumerate([(1, "128m", 4), (7, "2k", 3), (13, "16k", 9)]):
            docs.orderBy(F.rand(n)).repartition(files).write.parquet(f"{tmp_path}/{n}")
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            some = spark.read.parquet(f"{tmp_path}/{n}")
            results.append(Counter(map(tuple, mixing.mix(some, block=16, shard=64).collect())))
            packs.append(Counter(map(tuple, mixing.packed(some, block=16, shard=64).collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert results[0] == results[1] == results[2] and sum(results[0].values()) == len(rows)
    assert packs[0] == packs[1] == packs[2]
    assert len({r[-1] for r in results[0] if r[0] == 7}) > 1  # copies are placed one by one
