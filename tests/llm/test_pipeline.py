"""The registered queries over test data and the pipeline over a fixture, against SQL, plain Python
versions of the same steps, or labels held out of training."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfscope.llm import langid, queries, textbytes
from shelfscope.llm import quality as quality_model
from tests.llm.test_operators import brute_components, brute_hits, brute_targets, words
from tests.test_queries import DATA, same

MORE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    def trimmed(session, data):
        out = queries.queries()[name](session, data)
        return out.drop("longest")

    same(spark, trimmed, queries.oracle_sql()[name])


def plain_language(model, text):
    """The greatest cosine with each language, a trigram at a time."""
    dims, counts = len(model.idf), Counter()
    raw = b" " + re.sub(rb"[^a-z\x80-\xff]+", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + b" "
    if not any(c.isalpha() for c in text or ""):
        return None, 0
    for k in range(len(raw) - 2):
        packed = raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16
        counts[packed * 2654435761 % 2**32 >> (33 - dims.bit_length())] += 1
    own = {p: np.log1p(n) * float(model.idf[p]) for p, n in counts.items()}
    norm = sum(v * v for v in own.values()) ** 0.5
    cosines = [sum(v * float(c[p]) for p, v in own.items()) / norm for c in model.centroids]
    best = defaultdict(lambda: -1.0)
    for k, x in zip(model.owner.tolist(), cosines, strict=True):
        best[model.languages[k]] = max(best[model.languages[k]], x)
    return dict(best), sum(counts.values())


def fixture(seed=9):
    rng = random.Random(seed)
    stems = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(3)) for _ in range(60)] for k in ("aa", "bb", "cc")}
    text = lambda k, n: " ".join(rng.choice(stems[k]) + rng.choice(stems[k]) for _ in range(n))
    rows = [(i, text(k, rng.randint(3, 120)), k) for i, k in enumerate(["aa", "bb", "cc"] * 50)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(0, 20, 2)]
    long = text("aa", 100).split()
    for i in range(12):
        near = list(long)
        near[rng.randrange(100)] = f"edit{i}"
        rows.append((300 + i, " ".join(near), "aa"))
    leak = text("bb", 12)
    rows += [(400 + i, f"{text('bb', 20)} {leak} {text('bb', 20)}", "bb") for i in range(3)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 34 !!", None), (503, "qx" * 200, None), (None, text("cc", 60), "cc"), (7, rows[7][1], rows[7][2])]
    return [(i, t, lang, rng.choice(["s1", "s2", None]), len(t or ""), "stay", "stay", 1, "x") for i, t, lang in rows], leak


def test_pipeline_by_plain_python(spark, tmp_path):
    rows, leak = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long, stay_id string, text_sha256 string, kept int, spans string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = queries.language_model(docs)
    left = []
    for r in rows:
        best, n = plain_language(model, r[1])
        if best is not None and max(best.values()) >= model.floor[min(int(np.log2(n + 1)), 31)]:
            left.append(r)
    assert len(rows) - len(left) >= 4 and len(set(range(150)) - {r[0] for r in left}) <= 3
    after = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert after.columns == docs.columns and Counter(map(tuple, after.collect())) == Counter(left)

    best = defaultdict(lambda: -1)
    for r in left:
        best[r[1]] = max(best[r[1]], -1 if r[0] is None else r[0])
    left = [r for r in left if best[r[1]] == (-1 if r[0] is None else r[0])]
    groups = brute_components([(i, t) for i, t, *_ in left if i is not None])
    left = [r for r in left if r[0] is None or groups[r[0]][2]]
    hits = brute_hits([(k, r[1]) for k, r in enumerate(left)], [(1, leak)], 10)
    left = [r for k, r in enumerate(left) if not hits[k][1]]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((r[0], r[3], len(words(r[1]))) for r in left)
    sizes = Counter()
    for r in left:
        sizes[r[3]] += len(words(r[1]))
    want, taken = brute_targets(sizes), Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= 256 for s in sizes)


def test_stages_keep_empty_tables_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_languages_held_out_of_training(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    out = queries.op6_language_id(spark, MORE)
    held = out.where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").where("lang IS NOT NULL").collect()
    assert out.count() == docs.count() and np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    model = queries.language_model(docs)
    for r in held[:40]:
        best, _ = plain_language(model, r.text)
        assert r.cosine == pytest.approx(max(best.values()), abs=1e-4) and best[r.lang_pred] == pytest.approx(max(best.values()), abs=1e-4)
        soft = {k: np.exp(20 * (v - max(best.values()))) for k, v in best.items()}
        assert r.score == pytest.approx(1 / sum(soft.values()), abs=1e-3)


def plain_score(model, text):
    """The classifier's score, a token at a time, over the same hashes of single tokens."""
    raw, dims = (text or "").encode(), len(model.weights)
    one = lambda t: textbytes.byte_prefix(np.frombuffer(t, np.uint8)).spans(np.array([0]), np.array([len(t)]))
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", raw)
    hashes = [one(re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)) for t in tokens]
    pairs = [textbytes.mix(a * np.uint64(3) + b) for a, b in zip(hashes, hashes[1:], strict=False)]
    total = model.intercept
    for salt, grams in ((1, hashes), (2, pairs)):
        places = Counter(int(textbytes.mix(g + np.uint64(salt))[0] % np.uint64(dims)) for g in grams)
        total += model.scale * sum(n * model.weights[p] for p, n in places.items()) / max(len(grams), 1)
    return total, tokens


def test_quality_held_out_of_training(spark):
    labels = spark.read.parquet(f"{MORE}/labels.parquet").select("doc_id", "quality").where("quality IS NOT NULL")
    out = queries.op10_quality(spark, MORE)
    held = out.where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert len(good) > 10 and len(bad) > 10
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9 and all(r.predicted == int(r.score >= 0.7) for r in held)
    # Texts of two tokens have no triple of shapes, so that the plain version is complete for them.
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    model = quality_model.train(docs, spark.read.parquet(f"{MORE}/labels.parquet").where("crc32(cast(doc_id AS string)) % 4 <> 2"))
    texts = ["Two words", "one", "Ünï Öde", "x1 !!", "", None, "  \n"]
    got = {r.doc_id: r.score for r in quality_model.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        total, tokens = plain_score(model, t)
        assert len(tokens) < 3 and got[i] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


def test_very_long_texts(spark):
    """A text far longer than any slice goes through the vectorised steps as a whole."""
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    base = " ".join(rng.choice(vocabulary) for _ in range(400_000))
    docs = spark.createDataFrame([(1, base, "aa", "s"), (2, base + " tail", "aa", "s"), (3, "short", "aa", "s")], "doc_id long, text string, lang string, source string")
    from shelfscope.llm import decontam, minhash, mixing, substring, suffixarray

    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()} == {1: 0, 2: 400_000, 3: 0}
    assert {r.doc_id: r.n_removed for r in suffixarray.remove_repeats(docs).select("doc_id", "n_removed").collect()} == {1: 0, 2: len(base), 3: 0}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    items = spark.createDataFrame([(1, " ".join(base.split()[200_000:200_020]))], "item_id long, text string")
    assert {r.doc_id: r.longest for r in decontam.contamination(docs, items).collect()} == {1: 20, 2: 20, 3: 0}
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()} == {1: "aa", 2: "aa", 3: "aa"}
    assert mixing.mix(docs).agg(F.sum("size")).first()[0] == 800_002
