"""Similar names, components and assignment against plain loops, and how their work grows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfscope.operators import assign, matching, similar
from tests.test_operators import catalogue, matched_in_turn, similarity

WORDS = ["red", "blue", "shirt", "cotton", "mug", "large", "small", "steel", "bottle", "travel", "organic", "lamp", "a", "x1", "aa"]


def near(rng, s, most=4):
    for _ in range(rng.randint(0, most)):
        i = rng.randrange(len(s) + 1)
        s = s[:i] + rng.choice(["", "x", "b", " ", "yz"]) + s[i + rng.randint(0, 1) :]
    return " ".join(s.split()) or "z"


def some_names(rng, n):
    out = [near(rng, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))) for _ in range(n)]
    return out + ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 6))).strip() or "a" for _ in range(n // 5)]


def frame(spark, names):
    return spark.createDataFrame([(x,) for x in names], "plain string")


@pytest.mark.parametrize("threshold", [0.8, 0.55, 0.7, 0.95])
def test_similar_names_equal_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    one = some_names(rng, 200)
    two = [near(rng, rng.choice(one)) for _ in range(250)]
    want = {(a, b): similarity(a, b) for a in one for b in two if similarity(a, b) >= threshold}
    got = similar.similar_pairs(frame(spark, [*one, one[0], ""]), frame(spark, [*two, two[0], ""]), threshold).collect()
    assert len(got) == len(want) and all(abs(want[r.a, r.b] - r.score) < 1e-12 for r in got)


def test_few_names_meet(spark):
    """Names of letters that follow no language: far fewer than all pairs share a posting."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    one = [" ".join(word() for _ in range(4)) for _ in range(1500)]
    two = [near(rng, x, 3) for x in one]
    met = similar.candidates(frame(spark, one), frame(spark, two), 0.8)
    assert met.count() < len(one) * len(two) / 100
    found = {(r.a, r.b) for r in met.collect()}
    assert all((a, b) in found for a, b in zip(one, two, strict=True) if similarity(a, b) >= 0.8)


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        similar.candidates(frame(spark, ["a"]), frame(spark, ["a"]), 0.5)


@pytest.mark.parametrize("shape", ["chain", "random", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {"chain": [(i, i + 1) for i in range(300)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(180)], "star": [(0, i) for i in range(1, 60)], "none": [(7, 7)]}[shape]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    got = {r.node: r.component for r in assign.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got) == set(root)
    groups = lambda f: sorted(sorted(x for x in root if f(x) == c) for c in {f(x) for x in root})
    assert groups(got.get) == groups(find)


def greedy(edges):
    """By mine in order, the best edge to what is free; edges: (mine, theirs, pref, passes)."""
    used, out = set(), []
    for m in sorted({e[0] for e in edges}):
        free = sorted((e for e in edges if e[0] == m and e[1] not in used), key=lambda e: e[2])
        if free and free[0][3]:
            used.add(free[0][1])
            out.append((m, free[0][1]))
    return out


@pytest.mark.parametrize("most", [100_000, 12, 1])
def test_assignment_in_groups_equals_the_greedy_loop(spark, most):
    """One group, components by groups, and rounds until what is left is small."""
    rng = random.Random(most)
    edges = [(m, t, [float(rng.randint(0, 3)), float(t)], rng.random() < 0.8) for m in range(40) for t in rng.sample(range(30), rng.randint(1, 3))]
    out = assign.assigned(spark.createDataFrame(edges, "mine long, theirs long, pref array<double>, passes boolean"), most=most)
    assert sorted((r.mine, r.theirs) for r in out.collect()) == greedy(edges)


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    """Each row prefers what the one before takes: solved by components, not by a round for each row."""
    n, levels = 400, []
    edges = [e for i in range(n) for e in ((i, i - 1, [0.0], True), (i, i, [1.0], True)) if e[1] >= 0]
    whole = assign.components

    def counted(*a):
        before = assign.checkpointed
        monkeypatch.setattr(assign, "checkpointed", lambda df: levels.append(1) or before(df))
        try:
            return whole(*a)
        finally:
            monkeypatch.setattr(assign, "checkpointed", before)

    monkeypatch.setattr(assign, "components", counted)
    out = assign.assigned(spark.createDataFrame(edges, "mine long, theirs long, pref array<double>, passes boolean"), most=n + 399)
    assert sorted((r.mine, r.theirs) for r in out.collect()) == greedy(edges)
    out = assign.assigned(spark.createDataFrame([*edges, (n + 1, n + 1, [0.0], True), (n + 2, n + 1, [0.0], True), (n + 2, n + 2, [1.0], True)], "mine long, theirs long, pref array<double>, passes boolean"), most=2 * n - 2)
    assert out.count() == n + 2
    assert len(levels) < 45  # three tables a level


def side(rng, n):
    return [(i, near(rng, " ".join(rng.choice(WORDS[:6]) for _ in range(rng.randint(1, 3))), 1), rng.choice(["", "", f"s{rng.randint(1, 12)}"]), rng.choice(["", "", "", str(10**8 + rng.randint(1, 12))])) for i in range(1, n + 1)]


def test_copies_of_names_are_matched_as_by_plain_loops(spark):
    rng = random.Random(8)
    mine, theirs = side(rng, 70), side(rng, 70)
    mine[20:45] = [(i, "blue mug", s, g) for i, _, s, g in mine[20:45]]
    theirs[10:40] = [(i, rng.choice(["blue mug", "blue mugs"]), s, g) for i, _, s, g in theirs[10:40]]
    one, two = (catalogue(spark, [(o, n, s, g, "") for o, n, s, g in rows]) for rows in (mine, theirs))
    got = matching.match(one, two, pair_limit=None, gram_pairs=None).collect()
    assert sorted((r.mine, r.theirs, r.method, r.confidence) for r in got) == matched_in_turn(mine, theirs, 10**9)


def test_a_large_component_of_names_is_unfolded(spark):
    rng = random.Random(2)
    rows = lambda c: spark.createDataFrame([(i, rng.choice("pqr")) for i in range(30)], f"ord long, {c} string")
    mine, theirs = rows("a"), rows("b")
    edges = [(a, b, [float(rng.randint(0, 1))], "m", 90) for a in "pqr" for b in "pqr" if rng.random() < 0.8]
    table = spark.createDataFrame(edges, "a string, b string, rank array<double>, method string, confidence long")
    one, two = ([(r.ord, r[c]) for r in df.collect()] for df, c in ((mine, "a"), (theirs, "b")))
    want = greedy([(m, t, [*rank, t], True) for m, x in one for t, y in two for a, b, rank, _, _ in edges if (a, b) == (x, y)])
    for most in (1000, 5):
        assert sorted((r.mine, r.theirs) for r in assign.assigned_classes(mine, theirs, table, most=most).collect()) == want


def test_a_large_component_of_copies_is_solved_in_portions(spark, monkeypatch):
    """No row for each pair of rows, of which there would be the square of the copies."""
    monkeypatch.setattr(assign, "assigned", lambda edges, by: edges.select("mine", "theirs", "method", "confidence") if edges.isEmpty() else pytest.fail("unfolded"))
    rng = random.Random(4)
    rows = lambda c: spark.createDataFrame([(i, rng.choice("pqrs")) for i in range(80)], f"ord long, {c} string")
    mine, theirs = rows("a"), rows("b")
    edges = [(a, b, [float(rng.randint(0, 1))], "m", 90, rng.random() < 0.8) for a in "pqrs" for b in "pqrs" if rng.random() < 0.8]
    table = spark.createDataFrame(edges, "a string, b string, rank array<double>, method string, confidence long, passes boolean")
    one, two = ([(r.ord, r[c]) for r in df.collect()] for df, c in ((mine, "a"), (theirs, "b")))
    want = greedy([(m, t, [*rank, t], passes) for m, x in one for t, y in two for a, b, rank, _, _, passes in edges if (a, b) == (x, y)])
    assert sorted((r.mine, r.theirs) for r in assign.assigned_classes(mine, theirs, table, most=90).collect()) == want


def test_limits_can_be_lifted(spark):
    """More pairs than the defaults allow: the tiers are skipped with them and run without."""
    rows = [(i, f"item number {i:04d}", "", "", "") for i in range(260)]
    one, two = catalogue(spark, rows), catalogue(spark, rows)
    assert matching.match(one, two, trigrams=False).count() == 0
    assert matching.match(one, two, pair_limit=None, trigrams=False).count() == 260
    assert matching.match(one, two, pair_limit=0, gram_pairs=10).count() == 0
    assert matching.match(one, two, pair_limit=0, gram_pairs=None, gram_most=None, gram_top=None).where(F.col("method") == "trigram").count() == 260


def test_copies_meet_by_rare_trigrams_once_for_a_pair_of_names(spark):
    """A row for each pair of names and not of rows, and the greedy loop's pairs, with ends that don't pass."""
    rng = random.Random(5)
    some = ["steel mug blue", "steel mug", "mug blue steel x", "blue steel", "travel lamp", "travel lamps", "lamp"]
    rows = lambda n: [(i, rng.choice(some), "", "") for i in range(1, n + 1)]
    mine, theirs = rows(60), rows(60)
    one, two = (catalogue(spark, [(o, n, s, g, "") for o, n, s, g in side]) for side in (mine, theirs))
    least = matching.gram_edges(matching.keyed(one), matching.keyed(two), most_pairs=None)
    pairs = least.collect()
    assert 0 < len(pairs) <= len(some) ** 2 and {r.passes for r in pairs} == {True, False}
    known = {(r.a, r.b): r for r in pairs}
    edges = [(m, t, [*known[a, b]["rank"], float(t)], known[a, b].passes) for m, a, *_ in mine for t, b, *_ in theirs if (a, b) in known]
    got = matching.match(one, two, pair_limit=0, gram_pairs=None).collect()
    assert sorted((r.mine, r.theirs) for r in got) == greedy(edges)
    whole = lambda most: matching.gram_edges(matching.keyed(one), matching.keyed(two), most_pairs=most).count()
    assert whole(len(edges)) == len(pairs) and whole(len(edges) - 1) == 0
