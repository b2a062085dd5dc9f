"""Exact top-k search and the Jaccard join against brute force."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import jaccard, topk
from memloom.operators.components import components


def exact_weights(v, single=True):
    return [math.floor(Fraction(float(np.float32(x)) if single else x) * 64) for x in v]


def brute_top_k(rows, every, k, single=True):
    """The k best of each query id, exact; a score beyond a long is shown as the nearest long."""
    good = [(i, exact_weights(v, single)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        s = sorted((-sum(a * b for a, b in zip(x, v)), i) for j, x in good if j == q for i, v in good if i != q)[:k]
        out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -x))) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("n, dims, zero", [(60, 8, 0.0), (150, 5, 0.8), (3, 4, 0.5)])
def test_top_k_matches_brute_force(spark, n, dims, zero):
    rng = random.Random(n)
    rows = [(i, [0.0 if rng.random() < zero else round(rng.uniform(-1, 1), 1) for _ in range(dims)]) for i in range(n)]
    rows += [(1000, None), (1005, [0.1] * (dims - 1) + [None]), (1010, [float("nan")] * dims), (1015, [float("inf")] + [0.0] * (dims - 1)), (None, [0.5] * dims), (1020, [0.5]), (1025, [])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, cell int")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, k=7).collect()
    assert sorted(map(tuple, got)) == brute_top_k(rows, 5, 7)


def test_cells_of_any_size_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(300)], "vec_id long, embedding array<float>").cache()
    one = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 3 == 0).collect()))
    for name, size in (("CELL", 32), ("FINE", 16), ("QUERIES", 20), ("BLOCK", 3), ("ENTRIES", 100)):
        monkeypatch.setattr(topk, name, size)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 3 == 0).collect())) == one


@pytest.mark.parametrize("kind", ["float", "double"])
def test_scores_are_exact_at_any_size(spark, kind):
    rng = random.Random(12)
    scales = [1.0, 2.0**20, 2.0**21 + 3, 1e9, 1e17] + ([1e38] if kind == "float" else [1e160, 1.7e308])
    rows = [(i, [rng.uniform(-1, 1) * rng.choice(scales[: 1 + i % len(scales)]) for _ in range(rng.randrange(1, 7))]) for i in range(90)]
    rows += [(100, [3.0e6]), (101, [2.0e6]), (102, [4.0]), (200, [])]
    for some in (rows, [r for r in rows if max(map(abs, r[1]), default=0) < 2e7]):
        got = topk.top_k(spark.createDataFrame(some, f"vec_id long, embedding array<{kind}>").repartition(3), F.col("vec_id") % 5 == 0, k=9).collect()
        assert sorted(map(tuple, got)) == brute_top_k(some, 5, 9, kind == "float")


def test_ids_that_repeat_are_dealt_apart(spark):
    rng = random.Random(13)
    rows = [(i % 40, [float(rng.randrange(-3, 4)) for _ in range(5)]) for i in range(120)] + [(5, [1.0] * 5)] * 60 + [(7, [2.0] * 5)] * 60 + [(7, [1.0] * 4)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), F.col("vec_id") % 5 == 0, k=8).collect()
    assert sorted(map(tuple, got)) == brute_top_k(rows, 5, 8)


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") == 0).collect() == []
    assert topk.top_k(spark.createDataFrame([(1, [1.0]), (3, [1.0])], schema), F.col("vec_id") % 2 == 0).collect() == []


def brute_components(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}))
    top = {i: i for i, _ in sets if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    live = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, x) in enumerate(live):
        for j, y in live[:a]:
            if den * len(x & y) >= num * len(x | y) and find(i) != find(j):
                lo, hi = sorted((find(i), find(j)))
                top[hi] = lo
    return sorted((i, len(s), find(i)) for i, s in sets if i is not None), sorted(len(s) for i, s in sets if i is None)


def edited(rng, base, edits):
    d = list(base)
    for _ in range(edits):
        at = rng.randrange(len(d))
        d[at : at + rng.choice([0, 1])] = [f"n{rng.randrange(10**6)}"] if rng.random() < 0.7 else []
        if not d:
            return ["x"]
    return d


def corpus(seed, families=12, members=9):
    rng = random.Random(seed)
    rows = []
    shared = [f"p{i}" for i in range(40)]
    for _ in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 4, 9, 30, 90, 250]))]
        if rng.random() < 0.5:
            base = shared + base
        for _ in range(members):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 6]))))
    rng.shuffle(rows)
    return list(enumerate(rows))


SPECIAL = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "One\ttwo"), (None, "one"), (None, None), (907, "w " * 70_000), (908, "w " * 70_001), (909, "élan vital is"), (910, "ÉLAN vital is"), (911, "w0 w1 w2"), (911, "w0 w1 w2")]


@pytest.mark.parametrize("k, num, den, block, seed", [(3, 90, 100, 1024, 1), (5, 80, 100, 1024, 2), (2, 50, 100, 4, 3), (3, 80, 100, 2, 4), (5, 80, 100, 3, 5)])
def test_components_match_brute_force(spark, k, num, den, block, seed):
    rows = corpus(seed) + SPECIAL
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, label string, n long, rep int")
    got = jaccard.jaccard_components(df.repartition(3), k, num, den, block=block).collect()
    known, loose = brute_components(rows, k, num, den)
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == known
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] is None) == loose
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_one_of_each_component_stays(spark):
    rows = corpus(7) + SPECIAL
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, gone string")
    kept = jaccard.keep_representatives(df)
    known, loose = brute_components(rows, 5, 80, 100)
    assert kept.columns == df.columns
    got = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert got == sorted(i for i, _, c in known if i == c)
    assert kept.filter("doc_id IS NULL").count() == len(loose)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(df).collect() == []
    assert jaccard.keep_representatives(df).collect() == []


def test_linked_sets_send_a_common_shingle_and_part():
    rng = random.Random(6)
    dice = np.random.default_rng(6)
    # Both sets have what they have in common, so its counters are at least 2.
    sketch = jaccard.Sketch(1 << 18, dice.choice(np.array([0b10101010, 0b11101110, 0b11111111], np.uint8), 1 << 16), dice.integers(0, 9, 1 << 13).astype(np.uint8))
    for num, den in ((90, 100), (80, 100), (50, 100)):
        scheme = jaccard.Scheme(num, den)
        for _ in range(400):
            n = rng.choice([1, 2, 5, 9, 20, 60, 300, 3000])
            x = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
            y = x[np.random.default_rng(rng.getrandbits(32)).random(len(x)) > rng.choice([0.0, 0.05, 0.1, 0.2])]
            y = np.unique(np.concatenate([y, np.array([rng.getrandbits(64) for _ in range(rng.randrange(1 + n // 12))], np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(y) and den * both >= num * (len(x) + len(y) - both):
                assert set(scheme.signatures(x).tolist()) & set(scheme.signatures(y).tolist())
                assert set(jaccard.prefix(x, sketch, num, den).tolist()) & set(jaccard.prefix(y, sketch, num, den).tolist())


def test_graph_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    top = list(range(2000))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        top[max(find(a), find(b))] = min(find(a), find(b))
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 2])
def test_an_id_that_repeats_has_the_links_of_all_its_texts(spark, block):
    text = lambda name, last="": " ".join([*(f"{name}{i}" for i in range(60)), last])
    rows = [(5, text("a")), (5, text("b")), (7, text("a", "x")), (9, text("b", "y")), (5, text("c")), (3, text("c")), (9, ""), (11, text("d")), (11, None), (12, "")]
    for held in (rows, rows[::-1]):
        df = spark.createDataFrame(held, "doc_id long, text string").repartition(3)
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, block=block).collect()}
        assert got == {(5, 56, 3), (7, 57, 3), (9, 57, 3), (3, 56, 3), (9, 0, 3), (11, 56, 11), (11, 0, 11), (12, 0, 12)}
        assert {r["doc_id"] for r in jaccard.keep_representatives(df).collect()} == {3, 11, 12}
