"""Hard negatives against brute force, and the bounds that discard candidates."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import hard_negatives as hard

LONG = (1 << 63) - 1


def shown(s):
    return max(-LONG - 1, min(LONG, s))


def brute(rows, every, k=5, m=3, band=(50, 95), single=True):
    """All pairs in Python's integers: ``(anchor, positive, rank, negative, scores)``."""
    good = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, label, tuple(math.floor(Fraction(float(np.float32(x)) if single else x) * 256) for x in v)))
    out = []
    for i, label, v in {r for r in good if r[0] % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in good if j != i)
        for p, j, _ in [x for x in scored if x[2]][:k]:
            found = [x for x in scored if not x[2] and band[0] * -p <= 100 * -x[0] <= band[1] * -p][:m]
            out += [(i, j, r + 1, n, shown(-p), shown(-s)) for r, (s, n, _) in enumerate(found)]
    return sorted(out)


def told(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, rows, kind="float", parts=3):
    return spark.createDataFrame([(i, label, v, 0, 1, "x") for i, label, v in rows], f"vec_id long, label int, embedding array<{kind}>, cell int, anchor int, place string").repartition(parts)


def clustered(seed, n, dims, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        v = [round((0.5 * c + rng.gauss(0, 0.4)) / 4, 2) for c in centres[rng.choice([label, label, rng.randrange(labels)])]]
        rows.append((i, label, v))
    return rows


@pytest.mark.parametrize("seed, n, dims", [(1, 200, 12), (2, 400, 3), (3, 30, 40), (4, 5, 2)])
def test_matches_brute_force(spark, seed, n, dims):
    rows = clustered(seed, n, dims)
    rows += [(1000, None, [0.1] * dims), (1005, 1, None), (1010, 1, [0.1] * (dims - 1) + [None]), (1015, 2, [float("nan")] * dims), (1020, 2, [float("inf")] + [0.0] * (dims - 1))]
    rows += [(None, 1, [0.5] * dims), (1025, 1, []), (1030, 0, [0.5]), (1035, 3, [0.0] * dims)]
    assert told(hard.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0)) == brute(rows, 5)


def test_blocks_and_cells_of_any_size_give_the_same(spark, monkeypatch):
    rows = clustered(6, 300, 8)
    for name, size in (("CELL", 64), ("FINE", 32), ("ENTRIES", 500), ("GROUP", 20), ("BLOCK", 7), ("SLAB", 32), ("PAIRS", 50), ("SPARSE", 0.9)):
        monkeypatch.setattr(hard, name, size)
    assert told(hard.hard_negatives(frame(spark, rows), F.col("vec_id") % 3 == 0)) == brute(rows, 3)


def test_repeated_ids_copies_and_ties(spark):
    rows = clustered(7, 60, 4) + [(10, 1, [0.25, 0.5, 0.0, 0.1]), (10, 1, [0.25, 0.5, 0.0, 0.1]), (10, 2, [0.1, 0.1, 0.1, 0.1])]
    rows += [(100 + i, i % 3, [0.25, 0.5, 0.25, 0.0]) for i in range(40)] + [(101, 1, [0.25, 0.5, 0.25, 0.0])]
    assert told(hard.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0)) == brute(rows, 5)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_scores_are_exact_at_any_size(spark, kind):
    rng = random.Random(12)
    scales = [1.0, 2.0**20, 1e9, 1e17] + ([1e38] if kind == "float" else [1e160, 1.7e308])
    rows = [(i, rng.randrange(2), [abs(rng.gauss(0, 0.5)) * rng.choice(scales[: 1 + i % len(scales)]) % 1.7e308 for _ in range(rng.randrange(1, 6))]) for i in range(80)]
    assert told(hard.hard_negatives(frame(spark, rows, kind), F.col("vec_id") % 5 == 0)) == brute(rows, 5, single=kind == "float")


def test_empty_table(spark):
    got = hard.hard_negatives(frame(spark, clustered(1, 5, 2)).limit(0), F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and got.count() == 0


def block(rows, rotation, labels):
    import pyarrow as pa

    ids, names, vectors = zip(*rows)
    return hard.Rows(pa.table({"vec_id": pa.array(ids, pa.int64()), "label": pa.array(list(map(str, names))), "embedding": pa.array(vectors, pa.list_(pa.float64()))}), rotation, 256.0, labels)


def test_discards_early_and_never_a_pair_in_range():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 32)) * 0.2 + rng.normal(size=(400, 32)) * 0.02
    w = np.floor(256 * base)
    rotation, labels = hard.Rotation(w.T @ w), {}
    rows = block([(i, i % 3, v.tolist()) for i, v in enumerate(base)], rotation, labels)
    scores = (w @ w.T).astype(np.int64)
    low = np.partition(scores[:50], -5, axis=1)[:, [-5]]
    i, j = np.arange(50), np.arange(400)
    p, q = hard.survivors(rows, i, rows, j, low, np.full_like(low, LONG), np.zeros((50, 400), bool), rotation)
    assert set(zip(*np.nonzero(scores[:50] >= low))) == set(zip(p.tolist(), q.tolist()))
    assert (hard.products(rows, p, rows, q) == scores[p, q]).all()
    # The first stage alone, an eighth of the components, leaves few pairs open.
    first = rows.turned[:50, : rotation.stops[1]] @ rows.turned[:, : rotation.stops[1]].T + np.outer(rows.rest[:50, 0], rows.rest[:, 0])
    assert (first >= low).mean() < 0.1
