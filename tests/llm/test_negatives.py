"""Hard negatives against all pairs in plain integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import negatives
from rankforge.llm.negatives import _hits, _reach, hard_negatives, whole_vectors
from tests.llm.cases import by_row

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=5, n=3):
    kept = []
    for i, (key, vector, label) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x * 256) for x in vector):
            kept.append((i, key, [math.floor(256 * x) for x in vector], label))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def order(pair):
        return (-pair[0], pair[1] is None, pair[1] or 0)

    out = []
    for i, key, a, label in kept:
        if key is None or key % 50:
            continue
        others = [(score(a, b), other, lab) for j, other, b, lab in kept if j != i]
        same = sorted(((s, o) for s, o, lab in others if lab == label), key=order)[:k]
        for s, o in same:
            wanted = sorted(((t, p) for t, p, lab in others if lab != label and 50 * s <= 100 * t and 100 * t <= 95 * s), key=order)[:n]
            out += [(key, o, r, p, s, t) for r, (t, p) in enumerate(wanted, 1)]
    return sorted(out, key=repr)


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA)
    result = hard_negatives(whole_vectors(table), **options)
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return by_row(result)


def clustered(rnd, n, dim=6, spread=0.3):
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        rows.append((i, [x + rnd.gauss(0, spread) for x in c], rnd.randrange(3)))
    return rows


@pytest.mark.parametrize("references", [0, 1, 8])
def test_clusters_in_small_blocks(spark, monkeypatch, references):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    rows = clustered(random.Random(references), 700)
    assert found(spark, rows, references=references) == brute(rows)


def test_ties_copies_zeros_nulls_and_lengths(spark):
    rnd = random.Random(4)
    rows = [(i, [float(rnd.randrange(-1, 2)) for _ in range(3)], rnd.randrange(2)) for i in range(300)]
    rows += [(50, [1.0, 0.0, 0.0], 0)] * 3 + [(100, [0.0, 0.0, 0.0], 1), (150, [], 1), (200, [2.0], 0), (250, [1.0, 1.0, 1.0, 1.0, 1.0], 0)]
    rows += [(None, [1.0, 1.0, 1.0], 0), (None, [1.0, 1.0, 0.9], 1), (300, None, 1), (350, [1.0, 1.0, 1.0], None)]
    rows += [(400, [1.0, None, 1.0], 0), (450, [1.0, float("nan"), 1.0], 0), (500, [1.0, float("inf"), 1.0], 0), (-50, [1.0, 1.0, 1.0], 0)]
    assert found(spark, rows) == brute(rows)


def test_components_of_any_size(spark):
    """Scores beyond 53 bits are exact, and norms of very unequal size stay within their bounds."""
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([1e-3, 1.0, 1e5, 3e6]) * rnd.gauss(0, 1) + 2.0**21 for _ in range(4)], rnd.randrange(2)) for i in range(250)]
    rows += [(1_000 + i, [rnd.gauss(0, 1e-4) for _ in range(4)], rnd.randrange(2)) for i in range(50)]
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 0), (3, [1.0, 0.2], 0), (4, [0.7, 0.1], 1)]
    assert found(spark, rows) == brute(rows) != []


def test_clashing_names(spark):
    rows = clustered(random.Random(1), 200)
    plain = spark.createDataFrame(rows, SCHEMA)
    more = plain.select("*", *[F.lit("x").alias(c) for c in ("VEC_ID", "Label", "id", "row", "vector", "_v", "norm", "angle")])
    assert by_row(hard_negatives(whole_vectors(more))) == brute(rows)


def test_bounds_hold_and_spare_work():
    """No pair in a window lies outside its reach; with clusters of like norms most pairs are never scored."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.floor(256 * (centres[rng.integers(12, size=3_000)] + 0.01 * rng.normal(size=(3_000, 16))))
    norms = np.linalg.norm(x, axis=1)
    ref = x[0] / norms[0]
    angle = np.arccos(np.clip(x @ ref / norms, -1, 1))
    order = np.argsort(angle)
    x, norms, angle = x[order], norms[order], angle[order]
    spared = 0
    for a in range(0, 3_000, 50):
        exact = x @ x[a]
        low, high = np.array([0.985 * norms[a] ** 2]), np.array([1.0 * norms[a] ** 2])
        first, last = _reach(low, high, norms[a : a + 1], angle[a : a + 1], norms.min(), norms.max())
        inside = (angle >= first[0]) & (angle <= last[0])
        assert not ((exact >= low) & (exact <= high) & ~inside).any()
        spared += (~inside).sum()
    assert spared > 0.4 * 60 * 3_000


def test_strips_find_every_pair():
    class Side:
        def __init__(self, vectors, angles):
            self.vectors, self.angles, self.norms = vectors, angles, np.linalg.norm(vectors, axis=1)

    rng = np.random.default_rng(8)
    a, b = (np.floor(rng.normal(size=(n, 5)) * 100) for n in (150, 900))
    ref = np.eye(5)[:1]
    sides = []
    for v in (a, b):
        angles = np.arccos(np.clip(v @ ref.T / np.linalg.norm(v, axis=1)[:, None], -1, 1))
        order = np.argsort(angles[:, 0])
        sides.append(Side(v[order], angles[order]))
    low = rng.integers(-20_000, 20_000, 150)
    high = low + rng.integers(-500, 9_000, 150)
    got = {(i, j, s) for part in _hits(sides[0], np.arange(150), sides[1], 0, low, high) for i, j, s in zip(*(p.tolist() for p in part))}
    exact = (sides[0].vectors @ sides[1].vectors.T).astype(int)
    assert got == {(i, j, exact[i, j]) for i in range(150) for j in range(900) if low[i] <= exact[i, j] <= high[i]}
