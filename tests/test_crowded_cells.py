"""Distance joins where points crowd: cells cut by their count, and start widths per query."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.plans import grid
from rankforge.plans.grid import knn_join, radius_join, start_levels, start_radii
from tests.conftest import as_set

POINTS = "frame_id int, point_idx int, x double, y double, z double"
QUERIES = "frame_id int, cand_idx int, tx double, ty double, tz double"


def rows(arrays):
    return [(f, i, *map(float, v)) for f, a in arrays.items() for i, v in enumerate(a)]


@pytest.fixture(scope="module")
def crowd(spark):
    """Half of the points in one cell, forty of them in one place; one cell lies across zero."""
    rng = np.random.default_rng(8)
    dense = rng.uniform(0.11, 0.19, (160, 3))
    dense[:40] = dense[0]
    p = {0: np.vstack([dense, rng.uniform(-0.3, 0.5, (200, 3))]), 1: rng.uniform(-0.01, 0.01, (60, 3))}
    q = {0: np.vstack([rng.uniform(0.05, 0.25, (30, 3)), dense[:2]]), 1: rng.uniform(-0.1, 0.1, (10, 3)), 2: np.zeros((1, 3))}
    return p, q, spark.createDataFrame(rows(p), POINTS), spark.createDataFrame(rows(q), QUERIES)


def test_crowded_cells_lose_and_repeat_nothing(crowd):
    p, q, points, queries = crowd
    for radius in (0.1, 0.03):
        want = sorted(
            (f, i, j) for f in q for i, a in enumerate(q[f]) for j, b in enumerate(p.get(f, [])) if ((a - b) ** 2).sum() <= radius * radius
        )
        for limit in (1000, 100, 8, 1):
            got = radius_join(queries, points, radius, crowd=limit)
            assert as_set(got, "frame_id", "cand_idx", "point_idx") == want
            assert not {c for c in got.columns if c.startswith("_")}


def test_a_crowded_cell_is_shared_out(spark):
    """The points that meet under one join key stay near the limit, in one place as well."""
    rng = np.random.default_rng(9)
    dense = np.vstack([np.tile([0.15, 0.15, 0.15], (400, 1)), rng.uniform(0.1, 0.2, (400, 3))])
    points = spark.createDataFrame(rows({0: dense}), POINTS)
    queries = spark.createDataFrame([(0, 0, 0.15, 0.15, 0.15)], QUERIES)
    on = ["frame_id", "_c0", "_c1", "_c2"]
    p = points.withColumns({f"_c{i}": c for i, c in enumerate(grid.cell_of(("x", "y", "z"), 1.0))})
    q = queries.withColumns({f"_c{i}": c for i, c in enumerate(grid.cell_of(("tx", "ty", "tz"), 1.0))})
    crowded = p.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    sent, placed = grid._split_crowded(q, p, crowded, on, 1.0, ("tx", "ty", "tz"), ("x", "y", "z"), 50)
    sizes = [r["count"] for r in placed.groupBy("_part", "_share").count().collect()]
    assert sum(sizes) == 800 and max(sizes) <= 3 * 50
    keys = as_set(sent.select("_part", "_share"))
    assert len(keys) == len(set(keys)) and set(keys) >= set(as_set(placed.select("_part", "_share").distinct()))


def test_neighbours_of_crowds_and_far_points(crowd, spark):
    p, q, _, _ = crowd
    p = {**p, 0: np.vstack([p[0], [[500.0, 500.0, 500.0]]])}
    q = {**q, 0: np.vstack([q[0], [[499.0, 500.0, 500.0], [-9000.0, 0.0, 0.0]]])}
    want = []
    for f in q:
        for i, a in enumerate(q[f]):
            d = ((p.get(f, np.zeros((0, 3))) - a) ** 2).sum(axis=1)
            want += [(f, i, k, int(j)) for k, j in enumerate(np.argsort(d, kind="stable")[:32])]
    points, queries = spark.createDataFrame(rows(p), POINTS), spark.createDataFrame(rows(q), QUERIES)
    for radius in (None, 0.02):
        assert as_set(knn_join(queries, points, 32, radius), "frame_id", "cand_idx", "nn", "point_idx") == sorted(want)


def test_a_dense_spot_starts_narrow(spark):
    """A spot outside the middle half of the frame has its own width; a far point changes no one's."""
    rng = np.random.default_rng(10)
    wide = rng.uniform(0, 1, (3000, 3))
    spot = rng.uniform(0.95, 0.97, (1500, 3))
    queries = spark.createDataFrame([(0, 0, 0.5, 0.5, 0.5), (0, 1, 0.96, 0.96, 0.96)], QUERIES)
    xyz, txyz = ["x", "y", "z"], ["tx", "ty", "tz"]
    found = []
    for extra in ([], [[900.0, 900.0, 900.0]]):
        points = spark.createDataFrame(rows({0: np.vstack([wide, spot, *map(np.atleast_2d, extra)])}), POINTS)
        frames = start_radii(points, 8, ["frame_id"], xyz)
        cloud, asked = points.join(frames.select("frame_id", "_r"), "frame_id"), queries.join(frames, "frame_id")
        levels = {r.cand_idx: r["_level"] for r in start_levels(asked, cloud, 8, ["frame_id"], "cand_idx", txyz, xyz).collect()}
        assert levels[1] >= levels[0] + 3
        found.append(levels)
    assert found[0] == found[1]


def test_neighbours_skip_what_has_no_place(spark):
    points = spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0), (0, 1, float("nan"), 0.0, 0.0), (0, 2, None, 0.0, 0.0)], POINTS)
    queries = spark.createDataFrame([(0, 0, 1.0, 1.0, 2.0), (0, 1, None, 0.0, 0.0), (0, 2, float("inf"), 0.0, 0.0)], QUERIES)
    assert as_set(knn_join(queries, points, 3), "cand_idx", "nn", "point_idx", "d2") == [(0, 0, 0, 1.0)]
    assert knn_join(queries.where("false"), points, 3).count() == 0
    assert knn_join(queries, points.where("false"), 3).count() == 0
