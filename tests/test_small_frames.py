"""Frames of few queries and points are joined whole, with the pairs that the cells give."""

from __future__ import annotations

import numpy as np
import pytest

from rankforge.plans.grid import radius_join
from tests.conftest import as_set


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    places = rng.uniform(-0.2, 0.2, (240, 3)).tolist()
    queries = spark.createDataFrame([(i % 8, i, *p) for i, p in enumerate(places)], "frame_id int, cand_idx int, tx double, ty double, tz double")
    points = spark.createDataFrame([(i % 9, i, *p) for i, p in enumerate(reversed(places))], "frame_id int, point_idx int, x double, y double, z double")
    return queries, points


@pytest.mark.parametrize("strict", [False, True])
def test_same_pairs(sides, strict):
    args = dict(radius=0.15, strict=strict, spread=["frame_id", "cand_idx"])
    whole, cells = radius_join(*sides, **args), radius_join(*sides, **args, small=0)
    assert whole.columns == cells.columns
    assert as_set(whole) == as_set(cells) != []


def test_small_frames_do_not_repeat_their_queries(sides):
    """Each query was shuffled 27 times, once for every cell around its own."""
    plan = radius_join(*sides, 0.15, spread=["frame_id", "cand_idx"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_one_larger_frame_keeps_the_cells(sides):
    queries, points = sides
    more = points.unionByName(points.limit(0)).unionByName(points.where("frame_id = 1").crossJoin(points.select("point_idx").limit(20).toDF("n")).drop("n"))
    plan = radius_join(queries, more, 0.15)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan
