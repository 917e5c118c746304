"""Operators on the points around each query against the same on one row per pair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import geometry as C
from rankforge.operators import sampling as N
from rankforge.plans import near as P
from rankforge.plans.grid import radius_join
from tests.conftest import as_set

RADIUS, KEYS, WHO = 0.04, ["frame_id"], ["frame_id", "cand_idx"]


@pytest.fixture(scope="module")
def clouds(spark):
    """Two frames, one with copies of points, one query far from everything, one frame without points."""
    rng = np.random.default_rng(5)
    points, queries = [], []
    for frame, n in ((0, 300), (1, 60)):
        at = rng.normal(scale=0.02, size=(n, 3))
        at[: n // 5] = at[0]
        points += [(frame, i, *map(float, x), None if i % 11 == 0 else float(i % 7)) for i, x in enumerate(at)]
    for frame, n in ((0, 40), (1, 25), (2, 2)):
        for i, x in enumerate(rng.normal(scale=0.02, size=(n, 3))):
            a = float(rng.uniform(0, 6))
            turn = [np.cos(a), -np.sin(a), 0, np.sin(a), np.cos(a), 0, 0, 0, 1]
            queries.append((frame, i, *map(float, x if i else x + 9), *map(float, turn)))
    axes = ", ".join(f"{r} double" for r in C.ROTATION)
    return (
        spark.createDataFrame(queries, f"frame_id int, cand_idx long, tx double, ty double, tz double, {axes}"),
        spark.createDataFrame(points, "frame_id int, point_idx long, x double, y double, z double, f double"),
    )


@pytest.fixture(scope="module")
def pairs(clouds):
    return C.to_local_frame(radius_join(*clouds, RADIUS)).cache()


@pytest.fixture(params=[(4096, 100_000), (7, 20)], ids=["one call", "many calls"])
def limit(request, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", request.param[0])
    return request.param[1]


def test_shell_pool_around(clouds, pairs, limit):
    old = C.shell_pool(pairs.withColumn("radius", F.sqrt("d2")), ["z", "f"], WHO, clouds[0])
    new = C.shell_pool_around(*clouds, ["z", "f"], limit=limit)
    assert new.columns == old.columns
    means = [F.round(c, 12).alias(c) for c in ("z_mean", "f_mean")]
    rest = [c for c in old.columns if not c.endswith("_mean")]
    assert sorted(map(str, new.select(*rest, *means).collect())) == sorted(map(str, old.select(*rest, *means).collect()))


def test_nearest_p_around(clouds, pairs, limit):
    for p in (3, 40):
        old = C.nearest_p_sample(pairs, p, WHO)
        assert as_set(C.nearest_p_around(*clouds, RADIUS, p, limit=limit), *WHO, "point_idx", "slot") == as_set(old, *WHO, "point_idx", "slot")


def test_nearest_join_within(clouds, monkeypatch):
    queries, points = clouds
    points = points.withColumn("label", F.col("point_idx").cast("int"))
    near = radius_join(queries, points, 0.01, strict=True).groupBy(*WHO).agg(F.min(F.struct("d2", "point_idx")).alias("b"))
    want = queries.select(*WHO).join(near, WHO, "left").select(*WHO, F.coalesce(F.col("b.point_idx").cast("int"), F.lit(-1)).alias("label"))
    out = C.nearest_join(queries, points, max_dist=0.01)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().toString()
    assert as_set(out.withColumnRenamed("nearest_label", "label"), *WHO, "label") == as_set(want, *WHO, "label")


@pytest.mark.parametrize("most", [100_000, 50], ids=["arrays", "arrays and rows"])
def test_local_cloud(clouds, pairs, most, monkeypatch):
    budgets = (2, 0, 6, 8)
    old = N.stratified_fps(pairs, WHO, budgets=budgets)
    columns = [*WHO, "shell", "slot", "point_idx", "lx", "ly", "lz"]
    want = as_set(old, *columns)
    if most > 50:
        # Few points around a candidate need no row per pair.
        monkeypatch.setattr(N, "radius_join", None)
    new = N.local_cloud(*clouds, budgets=budgets, limit=most)
    assert new.schema["shell"].dataType == old.schema["shell"].dataType and as_set(new, *columns) == want
