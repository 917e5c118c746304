"""Joins and samplers against plain numpy on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import clusters as K
from rankforge.operators import geometry as C
from rankforge.operators import sampling as N
from rankforge.plans.grid import knn_join, radius_join, start_radii
from tests.conftest import as_set


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    p = {f: rng.normal(0, 0.03, (n, 3)) for f, n in ((0, 90), (1, 5), (2, 30))}
    q = {f: rng.normal(0, 0.05, (n, 3)) for f, n in ((0, 20), (1, 6), (2, 1), (3, 2))}
    q[0][0] = 4.0  # far from everything
    points = spark.createDataFrame(
        [(f, i, *map(float, v)) for f, a in p.items() for i, v in enumerate(a)], "frame_id int, point_idx int, x double, y double, z double"
    )
    queries = spark.createDataFrame(
        [(f, i, *map(float, v)) for f, a in q.items() for i, v in enumerate(a)], "frame_id int, cand_idx int, tx double, ty double, tz double"
    )
    return p, q, points, queries


def test_radius_join(cloud):
    p, q, points, queries = cloud
    for r in (0.01, 0.04, 0.5):
        want = sorted(
            (f, i, j)
            for f in q
            for i, a in enumerate(q[f])
            for j, b in enumerate(p.get(f, []))
            if ((a - b) ** 2).sum() <= r * r
        )
        for spread in ((), ("frame_id", "cand_idx")):
            got = as_set(radius_join(queries, points, r, spread=spread), "frame_id", "cand_idx", "point_idx")
            assert got == want


def test_a_far_point_leaves_the_start_radii(spark):
    rng = np.random.default_rng(4)
    rows = [(f, *map(float, v)) for f in range(2) for v in rng.normal(0, 0.03, (200, 3))]
    schema = "frame_id int, x double, y double, z double"
    radii = [
        {r["frame_id"]: r["_r"] for r in start_radii(spark.createDataFrame(data, schema), 8, ["frame_id"], ["x", "y", "z"]).collect()}
        for data in (rows, rows + [(0, 500.0, 500.0, 500.0)])
    ]
    assert radii[0][1] == radii[1][1] and abs(radii[1][0] / radii[0][0] - 1) < 0.05


def test_knn_join(cloud):
    p, q, points, queries = cloud
    want = []
    for f in q:
        for i, a in enumerate(q[f]):
            d = ((p.get(f, np.zeros((0, 3))) - a) ** 2).sum(axis=1)
            want += [(f, i, k, int(j)) for k, j in enumerate(np.argsort(d, kind="stable")[:7])]
    assert as_set(knn_join(queries, points, 7), "frame_id", "cand_idx", "nn", "point_idx") == sorted(want)


def test_nearest_without_points(cloud):
    _, _, points, queries = cloud
    labelled = points.withColumn("label", F.col("point_idx"))
    out = C.nearest_join(queries, labelled)
    assert out.count() == queries.count()
    assert {r.nearest_label for r in out.where("frame_id = 3").collect()} == {-1}
    far = C.nearest_join(queries, labelled, max_dist=0.05).where("frame_id = 0 AND cand_idx = 0").first()
    assert far.nearest_label == -1


def numpy_fps(points, budget):
    points = points.astype(np.float32)
    if len(points) <= budget:
        return list(range(len(points)))
    chosen = [int(np.argmax(np.linalg.norm(points, axis=1)))]
    gap = np.full(len(points), np.inf, dtype=np.float32)
    while len(chosen) < budget:
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(np.argmax(gap)))
    return chosen


def test_farthest_points(cloud):
    p, _, points, _ = cloud
    want = sorted((f, s, i) for f, a in p.items() for s, i in enumerate(numpy_fps(a, 12)))
    assert as_set(N.farthest_point_sample(points, ["frame_id"], 12), "frame_id", "slot", "point_idx") == want


def test_stratified_slots(cloud):
    _, _, points, _ = cloud
    budgets = (2, 3, 4, 5)
    out = N.stratified_fps(points, ["frame_id"], budgets=budgets, xyz=("x", "y", "z")).collect()
    for r in out:
        start = sum(budgets[: r.shell])
        assert start <= r.slot < start + budgets[r.shell]
    assert len({(r.frame_id, r.slot) for r in out}) == len(out)
    with pytest.raises(ValueError):
        N.stratified_fps(points, ["frame_id"], budgets=(1, 2))


def test_object_cloud(spark):
    """Two objects side by side, a mask each; thinning and sampling against numpy."""
    h, w = 12, 16
    rows, masks = [], []
    for v in range(h):
        for u in range(w):
            left = u < 8
            z = (0.5 if left else 0.8) if (v + u) % 7 else 0.0
            rows.append((0, v, u, (u - 8) / 500 * z, (v - 6) / 500 * z, z, z > 0))
            masks.append((0, int(not left), v, u))
    points = spark.createDataFrame(rows, "frame_id int, v int, u int, x double, y double, z double, valid boolean")
    pixels = spark.createDataFrame(masks, "frame_id int, mask_idx int, v int, u int")
    areas = pixels.groupBy("frame_id", "mask_idx").agg(F.count(F.lit(1)).alias("area")).withColumn("score", F.lit(0.9))
    cam = spark.createDataFrame([(0, 500.0, 500.0, 8.0, 6.0)], "frame_id int, fx double, fy double, cx double, cy double")
    cand = points.where("valid AND v IN (1, 9)").select(
        "frame_id", (F.col("v") * w + F.col("u")).alias("cand_idx"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz")
    )
    for thin in (0, 40, 10):
        out = K.object_cloud(cand, areas, pixels, points, cam, (h, w), budget=20, cluster_radius=0.01, input_points=thin, min_area=5, max_ratio=0.9)
        got = {r.cand_idx: r for r in out.collect()}
        assert len(got) == cand.count()
        for r in got.values():
            left = r.cand_idx % w < 8
            mask = np.array([[x, y, z] for _, v, u, x, y, z, ok in rows if ok and (u < 8) == left])
            if thin > 0 and len(mask) > 20 and len(mask) > thin:
                mask = mask[np.linspace(0, len(mask) - 1, num=thin, dtype=np.int64)]
            want = mask[numpy_fps(mask, 20)].astype(np.float32)
            have = np.array([[p.x, p.y, p.z] for p in r.object_cloud], dtype=np.float32)
            assert np.array_equal(have, want)
    none = K.object_cloud(cand, areas, pixels, points, cam, (h, w), min_area=10_000)
    assert {len(r.object_cloud) for r in none.collect()} == {0}
