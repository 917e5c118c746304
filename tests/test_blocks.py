"""Blocked plans for crowded frames: rounds stay few, rows equal the one-pass plans, small frames are not moved."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import clusters as K
from rankforge.operators import sampling as N
from rankforge.plans import greedy
from tests.conftest import as_set

def frame():
    return [F.lit(1).alias("scene_id"), F.lit(7).alias("frame_id"), F.lit("left").alias("camera")]


@pytest.fixture
def rounds(monkeypatch):
    """Rounds of the blocked pass; each writes three tables after the first."""
    count, write = [0], greedy.materialise

    def counted(df):
        count[0] += 1
        return write(df)

    monkeypatch.setattr(greedy, "materialise", counted)
    return lambda: (count[0] - 1) / 3


def test_chain_through_many_blocks(spark, rounds):
    """Every element depends on the one before it."""
    chain = spark.range(10_000).select(
        *frame(), F.col("id").alias("cand_idx"), (F.col("id") * 0.02 - 71).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz")
    )
    found = K.leader_cluster(chain, 0.03, limit=2_500)
    assert as_set(found, "cand_idx", "leader_idx", "cluster_id") == [(i, i - i % 2, i // 2) for i in range(10_000)]
    assert rounds() < 10


def rotations(n):
    q = np.random.default_rng(1).normal(size=(n, 4))
    w, x, y, z = (q / np.linalg.norm(q, axis=1)[:, None]).T
    return np.stack(
        [
            1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z),
            2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
        ],
        axis=1,
    )


@pytest.mark.parametrize("angle", [math.pi / 6, 0.01])
def test_equal_positions_with_their_own_rotations(spark, rounds, angle):
    """One cell holds everything; with the small angle hardly anything is suppressed."""
    turns = rotations(10_000)
    scores = np.random.default_rng(2).permutation(10_000)
    rows = [(1, 7, "left", i, float(scores[i]), 0.1, -0.1, 0.0, *map(float, turns[i])) for i in range(10_000)]
    columns = ", ".join(f"{c} double" for c in ("base_score", "tx", "ty", "tz", *[f"r{i}" for i in range(9)]))
    poses = spark.createDataFrame(rows, f"scene_id int, frame_id int, camera string, cand_idx long, {columns}")
    once = K.pose_nms(poses, rot=angle)
    assert as_set(K.pose_nms(poses, rot=angle, limit=2_500), "cand_idx") == as_set(once, "cand_idx")
    assert rounds() < 10


def test_small_frames_keep_their_plan(spark, rounds):
    g = np.random.default_rng(5)
    rows = [(1, 1, "left", i, *map(float, p)) for i, p in enumerate(g.normal(size=(6_000, 3)) * [0.3, 0.3, 0.01])]
    rows += [(1, 2, "left", i, *map(float, p)) for i, p in enumerate(g.normal(size=(60, 3)) * 0.05)]
    poses = spark.createDataFrame(rows, "scene_id int, frame_id int, camera string, cand_idx long, tx double, ty double, tz double")
    once, blocked = K.leader_cluster(poses), K.leader_cluster(poses, limit=900)
    assert as_set(once) == as_set(blocked.select(*once.columns))
    assert 1 <= rounds() < 10
    plan = blocked._jdf.queryExecution().toString()
    assert plan.count("LeftAnti") and plan.count("LeftSemi")


@pytest.fixture
def writes(monkeypatch):
    count, write = [0], N.materialise

    def counted(df):
        count[0] += 1
        return write(df)

    monkeypatch.setattr(N, "materialise", counted)
    return count


def test_many_farthest_points_in_few_rounds(spark, writes):
    """The slots of the vectorised pass, for groups with outliers, copies of points and fewer distinct points than slots."""
    g = np.random.default_rng(4)
    clouds = {
        1: g.normal(size=(20_000, 3)) * [1, 2, 3],
        2: np.concatenate([g.normal(size=(3_000, 3)) * 0.01, [[1e6, 0, 0], [0, -3e5, 0]]]),
        3: g.integers(0, 3, size=(2_500, 3)).astype(float),
        4: g.normal(size=(40, 3)),
    }
    rows = [(f, i * 3 - 50, *map(float, p)) for f, cloud in clouds.items() for i, p in enumerate(cloud)]
    points = spark.createDataFrame(rows, "frame_id int, point_idx int, x float, y float, z float")
    found = N.farthest_point_sample(points, ["frame_id"], 96, limit=2_000)
    assert found.schema["point_idx"].dataType.simpleString() == "int"
    expected = []
    for f, cloud in clouds.items():
        picks = N._spread_order(cloud.astype(np.float32), 96, False) if len(cloud) > 96 else range(len(cloud))
        expected += [(f, slot, int(at) * 3 - 50) for slot, at in enumerate(picks)]
    assert as_set(found, "frame_id", "slot", "point_idx") == sorted(expected)
    assert writes[0] < 45


def test_crowded_cells_and_budgets_above_the_size(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_POINTS", 50)
    monkeypatch.setattr(N, "SHOWN", 2)
    g = np.random.default_rng(6)
    cloud = np.concatenate([np.zeros((400, 3)), g.normal(size=(300, 3))]).astype(np.float32)
    rows = [(1, i, *map(float, p), 30) for i, p in enumerate(cloud)] + [(2, i, *map(float, p), 1_000) for i, p in enumerate(cloud)]
    points = spark.createDataFrame(rows, "frame_id int, point_idx long, x float, y float, z float, wanted int")
    for seed in ("farthest", "nearest"):
        found = N.farthest_point_sample(points, ["frame_id"], "wanted", seed, limit=100)
        expected = [(1, s, int(i)) for s, i in enumerate(N._spread_order(cloud, 30, seed == "nearest"))]
        assert as_set(found, "frame_id", "slot", "point_idx") == expected + [(2, i, i) for i in range(700)]
