"""Joins whose pairs are the result: dealt out by pairs, rounded and written in few bytes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.plans import grid
from rankforge.plans.grid import radius_join
from suite.geometry import c6_to_local_frame
from suite.registry import long6, r6
from tests.conftest import as_set


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(5)
    near, far = rng.normal(0, 0.02, (400, 3)), rng.uniform(-0.4, 0.4, (200, 3))
    places = [[f, i, *map(float, v)] for f, part in enumerate((near, far, near[:5])) for i, v in enumerate(part)]
    odd = [[0, 900, math.nan, 0.0, 0.0], [0, 901, None, 0.0, 0.0], [7, 902, 0.0, 0.0, 0.0]]
    queries = spark.createDataFrame(places + odd, "frame_id int, cand_idx int, tx double, ty double, tz double")
    points = spark.createDataFrame([[f, i, z, x, y] for f, i, x, y, z in places + odd[:2]], "frame_id int, point_idx int, x double, y double, z double")
    return queries, points


@pytest.mark.parametrize(("sizes", "crowd"), [((2048, 3072, 128), 100_000), ((7, 11, 3), 20)])
def test_same_pairs_in_shares_of_any_size(sides, monkeypatch, sizes, crowd):
    for name, n in zip(("SHARE", "PARTY", "TILE"), sizes):
        monkeypatch.setattr(grid, name, n)
    for strict in (False, True):
        plain, dealt = radius_join(*sides, 0.04, strict=strict, small=0), radius_join(*sides, 0.04, strict=strict, small=0, crowd=crowd, even=True)
        assert dealt.columns == plain.columns and as_set(dealt) == as_set(plain) != []


def test_tasks_follow_the_pairs(sides, monkeypatch):
    """Tasks followed the bytes, so that one task had all pairs of a cell, however many these were."""
    for name, n in zip(("SHARE", "PARTY", "WORK"), (40, 40, 1600)):
        monkeypatch.setattr(grid, name, n)
    found = radius_join(*sides, 0.04, small=0, even=True)
    rows = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) > 20 and max(rows) < sum(rows) / 10


def test_the_result_is_written_in_few_bytes(spark, tmp_path):
    """Coordinates of a pair were written as eight bytes each; now they keep their dictionaries."""
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(0, 0.08, (1500, 8)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c6_to_local_frame(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert out.count() > 1_000_000 and size / out.count() < 14


def test_rounding_of_long_results(spark):
    values = [(v,) for v in (None, math.nan, math.inf, -math.inf, 0.0, -0.0, -1e-9, 0.0000005, -0.1234565, 12345.678901)]
    rng = np.random.default_rng(7)
    values += [(float(v),) for v in rng.normal(0, 1, 20_000) * 10.0 ** rng.integers(-6, 4, 20_000)]
    df = spark.createDataFrame(values, "v double")
    both = df.select("v", r6("v")[0].alias("a"), long6("v")[0].alias("b"))
    assert both.where("NOT a <=> b OR cast(a AS string) IS DISTINCT FROM cast(b AS string)").count() == 0
