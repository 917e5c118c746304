"""Sidecar trees: written, interrupted, resumed and read back."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.sources.catalog import object_sidecar_join
from rankforge.sources.sidecars import SidecarReader, read_sidecars, write_sidecars
from tests.conftest import as_set

SCHEMA = "scene_id int, frame_id int, camera string, cand_idx long, pooled array<float>"


@pytest.fixture(scope="module")
def pooled(spark):
    rng = np.random.default_rng(1)
    rows = [
        (scene, frame, camera, i, [float(x) for x in np.round(rng.normal(size=4) * 64) / 64])
        for scene in (100, 101, 7)
        for camera in ("left", "right")
        for frame in range(3)
        for i in range(1 + (scene + frame) % 5)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    return as_set(df.select("scene_id", "frame_id", "camera", "cand_idx", F.col("pooled").cast("string").alias("pooled")))


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if f.endswith(".npz"))


def test_round_trip_and_joined_batches(spark, pooled, tmp_path):
    root = str(tmp_path / "tree")
    write_sidecars(pooled, root)
    assert len(files(root)) == 18 and files(root)[0] == "scene_0007/left/0000.npz"
    with np.load(f"{root}/scene_0100/left/0002.npz") as archive:
        assert archive["object_pooled"].dtype == np.float16 and str(archive["source_relative_path"]) == "scene_0100/left/0002.npz"
    assert plain(read_sidecars(spark, root)) == plain(pooled)
    assert plain(read_sidecars(spark, root, partition_bytes=1)) == plain(pooled)
    assert read_sidecars(spark, root, partition_bytes=1).rdd.getNumPartitions() == 18
    joined = object_sidecar_join(pooled.drop("pooled"), read_sidecars(spark, root), require=True)
    assert plain(joined) == plain(pooled)


def test_interrupted_and_resumed(spark, pooled, tmp_path):
    """A failed job leaves the tree as it was; the next one writes only what is missing, and keeps what is there."""
    root = str(tmp_path / "tree")
    write_sidecars(pooled.where("scene_id = 7"), root)
    before = {f: os.path.getmtime(f"{root}/{f}") for f in files(root)}
    broken = pooled.withColumn("cand_idx", F.when((F.col("scene_id") == 101) & (F.col("frame_id") == 1), F.col("cand_idx") + 1).otherwise(F.col("cand_idx")))
    with pytest.raises(Exception, match="without gaps"):
        write_sidecars(broken, root)
    assert files(root) == sorted(before) and not os.listdir(f"{root}/_staging")
    write_sidecars(pooled, root)
    assert {f: os.path.getmtime(f"{root}/{f}") for f in before} == before
    assert plain(read_sidecars(spark, root)) == plain(pooled)
    write_sidecars(pooled, root)
    assert len(files(root)) == 18


def test_conditions_reach_the_listing(spark, pooled, tmp_path):
    root = str(tmp_path / "tree")
    write_sidecars(pooled, root)
    for condition in ("scene_id = 100", "scene_id in (7, 101) and camera = 'left'", "scene_id >= 101 and frame_id < 2", "scene_id = 5", "cand_idx = 0 and camera <=> 'right'"):
        assert plain(read_sidecars(spark, root).where(condition)) == plain(pooled.where(condition))
    found = read_sidecars(spark, root).where("scene_id = 100 and camera = 'left' and cand_idx = 0")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # What is pushed into the listing is not filtered again behind the scan.
    behind = plan[: plan.index("BatchScan")]
    assert "cand_idx" in behind and "Filter" in behind and "100" not in behind
    reader = SidecarReader(root, 1)
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("scene_id",), 100), EqualTo(("camera",), "left"), StringStartsWith(("camera",), "l")]))
    assert len(left) == 1 and len(reader.partitions()) == 3


def test_empty_trees(spark, pooled, tmp_path):
    assert read_sidecars(spark, str(tmp_path / "nothing")).collect() == []
    write_sidecars(pooled.limit(0), str(tmp_path / "none"))
    assert read_sidecars(spark, str(tmp_path / "none")).collect() == []


def test_sessions_without_filter_pushdown(spark, pooled, tmp_path):
    """Spark's default is not to push filters into Python sources; the rows are the same."""
    root, key = str(tmp_path / "tree"), "spark.sql.python.filterPushdown.enabled"
    write_sidecars(pooled, root)
    spark.conf.set(key, "false")
    try:
        for condition in ("scene_id = 100", "scene_id >= 101 and frame_id < 2", "true"):
            assert plain(read_sidecars(spark, root).where(condition)) == plain(pooled.where(condition))
        assert read_sidecars(spark, str(tmp_path / "nothing")).collect() == []
    finally:
        spark.conf.set(key, "true")


def test_query_without_filter_pushdown(spark):
    """The registered query against its SQL on tables that have scenes from 120 on."""
    from suite.registry import ORACLES, QUERIES
    import suite.labelling  # noqa: F401
    from tests.oracle import compare, connect

    sf, key = "/root/testdata/sf0.01", "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "false")
    try:
        ok, message = compare(QUERIES["a10_sidecar_tree"](spark, sf), connect(sf), ORACLES["a10_sidecar_tree"])
    finally:
        spark.conf.set(key, "true")
    assert ok, message
