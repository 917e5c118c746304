"""Trees of many small files: frames cut by batches, files gathered into batches, listing by few tasks."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rankforge import schemas as S
from rankforge.sources import dumps as D
from rankforge.streaming import jobs as J
from tests.conftest import as_set


def rows(spark, frames=40):
    df = spark.range(frames).select(F.col("id").alias("frame_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 23)).alias("cand_idx"))
    fixed = {c: F.lit(0.5) for c in ("width", "height", "depth", "tx", "ty", "tz")}
    return df.withColumns(
        {
            **fixed, "scene_id": (F.col("frame_id") % 3).cast("int"), "camera": F.lit("kinect"), "base_score": (F.col("cand_idx") + F.col("frame_id") * 100).cast("double"),
            "rotation": F.array(*[F.lit(float(i)) for i in range(9)]), "object_id": F.col("cand_idx").cast("int"),
            "mu_min": F.lit(0.2), "is_collision": F.col("cand_idx") % 2 == 0, "is_empty": F.lit(False),
            "cloud": F.transform(F.sequence(F.lit(0), (F.col("cand_idx") % 3).cast("int")), lambda j: F.struct(j.cast("double").alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))),
        }
    )


def test_frames_cut_by_batches(spark, tmp_path):
    df, name = rows(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = as_set(df.select("scene_id", F.col("frame_id").cast("int"), "cand_idx", F.col("base_score").cast("float"), F.size("cloud").alias("n")))
    spark.conf.set(name, 7)
    try:
        assert sorted(r.num for r in D.write_dumps(df, f"{tmp_path}/a").collect()) == sorted(i % 23 + 1 for i in range(40))
        assert D.write_archives(df, f"{tmp_path}/b").count() == 40
    finally:
        spark.conf.unset(name)
    got = D.read_candidate_dumps(spark, f"{tmp_path}/a", "kinect")
    assert as_set(got.select("scene_id", "frame_id", "cand_idx", "base_score")) == [w[:4] for w in want]
    back = D.read_archives(spark, f"{tmp_path}/b")
    assert as_set(back.select("scene_id", "frame_id", "cand_idx", "base_score", F.size("cloud").alias("n"))) == want
    assert {tuple(p) for r in back.where("cand_idx = 2").collect() for p in r.cloud} == {(0.0, 2.0, 3.0), (1.0, 2.0, 3.0), (2.0, 2.0, 3.0)}
    assert back.where("size(rotation) <> 9 OR rotation[8] <> 8 OR is_collision <> (cand_idx % 2 = 0)").count() == 0


def test_files_come_in_batches():
    def content(n):
        stream = io.BytesIO()
        np.save(stream, np.full((n, S.DUMP_WIDTH), n, np.float32))
        return stream.getvalue()

    sizes = [i % 5 for i in range(3000)]
    files = pa.RecordBatch.from_pydict(
        {"path": [f"p{i}" for i in range(3000)], "scene_id": sizes, "frame_id": [None] * 3000, "camera": ["a"] * 3000, "split": [None] * 3000, "content": [content(n) for n in sizes]}
    )
    found = list(D._gathered(iter([files]), D._dump_rows, to_arrow_schema(S.DUMP_SCHEMA)))
    assert len(found) == 1 and found[0].num_rows == sum(sizes)
    table = found[0].to_pydict()
    assert table["path"][:4] == ["p1", "p2", "p2", "p3"] and table["cand_idx"][:4] == [0, 0, 1, 0]
    assert table["base_score"] == table["scene_id"] and table["rotation"][3] == [3.0] * 9


def test_a_stream_lists_by_few_tasks(spark):
    own, name = J._listing_session(spark), "spark.sql.shuffle.partitions"
    assert int(own.conf.get(J.LISTING)) < 100 and own.conf.get(name) == spark.conf.get(name)
    assert spark.conf.get(J.LISTING, None) is None


def test_a_matrix_is_made_once_for_the_frames_of_a_batch():
    """Rows went through pandas frame by frame, with an object for each rotation."""
    fixed = {c: pa.array([0.5, 1.5, None]) for c in ("base_score", "width", "height", "depth", "tx", "ty", "tz")}
    rotation = [[float(i + 10 * j) for i in range(9)] for j in range(3)]
    batch = pa.RecordBatch.from_pydict({**fixed, "rotation": rotation, "object_id": pa.array([1, None, 3], pa.int32())}).slice(1)
    matrix = D._frame_matrix(batch)
    assert matrix.dtype == np.float32 and matrix.shape == (2, S.DUMP_WIDTH)
    assert matrix[0, :4].tolist() == [1.5] * 4 and np.isnan(matrix[1, 13]) and np.isnan(matrix[0, 16]) and matrix[1, 16] == 3
    assert matrix[:, 4:13].tolist() == rotation[1:]
    for wrong in ([rotation[0][:8], rotation[1] + [0.0], rotation[2]], [None, rotation[0] * 2, rotation[1]]):
        with pytest.raises(ValueError):
            D._frame_matrix(pa.RecordBatch.from_pydict({**fixed, "rotation": wrong, "object_id": [1, 2, 3]}))


def test_a_task_makes_a_folder_once(tmp_path):
    made = set()
    for n in "ab":
        with D.open_output(f"{tmp_path}/x/y/{n}", made) as stream:
            stream.write(n.encode())
    assert made == {f"{tmp_path}/x/y"} and (tmp_path / "x/y/b").read_bytes() == b"b"


def test_a_stream_reads_many_small_files_in_a_task(spark, tmp_path):
    """They were read 32 at a time, as opening each counted as four megabytes."""
    for i in range(3000):
        (tmp_path / f"{i}.npy").write_bytes(b"x")
    tasks = lambda session: session.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions()
    few = spark.sparkContext.defaultParallelism * 4
    assert tasks(spark) > 2 * few and tasks(J._listing_session(spark)) <= few + 1
    spark.conf.set(J.OPENING, 1 << 22)
    try:
        assert J._listing_session(spark).conf.get(J.OPENING) == str(1 << 22)
    finally:
        spark.conf.unset(J.OPENING)
