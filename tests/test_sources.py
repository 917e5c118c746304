"""Files in and out, manifests, and streams."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import labels as B
from rankforge.operators import models as K
from rankforge.sources import catalog as A
from rankforge.sources import dumps as D
from rankforge.streaming import jobs as J
from tests.conftest import as_set


def test_dump_layouts(spark, tmp_path):
    def put(rel, array):
        path = tmp_path / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        np.save(path, array)

    m = np.arange(34, dtype=np.float32).reshape(2, 17)
    put("scene_0100/realsense/0000.npy", m)
    put("scene_0100/0000.npy", m + 100)  # loses against the camera layout
    put("scene_0101/0003.npy", m[:1])
    put("scene_0102/realsense/0001.npy", np.zeros((0, 17), np.float32))
    df = D.read_candidate_dumps(spark, str(tmp_path), "realsense")
    assert as_set(df, "scene_id", "frame_id", "camera", "cand_idx", "base_score", "tz", "object_id") == [
        (100, 0, "realsense", 0, 0.0, 15.0, 16),
        (100, 0, "realsense", 1, 17.0, 32.0, 33),
        (101, 3, "realsense", 0, 0.0, 15.0, 16),
    ]
    put("scene_0103/0000.npy", np.zeros((2, 5), np.float32))
    with pytest.raises(Exception, match="need 17 values"):
        D.read_candidate_dumps(spark, str(tmp_path), "realsense").collect()


def test_archives(spark, tmp_path_factory):
    # A folder name that does not itself look like a split.
    tmp_path = tmp_path_factory.mktemp("packed") / "tree"
    folder = tmp_path / "train" / "scene_0007" / "kinect"
    folder.mkdir(parents=True)
    rows = np.ones((2, 17), np.float32)
    cloud = np.zeros((2, 4, 3), np.float32)
    cloud[0, :2] = 0.5
    np.savez(folder / "0004.npz", grasp_group_array=rows, mu_min=np.array([0.2, np.inf], np.float32), local_cloud=cloud,
             is_empty=np.array([False, True]), base_scores=np.array([0.9, 0.8], np.float32), object_cloud=cloud[:, :3] + 1, meta_json=np.array(json.dumps({"camera": "kinect"})))
    np.savez(folder / "0005.npz", grasp_group_array=rows[:1])
    df = D.read_archives(spark, str(tmp_path), "kinect").orderBy("frame_id", "cand_idx").collect()
    assert [(r.scene_id, r.frame_id, r.split, len(r.cloud)) for r in df] == [(7, 4, "train", 2), (7, 4, "train", 0), (7, 5, "train", 0)]
    assert [r.base_score for r in df] == [np.float32(0.9), np.float32(0.8), 1.0]
    assert [len(r.object_cloud) for r in df] == [3, 3, 0] and df[0].object_cloud[0].y == 1.5 and df[0].object_cloud[2].x == 1.0
    assert df[0].mu_min == np.float32(0.2) and df[2].mu_min == float("inf") and df[2].object_id == -1
    assert json.loads(df[0].meta_json) == {"camera": "kinect"} and df[2].meta_json == "{}"
    assert D.read_archives(spark, str(tmp_path), "realsense").count() == 0
    members = {r.path[-8:]: r.members for r in D.archive_members(spark, str(tmp_path)).collect()}
    assert members["0005.npz"] == ["grasp_group_array"]
    assert D.file_listing(spark, str(tmp_path)).where("length > 0").count() == 2
    np.savez(folder / "0006.npz", grasp_group_array=rows, local_cloud=cloud, cloud_mask=np.ones((1, 4), bool))
    with pytest.raises(Exception, match="cloud_mask has 1 rows"):
        D.read_archives(spark, str(tmp_path)).collect()
    other = tmp_path / "loose"
    other.mkdir()
    np.savez(other / "0009.npz", grasp_group_array=rows[:1], meta_json=np.array(json.dumps({"camera": "realsense", "scene_id": 12})))
    loose = D.read_archives(spark, str(other)).collect()
    assert [(r.scene_id, r.frame_id, r.camera) for r in loose] == [(12, 9, "realsense")]
    assert D.read_archives(spark, str(other), "kinect").count() == 0
    np.savez(folder / "0006.npz", grasp_group_array=rows, mu_min=np.ones(1, np.float32))
    with pytest.raises(Exception, match="rows for 2 candidates"):
        D.read_archives(spark, str(tmp_path)).collect()
    np.savez(folder / "0006.npz", grasp_group_array=np.array([{"a": 1}], dtype=object))
    with pytest.raises(Exception, match="allow_pickle"):
        D.read_archives(spark, str(tmp_path)).collect()


def test_archives_written_with_clouds(spark, tmp_path):
    point = "array<struct<x:double,y:double,z:double>>"
    schema = f"scene_id int, frame_id int, camera string, cand_idx long, base_score double, own double, object_id int, cloud {point}, object_cloud {point}, meta_json string"
    some = [(0.0, 0.0, 0.0), (1.0, 2.0, 3.0)]
    rows = [(1, 2, "kinect", 0, 0.5, 9.0, 3, some, some, '{"camera": "kinect"}'), (1, 2, "kinect", 1, 0.25, 8.0, -1, None, some, None)]
    rows.append((1, 3, "kinect", 0, 0.125, 7.0, 1, [], [], None))
    df = spark.createDataFrame(rows, schema).withColumns(
        {**{c: F.lit(0.5) for c in ("width", "height", "depth", "tx", "ty", "tz", "mu_min")}, "rotation": F.array_repeat(F.lit(0.0), 9),
         "is_collision": F.lit(True), "is_empty": F.lit(False)}
    )
    assert D.write_archives(df, str(tmp_path / "a"), matrix_score="own").count() == 2
    back = D.read_archives(spark, str(tmp_path / "a")).orderBy("frame_id", "cand_idx").collect()
    assert [(r.base_score, r.object_id, [tuple(p) for p in r.cloud], [tuple(p) for p in r.object_cloud], r.meta_json) for r in back] == [
        (0.5, 3, some, some, '{"camera": "kinect"}'), (0.25, -1, [], some, '{"camera": "kinect"}'), (0.125, 1, [], [], "{}"),
    ]
    members = D.archive_members(spark, str(tmp_path / "a")).collect()
    assert sorted(len(r.members) for r in members) == [9, 10]
    uneven = df.withColumn("object_cloud", F.slice("object_cloud", 1, F.col("cand_idx").cast("int")))
    with pytest.raises(Exception, match="one size"):
        D.write_archives(uneven, str(tmp_path / "b")).collect()


def test_manifest_versions(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"schema_version": 1, "num_grasps": 3, "mu_min_nonfinite_count": 1}\n\n{"schema_version": 1, "num_grasps": 4}\n')
    bad.write_text('{"schema_version": 99, "num_grasps": 3}\n')
    assert sorted(r.num for r in D.read_manifest(spark, str(good)).collect()) == [3, 4]
    assert D.read_manifest(spark, str(good)).agg(F.sum("mu_nonfinite_count")).first()[0] == 1
    for read in (lambda df: df.collect(), lambda df: df.select("num").collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="unsupported manifest"):
            read(D.read_manifest(spark, str(bad)))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "kinect", 0, 0.5, 0.25, 1)], "scene_id int, frame_id int, camera string, cand_idx int, base_score double, export_score double, rank int")
    D.write_reranked(df, str(tmp_path / "out"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.base_score, row.output_path) == (0.25, "scene_0001/kinect/0002.npy")
    D.write_records(df.withColumn("none", F.lit(None).cast("int")), str(tmp_path / "rec"))
    text = "".join(f.read_text() for f in (tmp_path / "rec").glob("part-*.json"))
    assert json.loads(text)["none"] is None
    D.write_summary(df, str(tmp_path / "sum"))
    assert len(list((tmp_path / "sum").glob("part-*.json"))) == 1


def test_union_roots(spark):
    a, b = spark.range(2).toDF("i"), spark.range(3).toDF("i")
    assert as_set(A.union_roots([a, b], ["s"]).groupBy("root_index", "sidecar_root").count()) == [(0, "s", 2), (1, "s", 3)]
    with pytest.raises(ValueError):
        A.union_roots([a, b, a], ["s", "t"])


def test_padding(spark):
    df = spark.createDataFrame([(0, [(1.0, 0.0, 0.0)]), (1, [])], "i int, cloud array<struct<x: double, y: double, z: double>>")
    padded = B.pad_clouds(B.cloud_mask(df), 3)
    assert [(len(r.cloud), sum(r.cloud_mask)) for r in padded.orderBy("i").collect()] == [(3, 1), (3, 0)]
    assert as_set(B.strip_padding(padded), "i", "cloud") == as_set(df, "i", "cloud")


def test_late_rows(spark, tmp_path):
    """Rows behind the watermark no longer change a closed window."""
    schema = "ts timestamp, scene_id int, mu_min double, is_collision boolean, is_empty boolean"
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def arrive(*times):
        rows = [(t, 1, 0.2, False, False) for t in times]
        spark.createDataFrame(rows, "ts string, scene_id int, mu_min double, is_collision boolean, is_empty boolean").withColumn(
            "ts", F.col("ts").cast("timestamp")
        ).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        J.write_updates(J.stream_manifest(stream, "ts"), out, check).awaitTermination()

    arrive("2024-01-01 00:10:00", "2024-01-01 00:20:00")
    arrive("2024-01-01 05:00:00")
    arrive("2024-01-01 00:30:00", "2024-01-01 05:30:00")
    last = J.latest_updates(spark, out, ["window", "scene_id"])
    assert as_set(last.select(F.hour("window.start").alias("h"), "num")) == [(0, 2), (5, 2)]


def test_stream_ranking_edges(spark):
    schema = "frame_id int, candidates array<struct<cand_idx: long, base_score: double, model_score: double>>"
    df = spark.createDataFrame([(0, []), (1, [(0, 2.0, 1.0)]), (2, [(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 3.0)])], schema)
    out = J.stream_rerank(df, 1.0)
    assert as_set(out, "frame_id", "cand_idx", "rank") == [(1, 0, 1), (2, 0, 2), (2, 1, 3), (2, 2, 1)]


def test_callbacks(spark):
    df = spark.createDataFrame([(0, 0, "k", i, float(i)) for i in range(5)], "scene_id int, frame_id int, camera string, cand_idx long, base_score double")
    with pytest.raises(Exception, match="values for 5 candidates"):
        K.label_with(df, lambda pdf, meta: {"l": [1]}, "l int").collect()
    with pytest.raises(ValueError, match="required"):
        K.score_with(df.withColumn("f", F.lit(None).cast("array<double>")), lambda: (lambda x: x), "f", required="f")
    done = spark.createDataFrame([(1,)], "cluster_id int")
    clouds = spark.createDataFrame([(1, [(1.0, 2.0, 3.0)]), (2, []), (3, [(1.0, 2.0, 3.0), (3.0, 0.0, 1.0)])],
                                   "cluster_id int, object_cloud array<struct<x: double, y: double, z: double>>")
    out = K.embed_objects(clouds, lambda: (lambda cs: [c[:, :2] for c in cs]), 2, keys=["cluster_id"], done=done)
    assert as_set(out) == [(2, [0.0] * 4), (3, [2.0, 1.0, 3.0, 2.0])]


def test_pooled_in_double(spark):
    """A mean of double points keeps digits that single precision has not."""
    clouds = spark.createDataFrame([(1, [(0.1, 0.0, 0.0), (0.4 + 1e-9, 0.0, 0.0)])], "cluster_id int, object_cloud array<struct<x: double, y: double, z: double>>")
    encoder = lambda: (lambda cs: [c[:, :1] for c in cs])
    assert as_set(K.embed_objects(clouds, encoder, 1, keys=["cluster_id"], precision="double"))[0][1] == pytest.approx([0.25 + 5e-10, 0.4 + 1e-9], abs=1e-15)
    with pytest.raises(ValueError, match="precision"):
        K.embed_objects(clouds, encoder, 1, keys=["cluster_id"], precision="half")


def test_k3_near_the_rounding_edge(spark, tmp_path):
    """Blocks whose mean of 64 values lies within single precision of the edge at which the query rounds."""
    import duckdb
    import __spark_entry__ as entry
    from tests.oracle import compare

    # 64 values of mean 350.48765625, 0.00004375 below the edge 350.4877; many orders of them.
    rng = np.random.default_rng(3)
    rows = []
    for block in range(200):
        cents = rng.integers(10_000, 60_000, 63)
        cents = np.append(cents, 2_243_121 - cents.sum())
        rows += [(64 * block + i, block, "view", int(c) / 100) for i, c in enumerate(cents)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    ok, message = compare(entry.queries()["k3_embed_objects"](spark, str(tmp_path)), con, entry.oracle_sql()["k3_embed_objects"])
    assert ok, message


def test_trained_models(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(b), float(abs(0.5 + a)), bool(b > 0), bool(a > 0), int(i % 3) - 1)
            for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "cand_idx int, f0 double, f1 double, mu_min double, is_collision boolean, is_empty boolean, object_id int")
    for kind in ("huber", "gbt"):
        out = K.apply_model(df, K.fit_quality(df, ["f0", "f1"], kind=kind))
        assert out.where("predicted_quality IS NOT NULL").count() == 120
    aux = K.fit_aux(df, ["f0", "f1"], maxIter=10)
    out = K.apply_model(df, aux["is_collision"])
    assert out.where("cast(is_collision as double) = is_collision_pred").count() > 110


def test_intermediates_have_an_owner(spark):
    import os

    from rankforge.session import intermediates, materialise

    with intermediates(spark):
        table = materialise(spark.range(5))
        (path,) = {f.removeprefix("file:").removeprefix("//").rsplit("/", 1)[0] for f in table.inputFiles()}
        assert table.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
    assert materialise(spark.range(3)).count() == 3
