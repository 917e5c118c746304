"""The plans for large groups must give the results of the plans for small ones.

Limits are set so low that every group counts as large; one frame holds a third
of all rows.
"""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.functions.stats import latency_summary, numeric_stats
from rankforge.operators import clusters as K
from rankforge.operators import geometry as C
from rankforge.operators import quality as H
from rankforge.operators import sampling as N
from rankforge.operators import scoring as E
from rankforge.operators import splits as I
from rankforge.operators.evaluation import ap_by_split, bootstrap_ci, frame_ap
from rankforge.operators.models import label_with, select_checkpoint
from rankforge.plans.groups import exact_quantiles, scan_within
from rankforge.plans.pipelines import compare_orders
from tests.conftest import as_set

KEYS = ["scene_id", "frame_id", "camera"]


@pytest.fixture(scope="module")
def skewed(spark):
    """300 candidates, 100 of them in one frame, many ties."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        frame = 0 if i % 3 == 0 else int(rng.integers(1, 12))
        mu = [0.2, 0.4, 0.8, float("inf")][int(rng.integers(4))]
        x, y, z = (float(v) for v in rng.uniform(0, 0.12, 3))
        a = float(rng.uniform(0, 3))
        rows.append(
            (100 + frame * 7, frame, "kinect", i, float(rng.integers(0, 20)) / 4, float(rng.integers(0, 9)) / 3, mu, x, y, z, a)
        )
    df = spark.createDataFrame(
        rows,
        "scene_id int, frame_id int, camera string, cand_idx long, base_score double, model_score double, "
        "mu_min double, tx double, ty double, tz double, a double",
    )
    turn = {"r0": F.cos("a"), "r1": -F.sin("a"), "r3": F.sin("a"), "r4": F.cos("a"), "r8": F.lit(1.0)}
    zero = {f"r{i}": F.lit(0.0) for i in (2, 5, 6, 7)}
    return df.withColumns({**turn, **zero}).withColumns(
        {"is_collision": F.col("cand_idx") % 5 == 0, "is_empty": F.col("cand_idx") % 7 == 0}
    ).cache()


def rounded(df, *cols):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not cols or c in cols])


def test_scan_within(skewed):
    order = [F.desc("base_score"), F.asc("cand_idx")]
    specs = {
        "r": ("rank", F.lit(1)),
        "s": ("sum", F.col("cand_idx")),
        "lo": ("min", F.col("model_score")),
        "hi": ("max", F.when(F.col("model_score") > 1, F.col("model_score"))),
    }
    for keys in (KEYS, []):
        small = scan_within(skewed, keys, order, specs, limit=10**6)
        large = scan_within(skewed, keys, order, specs, limit=7)
        assert as_set(small.na.fill(-1), "cand_idx", *specs) == as_set(large.na.fill(-1), "cand_idx", *specs)


def test_exact_quantiles(skewed):
    q = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    for keys in (KEYS, []):
        small = exact_quantiles(skewed, keys, F.col("base_score"), q)
        large = exact_quantiles(skewed, keys, F.col("base_score"), q, limit=5)
        assert as_set(rounded(small)) == as_set(rounded(large))


def test_rerank_and_export(skewed):
    small = E.rerank(skewed, 0.6, export=True)
    large = E.rerank(skewed, 0.6, export=True, limit=9)
    cols = ["frame_id", "cand_idx", "rank", "export_score"]
    a, b = as_set(small, *cols), as_set(large, *cols)
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert np.allclose([r[3] for r in a], [r[3] for r in b], atol=1e-6)


def test_sweep_and_comparison(skewed):
    small = rounded(E.lambda_sweep(skewed, [0.0, 0.3, 1.0]))
    large = rounded(E.lambda_sweep(skewed, [0.0, 0.3, 1.0], limit=9))
    cols = ["frame_id", "lam", "friction", "ap"]
    assert as_set(small, *cols) == as_set(large, *cols)
    assert as_set(compare_orders(skewed, 0.3)) == as_set(compare_orders(skewed, 0.3, limit=9))


def test_statistics(skewed):
    for by in (["frame_id"], []):
        small = numeric_stats(skewed, ["base_score", "mu_min"], by)
        large = numeric_stats(skewed, ["base_score", "mu_min"], by, limit=5)
        assert as_set(rounded(small).na.fill(-9)) == as_set(rounded(large).na.fill(-9))
    lat = [rounded(latency_summary(skewed, "base_score", "cand_idx", by=["frame_id"], limit=n)) for n in (5, 10**6)]
    assert as_set(lat[0]) == as_set(lat[1])
    rec = [rounded(H.rerank_records(E.rerank(skewed, 0.5), columns=["fused", "base_score"], limit=n)) for n in (5, 10**6)]
    assert as_set(rec[0]) == as_set(rec[1].select(*rec[0].columns))


def test_match_rows_and_colors(skewed):
    content = ["frame_id", "base_score"]
    pairs = [
        E.match_rows(
            skewed.withColumnRenamed("cand_idx", "s"),
            skewed.where("model_score > 1").withColumnRenamed("cand_idx", "t"),
            content,
            "s",
            "t",
            limit=n,
        )
        for n in (2, 10**6)
    ]
    assert as_set(pairs[0]) == as_set(pairs[1])
    colors = [E.minmax_color(skewed, "mu_min", limit=n).select("cand_idx", F.round("color", 9)) for n in (2, 10**6)]
    assert as_set(colors[0]) == as_set(colors[1])


def test_farthest_points(skewed):
    p = skewed.select("frame_id", F.col("cand_idx").alias("point_idx"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    for seed, budget in (("farthest", 18), ("nearest", 3)):
        small = N.farthest_point_sample(p, ["frame_id"], budget, seed)
        large = N.farthest_point_sample(p, ["frame_id"], budget, seed, limit=15)
        assert as_set(small, "frame_id", "point_idx", "slot") == as_set(large, "frame_id", "point_idx", "slot")


def test_clusters_and_suppression(skewed):
    small, large = K.leader_cluster(skewed, 0.06), K.leader_cluster(skewed, 0.06, limit=9)
    assert as_set(small) == as_set(large.select(*small.columns))
    small, large = K.pose_nms(skewed, t=0.05), K.pose_nms(skewed, t=0.05, limit=9)
    assert as_set(small, "cand_idx") == as_set(large, "cand_idx")
    assert small.count() < skewed.count()


def test_point_operators(skewed):
    p = skewed.select("frame_id", F.col("cand_idx").alias("point_idx"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    for variant in ("truncate", "round"):
        for m in (1, 10, 40, 0):
            runs = [C.stride_subset(p, m, variant=variant, limit=n) for n in (5, 10**6)]
            assert as_set(runs[0], "point_idx", "slot") == as_set(runs[1], "point_idx", "slot")
    spheres = [rounded(C.unit_sphere(p, limit=n)) for n in (5, 10**6)]
    assert as_set(spheres[0]) == as_set(spheres[1])


def test_batches_and_runs(spark, skewed):
    frames = spark.createDataFrame([(i, (i * 7) % 11 if i % 9 else 40) for i in range(400)], "frame_id int, num int")
    expected, batch, size = [], 0, 0
    for r in sorted(frames.collect()):
        if r.num <= 0:
            continue
        if size and size + r.num > 32:
            batch, size = batch + 1, 0
        expected.append((r.frame_id, r.num, batch))
        size += r.num
        if size >= 32 and r.num >= 32:
            batch, size = batch + 1, 0
    for kw in ({}, {"block": 32}, {"block": 32, "limit": 50}):
        assert as_set(I.batches_whole_frames(frames, 32, **kw)) == expected
    for op in (
        lambda n: I.pack_offsets(frames, limit=n),
        lambda n: I.batches_mixed(frames, 32, 3, 1, limit=n),
        lambda n: I.split_by_frame(frames, frame=["frame_id"], limit=n),
        lambda n: I.strided_shard(frames, 5, order=["frame_id"], limit=n),
        lambda n: I.contiguous_runs(skewed, "cand_idx", keys=["frame_id"], limit=n),
        lambda n: I.contiguous_runs(skewed, "scene_id", order="cand_idx", limit=n),
    ):
        assert as_set(op(20)) == as_set(op(10**6))


def test_checkpoints(spark):
    rng = np.random.default_rng(2)
    rows = [("r", e, (e + 1) * 10, float(round(rng.normal(), 2)), bool(e % 4)) for e in range(40)]
    h = spark.createDataFrame(rows, "run string, epoch int, steps int, metric double, gate boolean")
    for delta in (0.0, 0.3):
        best, wait, expected = float("inf"), 0, []
        for _, e, steps, m, gate in rows:
            ok = steps >= 30 and gate
            better = ok and m < best - delta
            wait = 0 if better or not ok else wait + 1
            best = m if better else best
            expected.append((e, ok, better, wait))
        runs = [select_checkpoint(h, min_delta=delta, min_steps=30, gate="gate", limit=n) for n in (10**6, 10)]
        for out in runs:
            assert as_set(out, "epoch", "eligible", "improved", "waited") == expected
    stopped = select_checkpoint(h, patience=2, min_steps=30)
    assert stopped.where("stop").count() == 1


def test_bootstrap_and_split(skewed):
    prec = frame_ap(skewed, "base_score")
    assert {r["split"] for r in ap_by_split(prec).collect()} >= {"overall", "seen"}
    delta = skewed.groupBy("scene_id").agg(F.avg("base_score").alias("delta_ap"))
    a, b = (bootstrap_ci(delta, draws=50, limit=n).collect()[0] for n in (10**6, 3))
    assert np.allclose([v for v in a], [v for v in b])


def test_callback_sees_whole_frames_unless_told_otherwise(skewed):
    df = skewed.select(*KEYS, "cand_idx", "base_score")

    def whole(pdf, meta):
        return {"size": [len(pdf)] * len(pdf)}

    sizes = {r["frame_id"]: r["count"] for r in df.groupBy(*KEYS).count().collect()}
    assert all(r["size"] == sizes[r["frame_id"]] for r in label_with(df, whole, "size long").collect())

    def rowwise(pdf, meta):
        assert len(pdf) <= 10
        return {"twice": pdf["base_score"] * 2}

    pieces = label_with(df, rowwise, "twice double", rows_per_call=10)
    expected = df.select("cand_idx", (F.col("base_score") * 2).alias("twice"))
    assert as_set(pieces, "cand_idx", "twice") == as_set(expected)
