"""Queries for sources and sinks, streams, callbacks and model jobs."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.functions.stats import multitask_loss
from rankforge.operators import geometry as C
from rankforge.operators import labels as B
from rankforge.operators import models as K
from rankforge.operators import quality as H
from rankforge.operators import training as T
from rankforge.plans.grid import radius_join
from rankforge.plans.pipelines import fit_and_compare
from rankforge.session import materialise, shared_dir
from rankforge.sources import dumps as D
from rankforge.streaming import jobs as J
from suite import mappings as M
from suite.labelling import block_clouds
from suite.registry import long6, r6, register, s6
from suite.statistics import MANIFEST, manifest


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def full_rows(spark, sf, *more):
    """Candidates with every field of a dump row; indices restart in each frame."""
    df = M.candidates(spark, sf, *more)
    width = (F.col("cand_idx") % 100) / 1000
    return df.withColumns(
        {
            "width": width,
            "height": F.lit(0.02),
            "depth": F.lit(0.03),
            "rotation": F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]),
            "tx": F.col("base_score") / 1000,
            "ty": F.col("model_score"),
            "tz": F.lit(0.5),
            "is_collision": F.col("raw_collision"),
        }
    )


ROWS = f"""{M.CAND}, rows AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_id ORDER BY cand_idx) - 1 AS pos FROM cand)"""
DUMPED = f"""WITH {ROWS} SELECT CAST(scene_id AS INTEGER) AS scene_id, CAST(frame_id AS INTEGER) AS frame_id, camera, pos AS cand_idx,
  round(base_score::FLOAT::DOUBLE + 2.3e-8, 6) + 0.0 AS base_score, round(model_score::FLOAT::DOUBLE + 2.3e-8, 6) + 0.0 AS ty, object_id FROM rows"""


def dump_columns(df):
    out = df.select(
        "scene_id", "frame_id", "camera", "cand_idx", *[F.col(c).cast("double").alias(c) for c in ("base_score", "ty")], "object_id"
    )
    return out.select("scene_id", "frame_id", "camera", "cand_idx", *long6("base_score", "ty"), "object_id")


def dump_tree(spark, sf, root: str) -> None:
    """The candidates as array dumps among files that a reader must leave alone:
    the same frames in the flat layout, another camera, and a path without a frame."""
    rows = full_rows(spark, sf)
    D.write_dumps(rows, root).agg(F.sum("num")).collect()
    other = rows.where("frame_id % 7 = 0").withColumn("base_score", F.col("base_score") + 1000)
    for camera in (".", "kinect"):
        D.write_dumps(other.withColumn("camera", F.lit(camera)), root).agg(F.sum("num")).collect()
    with D.open_output(f"{root}/notes/readme_0001.npy") as stream:
        stream.write(b"not an array")


@register("a1_read_candidate_dumps", DUMPED)
def a1_read_candidate_dumps(spark, sf):
    """Write the candidates among other files as array dumps, read back those of one camera."""
    root = fresh(spark, "dumps")
    dump_tree(spark, sf, root)
    return dump_columns(D.read_candidate_dumps(spark, root, "realsense"))


@register(
    "a4_read_archives",
    f"""WITH {ROWS} SELECT CAST(scene_id AS INTEGER) AS scene_id, CAST(frame_id AS INTEGER) AS frame_id, pos AS cand_idx,
      isfinite(mu_min) AS finite_mu, CAST(round(CASE WHEN isfinite(mu_min) THEN mu_min * 10 ELSE -1 END) AS INTEGER) AS mu10,
      raw_collision AS is_collision, is_empty, object_id FROM rows""",
)
def a4_read_archives(spark, sf):
    root = fresh(spark, "archives")
    D.write_archives(full_rows(spark, sf), root).agg(F.sum("num")).collect()
    df = D.read_archives(spark, root)
    finite = F.abs("mu_min") != float("inf")
    return df.select(
        "scene_id",
        "frame_id",
        "cand_idx",
        finite.alias("finite_mu"),
        F.when(finite, F.round(F.col("mu_min") * 10)).otherwise(-1).cast("int").alias("mu10"),
        "is_collision",
        "is_empty",
        "object_id",
    )


@register(
    "a4_archives_with_clouds",
    f"""WITH {ROWS}, c AS (SELECT *, [(cand_idx % 8 + j) / 8::DOUBLE for j in range(0, cand_idx % 4)] AS near,
      [(frame_id % 16 + j) / 16::DOUBLE for j in range(0, 1 + frame_id % 3)] AS whole FROM rows)
    SELECT CAST(scene_id AS INTEGER) AS scene_id, CAST(frame_id AS INTEGER) AS frame_id, camera, pos AS cand_idx,
      round(base_score::FLOAT::DOUBLE + 2.3e-8, 6) + 0.0 AS base_score, cand_idx % 4 AS points, coalesce(list_sum(near), 0) AS sum_x,
      CASE WHEN cand_idx % 4 > 0 THEN near[-1] / 2 END AS last_y, 1 + frame_id % 3 AS object_points, list_sum(whole) AS object_x,
      'sensor ' || frame_id % 5 AS sensor FROM c""",
)
def a4_archives_with_clouds(spark, sf):
    """All ten members written and read: padded clouds with their mask, whole clouds, own scores, metadata."""
    root = fresh(spark, "archives")

    def cloud(size, x):
        point = lambda j: F.struct(x(j).alias("x"), (x(j) / 2).alias("y"), F.lit(0.0).alias("z"))
        return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda j: point(j - 1))).otherwise(F.slice(F.array(point(F.lit(0))), 1, 0))

    rows = full_rows(spark, sf).withColumns(
        {
            "cloud": cloud((F.col("cand_idx") % 4).cast("int"), lambda j: (F.col("cand_idx") % 8 + j) / 8),
            "object_cloud": cloud((1 + F.col("frame_id") % 3).cast("int"), lambda j: (F.col("frame_id") % 16 + j) / 16),
            "meta_json": F.to_json(F.struct("camera", "scene_id", "frame_id", F.concat(F.lit("sensor "), F.col("frame_id") % 5).alias("sensor"))),
            "matrix": F.col("base_score") + 1000,
        }
    )
    D.write_archives(rows, root, matrix_score="matrix").agg(F.sum("num")).collect()
    df = D.read_archives(spark, root, "realsense")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, p: a + p["x"])
    return df.select(
        "scene_id", "frame_id", "camera", "cand_idx", F.col("base_score").cast("double").alias("base_score"),
        F.size("cloud").cast("long").alias("points"), total("cloud").alias("sum_x"),
        F.try_element_at("cloud", F.lit(-1))["y"].cast("double").alias("last_y"),
        F.size("object_cloud").cast("long").alias("object_points"), total("object_cloud").alias("object_x"),
        F.get_json_object("meta_json", "$.sensor").alias("sensor"),
    ).withColumn("base_score", r6("base_score")[0])


@register(
    "a6_a7_manifest_records",
    f"""WITH {MANIFEST} SELECT 1 AS schema_version, format('scene_{{:04d}}', scene_id) AS scene_name, CAST(frame_id AS INTEGER) AS frame_id, camera, num,
      success_count, collision_count, empty_count, mu_finite_count, round(mu_finite_sum, 4) + 0.0 AS mu_finite_sum FROM man""",
)
def a6_a7_manifest_records(spark, sf):
    """Write the manifest as JSON records and read it under its schema version."""
    out = fresh(spark, "manifest")
    rows = manifest(spark, sf).withColumns(
        {
            "schema_version": F.lit(S.MANIFEST_VERSION),
            "scene_name": F.format_string("scene_%04d", "scene_id"),
            "success_mu_thresh": F.lit(S.SUCCESS_TAU),
        }
    )
    D.write_manifest(rows.drop("scene_id"), out)
    back = D.read_manifest(spark, out)
    return back.select(
        "schema_version", "scene_name", "frame_id", "camera", *H.MANIFEST_SUMS, F.round("mu_finite_sum", 4).alias("mu_finite_sum")
    )


RANKED = f"""WITH {M.ZED}, f AS (SELECT *, {M.fused_sql(0.5)} FROM zed)
    SELECT scene_id, frame_id, cand_idx, {s6('fused')},
           row_number() OVER (PARTITION BY scene_id, frame_id, camera ORDER BY f.fused DESC, cand_idx) AS rank FROM f"""


@register("j1_stream_rerank", RANKED)
def j1_stream_rerank(spark, sf):
    """Frames arrive as a stream of files; the sink must equal the batch ranking."""
    source, sink = fresh(spark, "frames"), fresh(spark, "ranked")
    entry = F.struct("cand_idx", "base_score", "model_score")
    frames = M.candidates(spark, sf).groupBy(*S.FRAME_KEYS).agg(F.sort_array(F.collect_list(entry)).alias("candidates"))
    frames.write.parquet(source)
    stream = spark.readStream.schema(frames.schema).parquet(source)
    query = (
        J.stream_rerank(stream, 0.5)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", fresh(spark, "check"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(sink).select("scene_id", "frame_id", "cand_idx", *r6("fused"), "rank")


@register("j1_rerank_batches", RANKED)
def j1_rerank_batches(spark, sf):
    """Candidate rows arrive as a stream and are ranked per micro-batch, frames of any size."""
    source, out = fresh(spark, "rows"), fresh(spark, "ranked")
    rows = M.candidates(spark, sf)
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    J.rerank_batches(stream, 0.5, out, fresh(spark, "check")).awaitTermination()
    return spark.read.parquet(f"{out}/batch=*").select("scene_id", "frame_id", "cand_idx", *r6("fused"), "rank")


@register("j1_rerank_held_frames", RANKED)
def j1_rerank_held_frames(spark, sf):
    """Every frame arrives in pieces over three triggers and is ranked when its last row is there."""
    source, out = fresh(spark, "pieces"), fresh(spark, "ranked")
    rows = M.candidates(spark, sf)
    sizes = rows.groupBy(*S.FRAME_KEYS).agg(F.count(F.lit(1)).alias("num_recorded"))
    rows = materialise(rows.join(sizes, S.FRAME_KEYS))
    check = fresh(spark, "check")
    for piece in range(3):
        rows.where(F.col("cand_idx") % 3 == piece).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        J.rerank_batches(stream, 0.5, out, check, expected="num_recorded").awaitTermination()
    return spark.read.parquet(f"{out}/batch=*").select("scene_id", "frame_id", "cand_idx", *r6("fused"), "rank")


@register("j2_compact_ingested", DUMPED)
def j2_compact_ingested(spark, sf):
    """Dumps ingested in three runs, flat layouts first, merged after two of them."""
    root, out, check = fresh(spark, "dumps"), fresh(spark, "ingested"), fresh(spark, "check")
    rows = full_rows(spark, sf)
    flat = rows.withColumns({"camera": F.lit("."), "base_score": F.col("base_score") + 1000})
    for part in (flat.where("frame_id % 2 = 0"), rows.where("frame_id % 3 > 0"), rows.where("frame_id % 3 = 0")):
        D.write_dumps(part, root).agg(F.sum("num")).collect()
        J.stream_ingest(spark, root, out, check, "realsense").awaitTermination()
        if part is not flat:
            J.compact_ingested(spark, out)
    return dump_columns(J.latest_ingested(spark, out))


@register("j2_stream_ingest", DUMPED)
def j2_stream_ingest(spark, sf):
    """Dumps ingested by a stream in two runs; the second finds nothing new."""
    root, out, check = fresh(spark, "dumps"), fresh(spark, "ingested"), fresh(spark, "check")
    dump_tree(spark, sf, root)
    for _ in range(2):
        J.stream_ingest(spark, root, out, check, "realsense").awaitTermination()
    return dump_columns(J.latest_ingested(spark, out))


@register(
    "j3_stream_manifest",
    f"""WITH {M.CAND}, t AS (SELECT c.*, date_trunc('day', e.ts) AS day FROM cand c JOIN events e ON e.event_id = c.cand_idx)
    SELECT CAST(day AS DATE) AS day, scene_id, count(*) AS num, count(*) FILTER (WHERE isfinite(mu_min) AND mu_min <= 0.4::DOUBLE) AS success_count,
           count(*) FILTER (WHERE raw_collision) AS collision_count, count(*) FILTER (WHERE is_empty) AS empty_count
    FROM t GROUP BY ALL""",
)
def j3_stream_manifest(spark, sf):
    """Label counts per day and scene, kept by a stream over the events."""
    source, out, check = fresh(spark, "timed"), fresh(spark, "manifest"), fresh(spark, "check")
    times = M.table(spark, sf, "events").select(F.col("event_id").alias("cand_idx"), "ts")
    rows = M.candidates(spark, sf).withColumn("is_collision", F.col("raw_collision")).join(times, "cand_idx")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    J.write_updates(J.stream_manifest(stream, "ts", "1 day"), out, check).awaitTermination()
    last = J.latest_updates(spark, out, ["window", "scene_id"])
    return last.select(F.to_date("window.start").alias("day"), "scene_id", "num", "success_count", "collision_count", "empty_count")


@register(
    "k1_label_with",
    f"""WITH {M.CAND} SELECT scene_id, frame_id, cand_idx, base_score = max(base_score) OVER f AS is_best,
      round(max(base_score) OVER f - base_score + 2.3e-8, 6) + 0.0 AS gap FROM cand WINDOW f AS (PARTITION BY scene_id, frame_id)""",
)
def k1_label_with(spark, sf):
    def label(pdf, meta):
        top = pdf["base_score"].max()
        return {"is_best": pdf["base_score"] == top, "gap": top - pdf["base_score"]}

    df = M.candidates(spark, sf).select(*S.FRAME_KEYS, "cand_idx", "base_score")
    out = K.label_with(df, label, "is_best boolean, gap double")
    return out.select("scene_id", "frame_id", "cand_idx", "is_best", *r6("gap"))


def linear_scorer():
    weights = np.array([0.02, -1.5], dtype=np.float64)

    def predict(x):
        return x @ weights

    return predict


@register(
    "k2_score_with",
    f"""WITH {M.CAND} SELECT cand_idx, round(0.02::DOUBLE * base_score - 1.5::DOUBLE * model_score + 2.3e-8, 6) + 0.0 AS score FROM cand""",
)
def k2_score_with(spark, sf):
    df = M.candidates(spark, sf).withColumn("features", F.array("base_score", "model_score"))
    out = K.score_with(df, linear_scorer, "features", out="score", width=2, required="features")
    return out.select("cand_idx", *r6("score"))


def point_encoder():
    def encode(clouds):
        return [np.stack([c[:, 0], c[:, 1], c[:, 0] + c[:, 2]], axis=1) for c in clouds]

    return encode


@register(
    "k3_embed_objects",
    """WITH p AS (SELECT event_id // 64 AS block, CASE WHEN event_type <> 'error' THEN value / 1000 ELSE 0 END AS x,
                         CASE WHEN event_type <> 'error' THEN value / 500 ELSE 0 END AS y, event_type <> 'error' AND value <> 0 AS live FROM events),
    g AS (SELECT block, avg(x) FILTER (WHERE live) AS m0, avg(y) FILTER (WHERE live) AS m1, max(x) FILTER (WHERE live) AS x0,
                 max(y) FILTER (WHERE live) AS x1 FROM p GROUP BY block)
    SELECT block, CAST(slot AS INTEGER) AS slot, CAST(round(coalesce([m0, m1, m0, x0, x1, x0][slot + 1], 0) * 1000 + 0.0123) AS INTEGER) AS milli
    FROM g, range(0, 6) t(slot)""",
)
def k3_embed_objects(spark, sf):
    """Real points of the event blocks, pooled per block."""
    clouds = B.strip_padding(B.cloud_mask(block_clouds(spark, sf), "cloud")).withColumnRenamed("cloud", "object_cloud")
    out = K.embed_objects(clouds, point_encoder, 3, keys=["block"], precision="double")
    return out.select("block", F.posexplode("pooled").alias("slot", "p")).select(
        "block", "slot", F.round(F.col("p").cast("double") * 1000 + 0.0123).cast("int").alias("milli")
    )


@register(
    "k4_fit_quality",
    f"""WITH {M.CAND} SELECT cand_idx, round(0.4::DOUBLE - least(mu_min, 2.0::DOUBLE) + 2.3e-8, 3) + 0.0 AS quality FROM cand""",
)
def k4_fit_quality(spark, sf):
    """A robust linear fit among whose features the target is linear must return the target."""
    df = M.candidates(spark, sf).withColumn("reach", F.least("mu_min", F.lit(2.0)) + F.col("model_score"))
    model = K.fit_quality(df, ["base_score", "model_score", "reach"], maxIter=200, tol=1e-12)
    return K.apply_model(df, model).select("cand_idx", F.round(F.col("predicted_quality") + 2.3e-8, 3).alias("quality"))


@register(
    "k5_fit_aux",
    f"""WITH {M.CAND} SELECT cand_idx, raw_collision::INTEGER AS is_collision_pred, is_empty::INTEGER AS is_empty_pred,
      CASE WHEN cand_idx % 4 > 0 THEN (cand_idx % 4 - 1)::INTEGER END AS object_id_pred FROM cand""",
)
def k5_fit_aux(spark, sf):
    """Classes that a feature tells apart must be predicted as they are; unlabelled objects are left out."""
    df = M.candidates(spark, sf).withColumns({"is_collision": F.col("raw_collision"), "object_id": (F.col("cand_idx") % 4 - 1).cast("int")})
    flags = {"hit": F.col("is_collision"), "void": F.col("is_empty")} | {f"kind{i}": F.col("object_id") == i for i in range(3)}
    df = df.withColumns({n: c.cast("double") for n, c in flags.items()})
    out = df
    for model in K.fit_aux(df, [*flags, "model_score"], maxIter=30).values():
        out = K.apply_model(out, model)
    return out.select(
        "cand_idx",
        *[F.col(c).cast("int").alias(c) for c in ("is_collision_pred", "is_empty_pred")],
        F.when(F.col("object_id") >= 0, F.col("object_id_pred")).cast("int").alias("object_id_pred"),
    )


def described(spark, sf):
    """Candidates with pose, pooled neighbourhood and pooled object as one vector.

    The events of a block form the cloud that its candidates stand in. No feature
    comes from friction, collision, emptiness or object class.
    """
    hour = (F.hour("ts") / 1000).alias("hour")
    rows = full_rows(spark, sf, hour).withColumns(
        {"block": F.floor(F.col("cand_idx") / 64), "tx": F.col("base_score") / 1000, "ty": F.col("base_score") / 500, "tz": F.col("hour")}
    ).drop("hour")
    rows = B.pose_features(rows.drop("model_score"))
    clouds = B.strip_padding(B.cloud_mask(block_clouds(spark, sf), "cloud"))
    points = clouds.select("block", F.posexplode("cloud").alias("point_idx", "p")).select("block", "point_idx", "p.*")
    near = radius_join(rows.select("block", "cand_idx", "tx", "ty", "tz"), points, 0.04, ["block"], spread=["block", "cand_idx"])
    local = C.shell_pool(near.withColumns({"radius": F.sqrt("d2"), "ahead": F.col("x") - F.col("tx")}), ["ahead"], ["block", "cand_idx"], rows)
    pooled = K.embed_objects(clouds.withColumnRenamed("cloud", "object_cloud"), point_encoder, 3, keys=["block"])
    joined = rows.join(local, ["block", "cand_idx"]).join(pooled, "block")
    shells = [f"ahead_shell{s}" for s in range(4)] + [f"alive{s}" for s in range(4)] + ["ahead_max", "ahead_mean"]
    return joined.withColumn("features", T.feature_vector(F.col("pose_features"), *shells, F.col("pooled")))


TRAIN = "frame_id % 4 < 2"


@register("k45_joint_fit_rerank")
def k45_joint_fit_rerank(spark, sf):
    """Fit on half of the frames, score the others, re-rank them and report AP (tested by a dense solver)."""
    return fit_and_compare(materialise(described(spark, sf)), F.expr(TRAIN), 0.5)[1]


@register("k45_joint_losses")
def k45_joint_losses(spark, sf):
    """All losses of the joint fit, on its own frames and on the others."""
    rows = materialise(described(spark, sf))
    scored = T.score_joint(rows, T.fit_joint(rows.where(TRAIN)))
    scored = scored.withColumns({"target": K.quality_target("mu_min"), "part": F.when(F.expr(TRAIN), "fitted").otherwise("held out")})
    return multitask_loss(scored, pred="predicted_quality", by=["part"])


@register(
    "k6_feature_reliance",
    f"""WITH {M.CAND}, r AS (SELECT frame_id, cand_idx, base_score AS b, model_score AS m, row_number() OVER (PARTITION BY frame_id ORDER BY cand_idx) AS a,
        row_number() OVER (PARTITION BY frame_id ORDER BY md5('3:' || cand_idx), cand_idx) AS x FROM cand),
    s AS (SELECT p.b, 0.1::DOUBLE * p.b - p.m AS n, 0.1::DOUBLE * d.b - p.m AS t FROM r p JOIN r d ON d.frame_id = p.frame_id AND d.x = p.a)
    SELECT round(stddev_pop(b) + 2.3e-8, 6) AS raw_centered_rms, round(stddev_pop(n) + 2.3e-8, 6) AS score_std,
           round(sqrt(avg((n - t) * (n - t))) + 2.3e-8, 6) AS shuffle_delta_rms,
           round(sqrt(avg((n - t) * (n - t))) / stddev_pop(n) + 2.3e-8, 6) AS shuffle_ratio, count(*) AS num_samples FROM s""",
)
def k6_feature_reliance(spark, sf):
    """Reliance of a linear score on the detector score, frames as batches."""
    out = K.feature_reliance(
        M.candidates(spark, sf),
        lambda c: F.lit(0.1) * c["base_score"] - c["model_score"],
        ["base_score", "model_score"],
        ["base_score"],
        seed=3,
        batch="frame_id",
    )
    return out.select(*r6("raw_centered_rms", "score_std", "shuffle_delta_rms", "shuffle_ratio"), "num_samples")


HISTORY = """h AS (SELECT o_orderpriority AS run, row_number() OVER (PARTITION BY o_orderpriority ORDER BY date_trunc('month', o_orderdate)) - 1 AS epoch,
    round(avg(o_totalprice), 2) AS metric FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate))"""


def history(spark, sf):
    monthly = (
        M.table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("run"), F.date_trunc("month", "o_orderdate").alias("month"))
        .agg(F.round(F.avg("o_totalprice"), 2).alias("metric"))
    )
    ranked = K.rank_within(monthly, ["run"], [F.asc("month")], "_n")
    return ranked.select("run", (F.col("_n") - 1).alias("epoch"), (F.col("_n") * 100).alias("steps"), "metric")


STEPS = f"{HISTORY}, a AS (SELECT *, (epoch + 1) * 100 AS steps, (epoch + 1) * 100 >= 300 AS eligible FROM h)"
CHOSEN = """d AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best_epoch,
                 min(CASE WHEN improved THEN metric END) OVER (PARTITION BY run ORDER BY epoch) AS best_metric,
                 epoch + 1 - coalesce(max(CASE WHEN improved OR NOT eligible THEN epoch + 1 END) OVER (PARTITION BY run ORDER BY epoch), 0) AS waited FROM c),
    e AS (SELECT *, NOT improved AND epoch + 1 >= 5 AND best_epoch IS NOT NULL AND waited >= 20 AS stop FROM d)
    SELECT run, epoch, steps, metric, eligible, improved, best_epoch, best_metric, waited, stop FROM e
    WHERE epoch <= coalesce((SELECT min(epoch) FROM e x WHERE x.run = e.run AND x.stop), 1000000)"""


@register(
    "k7_select_checkpoint",
    f"""WITH {STEPS},
    b AS (SELECT *, min(CASE WHEN eligible THEN metric END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM a),
    c AS (SELECT *, eligible AND (best IS NULL OR metric < best) AS improved FROM b),
    {CHOSEN}""",
)
def k7_select_checkpoint(spark, sf):
    """Order priorities as runs, months as epochs, mean price as the metric."""
    return K.select_checkpoint(history(spark, sf), min_steps=300, patience=20, min_epochs=5)


@register(
    "k7_select_checkpoint_margin",
    f"""WITH RECURSIVE {STEPS},
    chain AS (
      SELECT run, min(epoch) AS epoch, arg_min(metric, epoch) AS metric FROM a WHERE eligible GROUP BY run
      UNION ALL
      SELECT k.run, min(a.epoch), arg_min(a.metric, a.epoch) FROM chain k
      JOIN a ON a.run = k.run AND a.eligible AND a.epoch > k.epoch AND a.metric < k.metric - 250 GROUP BY k.run, k.epoch),
    c AS (SELECT a.*, chain.epoch IS NOT NULL AS improved FROM a LEFT JOIN chain ON chain.run = a.run AND chain.epoch = a.epoch),
    {CHOSEN}""",
)
def k7_select_checkpoint_margin(spark, sf):
    """The same with a margin: an epoch counts when it is better by more than 250."""
    return K.select_checkpoint(history(spark, sf), min_delta=250.0, min_steps=300, patience=20, min_epochs=5)
