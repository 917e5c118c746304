"""Queries for catalogs, candidate columns and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.functions import expressions as X
from rankforge.operators import labels as B
from rankforge.operators.scoring import minmax_color, rank_candidates
from rankforge.session import shared_dir
from rankforge.sources import catalog as A
from rankforge.sources.sidecars import read_sidecars, write_sidecars
from suite import mappings as M
from suite.registry import NUDGE, r6, register

PARSED = (
    M.PATHS
    + r""",
parsed AS (
  SELECT event_id, path,
    CAST(coalesce(nullif(regexp_extract(path, '(?:^|/)scene_(\d+)/', 1), ''),
                  nullif(regexp_extract(path, '(?:^|/)(\d+)/(?:(?:realsense|kinect)/)?[^/]*$', 1), '')) AS INTEGER) AS scene_id,
    CAST(nullif(regexp_extract(path, '(?:^|/)(\d+)\.[^./]+$', 1), '') AS INTEGER) AS frame_id,
    CASE WHEN path LIKE '%/realsense/%' OR path LIKE 'realsense/%' THEN 'realsense'
         WHEN path LIKE '%/kinect/%' OR path LIKE 'kinect/%' THEN 'kinect' END AS path_camera,
    CASE WHEN path LIKE '%/train/%' OR path LIKE '%/train\_%' ESCAPE '\' THEN 'train'
         WHEN path LIKE '%/test/%' OR path LIKE '%/test\_%' ESCAPE '\' THEN 'test' END AS path_split
  FROM paths)"""
)


@register(
    "a2_parse_frame_path",
    f"WITH {PARSED} SELECT event_id, path, scene_id, frame_id, path_camera, path_split FROM parsed",
)
def a2_parse_frame_path(spark, sf):
    return A.parse_frame_path(M.paths(spark, sf))


@register(
    "a3_dedupe_layouts",
    f"""WITH {PARSED},
    k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_id
                 ORDER BY CASE WHEN path_camera IS NULL THEN 1 ELSE 0 END, path) AS rn
          FROM parsed WHERE scene_id IS NOT NULL AND frame_id IS NOT NULL AND coalesce(path_camera, 'realsense') = 'realsense')
    SELECT scene_id, frame_id, 'realsense' AS camera, path FROM k WHERE rn = 1""",
)
def a3_dedupe_layouts(spark, sf):
    return A.dedupe_layouts(M.paths(spark, sf), camera="realsense")


@register(
    "a3_merge_legacy_trees",
    f"""WITH {PARSED},
    t AS (SELECT scene_id, frame_id, min(path) AS path FROM parsed
          WHERE path_split IS NOT NULL AND scene_id IS NOT NULL AND frame_id IS NOT NULL GROUP BY ALL),
    l AS (SELECT scene_id, frame_id, min(path) AS path FROM parsed
          WHERE path_split IS NULL AND scene_id IS NOT NULL AND frame_id IS NOT NULL GROUP BY ALL)
    SELECT scene_id, frame_id, path FROM t
    UNION ALL SELECT l.* FROM l ANTI JOIN t USING (scene_id)""",
)
def a3_merge_legacy_trees(spark, sf):
    named = A.parse_frame_path(M.paths(spark, sf)).where("scene_id IS NOT NULL AND frame_id IS NOT NULL")
    tree = lambda rows: rows.groupBy("scene_id", "frame_id").agg(F.min("path").alias("path"))
    return A.merge_legacy_trees(
        tree(named.where("path_split IS NOT NULL")), tree(named.where("path_split IS NULL"))
    )


@register(
    "a5_output_names",
    f"""WITH {M.CAND}
    SELECT DISTINCT scene_id, frame_id,
           format('scene_{{:04d}}/{{}}/{{:04d}}.npy', scene_id, camera, frame_id) AS output_path,
           format('scene_{{:04d}}/{{}}/{{:06d}}.npy', scene_id, camera, frame_id) AS legacy_path
    FROM cand""",
)
def a5_output_names(spark, sf):
    frames = M.candidates(spark, sf).select(*S.FRAME_KEYS).distinct()
    return frames.select(
        "scene_id",
        "frame_id",
        A.output_name("scene_id", "camera", "frame_id").alias("output_path"),
        A.output_name("scene_id", "camera", "frame_id", 6).alias("legacy_path"),
    )


@register(
    "a8_union_roots",
    """SELECT event_id AS row_id, 0 AS root_index, 'pooled_a' AS sidecar_root, value FROM events
    UNION ALL SELECT l_orderkey, 1, 'pooled_b', l_quantity FROM lineitem""",
)
def a8_union_roots(spark, sf):
    first = M.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "value")
    second = M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_quantity").alias("value"))
    return A.union_roots([first, second], ["pooled_a", "pooled_b"])


@register(
    "a9_limit_frames",
    f"""WITH {M.CAND}, f AS (SELECT DISTINCT scene_id, frame_id FROM cand ORDER BY 1, 2 LIMIT 40)
    SELECT scene_id, frame_id, cand_idx FROM cand SEMI JOIN f USING (scene_id, frame_id)""",
)
def a9_limit_frames(spark, sf):
    return A.limit_frames(M.candidates(spark, sf), 40, ["scene_id", "frame_id"]).select("scene_id", "frame_id", "cand_idx")


@register(
    "a10_object_sidecar_join",
    f"""WITH {M.CAND}, side AS (SELECT cand_idx, base_score * 2 AS p0, model_score - 1 AS p1 FROM cand WHERE scene_id < 150)
    SELECT c.scene_id, c.frame_id, c.cand_idx, round(coalesce(p0, 0) + 2.3e-8, 6) + 0.0 AS p0, round(coalesce(p1, -1) + 2.3e-8, 6) + 0.0 AS p1
    FROM cand c LEFT JOIN side USING (cand_idx)""",
)
def a10_object_sidecar_join(spark, sf):
    """Sidecar vectors for one half of the scenes, an inline vector for the rest."""
    df = M.candidates(spark, sf)
    side = df.where("scene_id < 150").select(
        *S.FRAME_KEYS, "cand_idx", F.array(F.col("base_score") * 2, F.col("model_score") - 1).alias("pooled")
    )
    inline = df.withColumn("pooled", F.array(F.lit(0.0), F.lit(-1.0)))
    out = A.object_sidecar_join(inline, side, require=True)
    return out.select(
        "scene_id", "frame_id", "cand_idx", F.col("pooled")[0].alias("p0"), F.col("pooled")[1].alias("p1")
    ).select("scene_id", "frame_id", "cand_idx", *r6("p0", "p1"))


@register(
    "a10_sidecar_tree",
    f"""WITH {M.CAND}, placed AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_id, camera ORDER BY cand_idx) - 1 AS place FROM cand)
    SELECT scene_id, frame_id, place, cand_idx, CAST(cand_idx % 512 AS DOUBLE) / 64 AS p0, floor(model_score * 64) / 64 AS p1
    FROM placed WHERE scene_id >= 120""",
)
def a10_sidecar_tree(spark, sf):
    """Vectors that half precision holds exactly, written as a tree, read for some scenes and joined to their candidates."""
    order = Window.partitionBy(*S.FRAME_KEYS).orderBy("cand_idx")
    placed = M.candidates(spark, sf).withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    pooled = F.array((F.col("cand_idx") % 512) / 64, F.floor(F.col("model_score") * 64) / 64)
    root = f"{shared_dir(spark)}/rankforge/sidecars-{uuid.uuid4().hex}"
    write_sidecars(placed.select(*S.FRAME_KEYS, F.col("place").alias("cand_idx"), pooled.alias("pooled")), root)
    side = read_sidecars(spark, root).where("scene_id >= 120").withColumnRenamed("cand_idx", "place")
    out = A.object_sidecar_join(placed.where("scene_id >= 120"), side, require=True, keys=(*S.FRAME_KEYS, "place"))
    double = [F.col("pooled")[i].cast("double").alias(f"p{i}") for i in range(2)]
    return out.select("scene_id", "frame_id", "place", "cand_idx", *double)


@register(
    "b1_decode_candidates",
    """SELECT vec_id,
      round(CAST(embedding[1] AS DOUBLE) + 2.3e-8, 6) + 0.0 AS base_score, round(CAST(embedding[2] AS DOUBLE) + 2.3e-8, 6) + 0.0 AS width,
      round(CAST(embedding[5] AS DOUBLE) + 2.3e-8, 6) + 0.0 AS r_first, round(CAST(embedding[13] AS DOUBLE) + 2.3e-8, 6) + 0.0 AS r_last,
      round(CAST(embedding[14] AS DOUBLE) + 2.3e-8, 6) + 0.0 AS tx, round(CAST(embedding[16] AS DOUBLE) + 2.3e-8, 6) + 0.0 AS tz,
      round(CAST(embedding[6] AS DOUBLE) + 2.3e-8, 6) + 0.0 AS pose01, round(CAST(embedding[15] AS DOUBLE) + 2.3e-8, 6) + 0.0 AS pose13
    FROM embeddings""",
)
def b1_decode_candidates(spark, sf):
    df = B.decode_candidates(M.table(spark, sf, "embeddings"), "embedding")
    out = df.select(
        "vec_id",
        "base_score",
        "width",
        F.col("rotation")[0].alias("r_first"),
        F.col("rotation")[8].alias("r_last"),
        "tx",
        "tz",
        F.col("pose")[0][1].alias("pose01"),
        F.col("pose")[1][3].alias("pose13"),
    )
    return out.select("vec_id", *r6("base_score", "width", "r_first", "r_last", "tx", "tz", "pose01", "pose13"))


@register(
    "b2_pose_features",
    """SELECT vec_id, CAST(slot AS INTEGER) AS slot,
      round(CAST(embedding[[5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 2, 1][slot + 1]] AS DOUBLE) + 2.3e-8, 6) + 0.0 AS feature
    FROM embeddings, range(0, 14) t(slot)""",
)
def b2_pose_features(spark, sf):
    df = B.pose_features(B.decode_candidates(M.table(spark, sf, "embeddings"), "embedding"))
    return df.select("vec_id", F.posexplode("pose_features").alias("slot", "f")).select(
        "vec_id", "slot", F.round(F.col("f").cast("double") + NUDGE, 6).alias("feature")
    )


@register(
    "b3_clip_width",
    "SELECT event_id, round(greatest(0, least(0.1::DOUBLE, value / 100 - 0.05::DOUBLE)) + 2.3e-8, 6) + 0.0 AS width FROM events",
)
def b3_clip_width(spark, sf):
    raw = F.col("value") / 100 - 0.05
    return M.table(spark, sf, "events").select("event_id", X.clip_width(raw).alias("width")).select("event_id", *r6("width"))


@register(
    "b4_filter_camera",
    f"""WITH {PARSED}
    SELECT event_id, path FROM parsed
    WHERE coalesce(path_camera, CASE WHEN event_id % 3 = 0 THEN 'kinect' END, 'realsense') = 'realsense'""",
)
def b4_filter_camera(spark, sf):
    df = A.parse_frame_path(M.paths(spark, sf)).withColumn(
        "meta_camera", F.when(F.col("event_id") % 3 == 0, F.lit("kinect"))
    )
    return B.filter_camera(df, "realsense").select("event_id", "path")


@register(
    "b5_filter_scenes",
    f"""WITH {M.CAND} SELECT scene_id, frame_id, cand_idx FROM cand
    WHERE scene_id IN (SELECT 100 + n_nationkey FROM nation)""",
)
def b5_filter_scenes(spark, sf):
    scenes = M.table(spark, sf, "nation").select((F.lit(100) + F.col("n_nationkey")).alias("scene_id"))
    return B.filter_scenes(M.candidates(spark, sf), scenes).select("scene_id", "frame_id", "cand_idx")


@register(
    "b6_success_label",
    f"WITH {M.CAND} SELECT cand_idx, isfinite(mu_min) AND mu_min <= 0.4::DOUBLE AS success FROM cand",
)
def b6_success_label(spark, sf):
    return M.candidates(spark, sf).select("cand_idx", X.success_label().alias("success"))


@register(
    "b7_quality_target",
    f"""WITH {M.CAND} SELECT cand_idx,
           round(0.4::DOUBLE - CASE WHEN isfinite(mu_min) THEN mu_min ELSE 2 END + 2.3e-8, 6) + 0.0 AS quality FROM cand""",
)
def b7_quality_target(spark, sf):
    return M.candidates(spark, sf).select("cand_idx", X.quality_target().alias("quality")).select("cand_idx", *r6("quality"))


@register(
    "b8_coerce_labels",
    f"""WITH {M.CAND}
    SELECT cand_idx, is_empty, FALSE AS is_collision, -1 AS object_id, CAST('Infinity' AS DOUBLE) = mu_min AS no_mu
    FROM (SELECT cand_idx, coalesce(is_empty, FALSE) AS is_empty,
                 CASE WHEN raw_collision THEN CAST('Infinity' AS DOUBLE) ELSE mu_min END AS mu_min FROM cand)""",
)
def b8_coerce_labels(spark, sf):
    """Collision and object columns absent, friction missing where raw_collision."""
    df = M.candidates(spark, sf).drop("object_id").withColumn(
        "mu_min", F.when(~F.col("raw_collision"), F.col("mu_min"))
    )
    out = B.coerce_labels(df)
    return out.select(
        "cand_idx", "is_empty", "is_collision", "object_id", (F.col("mu_min") == float("inf")).alias("no_mu")
    )


@register(
    "b9_upgrade_schema",
    f"""WITH {M.CAND}
    SELECT cand_idx, base_score, is_empty, CASE WHEN is_empty THEN -1 ELSE object_id END AS object_id, TRUE AS schema_upgrade
    FROM cand""",
)
def b9_upgrade_schema(spark, sf):
    df = M.candidates(spark, sf)
    legacy = df.drop("object_id").withColumn("local_features", F.array("base_score"))
    objects = df.where(~F.col("is_empty")).select(*S.FRAME_KEYS, "cand_idx", "object_id")
    out = B.upgrade_schema(legacy, objects)
    assert "local_features" not in out.columns
    return out.select("cand_idx", "base_score", "is_empty", "object_id", "schema_upgrade")


RAW = f"""{M.CAND},
raw AS (SELECT *, is_empty AS raw_empty, CASE WHEN isfinite(mu_min) THEN mu_min ELSE -1 END AS friction_score,
               base_score / 100 AS distance, scene_id % 30 <> 7 AS has_models FROM cand)"""


@register(
    "b10_assemble_labels",
    f"""WITH {RAW},
    l AS (SELECT *, distance < 0.3::DOUBLE AND has_models AS live FROM raw)
    SELECT cand_idx, live AND raw_collision AND NOT raw_empty AS is_collision, NOT live OR raw_empty AS is_empty,
           coalesce(CASE WHEN live AND NOT raw_collision AND friction_score > 0 THEN friction_score END, 99) AS mu,
           CASE WHEN live THEN object_id ELSE -1 END AS object_id
    FROM l""",
)
def b10_assemble_labels(spark, sf):
    df = M.candidates(spark, sf).withColumns(
        {
            "raw_empty": F.col("is_empty"),
            "friction_score": F.when(X.is_finite("mu_min"), F.col("mu_min")).otherwise(-1.0),
            "distance": F.col("base_score") / 100,
        }
    )
    out = B.assemble_labels(df, max_distance=0.3, has_models=F.col("scene_id") % 30 != 7)
    mu = F.when(X.is_finite("mu_min"), F.col("mu_min")).otherwise(99.0)
    return out.select("cand_idx", "is_collision", "is_empty", mu.alias("mu"), "object_id")


@register(
    "b11_min_friction",
    f"""WITH {M.TESTS},
    w AS (SELECT *, min(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY cand_idx ORDER BY friction DESC) AS run FROM tests)
    SELECT scene_id, frame_id, cand_idx, coalesce(min(CASE WHEN run = 1 THEN friction END), -1) AS score
    FROM w GROUP BY scene_id, frame_id, cand_idx""",
)
def b11_min_friction(spark, sf):
    return B.min_friction(M.friction_tests(spark, sf)).drop("camera")


@register(
    "b12_map_object_ids",
    f"""WITH {M.CAND}, bank AS (SELECT DISTINCT scene_id, frame_id, i AS local_idx, CAST((frame_id + 7 * i) % 88 AS INTEGER) AS global_id
                                FROM cand, range(0, 6) t(i)),
    c AS (SELECT *, cand_idx % 8 AS local_idx FROM cand)
    SELECT c.cand_idx, CASE WHEN c.is_empty THEN -1 ELSE coalesce(global_id, -1) END AS object_id
    FROM c LEFT JOIN bank USING (scene_id, frame_id, local_idx)""",
)
def b12_map_object_ids(spark, sf):
    df = M.candidates(spark, sf)
    bank = (
        df.select("scene_id", "frame_id")
        .distinct()
        .withColumn("local_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
        .withColumn("global_id", ((F.col("frame_id") + 7 * F.col("local_idx")) % 88).cast("int"))
    )
    rows = df.drop("object_id").withColumn("local_idx", F.col("cand_idx") % 8)
    return B.map_object_ids(rows, bank, background="is_empty").select("cand_idx", "object_id")


def block_clouds(spark, sf):
    """Runs of 64 event ids as clouds (event_id is unique, so a cloud has 64 points at most).

    Errors are zero points, as padding would be.
    """
    real = F.col("event_type") != "error"
    p = F.struct(
        F.when(real, F.col("value") / 1000).otherwise(0.0).alias("x"),
        F.when(real, F.col("value") / 500).otherwise(0.0).alias("y"),
        F.lit(0.0).alias("z"),
    )
    block = F.floor(F.col("event_id") / 64).alias("block")
    return M.table(spark, sf, "events").groupBy(block).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", p.alias("p")))), lambda e: e["p"]).alias("cloud")
    )


BLOCKS = """n AS (SELECT event_id // 64 AS block, count(*) AS c, count(*) FILTER (WHERE event_type <> 'error' AND value <> 0) AS r,
      sum(CASE WHEN event_type <> 'error' THEN value / 1000 ELSE 0 END) AS sx FROM events GROUP BY event_id // 64)"""


@register("b13_cloud_mask", f"WITH {BLOCKS} SELECT block, c AS points, r AS real_points FROM n")
def b13_cloud_mask(spark, sf):
    df = B.cloud_mask(block_clouds(spark, sf))
    return df.select(
        "block",
        F.size("cloud").cast("long").alias("points"),
        F.size(F.filter("cloud_mask", lambda m: m)).cast("long").alias("real_points"),
    )


@register(
    "b14_pad_clouds",
    f"""WITH {BLOCKS} SELECT block, (SELECT max(c) FROM n) AS width, r AS real_points, r AS stripped, round(sx + 2.3e-8, 6) + 0.0 AS sum_x FROM n""",
)
def b14_pad_clouds(spark, sf):
    padded = B.pad_clouds(B.cloud_mask(block_clouds(spark, sf)))
    back = padded.withColumns({"width": F.size("cloud"), "sum_x": F.aggregate("cloud", F.lit(0.0), lambda a, p: a + p["x"])})
    back = back.withColumn("real_points", F.size(F.filter("cloud_mask", lambda m: m)))
    out = B.strip_padding(back)
    return out.select(
        "block",
        F.col("width").cast("long").alias("width"),
        F.col("real_points").cast("long").alias("real_points"),
        F.size("cloud").cast("long").alias("stripped"),
        *r6("sum_x"),
    )


@register(
    "b15_benchmark_split",
    f"""WITH s AS (SELECT event_id, user_id % 190 AS scene_id FROM events)
    SELECT event_id, CASE WHEN scene_id < 100 THEN 'train' ELSE 'test' END AS split, {M.GROUP_CASE} AS test_group FROM s""",
)
def b15_benchmark_split(spark, sf):
    df = M.table(spark, sf, "events").select("event_id", (F.col("user_id") % 190).alias("scene_id"))
    return df.select("event_id", X.benchmark_split().alias("split"), X.test_group().alias("test_group"))


@register(
    "b16_minmax_color",
    f"""WITH {M.CAND}, c AS (SELECT *, CASE WHEN isfinite(mu_min) THEN mu_min ELSE 0 END AS v FROM cand),
    w AS (SELECT *, min(v) OVER (PARTITION BY scene_id, frame_id) AS lo, max(v) OVER (PARTITION BY scene_id, frame_id) AS hi FROM c)
    SELECT cand_idx, round(CASE WHEN hi <= lo THEN 0.5::DOUBLE ELSE (v - lo) / (hi - lo) END + 2.3e-8, 6) + 0.0 AS color FROM w""",
)
def b16_minmax_color(spark, sf):
    return minmax_color(M.candidates(spark, sf), "mu_min").select("cand_idx", *r6("color"))


@register(
    "b17_weight_tag",
    """SELECT event_id, CASE WHEN w = 1 THEN '' WHEN w = 0 THEN '_detector_baseline'
      ELSE '_lambda_' || replace(CAST(w AS VARCHAR), '.', 'p') END AS tag
    FROM (SELECT event_id, (event_id % 101)::DOUBLE / 100 AS w FROM events)""",
)
def b17_weight_tag(spark, sf):
    weight = (F.col("event_id") % 101).cast("double") / 100
    return M.table(spark, sf, "events").select("event_id", X.weight_tag(weight).alias("tag"))


@register(
    "a5_reranked_table",
    f"""WITH {M.CAND}
    SELECT CAST(scene_id AS INTEGER) AS scene_id, frame_id, cand_idx,
           row_number() OVER (PARTITION BY scene_id, frame_id ORDER BY base_score DESC, cand_idx) AS rank FROM cand""",
)
def a5_reranked_table(spark, sf):
    """Write the ranked table by scene and camera and read it back."""
    import uuid

    from rankforge.session import shared_dir
    from rankforge.sources.dumps import write_reranked

    out = f"{shared_dir(spark)}/reranked-{uuid.uuid4().hex}"
    write_reranked(rank_candidates(M.candidates(spark, sf), "base_score"), out)
    return spark.read.parquet(out).select("scene_id", "frame_id", "cand_idx", "rank")


