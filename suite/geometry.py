"""Queries for geometry, sampling and clustering."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.functions.expressions import shell_id
from rankforge.operators import clusters as K
from rankforge.operators import geometry as C
from rankforge.operators import sampling as N
from rankforge.plans.grid import radius_join
from suite import mappings as M
from suite.registry import long6, r6, register, s6

CAMERA = "500.0::DOUBLE AS fx, 500.0::DOUBLE AS fy, 20.0::DOUBLE AS cx, 125.0::DOUBLE AS cy"
PT3 = f"""{M.PIX}, pt3 AS (SELECT *, (u - 20) / 500.0::DOUBLE * (depth_mm / 1000.0::DOUBLE) AS x,
      (v - 125) / 500.0::DOUBLE * (depth_mm / 1000.0::DOUBLE) AS y, depth_mm / 1000.0::DOUBLE AS z, depth_mm > 0 AS valid FROM pix)"""


def pixel_points(spark, sf):
    return C.depth_to_points(M.pixels(spark, sf), M.cameras(spark, sf))


@register("c1_depth_to_points", f"WITH {PT3} SELECT frame_id, v, u, {s6('x', 'y', 'z')}, valid FROM pt3")
def c1_depth_to_points(spark, sf):
    return pixel_points(spark, sf).select("frame_id", "v", "u", *r6("x", "y", "z"), "valid")


@register(
    "c2_workspace_filter",
    f"WITH {PT3} SELECT frame_id, v, u, {s6('z')} FROM pt3 WHERE valid AND event_type <> 'view'",
)
def c2_workspace_filter(spark, sf):
    """A mask that blanks one event type."""
    points = pixel_points(spark, sf)
    mask = points.select("frame_id", "v", "u", F.when(F.col("event_type") == "view", 0).otherwise(1).alias("mask"))
    return C.workspace_filter(points, mask).select("frame_id", "v", "u", *r6("z"))


@register(
    "c3_project_to_pixel",
    f"""WITH {M.PTS}, p AS (SELECT frame_id, point_idx, x, y, z - 0.005::DOUBLE AS z FROM pts)
    SELECT frame_id, point_idx,
      CASE WHEN z > 1e-6 THEN CAST(round_even(x * 500.0::DOUBLE / z + 20, 0) AS BIGINT) ELSE -1 END AS u,
      CASE WHEN z > 1e-6 THEN CAST(round_even(y * 500.0::DOUBLE / z + 125, 0) AS BIGINT) ELSE -1 END AS v FROM p""",
)
def c3_project_to_pixel(spark, sf):
    points = M.points(spark, sf).withColumn("z", F.col("z") - 0.005)
    cams = points.select("frame_id").distinct().select(
        "frame_id", F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.lit(20.0).alias("cx"), F.lit(125.0).alias("cy")
    )
    return C.project_to_pixel(points, cams).select("frame_id", "point_idx", "u", "v")


@register(
    "c4_mask_points",
    f"""WITH {PT3}, mp AS (SELECT DISTINCT frame_id, user_id AS mask_idx, v, u FROM pix WHERE event_type IN ('click', 'error', 'view'))
    SELECT frame_id, mask_idx, v, u, {s6('x', 'z')} FROM pt3 JOIN mp USING (frame_id, v, u) WHERE valid""",
)
def c4_mask_points(spark, sf):
    """Users as masks over the pixels of their events."""
    pix = M.pixels(spark, sf)
    masks = (
        pix.where(F.col("event_type").isin("click", "error", "view"))
        .select("frame_id", F.col("user_id").alias("mask_idx"), "v", "u")
        .distinct()
    )
    return C.mask_points(pixel_points(spark, sf), masks).select("frame_id", "mask_idx", "v", "u", *r6("x", "z"))


MASKS = """
masks AS (SELECT user_id AS prompt, event_id AS mask_idx, CAST(floor(value * 100) AS BIGINT) AS area,
                 CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM events)"""


def masks(spark, sf):
    return M.table(spark, sf, "events").select(
        F.col("user_id").alias("prompt"),
        F.col("event_id").alias("mask_idx"),
        F.floor(F.col("value") * 100).alias("area"),
        (((F.col("event_id") * 7919) % 1000).cast("double") / 1000).alias("score"),
    )


def pick_sql(order: str) -> str:
    return f"""WITH {MASKS}, ok AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY {order}) AS rn FROM masks
      WHERE score >= 0.3::DOUBLE AND area BETWEEN 200 AND CAST(floor(0.4::DOUBLE * 20000) AS BIGINT))
    SELECT p.prompt, ok.mask_idx FROM (SELECT DISTINCT prompt FROM masks) p LEFT JOIN ok ON ok.prompt = p.prompt AND rn = 1"""


@register("c5_pick_mask", pick_sql("area, mask_idx"))
def c5_pick_mask(spark, sf):
    return C.pick_mask(masks(spark, sf), ["prompt"], 20_000, floor=0.3)


@register("c5_pick_mask_best", pick_sql("score DESC, mask_idx"))
def c5_pick_mask_best(spark, sf):
    return C.pick_mask(masks(spark, sf), ["prompt"], 20_000, floor=0.3, mode="best")


PAIRS = f"""{M.PTS}, {M.QPTS},
pairs0 AS (SELECT *, (tx - x) * (tx - x) + (ty - y) * (ty - y) + (tz - z) * (tz - z) AS d2 FROM qp JOIN pts USING (frame_id)),
pairs AS (SELECT *, (x - tx) * r0 + (y - ty) * r3 + (z - tz) * r6 AS lx, (x - tx) * r1 + (y - ty) * r4 + (z - tz) * r7 AS ly,
                 (x - tx) * r2 + (y - ty) * r5 + (z - tz) * r8 AS lz FROM pairs0 WHERE d2 <= 0.04::DOUBLE * 0.04::DOUBLE)"""


def pairs(spark, sf):
    return radius_join(M.query_points(spark, sf), M.points(spark, sf), 0.04, even=True)


@register("c6_to_local_frame", f"WITH {PAIRS} SELECT frame_id, cand_idx, point_idx, {s6('lx', 'ly', 'lz')} FROM pairs")
def c6_to_local_frame(spark, sf):
    return C.to_local_frame(pairs(spark, sf)).select("frame_id", "cand_idx", "point_idx", *long6("lx", "ly", "lz"))


@register(
    "c6_transform_points",
    f"""WITH {M.PTS}, {M.QPTS},
    pose AS (SELECT frame_id, arg_min(tx, cand_idx) AS tx, arg_min(ty, cand_idx) AS ty, arg_min(tz, cand_idx) AS tz,
      {", ".join(f"arg_min(r{i}, cand_idx) AS r{i}" for i in range(9))} FROM qp GROUP BY frame_id),
    w AS (SELECT frame_id, point_idx, r0 * x + r1 * y + r2 * z + tx AS wx, r3 * x + r4 * y + r5 * z + ty AS wy, r6 * x + r7 * y + r8 * z + tz AS wz
          FROM pts JOIN pose USING (frame_id))
    SELECT frame_id, point_idx, {s6('wx', 'wy', 'wz')} FROM w""",
)
def c6_transform_points(spark, sf):
    """Every frame's points moved by the pose of its first candidate."""
    names = ["tx", "ty", "tz", *C.ROTATION]
    poses = (
        M.query_points(spark, sf)
        .groupBy("frame_id")
        .agg(F.min_by(F.struct(*names), "cand_idx").alias("_p"))
        .select("frame_id", "_p.*")
    )
    return C.transform_points(M.points(spark, sf), poses, ["frame_id"]).select("frame_id", "point_idx", *r6("wx", "wy", "wz"))


def voxel_sql(origin: str) -> str:
    start = {"zero": ("0", "0", "0"), "min": ("ox", "oy", "oz")}[origin]
    return f"""WITH {PT3}, lo AS (SELECT *, min(x) OVER f AS ox, min(y) OVER f AS oy, min(z) OVER f AS oz FROM pt3 WHERE valid WINDOW f AS (PARTITION BY frame_id)),
    g AS (SELECT frame_id, CAST(floor((x - {start[0]}) / 0.01::DOUBLE) AS BIGINT) AS vx, CAST(floor((y - {start[1]}) / 0.01::DOUBLE) AS BIGINT) AS vy,
                 CAST(floor((z - {start[2]}) / 0.01::DOUBLE) AS BIGINT) AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS points FROM lo GROUP BY 1, 2, 3, 4)
    SELECT frame_id, vx, vy, vz, {s6('x', 'y', 'z')}, points FROM g"""


@register("c7_voxel_downsample", voxel_sql("zero"))
def c7_voxel_downsample(spark, sf):
    df = C.voxel_downsample(pixel_points(spark, sf).where("valid"), 0.01)
    return df.select("frame_id", "vx", "vy", "vz", *r6("x", "y", "z"), "points")


@register("c7_voxel_from_minimum", voxel_sql("min"))
def c7_voxel_from_minimum(spark, sf):
    df = C.voxel_downsample(pixel_points(spark, sf).where("valid"), 0.01, origin="min")
    return df.select("frame_id", "vx", "vy", "vz", *r6("x", "y", "z"), "points")


@register("c8_radius_join", f"WITH {PAIRS} SELECT frame_id, cand_idx, point_idx, {s6('d2')} FROM pairs")
def c8_radius_join(spark, sf):
    return pairs(spark, sf).select("frame_id", "cand_idx", "point_idx", *long6("d2"))


NEAR = f"""{PAIRS}, nn AS (SELECT *, row_number() OVER (PARTITION BY frame_id, cand_idx ORDER BY d2, point_idx) - 1 AS nn FROM pairs0)"""


@register(
    "c9_nearest_join",
    f"""WITH {NEAR} SELECT frame_id, cand_idx, CAST(point_idx % 6 AS INTEGER) AS nearest_label, round(sqrt(d2) + 2.3e-8, 6) AS distance FROM nn WHERE nn = 0""",
)
def c9_nearest_join(spark, sf):
    points = M.points(spark, sf).withColumn("label", (F.col("point_idx") % 6).cast("int"))
    return C.nearest_join(M.query_points(spark, sf), points).select(
        "frame_id", "cand_idx", "nearest_label", *r6("distance")
    )


@register(
    "c9_nearest_within",
    f"""WITH {NEAR} SELECT frame_id, cand_idx, CASE WHEN d2 < 0.01::DOUBLE * 0.01::DOUBLE THEN CAST(point_idx % 6 AS INTEGER) ELSE -1 END AS nearest_label,
      round(CASE WHEN d2 < 0.01::DOUBLE * 0.01::DOUBLE THEN sqrt(d2) END + 2.3e-8, 6) AS distance FROM nn WHERE nn = 0""",
)
def c9_nearest_within(spark, sf):
    points = M.points(spark, sf).withColumn("label", (F.col("point_idx") % 6).cast("int"))
    return C.nearest_join(M.query_points(spark, sf), points, max_dist=0.01).select(
        "frame_id", "cand_idx", "nearest_label", *r6("distance")
    )


@register(
    "c10_knn_groups",
    f"""WITH {NEAR}, c AS (SELECT *, CAST(s AS INTEGER) AS slot FROM qp, range(0, 32) t(s))
    SELECT c.frame_id, c.cand_idx, c.slot, n.point_idx,
      round(coalesce(n.x - c.tx, 0) + 2.3e-8, 6) + 0.0 AS dx, round(coalesce(n.y - c.ty, 0) + 2.3e-8, 6) + 0.0 AS dy, round(coalesce(n.z - c.tz, 0) + 2.3e-8, 6) + 0.0 AS dz
    FROM c LEFT JOIN nn n ON n.frame_id = c.frame_id AND n.cand_idx = c.cand_idx AND n.nn = c.slot""",
)
def c10_knn_groups(spark, sf):
    df = C.knn_groups(M.query_points(spark, sf), M.points(spark, sf), 32)
    return df.select("frame_id", "cand_idx", "slot", "point_idx", *r6("dx", "dy", "dz"))


@register(
    "c11_shell_id",
    f"""WITH {M.PTS}, r AS (SELECT frame_id, point_idx, sqrt(x * x + y * y + z * z) AS r FROM pts)
    SELECT frame_id, point_idx,
      CASE WHEN r < 0.01::DOUBLE THEN 0 WHEN r < 0.02::DOUBLE THEN 1 WHEN r < 0.03::DOUBLE THEN 2 ELSE 3 END AS outer_side,
      CASE WHEN r <= 0.01::DOUBLE THEN 0 WHEN r <= 0.02::DOUBLE THEN 1 WHEN r <= 0.03::DOUBLE THEN 2 ELSE 3 END AS inner_side FROM r""",
)
def c11_shell_id(spark, sf):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return M.points(spark, sf).select(
        "frame_id", "point_idx", shell_id(r, side="right").alias("outer_side"), shell_id(r, side="left").alias("inner_side")
    )


def fps_sql(source: str, group: str, steps: int) -> str:
    """Farthest point sampling in float32 by recursion; ``source`` has group, point_idx, x, y, z, budget."""
    return f"""p AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
    s AS (
      SELECT {group}, point_idx, x, y, z, budget, CAST('Infinity' AS FLOAT) AS gap, 0 AS step,
             row_number() OVER (PARTITION BY {group} ORDER BY sqrt((x * x + y * y) + z * z)::FLOAT DESC, point_idx) = 1 AS sel FROM p WHERE n > budget
      UNION ALL
      SELECT {group}, point_idx, x, y, z, budget, gap, step + 1, row_number() OVER (PARTITION BY {group} ORDER BY gap DESC, point_idx) = 1 AS sel
      FROM (SELECT {group}, point_idx, x, y, z, budget, step,
                   least(gap, ((x - lx) * (x - lx) + (y - ly) * (y - ly)) + (z - lz) * (z - lz)) AS gap
            FROM (SELECT *, first_value(x) OVER w AS lx, first_value(y) OVER w AS ly, first_value(z) OVER w AS lz FROM s WHERE step < {steps - 1}
                  WINDOW w AS (PARTITION BY {group} ORDER BY sel DESC, point_idx)) a) b),
    picked AS (
      SELECT {group}, point_idx, step AS slot FROM s WHERE sel AND step < budget
      UNION ALL SELECT {group}, point_idx, CAST(row_number() OVER (PARTITION BY {group} ORDER BY point_idx) - 1 AS INTEGER) FROM p WHERE n <= budget)"""


SRC16 = "(SELECT frame_id, point_idx, x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z, 16 AS budget FROM pts)"


@register(
    "c12_farthest_point_sample",
    f"WITH RECURSIVE {M.PTS}, {fps_sql(SRC16, 'frame_id', 16)} SELECT frame_id, point_idx, slot FROM picked",
)
def c12_farthest_point_sample(spark, sf):
    return N.farthest_point_sample(M.points(spark, sf), ["frame_id"], 16).select("frame_id", "point_idx", "slot")


def shells_sql(source: str, group: str, budgets: tuple[int, ...]) -> str:
    """Shell, budget and first slot of float32 points."""
    b = ", ".join(map(str, budgets))
    starts = ", ".join(str(sum(budgets[:i])) for i in range(len(budgets)))
    return f"""sh0 AS (SELECT {group}, point_idx, x, y, z, sqrt((x * x + y * y) + z * z)::FLOAT::DOUBLE AS r FROM {source}),
    sh1 AS (SELECT *, CASE WHEN r < 0.01::DOUBLE THEN 0 WHEN r < 0.02::DOUBLE THEN 1 WHEN r < 0.03::DOUBLE THEN 2 WHEN r <= 0.04::DOUBLE + 1e-9 THEN 3 END AS shell FROM sh0),
    sh AS (SELECT *, [{b}][shell + 1] AS budget, [{starts}][shell + 1] AS first_slot FROM sh1 WHERE shell IS NOT NULL)"""


FEW = (2, 6, 8, 8)


@register(
    "c13_stratified_fps",
    f"""WITH RECURSIVE {M.PTS}, {shells_sql("(SELECT frame_id, point_idx, x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z FROM pts)", "frame_id", FEW)},
    {fps_sql("sh", "frame_id, shell", max(FEW))}
    SELECT frame_id, shell, slot + [0, 2, 8, 16][shell + 1] AS slot, point_idx FROM picked""",
)
def c13_stratified_fps(spark, sf):
    """Frame points around the origin, few slots per shell."""
    df = N.stratified_fps(M.points(spark, sf), ["frame_id"], budgets=FEW, xyz=("x", "y", "z"))
    return df.select("frame_id", "shell", "slot", "point_idx")


@register(
    "c14_nearest_p_sample",
    f"""WITH {PAIRS}, k AS (SELECT frame_id, cand_idx, point_idx, count(*) OVER (PARTITION BY frame_id, cand_idx) AS n,
        row_number() OVER (PARTITION BY frame_id, cand_idx ORDER BY lx * lx + ly * ly + lz * lz, point_idx) AS rd,
        row_number() OVER (PARTITION BY frame_id, cand_idx ORDER BY point_idx) AS ri FROM pairs)
    SELECT frame_id, cand_idx, point_idx, CAST(CASE WHEN n <= 12 THEN ri ELSE rd END - 1 AS INTEGER) AS slot FROM k WHERE n <= 12 OR rd <= 12""",
)
def c14_nearest_p_sample(spark, sf):
    return C.nearest_p_around(M.query_points(spark, sf), M.points(spark, sf), 0.04, 12).select("frame_id", "cand_idx", "point_idx", "slot")


def stride_sql(rule: str, short: str) -> str:
    return f"""WITH {PT3}, o AS (SELECT frame_id, event_type, v, u, row_number() OVER (PARTITION BY frame_id, event_type ORDER BY v, u) - 1 AS pos,
        count(*) OVER (PARTITION BY frame_id, event_type) AS n FROM pt3),
    slots AS (SELECT DISTINCT frame_id, event_type, n, s AS slot FROM o, range(0, 300) t(s)),
    want AS (SELECT *, CASE WHEN n <= 300 THEN {short} WHEN slot = 299 THEN n - 1 ELSE CAST({rule}(slot * ((n - 1) / 299.0::DOUBLE)) AS BIGINT) END AS pos FROM slots)
    SELECT frame_id, event_type, v, u, slot FROM want JOIN o USING (frame_id, event_type, n, pos)"""


@register("c15_stride_subset", stride_sql("floor", "slot"))
def c15_stride_subset(spark, sf):
    df = C.stride_subset(pixel_points(spark, sf), 300, ["frame_id", "event_type"], ["v", "u"])
    return df.select("frame_id", "event_type", "v", "u", "slot")


@register(
    "c15_stride_round", stride_sql("round_even", "CASE WHEN n = 300 THEN slot ELSE slot % n END").replace("* ((n - 1) / 299.0::DOUBLE))", "* ((n - 1) / 299.0::DOUBLE), 0)")
)
def c15_stride_round(spark, sf):
    df = C.stride_subset(pixel_points(spark, sf), 300, ["frame_id", "event_type"], ["v", "u"], variant="round")
    return df.select("frame_id", "event_type", "v", "u", "slot")


POSED = f"""{M.CAND}, posed AS (SELECT scene_id, frame_id, camera, cand_idx, base_score, base_score / 1000 AS tx,
      CAST((cand_idx * 7919) % 1000 AS DOUBLE) / 10000 AS ty, CAST((cand_idx * 104729) % 1000 AS DOUBLE) / 10000 AS tz,
      radians(CAST((cand_idx * 31) % 360 AS DOUBLE) * 0.997::DOUBLE) AS a FROM cand)"""


def posed(spark, sf):
    idx = F.col("cand_idx")
    a = F.radians(((idx * 31) % 360).cast("double") * 0.997)
    return M.candidates(spark, sf).select(
        *S.FRAME_KEYS,
        "cand_idx",
        "base_score",
        (F.col("base_score") / 1000).alias("tx"),
        (((idx * 7919) % 1000).cast("double") / 10000).alias("ty"),
        (((idx * 104729) % 1000).cast("double") / 10000).alias("tz"),
        F.cos(a).alias("r0"),
        (-F.sin(a)).alias("r1"),
        F.lit(0.0).alias("r2"),
        F.sin(a).alias("r3"),
        F.cos(a).alias("r4"),
        *[F.lit(0.0).alias(f"r{i}") for i in (5, 6, 7)],
        F.lit(1.0).alias("r8"),
    )


def leaders_sql(source: str) -> str:
    """Leader of every candidate by literal recursion; ``source`` has frame_id, cand_idx, tx, ty, tz."""
    return f"""st AS (
      SELECT frame_id, cand_idx, tx, ty, tz, CAST(NULL AS BIGINT) AS owner, 0 AS step FROM {source}
      UNION ALL
      SELECT frame_id, cand_idx, tx, ty, tz,
             CASE WHEN owner IS NULL AND (cand_idx = lead OR (tx - lx) * (tx - lx) + (ty - ly) * (ty - ly) + (tz - lz) * (tz - lz) < 0.03::DOUBLE * 0.03::DOUBLE)
                  THEN lead ELSE owner END, step + 1
      FROM (SELECT *, min(CASE WHEN owner IS NULL THEN cand_idx END) OVER (PARTITION BY frame_id) AS lead,
                   first_value(tx) OVER w AS lx, first_value(ty) OVER w AS ly, first_value(tz) OVER w AS lz
            FROM st WINDOW w AS (PARTITION BY frame_id ORDER BY owner IS NULL DESC, cand_idx)) q
      WHERE lead IS NOT NULL),
    own AS (SELECT frame_id, cand_idx, max(owner) AS leader_idx FROM st GROUP BY frame_id, cand_idx)"""


LEADERS = f"WITH RECURSIVE {POSED}, {leaders_sql('posed')}"


@register(
    "c16_leader_cluster",
    f"{LEADERS} SELECT frame_id, cand_idx, leader_idx, dense_rank() OVER (PARTITION BY frame_id ORDER BY leader_idx) - 1 AS cluster_id FROM own",
)
def c16_leader_cluster(spark, sf):
    return K.leader_cluster(posed(spark, sf)).select("frame_id", "cand_idx", "leader_idx", "cluster_id")


@register(
    "c17_broadcast_cluster_payload",
    f"""{LEADERS}, c AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY leader_idx) - 1 AS cluster_id FROM own),
    pay AS (SELECT frame_id, cluster_id, max(cand_idx) AS last_member FROM c GROUP BY ALL HAVING count(*) > 1)
    SELECT frame_id, cand_idx, cluster_id, CASE WHEN last_member IS NULL THEN 0 ELSE 2 END AS cloud_points, last_member
    FROM c LEFT JOIN pay USING (frame_id, cluster_id)""",
)
def c17_broadcast_cluster_payload(spark, sf):
    """First and last member of a cluster as its payload; a cluster of one has none."""
    clusters = K.leader_cluster(posed(spark, sf))
    payload = (
        clusters.groupBy(*S.FRAME_KEYS, "cluster_id")
        .agg(F.count(F.lit(1)).alias("n"), F.array(F.min("cand_idx"), F.max("cand_idx")).alias("object_cloud"))
        .where("n > 1")
        .drop("n")
    )
    out = K.broadcast_cluster_payload(clusters, payload)
    return out.select(
        "frame_id",
        "cand_idx",
        "cluster_id",
        F.size("object_cloud").alias("cloud_points"),
        F.get("object_cloud", F.lit(1)).alias("last_member"),
    )


NMS = f"""WITH RECURSIVE {POSED},
    od AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY base_score DESC, cand_idx) AS o FROM posed),
    st AS (
      SELECT frame_id, cand_idx, o, tx, ty, tz, a, 0 AS state, 0 AS step FROM od
      UNION ALL
      SELECT frame_id, cand_idx, o, tx, ty, tz, a,
             CASE WHEN state <> 0 THEN state WHEN o = lead THEN 1
                  WHEN (tx - lx) * (tx - lx) + (ty - ly) * (ty - ly) + (tz - lz) * (tz - lz) < 0.03::DOUBLE * 0.03::DOUBLE
                       AND (2 * cos(a - la) + 1 - 1) / 2 > cos({math.pi / 6!r}::DOUBLE) THEN 2 ELSE 0 END, step + 1
      FROM (SELECT *, min(CASE WHEN state = 0 THEN o END) OVER (PARTITION BY frame_id) AS lead, first_value(tx) OVER w AS lx,
                   first_value(ty) OVER w AS ly, first_value(tz) OVER w AS lz, first_value(a) OVER w AS la
            FROM st WINDOW w AS (PARTITION BY frame_id ORDER BY state = 0 DESC, o)) q
      WHERE lead IS NOT NULL),
    kept AS (SELECT frame_id, cand_idx, o, max(state) AS state FROM st GROUP BY ALL)"""


@register("c18_pose_nms", f"{NMS} SELECT frame_id, cand_idx FROM kept WHERE state = 1")
def c18_pose_nms(spark, sf):
    return K.pose_nms(posed(spark, sf)).select("frame_id", "cand_idx")


@register(
    "e10_top_k_preview",
    f"""{NMS}, r AS (SELECT frame_id, cand_idx, row_number() OVER (PARTITION BY frame_id ORDER BY o) AS rank FROM kept WHERE state = 1)
    SELECT frame_id, cand_idx, rank FROM r WHERE rank <= 50""",
)
def e10_top_k_preview(spark, sf):
    return K.top_k_preview(posed(spark, sf)).select("frame_id", "cand_idx", "rank")


@register(
    "c19_unit_sphere",
    f"""WITH {M.PTS}, c AS (SELECT frame_id, point_idx, x - avg(x) OVER f AS ux, y - avg(y) OVER f AS uy, z - avg(z) OVER f AS uz FROM pts WINDOW f AS (PARTITION BY frame_id)),
    s AS (SELECT *, greatest(max(sqrt(ux * ux + uy * uy + uz * uz)) OVER (PARTITION BY frame_id), 1e-6) AS s FROM c)
    SELECT frame_id, point_idx, round(ux / s + 2.3e-8, 6) + 0.0 AS ux, round(uy / s + 2.3e-8, 6) + 0.0 AS uy, round(uz / s + 2.3e-8, 6) + 0.0 AS uz FROM s""",
)
def c19_unit_sphere(spark, sf):
    return C.unit_sphere(M.points(spark, sf)).select("frame_id", "point_idx", *r6("ux", "uy", "uz"))


@register(
    "c20_shell_pool",
    f"""WITH {PAIRS}, p AS (SELECT *, CASE WHEN sqrt(d2) <= 0.01::DOUBLE THEN 0 WHEN sqrt(d2) <= 0.02::DOUBLE THEN 1 WHEN sqrt(d2) <= 0.03::DOUBLE THEN 2 ELSE 3 END AS sh FROM pairs),
    g AS (SELECT frame_id, cand_idx, count(*) AS n, {", ".join(f"max(CASE WHEN sh = {s} THEN z END) AS z_shell{s}, count(*) FILTER (WHERE sh = {s}) > 0 AS alive{s}" for s in range(4))},
                 max(z) AS z_max, avg(z) AS z_mean FROM p GROUP BY frame_id, cand_idx)
    SELECT q.frame_id, q.cand_idx, {", ".join(f"round(CASE WHEN n IS NULL THEN 0 ELSE z_shell{s} END + 2.3e-8, 6) + 0.0 AS z_shell{s}, coalesce(alive{s}, FALSE) AS alive{s}" for s in range(4))},
           round(coalesce(z_max, 0) + 2.3e-8, 6) + 0.0 AS z_max, round(coalesce(z_mean, 0) + 2.3e-8, 6) + 0.0 AS z_mean
    FROM qp q LEFT JOIN g USING (frame_id, cand_idx)""",
)
def c20_shell_pool(spark, sf):
    out = C.shell_pool_around(M.query_points(spark, sf), M.points(spark, sf), ["z"])
    return out.select(
        "frame_id", "cand_idx", *r6(*[f"z_shell{s}" for s in range(4)], "z_max", "z_mean"), *[f"alive{s}" for s in range(4)]
    )


LOCAL = (2, 4, 6, 8)


@register(
    "c21_local_cloud",
    f"""WITH RECURSIVE {PAIRS},
    {shells_sql("(SELECT frame_id, cand_idx, point_idx, lx::FLOAT AS x, ly::FLOAT AS y, lz::FLOAT AS z FROM pairs)", "frame_id, cand_idx", LOCAL)},
    {fps_sql("sh", "frame_id, cand_idx, shell", max(LOCAL))}
    SELECT frame_id, cand_idx, shell, slot + [0, 2, 6, 12][shell + 1] AS slot, point_idx,
      round(lx::FLOAT + 2.3e-8, 6) + 0.0 AS lx, round(ly::FLOAT + 2.3e-8, 6) + 0.0 AS ly, round(lz::FLOAT + 2.3e-8, 6) + 0.0 AS lz
    FROM picked JOIN pairs USING (frame_id, cand_idx, point_idx)""",
)
def c21_local_cloud(spark, sf):
    """Sampled neighbourhoods, few slots per shell so that sampling is at work."""
    df = N.local_cloud(M.query_points(spark, sf), M.points(spark, sf), budgets=LOCAL)
    axes = [F.col(c).cast("double").alias(c) for c in ("lx", "ly", "lz")]
    return df.select("frame_id", "cand_idx", "shell", "slot", "point_idx", *axes).select(
        "frame_id", "cand_idx", "shell", "slot", "point_idx", *r6("lx", "ly", "lz")
    )


@register(
    "c22_object_cloud",
    f"""WITH RECURSIVE {PT3},
    src AS (SELECT frame_id, v * 40 + u AS cand_idx, x AS tx, y AS ty, z AS tz FROM pt3 WHERE valid),
    {leaders_sql('src')},
    band AS (SELECT frame_id, v // 10 AS mask_idx, count(*) FILTER (WHERE valid) AS real_points, count(*) AS area FROM pt3 GROUP BY ALL),
    c AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY leader_idx) - 1 AS cluster_id, leader_idx // 400 AS mask_idx FROM own)
    SELECT c.frame_id, c.cand_idx, c.cluster_id,
           CAST(CASE WHEN area BETWEEN 10 AND floor(0.9::DOUBLE * 40 * (SELECT max(v) + 1 FROM pt3)) THEN least(32, real_points) ELSE 0 END AS INTEGER) AS points
    FROM c LEFT JOIN band USING (frame_id, mask_idx)""",
)
def c22_object_cloud(spark, sf):
    """Candidates on the depth points; horizontal bands of the image are the masks."""
    points = pixel_points(spark, sf).select("frame_id", "v", "u", "x", "y", "z", "valid")
    candidates = points.where("valid").select(
        "frame_id",
        (F.col("v") * 40 + F.col("u")).alias("cand_idx"),
        F.col("x").alias("tx"),
        F.col("y").alias("ty"),
        F.col("z").alias("tz"),
    )
    band = F.floor(F.col("v") / 10)
    pixels = points.select("frame_id", band.alias("mask_idx"), "v", "u")
    areas = pixels.groupBy("frame_id", "mask_idx").agg(F.count(F.lit(1)).alias("area")).withColumn("score", F.lit(1.0))
    height = points.agg(F.max("v")).first()[0] + 1
    out = K.object_cloud(
        candidates,
        areas,
        pixels,
        points,
        M.cameras(spark, sf),
        (height, 40),
        budget=32,
        min_area=10,
        max_ratio=0.9,
    )
    return out.select("frame_id", "cand_idx", "cluster_id", F.size("object_cloud").alias("points"))


# ---- samplers at their full budgets, over the pixels of a frame -----------------

CLOUD = f"""{PT3}, cloud AS (SELECT frame_id, v * 40 + u AS point_idx, x * 0.1::DOUBLE AS x, y * 0.1::DOUBLE AS y, (z - 0.7::DOUBLE) * 0.1::DOUBLE AS z FROM pt3 WHERE valid)"""
CLOUD_PAIRS = f"""{CLOUD}, posts AS (SELECT DISTINCT frame_id, c AS cand_idx, CAST(c AS DOUBLE) / 200 - 0.005::DOUBLE AS ty FROM cloud, range(0, 3) t(c)),
    near0 AS (SELECT frame_id, cand_idx, point_idx, x AS lx, y - ty AS ly, z AS lz, x * x + (y - ty) * (y - ty) + z * z AS d2 FROM posts JOIN cloud USING (frame_id)),
    near AS (SELECT * FROM near0 WHERE d2 <= 0.04::DOUBLE * 0.04::DOUBLE)"""


def cloud(spark, sf):
    small = pixel_points(spark, sf).where("valid")
    return small.select(
        "frame_id", (F.col("v") * 40 + F.col("u")).alias("point_idx"), (F.col("x") * 0.1).alias("x"), (F.col("y") * 0.1).alias("y"), ((F.col("z") - 0.7) * 0.1).alias("z")
    )


def posts(spark, sf):
    """Three upright candidates in the middle of every frame."""
    turn = [F.lit(float(i in (0, 4, 8))).alias(f"r{i}") for i in range(9)]
    numbered = cloud(spark, sf).select("frame_id").distinct().withColumn("cand_idx", F.explode(F.array(*[F.lit(c).cast("long") for c in range(3)])))
    return numbered.select("frame_id", "cand_idx", F.lit(0.0).alias("tx"), (F.col("cand_idx").cast("double") / 200 - 0.005).alias("ty"), F.lit(0.0).alias("tz"), *turn)


FULL_FPS = "(SELECT frame_id, point_idx, x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z, 512 AS budget FROM cloud)"


@register("c12_full_budget", f"WITH RECURSIVE {CLOUD}, {fps_sql(FULL_FPS, 'frame_id', 512)} SELECT frame_id, point_idx, slot FROM picked")
def c12_full_budget(spark, sf):
    return N.farthest_point_sample(cloud(spark, sf), ["frame_id"], 512).select("frame_id", "point_idx", "slot")


FULL_STARTS = [sum(S.SHELL_BUDGETS[:i]) for i in range(len(S.SHELL_BUDGETS))]


@register(
    "c13_full_budget",
    f"""WITH RECURSIVE {CLOUD}, {shells_sql("(SELECT frame_id, point_idx, x::FLOAT AS x, y::FLOAT AS y, z::FLOAT AS z FROM cloud)", "frame_id", S.SHELL_BUDGETS)},
    {fps_sql("sh", "frame_id, shell", max(S.SHELL_BUDGETS))}
    SELECT frame_id, shell, slot + {FULL_STARTS}[shell + 1] AS slot, point_idx FROM picked""",
)
def c13_full_budget(spark, sf):
    return N.stratified_fps(cloud(spark, sf), ["frame_id"], xyz=("x", "y", "z")).select("frame_id", "shell", "slot", "point_idx")


@register(
    "c14_full_budget",
    f"""WITH {CLOUD_PAIRS}, k AS (SELECT frame_id, cand_idx, point_idx, count(*) OVER (PARTITION BY frame_id, cand_idx) AS n,
        row_number() OVER (PARTITION BY frame_id, cand_idx ORDER BY lx * lx + ly * ly + lz * lz, point_idx) AS rd,
        row_number() OVER (PARTITION BY frame_id, cand_idx ORDER BY point_idx) AS ri FROM near)
    SELECT frame_id, cand_idx, point_idx, CAST(CASE WHEN n <= 512 THEN ri ELSE rd END - 1 AS INTEGER) AS slot FROM k WHERE n <= 512 OR rd <= 512""",
)
def c14_full_budget(spark, sf):
    near = radius_join(posts(spark, sf), cloud(spark, sf), 0.04, spread=["frame_id", "cand_idx"])
    return C.nearest_p_sample(C.to_local_frame(near), 512, ["frame_id", "cand_idx"]).select("frame_id", "cand_idx", "point_idx", "slot")


@register(
    "c21_full_budget",
    f"""WITH RECURSIVE {CLOUD_PAIRS},
    {shells_sql("(SELECT frame_id, cand_idx, point_idx, lx::FLOAT AS x, ly::FLOAT AS y, lz::FLOAT AS z FROM near)", "frame_id, cand_idx", S.SHELL_BUDGETS)},
    {fps_sql("sh", "frame_id, cand_idx, shell", max(S.SHELL_BUDGETS))}
    SELECT frame_id, cand_idx, shell, slot + {FULL_STARTS}[shell + 1] AS slot, point_idx FROM picked""",
)
def c21_full_budget(spark, sf):
    return N.local_cloud(posts(spark, sf), cloud(spark, sf)).select("frame_id", "cand_idx", "shell", "slot", "point_idx")
