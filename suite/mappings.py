"""Driver tables read as the engine's inputs, in Spark and as SQL text.

Each Spark function has a SQL twin; whole tables are always read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.schemas import FRICTION_TESTS



def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def candidates(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """One candidate per event, with ``more`` columns of the event."""
    draw = (F.col("event_id") * 7919) % 13
    return table(spark, sf, "events").select(
        (F.lit(100) + F.col("user_id") % 90).alias("scene_id"),
        F.col("user_id").alias("frame_id"),
        F.lit("realsense").alias("camera"),
        F.col("event_id").alias("cand_idx"),
        F.col("value").alias("base_score"),
        (((F.col("event_id") * 7919) % 1000).cast("double") / 1000).alias("model_score"),
        F.when(draw >= 9, F.lit(float("inf"))).otherwise((2 * (1 + draw % 6)).cast("double") / 10).alias("mu_min"),
        (F.col("event_type") == "error").alias("raw_collision"),
        (F.col("event_type") == "signup").alias("is_empty"),
        (F.col("event_id") % 89 - 1).cast("int").alias("object_id"),
        *more,
    )


CAND = """
cand AS (
  SELECT 100 + user_id % 90 AS scene_id, user_id AS frame_id, 'realsense' AS camera,
         event_id AS cand_idx, value AS base_score,
         CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS model_score,
         CASE WHEN (event_id * 7919) % 13 >= 9 THEN CAST('Infinity' AS DOUBLE)
              ELSE CAST(2 * (1 + ((event_id * 7919) % 13) % 6) AS DOUBLE) / 10 END AS mu_min,
         event_type = 'error' AS raw_collision, event_type = 'signup' AS is_empty,
         CAST(event_id % 89 AS INTEGER) - 1 AS object_id
  FROM events)"""

# z-scores and both fused orders used by several oracles.
ZED = (
    CAND
    + """,
zed AS (
  SELECT *,
    CASE WHEN stddev_pop(base_score) OVER f <= 1e-6 THEN 0
         ELSE (base_score - avg(base_score) OVER f) / stddev_pop(base_score) OVER f END AS base_z,
    CASE WHEN stddev_pop(model_score) OVER f <= 1e-6 THEN 0
         ELSE (model_score - avg(model_score) OVER f) / stddev_pop(model_score) OVER f END AS model_z
  FROM cand WINDOW f AS (PARTITION BY scene_id, frame_id, camera))"""
)

FRICTION_ROWS = "(VALUES (0, 0.2::DOUBLE), (1, 0.4), (2, 0.6), (3, 0.8), (4, 1.0), (5, 1.2)) fr(friction_idx, friction)"


def fused_sql(lam: float, name: str = "fused") -> str:
    return f"({1.0 - lam!r}::DOUBLE * base_z + {lam!r}::DOUBLE * model_z) AS {name}"


def cells_sql(score: str, source: str, name: str, extra: str = "") -> str:
    """CTEs that build all precision cells of one order, by the textbook definition."""
    keys = f"{extra}scene_id, frame_id, camera"
    return f"""
{name}_rk AS (
  SELECT {keys}, mu_min, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC, cand_idx) AS rk
  FROM {source}),
{name}_grid AS (
  SELECT {keys}, CAST(k AS INTEGER) AS k, friction_idx, friction
  FROM (SELECT DISTINCT {keys} FROM {source}) CROSS JOIN range(1, 51) t(k)
  CROSS JOIN {FRICTION_ROWS}),
{name} AS (
  SELECT {", ".join("g." + c.strip() for c in keys.split(","))}, g.k, g.friction_idx, g.friction,
         count(*) FILTER (WHERE r.mu_min > 0 AND r.mu_min <= g.friction) / g.k::DOUBLE AS precision
  FROM {name}_grid g LEFT JOIN {name}_rk r
    ON {" AND ".join(f"g.{c.strip()} = r.{c.strip()}" for c in keys.split(","))} AND r.rk <= g.k
  GROUP BY {", ".join("g." + c.strip() for c in keys.split(","))}, g.k, g.friction_idx, g.friction)"""


AP_COLS = """round(100 * avg(precision), 4) AS ap,
       round(100 * avg(CASE WHEN friction_idx = 1 THEN precision END), 4) AS ap_04,
       round(100 * avg(CASE WHEN friction_idx = 3 THEN precision END), 4) AS ap_08"""

GROUP_CASE = """CASE WHEN scene_id BETWEEN 100 AND 129 THEN 'seen'
       WHEN scene_id BETWEEN 130 AND 159 THEN 'similar'
       WHEN scene_id BETWEEN 160 AND 189 THEN 'novel' END"""


# Frames of a dump tree, most of them without a candidate.
LISTED = """listed AS (SELECT DISTINCT 100 + c_custkey % 90 AS scene_id, c_custkey AS frame_id, 'realsense' AS camera FROM customer),
absent AS (SELECT * FROM listed ANTI JOIN cand USING (scene_id, frame_id, camera))"""


def listed_frames(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        (F.lit(100) + F.col("c_custkey") % 90).alias("scene_id"), F.col("c_custkey").alias("frame_id"), F.lit("realsense").alias("camera")
    )


def friction_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Pass flags of every candidate at the six test frictions."""
    f10 = [round(f * 10) for f in FRICTION_TESTS]
    return (
        table(spark, sf, "events")
        .select(
            (F.lit(100) + F.col("user_id") % 90).alias("scene_id"),
            F.col("user_id").alias("frame_id"),
            F.lit("realsense").alias("camera"),
            F.col("event_id").alias("cand_idx"),
            F.explode(F.array(*[F.lit(f) for f in f10])).alias("f10"),
        )
        .select(
            "scene_id",
            "frame_id",
            "camera",
            "cand_idx",
            (F.col("f10").cast("double") / 10).alias("friction"),
            (((F.col("cand_idx") * 31 + F.col("f10") * 7) % 5) != 0).alias("passed"),
        )
    )


TESTS = (
    CAND
    + """,
tests AS (
  SELECT scene_id, frame_id, camera, cand_idx, CAST(f10 AS DOUBLE) / 10 AS friction,
         ((cand_idx * 31 + f10 * 7) % 5) <> 0 AS passed
  FROM cand CROSS JOIN (VALUES (12), (10), (8), (6), (4), (2)) t(f10))"""
)


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("frame_id"),
        F.col("vec_id").alias("point_idx"),
        *[(F.element_at(e, i + 1).cast("double") * 0.1).alias(c) for i, c in enumerate("xyz")],
    )


PTS = """
pts AS (
  SELECT label AS frame_id, vec_id AS point_idx, CAST(embedding[1] AS DOUBLE) * 0.1 AS x,
         CAST(embedding[2] AS DOUBLE) * 0.1 AS y, CAST(embedding[3] AS DOUBLE) * 0.1 AS z
  FROM embeddings)"""


def query_points(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates placed by the next three coordinates, turned about one axis."""
    e = F.col("embedding")
    angle = F.element_at(e, 7).cast("double") * 3
    turn = {
        "r0": F.cos(angle), "r1": -F.sin(angle), "r2": F.lit(0.0),
        "r3": F.sin(angle), "r4": F.cos(angle), "r5": F.lit(0.0),
        "r6": F.lit(0.0), "r7": F.lit(0.0), "r8": F.lit(1.0),
    }
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("frame_id"),
        F.col("vec_id").alias("cand_idx"),
        *[(F.element_at(e, i + 4).cast("double") * 0.1).alias(c) for i, c in enumerate(("tx", "ty", "tz"))],
        *[c.alias(n) for n, c in turn.items()],
    )


QPTS = """
qp0 AS (
  SELECT label AS frame_id, vec_id AS cand_idx, CAST(embedding[4] AS DOUBLE) * 0.1 AS tx,
         CAST(embedding[5] AS DOUBLE) * 0.1 AS ty, CAST(embedding[6] AS DOUBLE) * 0.1 AS tz,
         CAST(embedding[7] AS DOUBLE) * 3 AS angle
  FROM embeddings),
qp AS (
  SELECT frame_id, cand_idx, tx, ty, tz, cos(angle) AS r0, -sin(angle) AS r1, 0.0::DOUBLE AS r2,
         sin(angle) AS r3, cos(angle) AS r4, 0.0::DOUBLE AS r5,
         0.0::DOUBLE AS r6, 0.0::DOUBLE AS r7, 1.0::DOUBLE AS r8
  FROM qp0)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("frame_id"),
        F.floor(F.col("event_id") / 40).alias("v"),
        (F.col("event_id") % 40).alias("u"),
        F.when(F.col("event_type") == "error", F.lit(0)).otherwise(400 + F.col("event_id") % 600).alias("depth_mm"),
        F.col("user_id"),
        F.col("event_type"),
    )


PIX = """
pix AS (
  SELECT user_id % 5 AS frame_id, CAST(floor(event_id / 40) AS BIGINT) AS v, event_id % 40 AS u,
         CASE WHEN event_type = 'error' THEN 0 ELSE 400 + event_id % 600 END AS depth_mm, user_id, event_type
  FROM events)"""


def cameras(spark: SparkSession, sf: str) -> DataFrame:
    """One constant row of intrinsics per frame."""
    return (
        table(spark, sf, "events")
        .select((F.col("user_id") % 5).alias("frame_id"))
        .distinct()
        .select(
            "frame_id", F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.lit(20.0).alias("cx"), F.lit(125.0).alias("cy")
        )
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their candidate counts; some are empty."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("num"))
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("frame_id"),
        (F.col("o_custkey") % 190).alias("scene_id"),
        F.coalesce("num", F.lit(0)).alias("num"),
    )


FRM = """
frm AS (
  SELECT o_orderkey AS frame_id, o_custkey % 190 AS scene_id, count(l_orderkey) AS num
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
  GROUP BY o_orderkey, o_custkey % 190)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        ((F.col("l_discount") - F.lit(0.05)) * 20).alias("pred"),
        (F.col("l_quantity") / 25 - 1).alias("target"),
        (F.col("l_tax") * 50 - 2).alias("collision_logit"),
        (F.col("l_returnflag") == "R").alias("is_collision"),
        (F.lit(1) - F.col("l_tax") * 30).alias("empty_logit"),
        (F.col("l_linestatus") == "O").alias("is_empty"),
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_linenumber",
    )


PRED = """
pred AS (
  SELECT l_returnflag, l_linestatus, (l_discount - 0.05::DOUBLE) * 20 AS pred, l_quantity / 25 - 1 AS target,
         l_tax * 50 - 2 AS collision_logit, l_returnflag = 'R' AS is_collision,
         1 - l_tax * 30 AS empty_logit, l_linestatus = 'O' AS is_empty,
         l_quantity, l_discount, l_tax, l_linenumber
  FROM lineitem)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: a scene, a size and a content hash each."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("scene_"), F.lpad((F.col("doc_id") % 50).cast("string"), 4, "0")).alias("scene"),
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        F.col("lang"),
        F.col("source"),
    )


FIL = """
fil AS (
  SELECT doc_id AS file_id, 'scene_' || lpad(CAST(doc_id % 50 AS VARCHAR), 4, '0') AS scene, n_chars AS size,
         sha256(text) AS sha256, lang, source
  FROM documents)"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """File paths in the layouts a dump tree may have, one per event."""
    e = table(spark, sf, "events")
    scene = F.lpad((F.col("user_id") % 190).cast("string"), 4, "0")
    frame = F.lpad((F.col("event_id") % 256).cast("string"), 4, "0")
    tree = F.when(F.col("user_id") % 190 < 100, "train").otherwise("test")
    return e.select(
        "event_id",
        F.when(
            F.col("event_type") == "click",
            F.concat(F.lit("dump/"), tree, F.lit("_top50/scene_"), scene, F.lit("/realsense/"), frame, F.lit(".npy")),
        )
        .when(
            F.col("event_type") == "view",
            F.concat(F.lit("dump/"), tree, F.lit("/scene_"), scene, F.lit("/"), frame, F.lit(".npy")),
        )
        .when(F.col("event_type") == "signup", F.concat(F.lit("kinect/"), scene, F.lit("/kinect/"), frame, F.lit(".npz")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("dump/"), scene, F.lit("/"), frame, F.lit(".npy")))
        .otherwise(F.concat(F.lit("notes/"), F.col("event_type"), F.lit("/readme_"), frame, F.lit(".npy")))
        .alias("path"),
    )


PATHS = """
paths0 AS (
  SELECT event_id, event_type, lpad(CAST(user_id % 190 AS VARCHAR), 4, '0') AS sc,
         lpad(CAST(event_id % 256 AS VARCHAR), 4, '0') AS fr,
         CASE WHEN user_id % 190 < 100 THEN 'train' ELSE 'test' END AS tree
  FROM events),
paths AS (
  SELECT event_id,
    CASE event_type
      WHEN 'click' THEN 'dump/' || tree || '_top50/scene_' || sc || '/realsense/' || fr || '.npy'
      WHEN 'view' THEN 'dump/' || tree || '/scene_' || sc || '/' || fr || '.npy'
      WHEN 'signup' THEN 'kinect/' || sc || '/kinect/' || fr || '.npz'
      WHEN 'purchase' THEN 'dump/' || sc || '/' || fr || '.npy'
      ELSE 'notes/' || event_type || '/readme_' || fr || '.npy' END AS path
  FROM paths0)"""
