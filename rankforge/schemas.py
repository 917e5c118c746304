"""Column contracts shared by every operator.

One row per candidate, point, mask, frame or evaluation cell; a frame is named
by ``FRAME_KEYS`` and a candidate by ``FRAME_KEYS + [CANDIDATE]``.
"""

from __future__ import annotations

from pyspark.sql import types as T

FRAME_KEYS = ["scene_id", "frame_id", "camera"]
CANDIDATE = "cand_idx"

# Fixed values of the evaluation protocol and the dump format.
TOP_K = 50
FRICTIONS = (0.2, 0.4, 0.6, 0.8, 1.0, 1.2)
FRICTION_TESTS = (1.2, 1.0, 0.8, 0.6, 0.4, 0.2)
FRAMES_PER_SCENE = 256
TRAIN_SCENES = (0, 99)
TEST_SCENES = (100, 189)
SEEN_SCENES = (100, 129)
SIMILAR_SCENES = (130, 159)
NOVEL_SCENES = (160, 189)
CAMERAS = ("realsense", "kinect")
OBJECT_CLASSES = 88
SUCCESS_TAU = 0.4
MAX_WIDTH = 0.1
STD_FLOOR = 1e-6
SWEEP_WEIGHTS = (0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
SHELL_EDGES = (0.0, 0.010, 0.020, 0.030, 0.040)
SHELL_BUDGETS = (64, 128, 128, 192)
LOSS_WEIGHTS = {"collision": 0.10, "empty": 0.05, "object": 0.05}
DUMP_WIDTH = 17
MANIFEST_VERSION = 1

# Column order of one dump row: score, width, height, depth, rotation (9),
# translation (3), object id.
DUMP_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("scene_id", T.IntegerType(), True),
        T.StructField("frame_id", T.IntegerType(), True),
        T.StructField("camera", T.StringType(), True),
        T.StructField("split", T.StringType(), True),
        T.StructField("cand_idx", T.LongType(), False),
        T.StructField("base_score", T.FloatType(), False),
        T.StructField("width", T.FloatType(), False),
        T.StructField("height", T.FloatType(), False),
        T.StructField("depth", T.FloatType(), False),
        T.StructField("rotation", T.ArrayType(T.FloatType(), False), False),
        T.StructField("tx", T.FloatType(), False),
        T.StructField("ty", T.FloatType(), False),
        T.StructField("tz", T.FloatType(), False),
        T.StructField("object_id", T.IntegerType(), False),
    ]
)

POINTS = T.ArrayType(T.StructType([T.StructField(n, T.FloatType(), False) for n in ("x", "y", "z")]), False)

ARCHIVE_SCHEMA = T.StructType(
    DUMP_SCHEMA.fields[:-1]
    + [
        T.StructField("mu_min", T.FloatType(), False),
        T.StructField("is_collision", T.BooleanType(), False),
        T.StructField("is_empty", T.BooleanType(), False),
        T.StructField("object_id", T.IntegerType(), False),
        T.StructField("cloud", POINTS, False),
        T.StructField("object_cloud", POINTS, False),
        T.StructField("meta_json", T.StringType(), False),
    ]
)

# The manifest record's fields as they stand in files.
MANIFEST_SCHEMA = (
    "schema_version int, relative_path string, archive_size long, archive_mtime_ns long, scene_name string, "
    "frame_id int, detector string, benchmark string, split string, camera string, num_grasps long, "
    "success_mu_thresh double, success_count long, collision_count long, empty_count long, "
    "mu_min_finite_count long, mu_min_nonfinite_count long, mu_min_finite_sum double, mu_min_finite_sumsq double, "
    "base_score_sum double, base_score_sumsq double"
)
# The same fields under the names that tables use, where they differ.
MANIFEST_NAMES = {
    "num_grasps": "num",
    "mu_min_finite_count": "mu_finite_count",
    "mu_min_nonfinite_count": "mu_nonfinite_count",
    "mu_min_finite_sum": "mu_finite_sum",
    "mu_min_finite_sumsq": "mu_finite_sumsq",
    "base_score_sum": "base_sum",
    "base_score_sumsq": "base_sumsq",
}
