"""Decode candidates, filter them and assemble their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.functions.expressions import INF, col
from rankforge.plans.groups import require_none

# Defaults of label columns an input may lack.
LABEL_DEFAULTS = {"mu_min": INF, "is_collision": False, "is_empty": False, "object_id": -1}


def _at(values: Column, i: int) -> Column:
    return F.get(values, F.lit(i)).cast("double")


def decode_candidates(df: DataFrame, values: str = "values") -> DataFrame:
    """Split a dump row (array of numbers) into score, width, rotation, translation and pose.

    Rows shorter than 16 values get the identity pose.
    """
    v = F.col(values)
    posed = F.size(v) >= 16
    identity = [float(i % 4 == 0) for i in range(9)]
    rotation = [F.when(posed, _at(v, 4 + i)).otherwise(F.lit(identity[i])) for i in range(9)]
    shift = [F.when(posed, _at(v, 13 + i)).otherwise(F.lit(0.0)) for i in range(3)]
    rows = [F.array(*rotation[3 * r : 3 * r + 3], shift[r]) for r in range(3)]
    return df.withColumns(
        {
            "base_score": _at(v, 0),
            "width": _at(v, 1),
            "rotation": F.array(*rotation),
            "tx": shift[0],
            "ty": shift[1],
            "tz": shift[2],
            "pose": F.array(*rows, F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])),
        }
    )


def pose_features(df: DataFrame, out: str = "pose_features") -> DataFrame:
    """Nine rotation entries, three of translation, width and score as one array."""
    parts = [F.get("rotation", F.lit(i)) for i in range(9)] + [F.col(c) for c in ("tx", "ty", "tz", "width", "base_score")]
    return df.withColumn(out, F.array(*[p.cast("float") for p in parts]))


def filter_camera(df: DataFrame, camera: str | None, path_camera: str = "path_camera", meta_camera: str = "meta_camera") -> DataFrame:
    """Keep one camera's rows; the path decides, then metadata; unknown rows pass."""
    if not camera:
        return df
    return df.where(F.coalesce(F.col(path_camera), F.col(meta_camera), F.lit(camera)) == camera)


def filter_scenes(df: DataFrame, scenes: DataFrame, on: str = "scene_id") -> DataFrame:
    """Keep candidates of listed scenes."""
    return df.join(scenes.select(on).distinct(), on, "left_semi")


def coerce_labels(df: DataFrame) -> DataFrame:
    """Fill absent label columns and missing labels with their defaults."""
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
            for name, default in LABEL_DEFAULTS.items()
        }
    )


def upgrade_schema(
    legacy: DataFrame,
    objects: DataFrame,
    keys: Sequence[str] = (*S.FRAME_KEYS, S.CANDIDATE),
    deprecated: Sequence[str] = ("local_features",),
) -> DataFrame:
    """Add the object fields to legacy rows, drop deprecated columns, mark the upgrade."""
    return (
        legacy.drop("object_id", "object_cloud", *deprecated)
        .join(objects, list(keys), "left")
        .withColumn("object_id", F.coalesce("object_id", F.lit(-1)))
        .withColumn("schema_upgrade", F.lit(True))
    )


def assemble_labels(
    df: DataFrame,
    raw_collision: str = "raw_collision",
    raw_empty: str = "raw_empty",
    score: str = "friction_score",
    distance: str = "distance",
    max_distance: float | None = None,
    has_models: Column | None = None,
) -> DataFrame:
    """Final labels from raw outcomes of one candidate.

    A collision counts only when the candidate is not empty; friction is the
    positive score of a collision-free candidate, else infinite. Background
    candidates and frames without models are empty and have no object.
    """
    near = F.lit(True) if max_distance is None else F.col(distance) < max_distance
    models = F.lit(True) if has_models is None else has_models
    live = near & models
    empty, hit = F.col(raw_empty), F.col(raw_collision)
    good = live & ~hit & (F.col(score) > 0)
    return df.withColumns(
        {
            "is_collision": F.coalesce(live & hit & ~empty, F.lit(False)),
            "is_empty": F.coalesce(~live | empty, F.lit(False)),
            "mu_min": F.when(good, F.col(score).cast("double")).otherwise(F.lit(INF)),
            "object_id": F.when(live, F.coalesce(F.col("object_id"), F.lit(-1))).otherwise(F.lit(-1)),
        }
    )


def min_friction(
    tests: DataFrame,
    keys: Sequence[str] = (*S.FRAME_KEYS, S.CANDIDATE),
    friction: str = "friction",
    passed: str = "passed",
) -> DataFrame:
    """Lowest friction of the unbroken run of passes from the highest one down.

    -1 when the first test fails. The run ends at the highest failed friction,
    so two order-free aggregates give the answer without a window.
    """
    f, ok = F.col(friction), F.coalesce(F.col(passed), F.lit(False))
    per = tests.groupBy(*keys).agg(
        F.max(F.when(~ok, f)).alias("_fail"),
        F.max(f).alias("_first"),
        F.min(f).alias("_last"),
        F.sort_array(F.collect_set(F.when(ok, f))).alias("_passes"),
    )
    run = F.when(F.col("_fail").isNull(), F.col("_last")).when(
        F.col("_fail") < F.col("_first"),
        F.array_min(F.filter("_passes", lambda x: x > F.col("_fail"))),
    )
    return per.select(*keys, F.coalesce(run, F.lit(-1.0)).alias("score"))


def map_object_ids(
    df: DataFrame,
    bank: DataFrame,
    frame: Sequence[str] = ("scene_id", "frame_id"),
    local: str = "local_idx",
    background: str | None = None,
) -> DataFrame:
    """Frame-local model index to global object id; background or unknown is -1."""
    out = df.join(bank, [*frame, local], "left")
    known = F.coalesce(F.col("global_id"), F.lit(-1))
    if background:
        known = F.when(F.col(background), F.lit(-1)).otherwise(known)
    return out.withColumn("object_id", known.cast("int")).drop("global_id")


def cloud_mask(df: DataFrame, cloud: str = "cloud", out: str = "cloud_mask") -> DataFrame:
    """The stored mask where there is one, else: any coordinate differs from zero."""
    derived = F.transform(cloud, lambda p: (p.x != 0) | (p.y != 0) | (p.z != 0))
    return df.withColumn(out, F.coalesce(F.col(out), derived) if out in df.columns else derived)


def pad_clouds(df: DataFrame, width: int | None = None, cloud: str = "cloud", mask: str = "cloud_mask") -> DataFrame:
    """Grow every cloud to ``width`` (default: the widest) with zero points masked out."""
    if width is None:
        width = df.agg(F.max(F.size(cloud))).first()[0] or 0
    missing = F.greatest(F.lit(width) - F.size(cloud), F.lit(0))
    zero = F.struct(*[F.lit(0).cast(f.dataType).alias(f.name) for f in df.schema[cloud].dataType.elementType])
    return df.withColumns(
        {
            cloud: F.concat(F.col(cloud), F.array_repeat(zero, missing)),
            mask: F.concat(F.col(mask), F.array_repeat(F.lit(False), missing)),
        }
    )


def strip_padding(df: DataFrame, cloud: str = "cloud", mask: str = "cloud_mask") -> DataFrame:
    """Keep only real points; the inverse of padding."""
    real = F.filter(F.arrays_zip(F.col(cloud).alias("p"), F.col(mask).alias("m")), lambda z: z["m"])
    return df.withColumns(
        {cloud: F.transform(real, lambda z: z["p"]), mask: F.transform(real, lambda z: F.lit(True))}
    )


def check_lengths(counts: DataFrame, expected: str, actual: str) -> None:
    """Raise when two recorded lengths of a frame differ."""
    require_none(counts.where(~col(expected).eqNullSafe(col(actual))), "lengths differ")
