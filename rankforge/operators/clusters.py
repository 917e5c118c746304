"""Leader clusters, suppression of near-duplicate poses, and object clouds."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge import schemas as S
from rankforge.operators.geometry import ROTATION, mask_points, pick_mask, project_to_pixel, stride_subset
from rankforge.operators.sampling import SAMPLE_LIMIT, farthest_point_sample
from rankforge.plans.greedy import assign_leaders, greedy_leaders
from rankforge.plans.groups import rank_within, split_by_size
from rankforge.session import materialise

# Candidates of one frame that one vectorised pass may hold.
CLUSTER_LIMIT = 20_000
XYZ = ("tx", "ty", "tz")


OWNERS = T.StructType(
    [T.StructField("leader_idx", T.ArrayType(T.LongType())), T.StructField("cluster_id", T.ArrayType(T.LongType()))]
)


def _leader_owner(radius: float):
    @F.pandas_udf(OWNERS)
    def owner(ids: pd.Series, xs: pd.Series, ys: pd.Series, zs: pd.Series) -> pd.DataFrame:
        leaders, clusters = [], []
        for i, x, y, z in zip(ids, xs, ys, zs):
            p = np.stack([x, y, z], axis=1).astype(np.float64)
            own, number = np.zeros(len(p), dtype=np.int32), np.zeros(len(p), dtype=np.int64)
            # Positions and coordinates of the free candidates shrink together.
            free, left, opened = np.arange(len(p)), p, 0
            while len(free):
                d = left - left[0]
                near = np.einsum("ij,ij->i", d, d) < radius * radius
                near[0] = True
                own[free[near]], number[free[near]] = free[0], opened
                free, left, opened = free[~near], left[~near], opened + 1
            leaders.append(np.asarray(i, dtype=np.int64)[own])
            clusters.append(number)
        return pd.DataFrame({"leader_idx": leaders, "cluster_id": clusters})

    return owner


def leader_cluster(
    df: DataFrame,
    radius: float = 0.03,
    keys: Sequence[str] = S.FRAME_KEYS,
    idx: str = S.CANDIDATE,
    xyz: Sequence[str] = XYZ,
    limit: int = CLUSTER_LIMIT,
) -> DataFrame:
    """Cluster per candidate: keys, idx, ``leader_idx``, ``cluster_id`` (order of opening).

    In index order the first free candidate opens a cluster and takes every free
    one closer than ``radius``.
    """
    keys = list(keys)
    rows = df.select(*keys, idx, *[F.col(c).cast("double").alias(c) for c in xyz])
    small, large = split_by_size(rows, keys, limit)
    found = _cluster_lists(small, radius, keys, idx, xyz)
    if large is None:
        return found
    leaders = greedy_leaders(large, keys, idx, xyz, radius, capacity=limit)
    numbered = rank_within(leaders, keys, [F.asc(idx)], "_n", limit).select(
        *keys, F.col(idx).alias("leader_idx"), (F.col("_n") - 1).alias("cluster_id")
    )
    owned = assign_leaders(large, leaders, keys, idx, xyz, radius).withColumnRenamed("owner", "leader_idx")
    return found.unionByName(owned.join(numbered, [*keys, "leader_idx"]).select(*keys, idx, "leader_idx", "cluster_id"))


def _cluster_lists(rows: DataFrame, radius: float, keys: list[str], idx: str, xyz: Sequence[str]) -> DataFrame:
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(idx, *xyz))).alias("_p"))
    fields = [F.col(f"_p.{c}") for c in (idx, *xyz)]
    members = F.arrays_zip(
        fields[0].alias(idx), F.col("_o.leader_idx").alias("leader_idx"), F.col("_o.cluster_id").alias("cluster_id")
    )
    owned = lists.withColumn("_o", _leader_owner(radius)(*fields))
    return owned.select(*keys, F.explode(members).alias("_m")).select(*keys, "_m.*")


def broadcast_cluster_payload(
    clusters: DataFrame, payload: DataFrame, keys: Sequence[str] = S.FRAME_KEYS, cloud: str = "object_cloud"
) -> DataFrame:
    """Every member gets its cluster's payload; none means an empty cloud."""
    out = clusters.join(payload, [*keys, "cluster_id"], "left")
    empty = F.array().cast(payload.schema[cloud].dataType)
    return out.withColumn(cloud, F.coalesce(F.col(cloud), empty))


def _suppress(t: float, cos_limit: float):
    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def keep(xs: pd.Series, ys: pd.Series, zs: pd.Series, rots: pd.Series) -> pd.Series:
        out = []
        for x, y, z, r in zip(xs, ys, zs, rots):
            p = np.stack([x, y, z], axis=1).astype(np.float64)
            rot = np.asarray(r, dtype=np.float64).reshape(len(p), 9)
            kept = np.zeros(len(p), dtype=bool)
            free = np.arange(len(p))
            while len(free):
                lead = free[0]
                kept[lead] = True
                d = p[free] - p[lead]
                close = (d * d).sum(axis=1) < t * t
                turned = (rot[free] @ rot[lead] - 1.0) / 2.0 > cos_limit
                gone = close & turned
                gone[0] = True
                free = free[~gone]
            out.append(kept)
        return pd.Series(out)

    return keep


def pose_nms(
    df: DataFrame,
    t: float = 0.03,
    rot: float = math.pi / 6,
    score: str = "base_score",
    keys: Sequence[str] = S.FRAME_KEYS,
    idx: str = S.CANDIDATE,
    xyz: Sequence[str] = XYZ,
    rotation: Sequence[str] = ROTATION,
    limit: int = CLUSTER_LIMIT,
) -> DataFrame:
    """Candidates that survive greedy suppression by score (ties by index).

    A later pose goes when its translation is closer than ``t`` and its rotation
    differs by less than ``rot`` from a surviving one.
    """
    keys = list(keys)
    cos_limit = math.cos(rot)
    narrow = df.select(
        *keys, idx, score, *[F.col(c).cast("double").alias(c) for c in (*xyz, *rotation)]
    )
    small, large = split_by_size(narrow, keys, limit)
    survivors = _suppress_lists(small, t, cos_limit, score, keys, idx, xyz, rotation)
    if large is not None:
        ranked = rank_within(large, keys, [F.desc(score), F.asc(idx)], "_prio", limit)
        leaders = greedy_leaders(ranked, keys, "_prio", xyz, t, [idx, *rotation], (rotation, cos_limit), limit)
        survivors = survivors.unionByName(leaders.select(*keys, idx))
    return df.join(survivors, [*keys, idx], "left_semi")


def _suppress_lists(
    rows: DataFrame, t: float, cos_limit: float, score: str, keys: list[str], idx: str, xyz: Sequence[str], rotation: Sequence[str]
) -> DataFrame:
    fields = F.struct((-F.col(score)).alias("_neg"), F.col(idx).alias(idx), *xyz, F.array(*rotation).alias("_r"))
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(fields)).alias("_p"))
    axes = [F.col(f"_p.{c}") for c in xyz]
    turns = F.flatten(F.transform("_p", lambda p: p["_r"]))
    return (
        lists.withColumn("_k", _suppress(t, cos_limit)(*axes, turns))
        .select(*keys, F.explode(F.arrays_zip(F.col(f"_p.{idx}").alias(idx), F.col("_k").alias("kept"))).alias("_m"))
        .where("_m.kept")
        .select(*keys, F.col(f"_m.{idx}").alias(idx))
    )


def top_k_preview(df: DataFrame, k: int = S.TOP_K, score: str = "base_score", keys: Sequence[str] = S.FRAME_KEYS, idx: str = S.CANDIDATE, **nms) -> DataFrame:
    """Suppress, sort by score and keep the first ``k`` per frame, with ``rank``."""
    kept = pose_nms(df, score=score, keys=keys, idx=idx, **nms)
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(idx))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def object_cloud(
    candidates: DataFrame,
    masks: DataFrame,
    mask_pixels: DataFrame,
    points: DataFrame,
    cameras: DataFrame,
    image: tuple[int, int],
    budget: int = 512,
    cluster_radius: float = 0.03,
    input_points: int = 0,
    keys: Sequence[str] = ("frame_id",),
    **mask_rule,
) -> DataFrame:
    """Object cloud of every candidate: (keys, cand_idx, cluster_id, object_cloud).

    Candidates share one cloud per cluster. The cluster's opener, projected into
    the image, prompts for the masks that contain its pixel (``mask_pixels``);
    one is picked by area and score (``masks``), its points are thinned evenly if
    ``input_points`` is set and then sampled to ``budget``.
    """
    keys = list(keys)
    # Clusters and choices feed several branches; each is computed once.
    clusters = materialise(leader_cluster(candidates, cluster_radius, keys))
    openers = clusters.where(F.col(S.CANDIDATE) == F.col("leader_idx")).select(*keys, S.CANDIDATE, "cluster_id")
    prompts = openers.join(candidates.select(*keys, S.CANDIDATE, *XYZ), [*keys, S.CANDIDATE])
    pixels = project_to_pixel(prompts, cameras, keys, XYZ, image).where("inside")
    offered = (
        pixels.select(*keys, "cluster_id", "u", "v")
        .join(mask_pixels, [*keys, "v", "u"])
        .join(masks, [*keys, "mask_idx"])
    )
    picked = pick_mask(offered, [*keys, "cluster_id"], image[0] * image[1], **mask_rule)
    chosen = materialise(picked.where(F.col("mask_idx").isNotNull()))
    # Many clusters may pick the same mask; its cloud is sampled once.
    wanted = mask_pixels.join(chosen.select(*keys, "mask_idx").distinct(), [*keys, "mask_idx"], "left_semi")
    lifted = mask_points(points, wanted, keys).withColumn("point_idx", F.col("v") * image[1] + F.col("u"))
    per_mask = [*keys, "mask_idx"]
    if input_points > 0:
        # Only masks above the budget are thinned before sampling.
        sizes = lifted.groupBy(*per_mask).agg((F.count(F.lit(1)) > budget).alias("_over"))
        tagged = lifted.join(sizes, per_mask)
        thin = stride_subset(tagged.where("_over"), input_points, per_mask).drop("slot")
        lifted = thin.unionByName(tagged.where(~F.col("_over"))).drop("_over")
    # No mask lifts more points than its area.
    small = masks.where(F.col("area") > SAMPLE_LIMIT).isEmpty() or None
    sampled = farthest_point_sample(lifted, per_mask, budget, bounded=small)
    clouds = sampled.groupBy(*per_mask).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("slot", "x", "y", "z"))),
            lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")),
        ).alias("object_cloud")
    )
    payload = chosen.join(clouds, per_mask).select(*keys, "cluster_id", "object_cloud")
    return broadcast_cluster_payload(clusters, payload, keys)
