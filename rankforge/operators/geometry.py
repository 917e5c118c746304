"""Pixels, points, cells and pooled shells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge import schemas as S
from rankforge.functions.expressions import rotate_into, shell_id
from rankforge.plans.grid import CROWD, knn_join
from rankforge.plans.groups import GROUP_LIMIT, attach_stats, groups_bounded, rank_within, require_none
from rankforge.plans.near import distances, map_near, nearest_pairs, query_cells

FRAME = ("frame_id",)
XYZ = ("x", "y", "z")
ROTATION = tuple(f"r{i}" for i in range(9))


def depth_to_points(
    pixels: DataFrame, cameras: DataFrame, scale: float = 1000.0, frame: Sequence[str] = FRAME
) -> DataFrame:
    """Back-project depth pixels: adds ``x, y, z`` and ``valid`` (depth above zero)."""
    z = F.col("depth_mm") / F.lit(float(scale))
    return (
        pixels.join(cameras, list(frame))
        .withColumns(
            {
                "x": (F.col("u") - F.col("cx")) / F.col("fx") * z,
                "y": (F.col("v") - F.col("cy")) / F.col("fy") * z,
                "z": z,
                "valid": z > 0,
            }
        )
        .drop("fx", "fy", "cx", "cy")
    )


def workspace_filter(
    points: DataFrame, mask: DataFrame | None = None, frame: Sequence[str] = FRAME, check: bool = True
) -> DataFrame:
    """Valid pixels inside the workspace mask; without a mask all valid ones.

    Checked: a masked frame must cover the same pixels as its depth image, and
    no frame may end up empty.
    """
    frame = list(frame)
    kept = points.where("valid")
    if mask is not None:
        inside = mask.where(F.col("mask") > 0).select(*frame, "v", "u")
        if check:
            shape = [F.count(F.lit(1)).alias("n"), F.max("v").alias("v"), F.max("u").alias("u")]
            a, b = points.groupBy(*frame).agg(*shape), mask.groupBy(*frame).agg(*shape)
            require_none(a.join(b, [*frame, "n", "v", "u"], "left_anti"), "mask shape differs from depth shape")
        kept = kept.join(inside, [*frame, "v", "u"], "left_semi")
    if check:
        all_frames = points.select(*frame).distinct()
        require_none(all_frames.join(kept, frame, "left_anti"), "workspace has no valid depth points")
    return kept


def project_to_pixel(
    df: DataFrame,
    cameras: DataFrame,
    frame: Sequence[str] = FRAME,
    xyz: Sequence[str] = XYZ,
    image: tuple[int, int] | None = None,
) -> DataFrame:
    """Pinhole projection to integer ``u, v``, halves to even; behind the camera is -1, -1.

    With ``image`` (height, width) adds ``inside``.
    """
    x, y, z = (F.col(c) for c in xyz)
    ahead = z > 1e-6
    out = df.join(cameras, list(frame)).withColumns(
        {
            "u": F.when(ahead, F.rint(x * F.col("fx") / z + F.col("cx")).cast("long")).otherwise(-1),
            "v": F.when(ahead, F.rint(y * F.col("fy") / z + F.col("cy")).cast("long")).otherwise(-1),
        }
    ).drop("fx", "fy", "cx", "cy")
    if image:
        h, w = image
        out = out.withColumn("inside", F.col("u").between(0, w - 1) & F.col("v").between(0, h - 1))
    return out


def mask_points(points: DataFrame, mask_pixels: DataFrame, frame: Sequence[str] = FRAME) -> DataFrame:
    """Valid points whose pixel lies in a mask, once per mask."""
    return points.where("valid").join(mask_pixels, [*frame, "v", "u"])


def pick_mask(
    masks: DataFrame,
    keys: Sequence[str],
    image_pixels: int,
    min_area: int = 200,
    max_ratio: float = 0.4,
    floor: float = 0.0,
    mode: str = "smallest",
    idx: str = "mask_idx",
) -> DataFrame:
    """One mask per prompt: smallest valid area or best score, first on ties.

    Every prompt is kept; one without a valid mask gets NULL.
    """
    area, score = F.col("area"), F.col("score")
    top = int(max_ratio * image_pixels)
    valid = (score >= floor) & (area >= min_area) & (area <= top)
    if mode == "smallest":
        order = F.struct(area.alias("a"), F.col(idx).alias("i"))
    elif mode == "best":
        order = F.struct((-score).alias("a"), F.col(idx).alias("i"))
    else:
        raise ValueError("mode must be 'smallest' or 'best'")
    return masks.groupBy(*keys).agg(F.min(F.when(valid, order)).alias("_m")).select(*keys, F.col("_m.i").alias(idx))


def to_local_frame(pairs: DataFrame, out: Sequence[str] = ("lx", "ly", "lz"), rotation: Sequence[str] = ROTATION) -> DataFrame:
    """Coordinates of paired points in the candidate's own frame."""
    local = rotate_into("x", "y", "z", "tx", "ty", "tz", rotation)
    return pairs.withColumns(dict(zip(out, local)))


def transform_points(points: DataFrame, poses: DataFrame, keys: Sequence[str], rotation: Sequence[str] = ROTATION) -> DataFrame:
    """Model points moved by the pose of their object: ``R p + t``."""
    r = [F.col(c) for c in rotation]
    moved = {
        f"w{axis}": r[3 * i] * F.col("x") + r[3 * i + 1] * F.col("y") + r[3 * i + 2] * F.col("z") + F.col(f"t{axis}")
        for i, axis in enumerate("xyz")
    }
    return points.join(poses, list(keys)).withColumns(moved).drop(*rotation, "tx", "ty", "tz")


def voxel_downsample(
    points: DataFrame, size: float, frame: Sequence[str] = FRAME, origin: str = "zero", xyz: Sequence[str] = XYZ
) -> DataFrame:
    """One mean point per voxel; ``origin='min'`` anchors the grid at the cloud minimum."""
    frame = list(frame)
    rows = points
    start = {c: F.lit(0.0) for c in xyz}
    if origin == "min":
        low = points.groupBy(*frame).agg(*[F.min(c).alias(f"_o{c}") for c in xyz])
        rows = points.join(low, frame)
        start = {c: F.col(f"_o{c}") for c in xyz}
    elif origin != "zero":
        raise ValueError("origin must be 'zero' or 'min'")
    cell = [F.floor((F.col(c) - start[c]) / F.lit(size)).alias(f"v{c}") for c in xyz]
    return rows.groupBy(*frame, *cell).agg(*[F.avg(c).alias(c) for c in xyz], F.count(F.lit(1)).alias("points"))


def nearest_join(
    queries: DataFrame,
    points: DataFrame,
    label: str = "label",
    max_dist: float | None = None,
    radius: float | None = None,
    keys: Sequence[str] = FRAME,
    query_id: str = "cand_idx",
    point_id: str = "point_idx",
) -> DataFrame:
    """Label of the nearest point of the frame; -1 without one or at ``max_dist`` or farther."""
    keys = list(keys)
    if max_dist is not None:
        pairs = nearest_pairs(queries, points, max_dist, 1, keys, query_id, point_id, strict=True, payload=[label])
        best = pairs.groupBy(*keys, query_id).agg(
            F.min(F.struct(F.col("_d2").alias("d2"), F.col(point_id).alias("_id"), F.col(label).alias("_label"))).alias("_b")
        )
        near = best.select(*keys, query_id, F.col("_b._label").alias("nearest_label"), F.sqrt("_b.d2").alias("distance"))
    else:
        near = knn_join(queries, points, 1, radius, keys, query_id, point_id, payload=[label]).select(
            *keys, query_id, F.col(label).alias("nearest_label"), F.sqrt("d2").alias("distance")
        )
    out = queries.select(*keys, query_id).join(near, [*keys, query_id], "left")
    return out.withColumn("nearest_label", F.coalesce("nearest_label", F.lit(-1)))


def knn_groups(
    centroids: DataFrame,
    points: DataFrame,
    k: int = 32,
    radius: float | None = None,
    keys: Sequence[str] = FRAME,
    query_id: str = "cand_idx",
    point_id: str = "point_idx",
) -> DataFrame:
    """``k`` slots per centroid with offsets of its nearest points; spare slots are zero."""
    near = knn_join(centroids, points, k, radius, keys, query_id, point_id, payload=XYZ)
    lists = near.groupBy(*keys, query_id).agg(
        F.map_from_entries(F.collect_list(F.struct("nn", F.struct(*XYZ, F.col(point_id).alias("p"))))).alias("_m")
    )
    slots = (
        centroids.select(*keys, query_id, "tx", "ty", "tz")
        .join(lists, [*keys, query_id], "left")
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("_p", F.col("_m")[F.col("slot")])
    )
    return slots.select(
        *keys,
        query_id,
        "slot",
        F.col("_p.p").alias(point_id),
        *[
            F.coalesce(F.col(f"_p.{a}") - F.col(f"t{a}"), F.lit(0.0)).alias(f"d{a}")
            for a in XYZ
        ],
    )


def nearest_p_sample(
    points: DataFrame,
    p: int,
    group: Sequence[str],
    idx: str = "point_idx",
    xyz: Sequence[str] = ("lx", "ly", "lz"),
) -> DataFrame:
    """The ``p`` points nearest the origin; groups of at most ``p`` keep their order. Adds ``slot``."""
    group = list(group)
    d2 = sum((F.col(c) * F.col(c) for c in xyz[1:]), F.col(xyz[0]) * F.col(xyz[0]))
    near = Window.partitionBy(*group).orderBy("_d2", idx)
    first = points.withColumn("_d2", d2).withColumn("_rd", F.row_number().over(near)).where(F.col("_rd") <= p + 1)
    # At most p + 1 rows per group are left, enough to tell a full group from a cut one.
    full = F.count(F.lit(1)).over(Window.partitionBy(*group)) <= p
    by_index = F.row_number().over(Window.partitionBy(*group).orderBy(idx))
    slot = F.when(F.col("_all"), by_index).otherwise(F.col("_rd")) - 1
    return first.withColumn("_all", full).withColumn("slot", slot).where(F.col("slot") < p).drop("_d2", "_rd", "_all")


def nearest_p_around(
    queries: DataFrame,
    points: DataFrame,
    radius: float,
    p: int,
    keys: Sequence[str] = FRAME,
    query_id: str = "cand_idx",
    point_id: str = "point_idx",
    limit: int = CROWD,
) -> DataFrame:
    """``nearest_p_sample`` over all pairs within ``radius``, each query's in its own frame, without a row per pair.

    Columns: keys, both ids, ``slot``.
    """
    group = [*keys, query_id]
    # One more than p tells a full group from a cut one.
    near = nearest_pairs(queries, points, radius, p + 1, keys, query_id, point_id, rotation=ROTATION, limit=limit)
    by_distance = Window.partitionBy(*group).orderBy("_d2", point_id)
    by_index = Window.partitionBy(*group).orderBy(point_id)
    ranked = near.withColumns(
        {"_rd": F.row_number().over(by_distance), "_ri": F.row_number().over(by_index), "_n": F.count(F.lit(1)).over(Window.partitionBy(*group))}
    )
    slot = F.when(F.col("_n") <= p, F.col("_ri")).otherwise(F.col("_rd")) - 1
    return ranked.withColumn("slot", slot).where(F.col("slot") < p).drop("_d2", "_rd", "_ri", "_n")


def stride_subset(
    points: DataFrame,
    limit_points: int,
    group: Sequence[str] = FRAME,
    order: Sequence[str] = ("point_idx",),
    variant: str = "truncate",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Evenly spaced rows of each group in order, with ``slot``.

    ``truncate`` keeps short groups whole and a non-positive limit keeps all;
    ``round`` rounds positions to even halves and repeats short groups cyclically.
    """
    group = list(group)
    if variant not in ("truncate", "round"):
        raise ValueError("variant must be 'truncate' or 'round'")
    bounded = groups_bounded(points, group, limit)
    ranked = rank_within(points, group, [F.asc(c) for c in order], "_rn", limit, bounded)
    if limit_points <= 0:
        return ranked.withColumn("slot", F.col("_rn") - 1).drop("_rn")
    sized = attach_stats(ranked, group, {"_n": F.count(F.lit(1))}, bounded)
    at, n, m = F.col("_rn") - 1, F.col("_n"), limit_points
    step = (n - 1) / F.lit(float(max(m - 1, 1)))
    place = F.floor if variant == "truncate" else F.rint

    def position(i):
        return F.when(i == m - 1, n - 1 if m > 1 else F.lit(0)).otherwise(place(i * step)).cast("long")

    # The slot of a row is one of the three around row / step; no grid is joined.
    guess = F.floor(F.try_divide(at, step))
    near = [guess + d for d in (-1, 0, 1, 2)]
    slot = F.coalesce(*[F.when((i >= 0) & (i < m) & (position(i) == at), i) for i in near])
    if m == 1:
        slot = F.when(at == 0, F.lit(0))
    if variant == "truncate":
        slots = F.when(n <= m, F.array(at)).when(slot.isNotNull(), F.array(slot.cast("long")))
    else:
        repeats = F.transform(
            F.sequence(F.lit(0).cast("long"), F.floor((F.lit(m) - 1 - at) / F.greatest(n, F.lit(1)))), lambda r: at + r * n
        )
        cyclic = F.when(at < m, repeats)
        slots = F.when(n < m, cyclic).when(slot.isNotNull(), F.array(slot.cast("long")))
    return sized.withColumn("_slots", slots).where(F.col("_slots").isNotNull()).select(
        *points.columns, F.explode("_slots").alias("slot")
    )


def unit_sphere(
    points: DataFrame, cloud: Sequence[str] = FRAME, xyz: Sequence[str] = XYZ, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Centre each cloud on its mean and scale the farthest point to radius one (floor 1e-6)."""
    bounded = groups_bounded(points, cloud, limit)
    centred = attach_stats(points, cloud, {f"_m{c}": F.avg(c) for c in xyz}, bounded)
    centred = centred.withColumns({f"u{c}": F.col(c) - F.col(f"_m{c}") for c in xyz})
    r = F.sqrt(sum((F.col(f"u{c}") * F.col(f"u{c}") for c in xyz[1:]), F.col(f"u{xyz[0]}") * F.col(f"u{xyz[0]}")))
    scaled = attach_stats(centred.withColumn("_r", r), cloud, {"_s": F.max("_r")}, bounded)
    floor = F.greatest(F.col("_s"), F.lit(1e-6))
    return scaled.withColumns({f"u{c}": F.col(f"u{c}") / floor for c in xyz}).drop(
        "_r", "_s", *[f"_m{c}" for c in xyz]
    )


def shell_pool(
    points: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    candidates: DataFrame | None = None,
    radius: str = "radius",
    edges: Sequence[float] = S.SHELL_EDGES,
) -> DataFrame:
    """Per candidate: maximum per shell, shell alive flags, overall maximum and mean.

    Shells are an aggregation condition, so one shuffle serves all of them. A
    dead shell has NULL maxima; a candidate without points has zeros.
    """
    keys = list(keys)
    rows = points.withColumn("_shell", shell_id(radius, edges, side="left"))
    shells = range(len(edges) - 1)
    aggs = [F.max(F.when(F.col("_shell") == s, F.col(f))).alias(f"{f}_shell{s}") for s in shells for f in features]
    aggs += [F.count_if(F.col("_shell") == s).alias(f"_n{s}") for s in shells]
    aggs += [F.max(f).alias(f"{f}_max") for f in features] + [F.avg(f).alias(f"{f}_mean") for f in features]
    return _pool_columns(rows.groupBy(*keys).agg(*aggs), features, keys, candidates, shells)


def _pool_columns(pooled: DataFrame, features: Sequence[str], keys: list[str], candidates: DataFrame | None, shells: range) -> DataFrame:
    if candidates is not None:
        pooled = candidates.select(*keys).distinct().join(pooled, keys, "left")
        zeros = [f"{f}_{a}" for f in features for a in ("max", "mean")]
        none = F.col("_n0").isNull()
        pooled = pooled.withColumns(
            {
                **{c: F.coalesce(c, F.lit(0.0)) for c in zeros},
                **{f"{f}_shell{s}": F.when(none, F.lit(0.0)).otherwise(F.col(f"{f}_shell{s}")) for s in shells for f in features},
            }
        )
    alive = {f"alive{s}": F.coalesce(F.col(f"_n{s}") > 0, F.lit(False)) for s in shells}
    return pooled.withColumns(alive).drop(*[f"_n{s}" for s in shells])


def shell_pool_around(
    queries: DataFrame,
    points: DataFrame,
    features: Sequence[str],
    radius: float = S.SHELL_EDGES[-1],
    keys: Sequence[str] = FRAME,
    query_id: str = "cand_idx",
    edges: Sequence[float] = S.SHELL_EDGES,
    limit: int = CROWD,
) -> DataFrame:
    """``shell_pool`` of all points within ``radius`` of each query, without a row per pair.

    ``features`` are number columns of the points. Points that come in several calls
    give partial results, which one aggregate adds up.
    """
    keys, shells, reach = list(keys), range(len(edges) - 1), radius * radius
    q = queries.select(*keys, query_id, "tx", "ty", "tz")
    values = [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]
    p = points.select(*keys, "x", "y", "z", *values, *[F.col(f).isNull().alias(f"_e{i}") for i, f in enumerate(features)])
    maxima = [f"_m{i}_{s}" for i in range(len(features)) for s in shells]
    sums, filled, counts = ([f"{n}{i}" for i in range(m)] for n, m in (("_s", len(features)), ("_c", len(features)), ("_n", len(shells))))
    # What a query lacks is null, not NaN: NaN is a value that features may have.
    kinds = {n: "double" for n in (*maxima, *sums)} | {n: "long" for n in (*filled, *counts)}
    schema = T.StructType([*q.schema.fields[: len(keys) + 1], *T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in kinds.items())).fields])

    def pool(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        held = [(near[f"_f{i}"].to_numpy(np.float64), ~near[f"_e{i}"].to_numpy(bool)) for i in range(len(features))]
        found = []
        for i, d2 in distances(mine, near):
            at = np.flatnonzero(d2 <= reach)
            shell = np.searchsorted(np.asarray(edges[1:-1], np.float64), np.sqrt(d2[at]), side="left")
            parts = [at[shell == s] for s in shells]
            row: list = [i]
            for value, real in held:
                row += [value[part][real[part]].max() if real[part].any() else None for part in parts]
            row += [value[at][real[at]].sum() for value, real in held]
            row += [int(real[at].sum()) for _, real in held] + [len(part) for part in parts]
            if len(at):
                found.append(row)
        out = pd.DataFrame(found, columns=["_at", *kinds]).astype({n: object for n in maxima})
        own = mine[[*keys, query_id]].iloc[out["_at"].to_numpy(np.int64)].reset_index(drop=True)
        return pd.concat([own, out.drop(columns="_at")], axis=1)

    parts = map_near(q, p, query_cells(q, p, radius, keys), radius, keys, pool, schema, limit=limit)
    who = [*keys, query_id]
    total = parts.groupBy(*who).agg(*[F.max(n).alias(n) for n in maxima], *[F.sum(n).alias(n) for n in (*sums, *filled, *counts)])
    pooled = total.select(
        *who,
        *[F.col(f"_m{i}_{s}").alias(f"{f}_shell{s}") for s in shells for i, f in enumerate(features)],
        *counts,
        *[F.greatest(*[F.col(f"_m{i}_{s}") for s in shells]).alias(f"{f}_max") for i, f in enumerate(features)],
        *[(F.col(f"_s{i}") / F.nullif(F.col(f"_c{i}"), F.lit(0))).alias(f"{f}_mean") for i, f in enumerate(features)],
    )
    return _pool_columns(pooled, features, who, queries, shells)
