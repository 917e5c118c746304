"""Normalise, fuse and rank the candidates of every frame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge import schemas as S
from rankforge.functions.expressions import INF, check_weight, fuse
from rankforge.operators.evaluation import ap_weight_expr
from rankforge.plans.groups import (
    GROUP_LIMIT,
    attach_stats,
    groups_bounded,
    rank_within,
    require_none,
    scan_within,
)


def zscore(
    df: DataFrame,
    columns: dict[str, str],
    keys: Sequence[str] = S.FRAME_KEYS,
    limit: int = GROUP_LIMIT,
    bounded: bool | None = None,
) -> DataFrame:
    """Per-frame z-score with population std; a constant frame becomes zero.

    ``columns`` maps output name to input name.
    """
    if bounded is None:
        bounded = groups_bounded(df, keys, limit)
    stats = {}
    for out, src in columns.items():
        value = F.col(src).cast("double")
        stats[f"_m_{out}"] = F.avg(value)
        stats[f"_s_{out}"] = F.stddev_pop(value)
    rows = attach_stats(df, keys, stats, bounded)
    scaled = {
        out: F.when(F.col(f"_s_{out}") <= S.STD_FLOOR, F.lit(0.0)).otherwise(
            (F.col(src).cast("double") - F.col(f"_m_{out}")) / F.col(f"_s_{out}")
        )
        for out, src in columns.items()
    }
    return rows.withColumns(scaled).drop(*stats)


def rank_candidates(
    df: DataFrame,
    score: str = "fused",
    keys: Sequence[str] = S.FRAME_KEYS,
    idx: str = S.CANDIDATE,
    out: str = "rank",
    limit: int = GROUP_LIMIT,
    bounded: bool | None = None,
) -> DataFrame:
    """Descending rank by score; ties keep detector order; nothing is dropped."""
    return rank_within(df, keys, [F.desc(score), F.asc(idx)], out, limit, bounded)


@F.pandas_udf(T.LongType())
def float_order(score: pd.Series) -> pd.Series:
    """Integer whose order and unit steps are those of neighbouring float32 values."""
    bits = score.to_numpy(dtype=np.float32).view(np.int32).astype(np.int64)
    return pd.Series(np.where(bits < 0, -(bits & 0x7FFFFFFF), bits))


@F.pandas_udf(T.FloatType())
def float_from_order(order: pd.Series) -> pd.Series:
    k = order.to_numpy(dtype=np.int64)
    bits = np.where(k < 0, np.abs(k) | 0x80000000, k).astype(np.uint32)
    return pd.Series(bits.view(np.float32))


def strictly_descending(
    df: DataFrame,
    score: str = "fused",
    rank: str = "rank",
    keys: Sequence[str] = S.FRAME_KEYS,
    out: str = "export_score",
    limit: int = GROUP_LIMIT,
    bounded: bool | None = None,
) -> DataFrame:
    """Lower each score that does not fall below its predecessor by one float32 step.

    On order-preserving integers the chain is a running minimum of
    ``value + rank``, so it needs no sequential pass.
    """
    keyed = df.withColumn("_k", float_order(F.col(score).cast("float")))
    low = scan_within(
        keyed,
        keys,
        [F.asc(rank)],
        {"_low": ("min", F.col("_k") + F.col(rank))},
        limit,
        bounded,
    )
    return low.withColumn(out, float_from_order(F.col("_low") - F.col(rank))).drop("_k", "_low")


def first_argmax(score: str, idx: str = S.CANDIDATE) -> Column:
    """Index of the largest score, the first one on ties."""
    return F.max_by(idx, F.struct(F.col(score), -F.col(idx)))


def top1_change(
    df: DataFrame,
    base: str = "base_score",
    fused: str = "fused",
    keys: Sequence[str] = S.FRAME_KEYS,
    idx: str = S.CANDIDATE,
    frames: DataFrame | None = None,
) -> DataFrame:
    """Top candidate before and after, and whether it changed.

    Frames listed in ``frames`` without candidates report no change.
    """
    tops = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        first_argmax(base, idx).alias("base_top1_idx"),
        first_argmax(fused, idx).alias("final_top1_idx"),
    )
    if frames is not None:
        tops = frames.select(*keys).join(tops, list(keys), "left").fillna(0, ["candidate_count"])
    changed = F.coalesce(F.col("base_top1_idx") != F.col("final_top1_idx"), F.lit(False))
    return tops.withColumn("top1_changed", changed)


def restore_order(
    df: DataFrame,
    position: str = "original_idx",
    keys: Sequence[str] = S.FRAME_KEYS,
) -> DataFrame:
    """Check that ``position`` is a permutation 0..n-1 in every frame and order by it."""
    keys = list(keys)
    shape = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(position).alias("distinct"),
        F.min(position).alias("lo"),
        F.max(position).alias("hi"),
    )
    require_none(
        shape.where((F.col("n") != F.col("distinct")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)),
        "original indices must be a permutation of 0..n-1",
    )
    return df.orderBy(*keys, position)


def match_rows(
    source: DataFrame,
    selected: DataFrame,
    content: Sequence[str],
    source_idx: str,
    selected_idx: str,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Source index of every selected row by full-row equality.

    Equal rows are consumed in order; a selected row without a partner is an error.
    """
    content = list(content)
    left = rank_within(
        selected.select(*content, selected_idx), content, [F.asc(selected_idx)], "_copy", limit
    )
    right = rank_within(
        source.select(*content, source_idx), content, [F.asc(source_idx)], "_copy", limit
    ).select(*[F.col(c).alias(f"_s_{c}") for c in content], F.col("_copy").alias("_s_copy"), source_idx)
    on = F.col("_copy") == F.col("_s_copy")
    for c in content:
        on = on & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    matched = left.join(right, on, "left").select(*content, selected_idx, source_idx)
    require_none(matched.where(F.col(source_idx).isNull()), "selected rows without a source row")
    return matched


def rerank(
    df: DataFrame,
    lam: float,
    base: str = "base_score",
    model: str = "model_score",
    keys: Sequence[str] = S.FRAME_KEYS,
    idx: str = S.CANDIDATE,
    export: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Normalise both scores, fuse them and rank every candidate.

    Adds ``base_z``, ``model_z``, ``fused``, ``rank`` and, with ``export``, the
    strictly descending ``export_score``. Small frames use one shuffle for all.
    """
    check_weight(lam)
    bounded = groups_bounded(df, keys, limit)
    scaled = zscore(df, {"base_z": base, "model_z": model}, keys, limit, bounded)
    fused = scaled.withColumn("fused", fuse("base_z", "model_z", lam))
    ranked = rank_candidates(fused, "fused", keys, idx, "rank", limit, bounded)
    if export:
        ranked = strictly_descending(ranked, "fused", "rank", keys, "export_score", limit, bounded)
    return ranked


def first_step(mu: Column, frictions: Sequence[float]) -> Column:
    """Position of the smallest friction that holds, NULL if none does."""
    expr = F.lit(None).cast("int")
    for j in range(len(frictions) - 1, -1, -1):
        expr = F.when(mu <= F.lit(float(frictions[j])), F.lit(j)).otherwise(expr)
    return expr


def lambda_sweep(
    df: DataFrame,
    weights: Sequence[float] = S.SWEEP_WEIGHTS,
    base: str = "base_score",
    model: str = "model_score",
    mu: str = "mu_min",
    keys: Sequence[str] = S.FRAME_KEYS,
    idx: str = S.CANDIDATE,
    k: int = S.TOP_K,
    frictions: Sequence[float] = S.FRICTIONS,
    limit: int = GROUP_LIMIT,
    frames: DataFrame | None = None,
) -> DataFrame:
    """AP of every frame, weight and friction from one scan of the candidates.

    Columns: keys, ``lam``, ``friction``, ``ap``. Scores are normalised once.
    Small frames are shuffled once and sorted once per weight; with large frames
    the weights are exploded and each map task keeps its own top ``k`` first.
    Frames in ``frames`` without candidates score zero everywhere.
    """
    weights = [check_weight(w) for w in weights]
    keys = list(keys)
    if frames is not None:
        cells = lambda_sweep(df, weights, base, model, mu, keys, idx, k, frictions, limit)
        absent = frames.select(*keys).distinct().join(df.select(*keys).distinct(), keys, "left_anti")
        grid = absent.withColumn("lam", F.explode(F.array(*[F.lit(w) for w in weights]))).withColumn(
            "friction", F.explode(F.array(*[F.lit(float(f)) for f in frictions]))
        )
        return cells.unionByName(grid.withColumn("ap", F.lit(0.0)))
    bounded = groups_bounded(df, keys, limit)
    narrow = df.select(*keys, idx, base, model, mu)
    scaled = zscore(narrow, {"base_z": base, "model_z": model}, keys, limit, bounded)
    usable = F.col(mu) > 0
    if bounded:
        ranks = {
            f"_r{i}": F.row_number().over(
                Window.partitionBy(*keys).orderBy(fuse("base_z", "model_z", w).desc(), F.asc(idx))
            )
            for i, w in enumerate(weights)
        }
        # A hit counts for its own friction step and all larger ones: sum per step
        # first, then accumulate over the few steps of a frame.
        step = F.when(usable, first_step(F.col(mu), frictions)).alias("_step")
        sums = [
            F.sum(F.when(F.col(f"_r{i}") <= k, ap_weight_expr(F.col(f"_r{i}"), k))).alias(f"_a{i}")
            for i in range(len(weights))
        ]
        ranked = scaled.select(*keys, step, *[r.alias(n) for n, r in ranks.items()])
        steps = ranked.groupBy(*keys, "_step").agg(*sums)
        entries = [F.struct(F.lit(w).alias("lam"), F.col(f"_a{i}").alias("_a")) for i, w in enumerate(weights)]
        long = steps.select(*keys, "_step", F.explode(F.array(*entries)).alias("_e")).select(*keys, "_step", "_e.*")
        cells = long.groupBy(*keys, "lam").agg(
            *[
                F.coalesce(F.sum(F.when(F.col("_step") <= j, F.col("_a"))), F.lit(0.0)).alias(f"_f{j}")
                for j in range(len(frictions))
            ]
        )
        per = [F.struct(F.lit(f).alias("friction"), F.col(f"_f{j}").alias("ap")) for j, f in enumerate(frictions)]
        return cells.select(*keys, "lam", F.explode(F.array(*per)).alias("_e")).select(*keys, "lam", "_e.*")
    lam = F.explode(F.array(*[F.lit(w) for w in weights])).alias("lam")
    wide = scaled.select(*keys, idx, mu, "base_z", "model_z", lam).withColumn(
        "fused", (1 - F.col("lam")) * F.col("base_z") + F.col("lam") * F.col("model_z")
    )
    order = Window.partitionBy("lam", *keys).orderBy(F.desc("fused"), F.asc(idx))
    top = wide.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return (
        top.groupBy("lam", *keys)
        .agg(
            *[
                F.coalesce(
                    F.sum(F.when(usable & (F.col(mu) <= F.lit(f)), ap_weight_expr(F.col("_r"), k))), F.lit(0.0)
                ).alias(f"_a{j}")
                for j, f in enumerate(frictions)
            ]
        )
        .select(
            *keys,
            "lam",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(f).alias("friction"), F.col(f"_a{j}").alias("ap"))
                        for j, f in enumerate(frictions)
                    ]
                )
            ).alias("_e"),
        )
        .select(*keys, "lam", "_e.*")
    )


def minmax_color(
    df: DataFrame,
    score: str,
    keys: Sequence[str] = S.FRAME_KEYS,
    out: str = "color",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Scale a score to [0, 1] per frame; non-finite counts as 0, a flat frame as 0.5."""
    value = F.col(score).cast("double")
    clean = F.when(F.isnan(value) | value.isNull() | (F.abs(value) == INF), F.lit(0.0)).otherwise(value)
    rows = attach_stats(
        df.withColumn("_c", clean),
        keys,
        {"_lo": F.min("_c"), "_hi": F.max("_c")},
        groups_bounded(df, keys, limit),
    )
    flat = F.col("_hi") <= F.col("_lo")
    return rows.withColumn(
        out,
        F.when(flat, F.lit(0.5)).otherwise((F.col("_c") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))),
    ).drop("_c", "_lo", "_hi")
