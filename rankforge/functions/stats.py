"""Aggregate statistics: numeric, boolean, mergeable, losses and latencies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.functions.expressions import bce_with_logits, col, is_finite, smooth_l1
from rankforge.plans.groups import GROUP_LIMIT, beyond_first, exact_quantiles, groups_bounded

QUANTILES = {"p05": 0.05, "p50": 0.50, "p95": 0.95}


def moment_aggs(c: Column | str, prefix: str = "") -> list[Column]:
    """Counts over all values; min, max, mean and population std over finite ones."""
    value = col(c).cast("double")
    good = F.when(is_finite(value), value)
    total = F.count(F.lit(1))
    return [
        total.alias(f"{prefix}count"),
        F.count(good).alias(f"{prefix}finite_count"),
        (total - F.count(good)).alias(f"{prefix}nonfinite_count"),
        F.min(good).alias(f"{prefix}min"),
        F.max(good).alias(f"{prefix}max"),
        F.avg(good).alias(f"{prefix}mean"),
        F.stddev_pop(good).alias(f"{prefix}std"),
    ]


def numeric_stats(
    df: DataFrame,
    columns: str | Sequence[str],
    by: Sequence[str] = (),
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """One row per group and column: counts, extrema, moments and quantiles.

    Several columns are unpivoted first, so all share one aggregation.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    keys = [*by, "column"]
    long = df.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias("value")) for n in names])
        ).alias("_e"),
    ).select(*by, "_e.column", "_e.value")
    value = F.when(is_finite("value"), F.col("value"))
    if groups_bounded(long, keys, limit):
        out = long.groupBy(*keys).agg(
            *moment_aggs("value"),
            *[F.percentile(value, F.lit(q)).alias(n) for n, q in QUANTILES.items()],
        )
    else:
        moments = long.groupBy(*keys).agg(*moment_aggs("value"))
        quantiles = exact_quantiles(long, keys, value, QUANTILES, limit, bounded=False)
        out = moments.join(quantiles, keys, "left")
    return out if by else _every_column(out, names)


def _every_column(stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row for each requested column, with zero counts when the table is empty."""
    wanted = stats.sparkSession.createDataFrame([(n,) for n in names], "column string")
    return wanted.join(stats, "column", "left").fillna(0, [c for c in stats.columns if c.endswith("count")])


def boolean_stats(df: DataFrame, columns: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group and flag: counts and rates of true and false."""
    names = [columns] if isinstance(columns, str) else list(columns)
    long = df.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("column"), F.coalesce(F.col(n), F.lit(False)).alias("flag"))
                    for n in names
                ]
            )
        ).alias("_e"),
    ).select(*by, "_e.column", "_e.flag")
    total, true = F.count(F.lit(1)), F.count_if("flag")
    out = long.groupBy(*by, "column").agg(
        total.alias("count"),
        true.alias("true_count"),
        (total - true).alias("false_count"),
        (true / total).alias("true_rate"),
        ((total - true) / total).alias("false_rate"),
    )
    return out if by else _every_column(out, names)


def mergeable_stats(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Sufficient statistics per shard that later merge with sum, min and max."""
    value = F.col(c).cast("double")
    good = F.when(is_finite(value), value)
    total = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        total.alias("count"),
        F.count(good).alias("finite_count"),
        (total - F.count(good)).alias("nonfinite_count"),
        F.min(good).alias("min"),
        F.max(good).alias("max"),
        F.coalesce(F.sum(good), F.lit(0.0)).alias("sum"),
        F.coalesce(F.sum(good * good), F.lit(0.0)).alias("sumsq"),
    )


def merge_stats(partials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merge stored partial statistics; quantiles cannot be merged and stay NULL."""
    n = F.sum("finite_count")
    mean = F.when(n > 0, F.sum("sum") / n)
    var = F.greatest(F.sum("sumsq") / n - mean * mean, F.lit(0.0))
    return partials.groupBy(*by).agg(
        F.sum("count").alias("count"),
        n.alias("finite_count"),
        F.sum("nonfinite_count").alias("nonfinite_count"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        mean.alias("mean"),
        F.when(n > 0, F.sqrt(var)).alias("std"),
        *[F.lit(None).cast("double").alias(q) for q in QUANTILES],
    )


def latency_summary(
    batches: DataFrame,
    ms: str,
    ordinal: str | Sequence[str],
    frames: str | None = None,
    by: Sequence[str] = (),
    warmup: int = 5,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Latency statistics after dropping the first ``warmup`` batches of a run.

    ``ordinal`` names the number of a batch in its run, or the columns by which batches
    follow each other; then only the first ones are ranked. With ``frames`` (batch size) a second row family reports time per frame.
    """
    if isinstance(ordinal, str):
        kept = batches.where(F.col(ordinal) >= warmup)
    else:
        kept = beyond_first(batches, by, ordinal, warmup)
    families = [F.struct(F.lit("batch").alias("unit"), F.col(ms).cast("double").alias("ms"))]
    if frames:
        families.append(
            F.struct(F.lit("frame").alias("unit"), (F.col(ms) / F.col(frames)).cast("double").alias("ms"))
        )
    long = kept.select(*by, F.explode(F.array(*families)).alias("_e")).select(*by, "_e.unit", "_e.ms")
    keys = [*by, "unit"]
    quantiles = {"median_ms": 0.5, "p95_ms": 0.95}
    moments = [
        F.count("ms").alias("count"),
        F.avg("ms").alias("mean_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
        F.stddev_pop("ms").alias("std_ms"),
    ]
    if groups_bounded(batches, by, limit):
        out = long.groupBy(*keys).agg(*moments, *[F.percentile("ms", F.lit(q)).alias(n) for n, q in quantiles.items()])
    else:
        out = long.groupBy(*keys).agg(*moments).join(
            exact_quantiles(long, keys, F.col("ms"), quantiles, limit, bounded=False), keys
        )
    return out.select(*keys, "count", *[F.round(c, 4).alias(c) for c in out.columns if c.endswith("_ms")])


def progress_report(log: DataFrame, by: Sequence[str], done: Column, elapsed: str) -> DataFrame:
    """Work done, percent, rate and time left per run; no rate means no estimate."""
    total, finished = F.count(F.lit(1)), F.count_if(done)
    seconds = F.max(elapsed)
    rate = F.when(seconds > 0, finished / seconds).otherwise(F.lit(0.0))
    return log.groupBy(*by).agg(
        finished.alias("done"),
        total.alias("total"),
        F.round(F.lit(100.0) * finished / F.greatest(total, F.lit(1)), 2).alias("percent"),
        F.round(rate, 3).alias("rate"),
        F.round(seconds, 1).alias("elapsed_sec"),
        F.round(F.when(rate > 0, (total - finished) / rate), 1).alias("eta_sec"),
    )


def _object_terms():
    """Cross entropy of a row's logits with its class (null: none) and whether the first largest is that class."""

    def of_row(row: list | None, at: int | None) -> tuple[float | None, float | None]:
        real = [x for x in row or () if x is not None]
        if at is None or not real:
            return None, None
        if at >= len(row):
            raise ValueError(f"object class {at} of {len(row)} logits")
        # As in Spark's order, NaN is the largest number and equal to itself.
        top = max(real, key=lambda x: (x != x, x))
        first = next(i for i, x in enumerate(row) if x is not None and (x == top or (x != x and top != top)))
        if len(real) < len(row):
            return None, float(first == at)
        v = np.asarray(row, dtype=np.float64)
        with np.errstate(all="ignore"):
            return float(top + np.log(np.exp(v - top).sum()) - v[at]), float(first == at)

    @F.arrow_udf("struct<nll double, hit double>")
    def terms(logits: pa.Array, object_id: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(logits), 0).to_numpy()
        flat = logits.flatten()
        numbers = flat.to_numpy(zero_copy_only=False)
        width = int(sizes[0]) if len(sizes) else 0
        at = pc.fill_null(object_id, -1).to_numpy()
        known = at >= 0
        if width and (sizes == width).all() and not flat.null_count and np.isfinite(numbers).all() and (at < width).all():
            v = numbers.reshape(-1, width)[known]
            rows, own = np.arange(len(v)), at[known]
            top = v.max(axis=1)
            nll, hit = np.zeros(len(at)), np.zeros(len(at))
            nll[known] = top + np.log(np.exp(v - top[:, None]).sum(axis=1)) - v[rows, own]
            hit[known] = v.argmax(axis=1) == own
            columns = [pa.array(nll, mask=~known), pa.array(hit, mask=~known)]
        else:
            found = [of_row(*x) for x in zip(logits.to_pylist(), object_id.to_pylist())]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
        return pa.StructArray.from_arrays(columns, ["nll", "hit"])

    return terms


def multitask_loss(
    df: DataFrame,
    *,
    pred: str = "pred",
    target: str = "target",
    collision_logit: str = "collision_logit",
    collision: str = "is_collision",
    empty_logit: str = "empty_logit",
    empty: str = "is_empty",
    object_logits: str | None = "object_logits",
    object_id: str = "object_id",
    by: Sequence[str] = (),
) -> DataFrame:
    """Score, collision, empty and object losses with their weighted total.

    ``object_logits`` is an array column; rows without an object are ignored in
    the object loss and in its accuracy.
    """
    labelled = F.col(object_id) >= 0 if object_logits else F.lit(False)
    if object_logits:
        compared = _object_terms()(F.col(object_logits).cast("array<double>"), F.when(labelled, F.col(object_id).cast("int")))
        df = df.withColumn("_object", compared)
        loss_obj = F.avg("_object.nll")
        accuracy = F.avg("_object.hit")
    else:
        loss_obj = F.lit(None).cast("double")
        accuracy = F.lit(None).cast("double")
    parts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.avg(smooth_l1(pred, target)).alias("loss_score"),
        F.avg(bce_with_logits(collision_logit, collision)).alias("loss_coll"),
        F.avg(bce_with_logits(empty_logit, empty)).alias("loss_empty"),
        loss_obj.alias("loss_obj"),
        accuracy.alias("obj_acc_top1"),
    )
    total = (
        F.col("loss_score")
        + F.lit(S.LOSS_WEIGHTS["collision"]) * F.col("loss_coll")
        + F.lit(S.LOSS_WEIGHTS["empty"]) * F.col("loss_empty")
        + F.lit(S.LOSS_WEIGHTS["object"]) * F.coalesce(F.col("loss_obj"), F.lit(0.0))
    )
    return parts.withColumn("loss", total)


def pred_target_stats(
    df: DataFrame,
    pred: str = "pred",
    target: str = "target",
    by: Sequence[str] = (),
    collapse_std: float = 1e-4,
) -> DataFrame:
    """Mean, spread, correlation with the target and a flag for constant output."""
    n = F.count(F.lit(1))
    p, t = F.col(pred).cast("double"), F.col(target).cast("double")
    sums = {"sp": p, "spp": p * p, "st": t, "stt": t * t, "spt": p * t}
    agg = df.groupBy(*by).agg(n.alias("num_samples"), *[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    m = {k: F.col(f"_{k}") / F.col("num_samples") for k in sums}
    var_p = F.greatest(m["spp"] - m["sp"] * m["sp"], F.lit(0.0))
    var_t = F.greatest(m["stt"] - m["st"] * m["st"], F.lit(0.0))
    spread = F.sqrt(var_p * var_t)
    return agg.select(
        *by,
        "num_samples",
        m["sp"].alias("pred_mean"),
        F.sqrt(var_p).alias("pred_std"),
        F.when((F.col("num_samples") > 1) & (spread > 1e-12), (m["spt"] - m["sp"] * m["st"]) / spread).alias(
            "pred_target_corr"
        ),
        (F.sqrt(var_p) <= collapse_std).alias("score_collapse"),
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
