"""User callbacks, model fitting, reliance on features and checkpoint choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge import schemas as S
from rankforge.functions.expressions import hash_order, quality_target
from rankforge.plans.groups import (
    GROUP_LIMIT,
    attach_stats,
    groups_bounded,
    rank_within,
    require_none,
    scan_within,
)
from rankforge.session import materialise


def label_with(
    df: DataFrame,
    fn: Callable[[pd.DataFrame, dict], dict[str, np.ndarray]],
    schema: str,
    keys: Sequence[str] = S.FRAME_KEYS,
    idx: str = S.CANDIDATE,
    rows_per_call: int | None = None,
) -> DataFrame:
    """Label columns from a callback ``(candidates of a frame, meta) -> columns``.

    ``schema`` names the label columns. The callback always sees a whole frame,
    which then is one task's work. A callback that labels rows independently may
    say so with ``rows_per_call``: every frame is then given in consecutive
    pieces of that many rows, whatever its size. A column of the wrong length is
    an error.
    """
    keys = list(keys)
    labels = T.StructType.fromDDL(schema)
    rows, parts = df, keys
    if rows_per_call:
        ranked = rank_within(df, keys, [F.asc(idx)], "_n")
        rows = ranked.withColumn("_piece", F.floor((F.col("_n") - 1) / rows_per_call)).drop("_n")
        parts = [*keys, "_piece"]
    out = T.StructType([*df.schema.fields, *labels.fields])
    names = [f.name for f in labels.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx, ignore_index=True)
        meta = {k: pdf[k].iloc[0] for k in keys}
        made = fn(pdf, meta)
        for n in names:
            if len(made[n]) != len(pdf):
                raise ValueError(f"label {n!r} has {len(made[n])} values for {len(pdf)} candidates")
        return pdf.assign(**{n: made[n] for n in names})[[f.name for f in out.fields]]

    return rows.groupBy(*parts).applyInPandas(run, out)


def score_with(
    df: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    features: str = "pose_features",
    batch: int = 2048,
    out: str = "model_score",
    width: int | None = None,
    required: str | None = None,
) -> DataFrame:
    """One model score per candidate, in batches; the model loads once per worker.

    With ``required`` a candidate lacking that column is an error.
    """
    if required is not None:
        require_none(df.where(F.col(required).isNull()), f"{required} is required for scoring")
    udf = predict_batch_udf(
        make_predict,
        return_type=T.DoubleType(),
        batch_size=batch,
        input_tensor_shapes=[[width]] if width else None,
    )
    return df.withColumn(out, udf(F.col(features)))


def embed_objects(
    clouds: DataFrame,
    make_encoder: Callable[[], Callable[[list[np.ndarray]], list[np.ndarray]]],
    dim: int,
    batch: int = 2048,
    cloud: str = "object_cloud",
    keys: Sequence[str] = ("scene_id", "frame_id", "cluster_id"),
    done: DataFrame | None = None,
    precision: str = "float",
) -> DataFrame:
    """Pooled object vectors, one per distinct cluster: means then maxima of point features.

    The encoder maps point arrays to feature matrices of ``dim`` columns and must
    be deterministic; an empty cloud gives zeros. Clusters in ``done`` are skipped.
    Points reach the encoder, and features are pooled, in ``precision``: ``float`` or ``double``.
    """
    if precision not in ("float", "double"):
        raise ValueError("precision must be 'float' or 'double'")
    kind = np.float32 if precision == "float" else np.float64
    keys = list(keys)
    todo = clouds.select(*keys, cloud).dropDuplicates(keys)
    if done is not None:
        todo = todo.join(done.select(*keys), keys, "left_anti")

    def pooled(cols: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for xs, ys, zs in cols:
            out = [np.zeros(2 * dim, dtype=kind)] * len(xs)
            full = [i for i in range(len(xs)) if len(xs.iloc[i])]
            for start in range(0, len(full), batch):
                part = full[start : start + batch]
                points = [
                    np.stack([xs.iloc[i], ys.iloc[i], zs.iloc[i]], axis=1).astype(kind) for i in part
                ]
                for i, f in zip(part, encode(points)):
                    out[i] = np.concatenate([f.mean(axis=0), f.max(axis=0)]).astype(kind)
            yield pd.Series(out)

    udf = F.pandas_udf(pooled, f"array<{precision}>")
    axes = [F.col(f"{cloud}.{c}") for c in "xyz"]
    return todo.select(*keys, udf(*axes).alias("pooled"))


def fit_quality(
    df: DataFrame,
    features: Sequence[str],
    mu: str = "mu_min",
    tau: float = S.SUCCESS_TAU,
    kind: str = "huber",
    out: str = "predicted_quality",
    **params,
) -> PipelineModel:
    """Fit the quality target on numeric feature columns.

    ``huber`` is a robust linear fit, ``gbt`` boosted trees; both train on all
    partitions without moving rows to the driver.
    """
    data = df.select(*features, quality_target(mu, tau).alias("label"))
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": out}
    if kind == "huber":
        model = LinearRegression(loss="huber", **common, **params)
    elif kind == "gbt":
        model = GBTRegressor(**common, **params)
    else:
        raise ValueError("kind must be 'huber' or 'gbt'")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, model]).fit(data)


def fit_aux(df: DataFrame, features: Sequence[str], **params) -> dict[str, PipelineModel]:
    """Collision and empty classifiers, and one over object classes (unlabelled rows left out)."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    targets = {
        "is_collision": df.select(*features, F.col("is_collision").cast("double").alias("label")),
        "is_empty": df.select(*features, F.col("is_empty").cast("double").alias("label")),
        "object_id": df.where(F.col("object_id") >= 0).select(*features, F.col("object_id").cast("double").alias("label")),
    }
    fitted = {}
    for name, data in targets.items():
        family = "multinomial" if name == "object_id" else "binomial"
        head = LogisticRegression(
            featuresCol="features",
            labelCol="label",
            family=family,
            predictionCol=f"{name}_pred",
            probabilityCol=f"{name}_prob",
            rawPredictionCol=f"{name}_raw",
            **params,
        )
        fitted[name] = Pipeline(stages=[assembler, head]).fit(data)
    return fitted


def apply_model(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Predictions without the assembled vector; probabilities become arrays."""
    out = model.transform(df).drop("features")
    for c in out.columns:
        if c.endswith("_prob"):
            out = out.withColumn(c, vector_to_array(c))
        if c.endswith("_raw"):
            out = out.drop(c)
    return out


def feature_reliance(
    df: DataFrame,
    predict: Callable[[dict[str, Column]], Column],
    inputs: Sequence[str],
    shuffled: Sequence[str],
    seed: int = 0,
    batch: str = "batch",
    idx: str = S.CANDIDATE,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """How much a score depends on some features: one row of measures.

    Inside every batch the ``shuffled`` columns move together to other rows by a
    seeded permutation and rows are scored again. ``shuffle_ratio`` is the rms
    change over the score's spread; ``raw_centered_rms`` is the spread of the
    features themselves. Batches of one row are left out.
    """
    data = df.select(batch, idx, *{*inputs, *shuffled})
    bounded = groups_bounded(data, [batch], limit)
    sized = attach_stats(data, [batch], {"_size": F.count(F.lit(1))}, bounded).where(F.col("_size") >= 2)
    rows = rank_within(sized, [batch], [F.asc(idx)], "_at", limit, bounded)
    rows = rank_within(rows, [batch], [hash_order(seed, F.col(idx)), F.asc(idx)], "_mix", limit, bounded)
    donors = rows.select(batch, F.col("_mix").alias("_at"), *[F.col(c).alias(f"_d_{c}") for c in shuffled])
    both = rows.join(donors, [batch, "_at"])
    normal = predict({c: F.col(c) for c in inputs})
    moved = predict({c: F.col(f"_d_{c}") if c in shuffled else F.col(c) for c in inputs})
    scored = both.select(*shuffled, normal.alias("_s"), moved.alias("_t"))
    spread = F.stddev_pop("_s")
    delta = F.sqrt(F.avg((F.col("_s") - F.col("_t")) * (F.col("_s") - F.col("_t"))))
    var = sum((F.var_pop(c) for c in shuffled[1:]), F.var_pop(shuffled[0])) / len(shuffled)
    return scored.agg(
        F.sqrt(var).alias("raw_centered_rms"),
        spread.alias("score_std"),
        delta.alias("shuffle_delta_rms"),
        (delta / F.greatest(spread, F.lit(1e-12))).alias("shuffle_ratio"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def passes_gate(reliance: DataFrame, min_rms: float = 0.0, min_ratio: float = 0.0) -> DataFrame:
    return reliance.withColumn(
        "gate", (F.col("raw_centered_rms") >= min_rms) & (F.col("shuffle_ratio") >= min_ratio)
    )


def _improved_by_margin(placed: DataFrame, run: Sequence[str], min_delta: float, limit: int) -> DataFrame:
    """Add ``improved``: epochs below the last improvement by more than ``min_delta``, from the first eligible one.

    An improvement is lower than everything before it, so only those records
    matter. Along a run they fall, hence a record's successor is the earliest
    record below it by the margin: a running minimum of places in order of
    value. The chain from the first record is then marked by pointer doubling,
    in as many rounds as the logarithm of its length.
    """
    eligible = placed.where(F.col("eligible") & F.col("_m").isNotNull()).select(*run, "_p", "_m")
    lows = scan_within(eligible, run, [F.asc("_p")], {"_low": ("min", F.col("_m"))}, limit)
    records = materialise(lows.groupBy(*run, "_low").agg(F.min("_p").alias("_p")))
    asked = records.select(*run, (F.col("_low") - min_delta).alias("_v"), F.lit(0).alias("_side"), "_p", F.lit(None).cast("long").alias("_at"))
    known = records.select(*run, F.col("_low").alias("_v"), F.lit(1).alias("_side"), "_p", F.col("_p").alias("_at"))
    # Equal values do not count: questions come before records.
    both = asked.union(known)
    found = scan_within(both, run, [F.asc("_v"), F.asc("_side"), F.asc("_p")], {"_next": ("min", F.col("_at"))}, limit)
    jumps = materialise(found.where((F.col("_side") == 0) & F.col("_next").isNotNull()).select(*run, F.col("_p").alias("_from"), F.col("_next").alias("_to")))
    reached = materialise(records.groupBy(*run).agg(F.min("_p").alias("_from")))
    while not jumps.isEmpty():
        further = reached.join(jumps, [*run, "_from"]).select(*run, F.col("_to").alias("_from"))
        reached = materialise(reached.union(further).distinct())
        after = jumps.select(*run, F.col("_from").alias("_to"), F.col("_to").alias("_far"))
        jumps = materialise(jumps.join(after, [*run, "_to"]).select(*run, "_from", F.col("_far").alias("_to")))
    hits = reached.select(*run, F.col("_from").alias("_p"), F.lit(True).alias("improved"))
    return placed.join(hits, [*run, "_p"], "left").withColumn("improved", F.coalesce("improved", F.lit(False)))


def select_checkpoint(
    history: DataFrame,
    run: Sequence[str] = ("run",),
    metric: str = "metric",
    min_delta: float = 0.0,
    min_steps: int = 0,
    patience: int = -1,
    min_epochs: int = 1,
    min_optimizer_steps: int = 0,
    gate: str | None = None,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Epoch by epoch: eligible, improved, best so far, waiting epochs, stop.

    ``history`` has run columns, ``epoch``, ``steps``, the metric (lower is better)
    and optionally a gate flag. An eligible epoch improves when it beats the best
    by more than ``min_delta``; an ineligible one resets the wait. Rows after the
    stopping epoch are dropped.
    """
    run = list(run)
    ok = F.col("steps") >= max(min_steps, 0)
    if gate:
        ok = ok & F.col(gate)
    rows = history.withColumns({"eligible": ok, "_m": F.col(metric).cast("double")})
    bounded = groups_bounded(rows, run, limit)
    order = [F.asc("epoch")]
    if min_delta == 0:
        # The best so far is a running minimum over the eligible epochs before.
        placed = scan_within(
            rows,
            run,
            order,
            {"_low": ("min", F.when(F.col("eligible"), F.col("_m"))), "_p": ("rank", F.lit(1))},
            limit,
            bounded,
        )
        prev = placed.select(*run, (F.col("_p") + 1).alias("_p"), F.col("_low").alias("_best"))
        marked = placed.join(prev, [*run, "_p"], "left").withColumn(
            "improved", F.col("eligible") & (F.col("_best").isNull() | (F.col("_m") < F.col("_best")))
        )
    else:
        marked = _improved_by_margin(rank_within(rows, run, order, "_p", limit, bounded), run, min_delta, limit)
    waits = F.col("eligible") & ~F.col("improved")
    counted = scan_within(
        marked,
        run,
        order,
        {
            "_reset": ("max", F.when(~waits, F.col("_p")).otherwise(F.lit(0))),
            "best_epoch": ("max", F.when(F.col("improved"), F.col("epoch"))),
            "best_metric": ("min", F.when(F.col("improved"), F.col("_m"))),
        },
        limit,
        bounded,
    ).withColumn("waited", F.col("_p") - F.col("_reset"))
    stop = F.lit(False)
    if patience >= 0:
        stop = (
            ~F.col("improved")
            & (F.col("epoch") + 1 >= max(min_epochs, 1))
            & (F.col("steps") >= max(min_optimizer_steps, 0))
            & F.col("best_epoch").isNotNull()
            & (F.col("waited") >= patience)
        )
    flagged = counted.withColumn("stop", stop)
    ends = flagged.groupBy(*run).agg(F.min(F.when(F.col("stop"), F.col("epoch"))).alias("_end"))
    return (
        flagged.join(ends, run)
        .where(F.col("_end").isNull() | (F.col("epoch") <= F.col("_end")))
        .select(*run, "epoch", "steps", metric, "eligible", "improved", "best_epoch", "best_metric", "waited", "stop")
    )
