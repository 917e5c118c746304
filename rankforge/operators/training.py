"""One joint fit of all prediction heads on feature vectors, and scores from it.

The heads are linear in one shared vector: quality (smooth L1), collision and
empty (cross entropy on a logit) and the object class (cross entropy over all
classes). Their losses are added under the fixed loss weights, plus a ridge.
The rows stay where they are: a step is one job in which each partition adds up
the gradients of all heads at once, and only sums of the size of the model
travel, over a second level of tasks where there are many partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.functions.expressions import quality_target
from rankforge.session import intermediates, materialise

BINARY = ("collision", "empty")
# Sums of this many partitions go straight to the driver; more are added up by tasks first.
DIRECT_PARTS = 64
MEMORY = 10


@dataclass(frozen=True)
class JointModel:
    """``weights[d + 1, 3 + classes]`` on standardised features with a constant last.

    Columns: quality, collision, empty, then the object classes. ``losses`` holds
    the objective after every step and ``passes`` the jobs over the rows.
    """

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    losses: tuple[float, ...]
    passes: int

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def feature_vector(*parts: Column | str) -> Column:
    """Numbers, flags and arrays of numbers, in order, as one array of doubles.

    A missing number counts as zero (a dead shell has no maximum; its alive flag
    says so), a missing array gives a missing vector.
    """

    def as_array(c: Column, is_array: bool) -> Column:
        if is_array:
            return F.transform(c.cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0)))
        return F.array(F.coalesce(c.cast("double"), F.lit(0.0)))

    return F.concat(*[as_array(F.col(p), False) if isinstance(p, str) else as_array(p, True) for p in parts])


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if vectors.null_count or flat.size != len(vectors) * width or not np.isfinite(flat).all():
        raise ValueError(f"every feature vector needs {width} finite numbers")
    return flat.reshape(len(vectors), width)


def _summed(data: DataFrame, size: int, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``add`` over all batches of ``data``, a vector of ``size`` numbers."""
    kind = pa.list_(pa.float64())

    def one(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total], kind)], ["sums"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(batch)
        yield one(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(-1, size).sum(axis=0)
        yield one(total)

    sums = data.mapInArrow(part, "sums array<double>")
    parts = data.rdd.getNumPartitions()
    if parts > DIRECT_PARTS:
        sums = sums.repartition(int(np.sqrt(parts)) + 1).mapInArrow(merge, "sums array<double>")
    rows = sums.collect()
    return np.sum([r["sums"] for r in rows], axis=0) if rows else np.zeros(size)


def _losses(z: np.ndarray, y: np.ndarray, object_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed loss per head and the slope of every output; a missing target counts nothing."""
    slope = np.zeros_like(z)
    sums = np.zeros(4)
    there = np.isfinite(y[:, 0])
    d = np.where(there, z[:, 0] - y[:, 0], 0.0)
    size = np.abs(d)
    sums[0] = np.where(size < 1, 0.5 * d * d, size - 0.5).sum()
    slope[:, 0] = np.clip(d, -1, 1)
    for h in (1, 2):
        there = np.isfinite(y[:, h])
        target = np.where(there, y[:, h], 0.0)
        x = z[:, h]
        sums[h] = np.where(there, np.maximum(x, 0) - x * target + np.log1p(np.exp(-np.abs(x))), 0.0).sum()
        slope[:, h] = np.where(there, 1 / (1 + np.exp(-np.clip(x, -500, 500))) - target, 0.0)
    known = np.flatnonzero(object_id >= 0)
    if known.size and z.shape[1] > 3:
        logits = z[known, 3:]
        top = logits.max(axis=1, keepdims=True)
        e = np.exp(logits - top)
        total = e.sum(axis=1, keepdims=True)
        at = (np.arange(known.size), object_id[known])
        sums[3] = (np.log(total[:, 0]) + top[:, 0] - logits[at]).sum()
        p = e / total
        p[at] -= 1
        slope[known, 3:] = p
    return sums, slope


def _direction(gradient: np.ndarray, steps: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """Quasi-Newton direction from the last steps and the gradient's changes along them."""
    q, kept = gradient.copy(), []
    for s, t in zip(reversed(steps), reversed(turns)):
        a = (s * q).sum() / (s * t).sum()
        q -= a * t
        kept.append(a)
    if steps:
        q *= (steps[-1] * turns[-1]).sum() / (turns[-1] * turns[-1]).sum()
    for s, t, a in zip(steps, turns, reversed(kept)):
        q += s * (a - (t * q).sum() / (s * t).sum())
    return -q


def _minimise(data: DataFrame, classes: int, ridge: float, max_passes: int, tol: float) -> JointModel:
    """The model that fits ``data``: feature array ``x``, three numeric targets and the object class (-1: none)."""
    first = data.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to fit")
    width, outs = first.n, 3 + classes

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _matrix(batch.column(0), width)
        y = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2, 3)])
        return x, y, batch.column(4).to_numpy(zero_copy_only=False)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        x, y, o = columns(batch)
        return np.concatenate([[len(x)], np.isfinite(y).sum(axis=0), [(o >= 0).sum()], x.sum(axis=0)])

    counted = _summed(data, 5 + width, count)
    rows, per_head, mean = counted[0], np.maximum(counted[1:5], 1), counted[5:] / counted[0]

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        x = columns(batch)[0] - mean
        return (x.T @ x).ravel()

    gram = _summed(data, width * width, spread).reshape(width, width) / rows
    scale = np.sqrt(np.diag(gram))
    scale = np.where(scale > 1e-9 * np.maximum(np.abs(mean), 1), scale, 1.0)
    share = np.array([1.0, *(S.LOSS_WEIGHTS[h] for h in (*BINARY, "object"))]) / per_head
    per_out = np.concatenate([share[:3], np.full(classes, share[3])])
    # New coordinates for each head, w = basis @ v, in which its loss and the ridge
    # together bend about alike in every direction.
    bases = []
    for bend in share * rows * [1.0, 0.25, 0.25, 1 / max(classes, 2)]:
        bend = max(bend, 1e-12)
        basis = np.diag(np.full(width + 1, bend**-0.5))
        root = np.linalg.cholesky(bend * gram / np.outer(scale, scale) + max(ridge, 1e-6 * bend) * np.eye(width))
        basis[:width, :width] = np.linalg.inv(root).T
        bases.append(basis)

    def placed(v: np.ndarray, back: bool = False) -> np.ndarray:
        heads = [v[:, 0:1], v[:, 1:2], v[:, 2:3], v[:, 3:]]
        return np.hstack([(b.T if back else b) @ h for b, h in zip(bases, heads)])

    def at(v: np.ndarray) -> tuple[float, np.ndarray]:
        w = placed(v)

        def add(batch: pa.RecordBatch) -> np.ndarray:
            x, y, o = columns(batch)
            x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
            sums, slope = _losses(x @ w, y, o)
            return np.concatenate([sums, (x.T @ slope).ravel()])

        total = _summed(data, 4 + (width + 1) * outs, add)
        slope = total[4:].reshape(width + 1, outs) * per_out
        held = w.copy()
        held[-1] = 0
        value = float(total[:4] @ share + 0.5 * ridge * (held * held).sum())
        return value, placed(slope + ridge * held, back=True)

    v = np.zeros((width + 1, outs))
    value, gradient = at(v)
    losses, passes = [value], 1
    steps: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    while np.abs(gradient).max() > tol:
        way = _direction(gradient, steps, turns)
        slope, length = (way * gradient).sum(), 1.0
        while True:
            if passes >= max_passes:
                raise RuntimeError(f"no minimum after {passes} passes, largest slope {np.abs(gradient).max():.3g}")
            moved, new = at(v + length * way)
            passes += 1
            # Sums differ in the last digits with the order of the parts.
            if moved <= value + 1e-4 * length * slope + 1e-13 * abs(value):
                break
            length /= 2
        if (new - gradient).ravel() @ (length * way).ravel() > 0:
            steps.append(length * way)
            turns.append(new - gradient)
            del steps[:-MEMORY], turns[:-MEMORY]
        v, value, gradient = v + length * way, moved, new
        losses.append(value)
    return JointModel(mean, scale, placed(v), tuple(losses), passes)


def fit_joint(
    df: DataFrame,
    features: str = "features",
    mu: str = "mu_min",
    tau: float = S.SUCCESS_TAU,
    collision: str = "is_collision",
    empty: str = "is_empty",
    object_id: str = "object_id",
    classes: int = S.OBJECT_CLASSES,
    ridge: float = 1e-4,
    max_passes: int = 200,
    tol: float = 1e-6,
) -> JointModel:
    """Minimise the weighted sum of all head losses over every row.

    ``features`` is an array column of one length; a missing or non-finite entry
    is an error. Targets may be missing: such a row counts for the other heads
    only, and ``object_id`` below 0 is no object. Each head's loss is the mean
    over the rows that have its target. The ridge holds all weights but the
    constant ones, on standardised features. An object class of ``classes`` or
    more is an error. The steps are quasi-Newton, in coordinates in which every
    head is curved about alike in all directions, until no slope there exceeds
    ``tol``; not to get there within ``max_passes`` jobs is an error.
    Without rows there is nothing to fit, which is an error too.
    """
    names = ["quality", *BINARY, "object_id"]
    targets = [quality_target(mu, tau), F.col(collision), F.col(empty)]
    kind = F.coalesce(F.col(object_id).cast("int"), F.lit(-1))
    beyond = F.concat(F.lit("object class out of range: "), kind.cast("string"))
    kind = F.when(kind >= classes, F.raise_error(beyond).cast("int")).otherwise(kind)
    # A friction that is not known is no target, unlike one that no friction can hold.
    targets[0] = F.when(F.col(mu).isNotNull(), targets[0])
    rows = df.select(
        F.col(features).cast("array<double>").alias("x"),
        *[t.cast("double").alias(n) for t, n in zip(targets, names)],
        kind.alias("object_id"),
    )
    with intermediates(df.sparkSession):
        return _minimise(materialise(rows), classes, ridge, max_passes, tol)


def score_joint(df: DataFrame, model: JointModel, features: str = "features") -> DataFrame:
    """Add ``predicted_quality``, ``collision_logit``, ``empty_logit`` and ``object_logits`` to every row."""
    width = len(model.mean)
    schema = "predicted_quality double, collision_logit double, empty_logit double, object_logits array<double>"

    def score(vectors: pd.Series) -> pd.DataFrame:
        z = model.outputs(_matrix(pa.array(vectors, pa.list_(pa.float64())), width))
        named = dict(zip(("predicted_quality", "collision_logit", "empty_logit"), z.T))
        return pd.DataFrame({**named, "object_logits": list(z[:, 3:])})

    udf = F.pandas_udf(score, schema)
    return df.withColumn("_out", udf(F.col(features).cast("array<double>"))).select(*df.columns, "_out.*")
