"""End-to-end compositions: re-rank a candidate table and evaluate both orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.operators.evaluation import ap_by_split, frame_ap
from rankforge.operators.scoring import lambda_sweep
from rankforge.operators.training import JointModel, fit_joint, score_joint


def compare_orders(
    candidates: DataFrame,
    lam: float,
    keys: Sequence[str] = S.FRAME_KEYS,
    frames: DataFrame | None = None,
    **columns: str,
) -> DataFrame:
    """AP per test group of the detector order and of the fused order.

    The detector order is fusion weight 0 of the sweep, so both orders come from
    one normalisation and one shuffle of the candidates. A frame of equal base
    scores keeps detector order in either reading. Frames in ``frames`` without
    candidates score zero in both.
    """
    cells = lambda_sweep(candidates, [0.0, lam], keys=keys, frames=frames, **columns)
    index = F.array_position(F.array(*[F.lit(float(f)) for f in S.FRICTIONS]), F.col("friction")) - 1
    prec = cells.select(
        "scene_id",
        F.when(F.col("lam") == 0, "detector").otherwise("fused").alias("order"),
        index.alias("friction_idx"),
        F.col("ap").alias("precision"),
    )
    return ap_by_split(prec, ["order"])


def evaluate_order(candidates: DataFrame, score: str, frames: DataFrame | None = None) -> DataFrame:
    """AP per test group of one given order."""
    return ap_by_split(frame_ap(candidates, score, frames=frames))


def fit_and_compare(
    candidates: DataFrame,
    train: Column,
    lam: float,
    features: str = "features",
    **fit,
) -> tuple[JointModel, DataFrame]:
    """Fit all heads on the ``train`` rows, score the others and measure their new order.

    The predicted quality is the model score that is fused with the detector's.
    Rows for which ``train`` is unknown belong to neither side. Returns the model
    and the AP of both orders per test group.
    """
    model = fit_joint(candidates.where(train), features, **fit)
    scored = score_joint(candidates.where(~train).drop("model_score"), model, features)
    return model, compare_orders(scored, lam, model="predicted_quality")
