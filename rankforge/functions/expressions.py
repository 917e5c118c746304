"""Column expressions: labels, scene groups, geometry and losses."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankforge import schemas as S

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """Neither NULL, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def success_label(mu: Column | str = "mu_min", tau: float = S.SUCCESS_TAU) -> Column:
    """A finite friction not above ``tau``."""
    return is_finite(mu) & (col(mu) <= F.lit(tau))


def quality_target(mu: Column | str = "mu_min", tau: float = S.SUCCESS_TAU) -> Column:
    """``tau - mu``; a candidate no friction can hold counts as ``max(tau, 1) + 1``."""
    if not tau > 0:
        raise ValueError(f"tau must be positive, got {tau!r}")
    return F.lit(tau) - F.when(is_finite(mu), col(mu)).otherwise(F.lit(max(tau, 1.0) + 1.0))


def clip_width(width: Column | str = "width", lo: float = 0.0, hi: float = S.MAX_WIDTH) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(width)))


def benchmark_split(scene: Column | str = "scene_id") -> Column:
    """Benchmark half a scene belongs to; an unknown scene is an error."""
    s = col(scene)
    return (
        F.when(s.between(*S.TRAIN_SCENES), "train")
        .when(s.between(*S.TEST_SCENES), "test")
        .otherwise(F.raise_error(F.concat(F.lit("scene outside the benchmark: "), s.cast("string"))))
    )


def test_group(scene: Column | str = "scene_id") -> Column:
    """seen / similar / novel for a test scene, NULL elsewhere."""
    s = col(scene)
    return (
        F.when(s.between(*S.SEEN_SCENES), "seen")
        .when(s.between(*S.SIMILAR_SCENES), "similar")
        .when(s.between(*S.NOVEL_SCENES), "novel")
    )


def weight_tag(lam: Column | str) -> Column:
    """Folder suffix of a fusion weight: none for 1, a fixed name for 0."""
    value = col(lam).cast("double")
    # Twelve significant digits without trailing zeros.
    short = F.regexp_replace(F.format_string("%.12g", value), r"\.?0+(e|$)", "$1")
    return (
        F.when(value == 1.0, F.lit(""))
        .when(value == 0.0, F.lit("_detector_baseline"))
        .otherwise(F.concat(F.lit("_lambda_"), F.replace(short, F.lit("."), F.lit("p"))))
    )


def check_weight(lam: float) -> float:
    lam = float(lam)
    if math.isnan(lam) or not 0.0 <= lam <= 1.0:
        raise ValueError(f"fusion weight must lie in [0, 1], got {lam!r}")
    return lam


def fuse(base_z: Column | str, model_z: Column | str, lam: float) -> Column:
    """``(1 - lam) * base + lam * model`` on normalised scores."""
    lam = check_weight(lam)
    return F.lit(1.0 - lam) * col(base_z) + F.lit(lam) * col(model_z)


def shell_id(radius: Column | str, edges: Sequence[float] = S.SHELL_EDGES, *, side: str) -> Column:
    """Shell number of a radius, clipped to the outer shells.

    ``side='right'`` puts a radius on an edge into the outer shell,
    ``side='left'`` into the inner one.
    """
    if side not in ("left", "right"):
        raise ValueError("side must be 'left' or 'right'")
    r = col(radius)
    last = len(edges) - 2
    expr = F.lit(last)
    for shell in range(last - 1, -1, -1):
        edge = F.lit(float(edges[shell + 1]))
        expr = F.when(r < edge if side == "right" else r <= edge, F.lit(shell)).otherwise(expr)
    return expr


def smooth_l1(pred: Column | str, target: Column | str, beta: float = 1.0) -> Column:
    d = F.abs(col(pred) - col(target))
    return F.when(d < beta, F.lit(0.5 / beta) * d * d).otherwise(d - F.lit(0.5 * beta))


def bce_with_logits(logit: Column | str, label: Column | str) -> Column:
    """Binary cross entropy on a logit, without overflow for large values."""
    x, y = col(logit), col(label).cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def hash_order(seed: int | str, key: Column) -> Column:
    """A seeded order that any engine with md5 reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_index(seed: int | str, key: Column, n: Column) -> Column:
    """A seeded index in ``[0, n)`` from the first 32 bits of the hash."""
    word = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long")
    return F.pmod(word, n)


def rotate_into(px, py, pz, tx, ty, tz, rotation: Sequence[Column]) -> list[Column]:
    """Coordinates of a point in a candidate's own frame: ``(p - t) @ R``."""
    d = [col(px) - col(tx), col(py) - col(ty), col(pz) - col(tz)]
    r = [col(c) for c in rotation]
    return [d[0] * r[axis] + d[1] * r[3 + axis] + d[2] * r[6 + axis] for axis in range(3)]
