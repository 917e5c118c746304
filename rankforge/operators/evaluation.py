"""Precision at k, average precision, splits, deltas and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.functions.expressions import hash_index, test_group
from rankforge.plans.groups import GROUP_LIMIT, exact_quantiles, rank_within
from rankforge.session import materialise


def top_ranked(
    df: DataFrame,
    score: str,
    keys: Sequence[str],
    idx: str = S.CANDIDATE,
    k: int = S.TOP_K,
) -> DataFrame:
    """First ``k`` candidates per frame, with ``rank``.

    The rank filter lets Spark keep only ``k`` rows per frame in every map task,
    so a huge frame reaches its final task already cut down.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(idx))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ap_weight_expr(rank: Column, k: int = S.TOP_K) -> Column:
    """Share of a hit at ``rank`` in the mean of precision@1..k.

    A hit at rank i adds 1/j to every precision@j with j >= i, so the mean over
    the k cut-offs is a sum of fixed weights and no cut-off has to be built.
    """
    tail, weights = 0.0, []
    for j in range(k, 0, -1):
        tail += 1.0 / j
        weights.append(tail / k)
    return F.element_at(F.array(*[F.lit(w) for w in reversed(weights)]), rank.cast("int"))


def precision_at_k(
    df: DataFrame,
    score: str = "fused",
    mu: str = "mu_min",
    keys: Sequence[str] = S.FRAME_KEYS,
    idx: str = S.CANDIDATE,
    k: int = S.TOP_K,
    frictions: Sequence[float] = S.FRICTIONS,
    frames: DataFrame | None = None,
) -> DataFrame:
    """Precision at every cut-off 1..k and friction, one row per cell.

    Past the end of a short list the hits stay and the divisor grows; frames in
    ``frames`` without candidates score zero everywhere.
    """
    keys = list(keys)
    top = top_ranked(df.select(*keys, idx, score, mu), score, keys, idx, k)
    lists = top.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", mu))).alias("_mu")
    )
    if frames is not None:
        lists = frames.select(*keys).distinct().join(lists, keys, "left")
    grid = lists.select(*keys, "_mu", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k")).withColumn(
        "_m", F.col("_mu")[F.col("k")]
    )
    upto = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.col("_m") > 0
    running = grid.select(
        *keys,
        "k",
        *[
            F.sum(F.when(hit & (F.col("_m") <= F.lit(f)), 1).otherwise(0)).over(upto).alias(f"_h{i}")
            for i, f in enumerate(frictions)
        ],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("friction_idx"),
                F.lit(float(f)).alias("friction"),
                (F.col(f"_h{i}") / F.col("k")).alias("precision"),
            )
            for i, f in enumerate(frictions)
        ]
    )
    return running.select(*keys, "k", F.explode(cells).alias("_c")).select(*keys, "k", "_c.*")


def frame_ap(
    df: DataFrame,
    score: str = "fused",
    mu: str = "mu_min",
    keys: Sequence[str] = S.FRAME_KEYS,
    idx: str = S.CANDIDATE,
    k: int = S.TOP_K,
    frictions: Sequence[float] = S.FRICTIONS,
    frames: DataFrame | None = None,
) -> DataFrame:
    """AP per frame and friction without building the precision cells."""
    keys = list(keys)
    top = top_ranked(df.select(*keys, idx, score, mu), score, keys, idx, k)
    weight = ap_weight_expr(F.col("rank"), k)
    sums = top.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when((F.col(mu) > 0) & (F.col(mu) <= F.lit(f)), weight)), F.lit(0.0)).alias(
                f"_a{i}"
            )
            for i, f in enumerate(frictions)
        ]
    )
    if frames is not None:
        names = [f"_a{i}" for i in range(len(frictions))]
        sums = frames.select(*keys).distinct().join(sums, keys, "left").fillna(0.0, names)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("friction_idx"), F.lit(float(f)).alias("friction"), F.col(f"_a{i}").alias("precision")
            )
            for i, f in enumerate(frictions)
        ]
    )
    return sums.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def ap_aggs(value: str = "precision", scale: float = 100.0) -> list[Column]:
    """AP over all frictions and at friction positions 1 and 3."""
    def mean(at: int | None) -> Column:
        v = F.col(value) if at is None else F.when(F.col("friction_idx") == at, F.col(value))
        return F.avg(v) * F.lit(scale)

    return [mean(None).alias("ap"), mean(1).alias("ap_04"), mean(3).alias("ap_08")]


def ap_summary(prec: DataFrame, by: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """AP, AP@0.4 and AP@0.8 in percent over cells of ``precision_at_k`` or ``frame_ap``."""
    out = prec.groupBy(*by).agg(*ap_aggs())
    if digits is None:
        return out
    return out.select(*by, *[F.round(c, digits).alias(c) for c in ("ap", "ap_04", "ap_08")])


def ap_by_split(prec: DataFrame, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """The same per test group plus ``overall``, in one pass with grouping sets."""
    rows = prec.withColumn("_grp", test_group("scene_id"))
    sets = [[*by, "_grp"], [*by]]
    out = rows.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*by, "_grp"]]
    ).agg(F.grouping("_grp").alias("_all"), *ap_aggs())
    return (
        out.where((F.col("_all") == 1) | F.col("_grp").isNotNull())
        .select(
            *by,
            F.when(F.col("_all") == 1, "overall").otherwise(F.col("_grp")).alias("split"),
            *[F.round(c, digits).alias(c) for c in ("ap", "ap_04", "ap_08")],
        )
    )


def missing_frames(
    present: DataFrame,
    scenes: tuple[int, int] = S.TEST_SCENES,
    per_scene: int = S.FRAMES_PER_SCENE,
) -> DataFrame:
    """Expected (scene, frame) pairs that are absent."""
    spark = present.sparkSession
    first, last = scenes
    expected = spark.range((last - first + 1) * per_scene).select(
        (F.lit(first) + F.floor(F.col("id") / per_scene)).cast("int").alias("scene_id"),
        (F.col("id") % per_scene).cast("int").alias("frame_id"),
    )
    have = present.select(F.col("scene_id").cast("int"), F.col("frame_id").cast("int")).distinct()
    return expected.join(have, ["scene_id", "frame_id"], "left_anti")


def check_complete(present: DataFrame, report: int = 10, **expected) -> None:
    """Raise when expected frames are absent, naming the first ``report`` of them."""
    lost = missing_frames(present, **expected).orderBy("scene_id", "frame_id").limit(report).collect()
    if lost:
        names = ", ".join(f"scene_{r.scene_id:04d}/{r.frame_id:04d}" for r in lost)
        raise ValueError(f"dump is incomplete; missing examples: {names}")


def complete_scenes(
    prec: DataFrame,
    per_scene: int = S.FRAMES_PER_SCENE,
    cells: int = S.TOP_K * len(S.FRICTIONS),
) -> DataFrame:
    """Scenes in which every frame is present with all its cells."""
    frames = prec.groupBy("scene_id", "frame_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count("precision").alias("filled")
    )
    whole = F.count_if((F.col("cells") == cells) & (F.col("filled") == cells))
    return (
        frames.groupBy("scene_id")
        .agg(whole.alias("frames"), F.count(F.lit(1)).alias("seen"))
        .where((F.col("frames") == per_scene) & (F.col("seen") == per_scene))
        .select("scene_id", "frames")
    )


def assemble_scene(prec: DataFrame, **shape) -> DataFrame:
    """Cells of complete scenes only."""
    return prec.join(complete_scenes(prec, **shape).select("scene_id"), "scene_id", "left_semi")


def paired_delta(base: DataFrame, treated: DataFrame) -> DataFrame:
    """Per scene: AP metrics of both runs in percent and treatment minus baseline."""
    metrics = ("ap", "ap_04", "ap_08")
    a = base.groupBy("scene_id").agg(*ap_aggs()).select(
        "scene_id", *[F.col(m).alias(f"base_{m}") for m in metrics]
    )
    b = treated.groupBy("scene_id").agg(*ap_aggs()).select(
        "scene_id", *[F.col(m).alias(f"treated_{m}") for m in metrics]
    )
    return a.join(b, "scene_id").select(
        "*", *[(F.col(f"treated_{m}") - F.col(f"base_{m}")).alias(f"delta_{m}") for m in metrics]
    )


def bootstrap_ci(
    delta: DataFrame,
    column: str = "delta_ap",
    draws: int = 10_000,
    seed: int = 7,
    unit: str = "scene_id",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Paired bootstrap over scenes: mean delta, 95 % interval, share of gains.

    Every slot of every draw takes a scene by a seeded hash, so all draws are
    generated, joined and averaged in parallel. No draws: the point estimate.
    """
    if draws < 0:
        raise ValueError("draws must not be negative")
    spark = delta.sparkSession
    # One row per scene; written once because three results read it.
    units = materialise(
        rank_within(materialise(delta.select(unit, F.col(column).alias("_d"))), [], [F.asc(unit)], "_i", limit)
    )
    n = units.count()
    if n == 0:
        raise ValueError("paired scene values must not be empty")
    point = units.agg(
        F.avg("_d").alias("mean_delta"),
        F.count_if(F.col("_d") > 0).alias("positive_count"),
        F.avg((F.col("_d") > 0).cast("double")).alias("positive_fraction"),
        F.count(F.lit(1)).alias("scene_count"),
    ).withColumn("_one", F.lit(1))
    if draws == 0:
        return point.select(
            "mean_delta",
            F.col("mean_delta").alias("ci_low"),
            F.col("mean_delta").alias("ci_high"),
            "positive_count",
            "positive_fraction",
            "scene_count",
        )
    slots = spark.range(draws * n).select(
        F.floor(F.col("id") / n).alias("draw"),
        (
            hash_index(
                seed,
                F.concat_ws(":", F.floor(F.col("id") / n).cast("string"), (F.col("id") % n).cast("string")),
                F.lit(n),
            )
            + 1
        ).alias("_i"),
    )
    means = slots.join(units.select("_i", "_d"), "_i").groupBy("draw").agg(F.avg("_d").alias("_mean"))
    bounds = exact_quantiles(
        means, [], F.col("_mean"), {"ci_low": 0.025, "ci_high": 0.975}, limit, bounded=draws <= limit
    ).withColumn("_one", F.lit(1))
    return point.join(bounds, "_one").select(
        "mean_delta", "ci_low", "ci_high", "positive_count", "positive_fraction", "scene_count"
    )


def results_table(prec: DataFrame, config: Sequence[str], variant: str = "variant") -> DataFrame:
    """One row per configuration: AP of ``baseline`` and ``treated`` per test group.

    ``average`` is the mean of the three groups, as in a report table.
    """
    groups = ("seen", "similar", "novel")
    ap = (
        prec.withColumn("_grp", test_group("scene_id"))
        .where(F.col("_grp").isNotNull())
        .groupBy(*config, variant, "_grp")
        .agg((F.avg("precision") * 100).alias("_ap"))
    )
    cells = [
        F.max(F.when((F.col(variant) == v) & (F.col("_grp") == g), F.col("_ap"))).alias(f"{v}_{g}")
        for g in groups
        for v in ("baseline", "treated")
    ]
    wide = ap.groupBy(*config).agg(*cells)
    means = [
        (sum((F.col(f"{v}_{g}") for g in groups[1:]), F.col(f"{v}_{groups[0]}")) / len(groups)).alias(f"{v}_average")
        for v in ("baseline", "treated")
    ]
    return wide.select(*config, *[f"{v}_{g}" for g in groups for v in ("baseline", "treated")], *means)
