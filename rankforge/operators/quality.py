"""Resume, validation, manifests and shard indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.functions.expressions import is_finite, success_label
from rankforge.functions.stats import QUANTILES, boolean_stats, merge_stats, mergeable_stats, moment_aggs, numeric_stats
from rankforge.operators.scoring import first_argmax
from rankforge.plans.groups import GROUP_LIMIT, exact_quantiles, groups_bounded, rank_within, require_none

MANIFEST_SUMS = ("num", "success_count", "collision_count", "empty_count", "mu_finite_count")


# ---- resume and checks -------------------------------------------------------


def pending(
    inputs: DataFrame,
    outputs: DataFrame,
    required: Sequence[str] = (),
    sidecar: DataFrame | None = None,
    keys: Sequence[str] = ("scene_id", "frame_id"),
    fields: str = "fields",
) -> DataFrame:
    """Inputs without a reusable output: one that has all required fields and its sidecar."""
    usable = outputs
    if required:
        usable = usable.where(F.size(F.array_except(F.array(*[F.lit(f) for f in required]), F.col(fields))) == 0)
    if sidecar is not None:
        usable = usable.join(sidecar.select(*keys), list(keys), "left_semi")
    return inputs.join(usable.select(*keys), list(keys), "left_anti")


def validate_manifest(
    manifest: DataFrame,
    files: DataFrame,
    tau: float | None = None,
    requested: DataFrame | None = None,
    key: str = "path",
) -> DataFrame:
    """One row per problem: missing record or file, stale size or time, other threshold.

    ``requested`` lists the paths to check; by default those on either side.
    """
    m = manifest.select(
        key,
        F.col("size").alias("m_size"),
        F.col("mtime").alias("m_mtime"),
        F.col("tau").alias("m_tau"),
        F.lit(True).alias("in_manifest"),
    )
    f = files.select(key, F.col("size").alias("f_size"), F.col("mtime").alias("f_mtime"), F.lit(True).alias("on_disk"))
    both = m.join(f, key, "full_outer")
    if requested is not None:
        both = requested.select(key).distinct().join(both, key, "left")
    recorded, present = F.coalesce("in_manifest", F.lit(False)), F.coalesce("on_disk", F.lit(False))
    live = recorded & present
    problems = [
        F.when(~recorded, F.lit("missing record")),
        F.when(recorded & ~present, F.lit("missing file")),
        F.when(live & (F.col("m_size") != F.col("f_size")), F.lit("stale size")),
        F.when(live & (F.col("m_mtime") != F.col("f_mtime")), F.lit("stale mtime")),
    ]
    if tau is not None:
        problems.append(F.when(live & (F.abs(F.col("m_tau") - F.lit(tau)) > 1e-12), F.lit("threshold mismatch")))
    return both.select(key, F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def test_rows(df: DataFrame, path_split: str = "path_split", meta_split: str = "meta_split") -> DataFrame:
    """Rows of the test half: the path decides, then metadata."""
    return df.where(F.coalesce(F.col(path_split), F.col(meta_split)) == "test")


def guard_no_test_rows(df: DataFrame, **columns: str) -> DataFrame:
    require_none(test_rows(df, **columns), "training data contains test rows")
    return df


def count_mismatches(
    recorded: DataFrame,
    rows: DataFrame,
    keys: Sequence[str] = ("scene_id", "frame_id"),
    count: str = "num",
    vector: str | None = None,
    width: int | None = None,
) -> DataFrame:
    """Frames whose recorded count, or vector width, differs from the actual rows."""
    wrong = F.count_if(F.size(vector) != F.lit(width)) if vector else F.lit(0).cast("long")
    actual = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"), wrong.alias("wrong_width"))
    both = recorded.select(*keys, F.col(count).cast("long").alias("recorded")).join(actual, list(keys), "full_outer")
    both = both.fillna(0, ["recorded", "actual", "wrong_width"])
    return both.where((F.col("recorded") != F.col("actual")) | (F.col("wrong_width") > 0))


def check_counts(recorded: DataFrame, rows: DataFrame, **kw) -> None:
    require_none(count_mismatches(recorded, rows, **kw), "recorded counts differ from rows")


def changed_candidates(before: DataFrame, after: DataFrame, content: Sequence[str]) -> DataFrame:
    """Rows lost or invented by a re-ranking, as a signed multiset difference.

    Both sides are counted per distinct row before the shuffle, so many equal
    rows cost no more than one.
    """
    tagged = before.select(*content, F.lit(1).alias("_d")).unionByName(after.select(*content, F.lit(-1).alias("_d")))
    return tagged.groupBy(*content).agg(F.sum("_d").alias("excess")).where(F.col("excess") != 0)


def check_preserved(before: DataFrame, after: DataFrame, content: Sequence[str]) -> None:
    require_none(changed_candidates(before, after, content), "re-ranking changed the candidates")


# ---- manifests and summaries ---------------------------------------------------


def build_manifest(
    df: DataFrame,
    keys: Sequence[str] = S.FRAME_KEYS,
    tau: float = S.SUCCESS_TAU,
    mu: str = "mu_min",
    base: str = "base_score",
) -> DataFrame:
    """Per-frame label counts and sums."""
    good = F.when(is_finite(mu), F.col(mu))
    zero = F.lit(0.0)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num"),
        F.count_if(success_label(mu, tau)).alias("success_count"),
        F.count_if("is_collision").alias("collision_count"),
        F.count_if("is_empty").alias("empty_count"),
        F.count(good).alias("mu_finite_count"),
        F.coalesce(F.sum(good), zero).alias("mu_finite_sum"),
        F.coalesce(F.sum(good * good), zero).alias("mu_finite_sumsq"),
        F.coalesce(F.sum(base), zero).alias("base_sum"),
        F.coalesce(F.sum(F.col(base) * F.col(base)), zero).alias("base_sumsq"),
    )


def summarize_manifest(manifest: DataFrame, scene: str = "scene_name") -> DataFrame:
    """Totals (``scene`` NULL, ``is_total`` true) and one row per scene; no name is "unknown"."""
    rows = manifest.withColumn(scene, F.coalesce(F.col(scene).cast("string"), F.lit("unknown")))
    out = rows.rollup(scene).agg(
        (F.grouping(scene) == 1).alias("is_total"),
        F.count(F.lit(1)).alias("num_frames"),
        *[F.sum(c).alias(c) for c in MANIFEST_SUMS],
        F.sum("mu_finite_sum").alias("mu_finite_sum"),
        F.sum("mu_finite_sumsq").alias("mu_finite_sumsq"),
    )
    return out.withColumns(
        {
            "negative_count": F.col("num") - F.col("success_count"),
            "mu_nonfinite_count": F.col("num") - F.col("mu_finite_count"),
        }
    )


def rerank_records(
    ranked: DataFrame,
    keys: Sequence[str] = S.FRAME_KEYS,
    columns: Sequence[str] = ("fused", "model_score", "base_score", "model_z"),
    base: str = "base_score",
    fused: str = "fused",
    idx: str = S.CANDIDATE,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """One record per frame: statistics of the score columns and the top-1 change."""
    keys = list(keys)
    top = F.struct(F.col(fused), -F.col(idx))
    tops = [
        F.count(F.lit(1)).alias("candidate_count"),
        F.max(fused).alias("top1_fused"),
        F.max_by(base, top).alias("top1_base_after"),
        F.max(base).alias("top1_base_before"),
        first_argmax(base, idx).alias("base_top1_idx"),
        first_argmax(fused, idx).alias("final_top1_idx"),
    ]
    moments = [agg for c in columns for agg in moment_aggs(c, f"{c}_")]
    bounded = groups_bounded(ranked, keys, limit)
    quantiles = []
    if bounded:
        quantiles = [
            F.percentile(F.when(is_finite(c), F.col(c)), F.lit(q)).alias(f"{c}_{n}")
            for c in columns
            for n, q in QUANTILES.items()
        ]
    out = ranked.groupBy(*keys).agg(*tops, *moments, *quantiles)
    if not bounded:
        for c in columns:
            names = {f"{c}_{n}": q for n, q in QUANTILES.items()}
            value = F.when(is_finite(c), F.col(c))
            out = out.join(exact_quantiles(ranked, keys, value, names, limit, bounded=False), keys, "left")
    return out.withColumn("top1_changed", F.col("base_top1_idx") != F.col("final_top1_idx"))


def rerank_summary(records: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Totals and per-scene rows: frames, candidates, changed tops and their moments."""
    return records.rollup(scene).agg(
        (F.grouping(scene) == 1).alias("is_total"),
        F.count(F.lit(1)).alias("num_frames"),
        F.sum("candidate_count").alias("num_candidates"),
        F.count_if("top1_changed").alias("top1_changed_count"),
        F.min("candidate_count").alias("count_min"),
        F.max("candidate_count").alias("count_max"),
        F.avg("candidate_count").alias("count_mean"),
        F.stddev_pop("candidate_count").alias("count_std"),
        F.avg("top1_base_before").alias("top1_base_before_mean"),
        F.avg("top1_base_after").alias("top1_base_after_mean"),
        F.avg("top1_fused").alias("top1_fused_mean"),
    )


FRAME_SERIES = ["candidate_count", "top1_export", "top1_fused", "top1_model", "top1_base_before", "top1_base_after"]


def rerank_statistics(
    ranked: DataFrame,
    scores: Sequence[str] = ("export_score", "fused", "model_score", "base_score"),
    keys: Sequence[str] = S.FRAME_KEYS,
    limit: int = GROUP_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """Statistics of a re-ranking: (per-frame series, candidate-level scores).

    ``ranked`` comes from ``rerank`` with export scores. The series are the
    number of candidates of a frame and the scores of its first candidate, with
    quantiles. Candidate-level scores merge one partial per frame, so they have
    no quantiles and every candidate is read once.
    """
    first = lambda c: F.min_by(c, "rank")
    tops = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        first("export_score").alias("top1_export"),
        first("fused").alias("top1_fused"),
        first("model_score").alias("top1_model"),
        F.max("base_score").alias("top1_base_before"),
        first("base_score").alias("top1_base_after"),
    )
    long = ranked.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in scores])).alias("_e"),
    ).select(*keys, "_e.*")
    return numeric_stats(tops, FRAME_SERIES, limit=limit), merge_stats(mergeable_stats(long, "value", [*keys, "column"]), ["column"])


def dataset_summary(
    df: DataFrame | None = None,
    cloud: str = "cloud",
    manifest: DataFrame | None = None,
    scene: str = "scene_name",
    tau: float = S.SUCCESS_TAU,
    limit: int = GROUP_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """The seven blocks of a data set, or with ``manifest`` its totals without a scan of the candidates.

    Blocks: base scores, friction, finite friction and non-zero points per cloud
    (numeric), success, collision and empty (flags). From a manifest: its totals
    and one row per scene, and the number of frames and candidates.
    """
    if manifest is not None:
        counts = manifest.agg(F.count(F.lit(1)).alias("num_archives"), F.coalesce(F.sum("num"), F.lit(0)).alias("num_samples"))
        return summarize_manifest(manifest, scene), counts
    real = F.size(F.filter(cloud, lambda p: (p["x"] != 0) | (p["y"] != 0) | (p["z"] != 0)))
    return full_summary(df.withColumn("_points", real), tau=tau, points="_points", limit=limit)


def full_summary(
    df: DataFrame,
    by: Sequence[str] = (),
    tau: float = S.SUCCESS_TAU,
    points: str | None = None,
    limit: int = GROUP_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """Numeric and boolean statistics of a labelled table: (numeric, flags).

    Numeric columns: base score, friction, finite friction and, given a count
    column, points per cloud. Flags: success, collision, empty.
    """
    numeric = {"base_scores": "base_score", "mu_min": "mu_min"}
    rows = df.withColumns(
        {
            **{out: F.col(src).cast("double") for out, src in numeric.items()},
            "mu_min_finite": F.when(is_finite("mu_min"), F.col("mu_min")),
            "success": success_label("mu_min", tau),
            "collision": F.col("is_collision"),
            "empty": F.col("is_empty"),
        }
    )
    names = [*numeric]
    if points:
        rows = rows.withColumn("cloud_points", F.col(points).cast("double"))
        names.append("cloud_points")
    stats = numeric_stats(rows, names, by, limit).unionByName(
        numeric_stats(rows.where(F.col("mu_min_finite").isNotNull()), ["mu_min_finite"], by, limit)
    )
    return stats, boolean_stats(rows, ["success", "collision", "empty"], by)


def quick_summary(files: DataFrame, scene: str = "scene", size: str = "size") -> DataFrame:
    """File counts and bytes in total and per scene, from file metadata only."""
    return files.rollup(scene).agg(
        (F.grouping(scene) == 1).alias("is_total"),
        F.count(F.lit(1)).alias("num_files"),
        F.sum(size).alias("bytes_total"),
    )


# ---- shards --------------------------------------------------------------------


def shard_index(
    files: DataFrame,
    per: int = 5,
    scene: str = "scene",
    size: str = "size",
    digest: str = "sha256",
    prefix: str = "",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Scenes in name order, ``per`` to a shard: path, size, hash and scene list.

    A file list is first reduced per scene: the hash of a scene is the hash of
    its sorted file hashes, cut into 256 buckets so that a scene of very many
    files is hashed in pieces. The shard hash covers its scene hashes.
    """
    bucket = F.substring(F.col(digest), 1, 2)
    pieces = (
        files.groupBy(scene, bucket.alias("_b"))
        .agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("_h"),
            F.sum(size).alias("_size"),
            F.count(F.lit(1)).alias("_files"),
        )
    )
    scenes = pieces.groupBy(scene).agg(
        F.sha2(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda s: s["_h"]), ""), 256
        ).alias("_h"),
        F.sum("_size").alias("_size"),
        F.sum("_files").alias("_files"),
    )
    placed = rank_within(scenes, [], [F.asc(scene)], "_n", limit).withColumn("_shard", F.floor((F.col("_n") - 1) / per))
    members = F.array_sort(F.collect_list(F.struct(F.col(scene).alias("s"), F.col("_h").alias("h"))))
    return (
        placed.groupBy("_shard")
        .agg(
            members.alias("_m"),
            F.min(scene).alias("_first"),
            F.max(scene).alias("_last"),
            F.sum("_size").alias("size"),
            F.sum("_files").alias("files"),
        )
        .select(
            F.concat(F.lit(f"{prefix}scenes-"), F.col("_first"), F.lit("-"), F.col("_last")).alias("path"),
            "size",
            F.sha2(F.array_join(F.transform("_m", lambda m: m["h"]), ""), 256).alias("sha256"),
            F.transform("_m", lambda m: m["s"]).alias("scenes"),
            "files",
        )
    )


def upsert_shards(index: DataFrame, new: DataFrame) -> DataFrame:
    """Replace shards whose size or hash differ, append new ones, flag what changed."""
    cols = [c for c in index.columns if c != "path"]
    a = index.select("path", F.struct(*cols).alias("_old"))
    b = new.select("path", F.struct(*cols).alias("_new"))
    both = a.join(b, "path", "full_outer")
    same = (F.col("_old.size") == F.col("_new.size")) & (F.col("_old.sha256") == F.col("_new.sha256"))
    changed = F.col("_new").isNotNull() & ~F.coalesce(same, F.lit(False))
    pick = F.when(changed, F.col("_new")).otherwise(F.col("_old"))
    return both.select("path", pick.alias("_p"), changed.alias("changed")).select("path", "_p.*", "changed")


def verify_shards(index: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed shards that are absent or whose size or hash differ."""
    f = files.select("path", F.col("size").alias("actual_size"), F.col("sha256").alias("actual_sha256"))
    out = index.select("path", "size", "sha256").join(f, "path", "left")
    problem = (
        F.when(F.col("actual_size").isNull(), "missing")
        .when(F.col("size") != F.col("actual_size"), "size mismatch")
        .when(F.col("sha256") != F.col("actual_sha256"), "hash mismatch")
    )
    return out.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def verify_tree(
    expected: DataFrame,
    files: DataFrame,
    keys: Sequence[str],
    size: str = "size",
    manifest_lines: DataFrame | None = None,
) -> DataFrame:
    """Per tree: expected and actual files, empty files, manifest lines and a verdict."""
    actual = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("actual"), F.count_if(F.col(size) <= 0).alias("empty_files")
    )
    out = expected.select(*keys, "expected").join(actual, list(keys), "left").fillna(0, ["actual", "empty_files"])
    ok = (F.col("actual") == F.col("expected")) & (F.col("empty_files") == 0)
    if manifest_lines is not None:
        out = out.join(manifest_lines.select(*keys, "lines"), list(keys), "left").fillna(0, ["lines"])
        ok = ok & (F.col("lines") == F.col("expected"))
    return out.withColumn("complete", ok)

