"""Queries for statistics, manifests, data quality and shard indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions import stats as Z
from rankforge.operators import quality as H
from rankforge.operators import scoring as E
from suite import mappings as M
from suite.registry import r6, register, s6

NUMERIC = ["min", "max", "mean", "std", "p05", "p50", "p95"]


def numeric_sql(value: str, prefix: str = "") -> str:
    """Definition of the numeric statistics over a nullable value; NULL counts as non-finite."""
    good = f"CASE WHEN isfinite({value}) THEN {value} END"
    parts = [
        f"count(*) AS {prefix}count",
        f"count({good}) AS {prefix}finite_count",
        f"count(*) - count({good}) AS {prefix}nonfinite_count",
        f"round(min({good}) + 2.3e-8, 6) + 0.0 AS {prefix}min",
        f"round(max({good}) + 2.3e-8, 6) + 0.0 AS {prefix}max",
        f"round(avg({good}) + 2.3e-8, 6) + 0.0 AS {prefix}mean",
        f"round(stddev_pop({good}) + 2.3e-8, 6) + 0.0 AS {prefix}std",
    ]
    parts += [
        f"round(quantile_cont({good}, {q}) + 2.3e-8, 6) + 0.0 AS {prefix}{n}" for n, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))
    ]
    return ", ".join(parts)


COUNTS = ["count", "finite_count", "nonfinite_count"]


def rounded_stats(df, *keys):
    return df.select(*keys, *COUNTS, *r6(*NUMERIC))


@register(
    "f1_numeric_stats",
    f"""WITH {M.CAND}
    SELECT scene_id, 'base_score' AS "column", {numeric_sql('base_score')} FROM cand GROUP BY scene_id
    UNION ALL SELECT scene_id, 'mu_min', {numeric_sql('mu_min')} FROM cand GROUP BY scene_id""",
)
def f1_numeric_stats(spark, sf):
    df = Z.numeric_stats(M.candidates(spark, sf), ["base_score", "mu_min"], ["scene_id"])
    return rounded_stats(df, "scene_id", "column")


def boolean_sql(flag: str) -> str:
    return f"""count(*) AS count, count(*) FILTER (WHERE {flag}) AS true_count, count(*) FILTER (WHERE NOT {flag}) AS false_count,
      round(count(*) FILTER (WHERE {flag}) / count(*)::DOUBLE + 2.3e-8, 6) AS true_rate,
      round(count(*) FILTER (WHERE NOT {flag}) / count(*)::DOUBLE + 2.3e-8, 6) AS false_rate"""


@register(
    "f2_boolean_stats",
    f"""WITH {M.CAND}
    SELECT scene_id, 'raw_collision' AS "column", {boolean_sql('raw_collision')} FROM cand GROUP BY scene_id
    UNION ALL SELECT scene_id, 'is_empty', {boolean_sql('is_empty')} FROM cand GROUP BY scene_id""",
)
def f2_boolean_stats(spark, sf):
    df = Z.boolean_stats(M.candidates(spark, sf), ["raw_collision", "is_empty"], ["scene_id"])
    return df.select("scene_id", "column", "count", "true_count", "false_count", *r6("true_rate", "false_rate"))


@register(
    "f3_mergeable_stats",
    f"""WITH {M.CAND}, g AS (SELECT scene_id, CASE WHEN isfinite(mu_min) THEN mu_min END AS v FROM cand)
    SELECT scene_id, count(*) AS count, count(v) AS finite_count, count(*) - count(v) AS nonfinite_count,
           min(v) AS min, max(v) AS max, round(sum(v) / count(v) + 2.3e-8, 6) AS mean,
           round(sqrt(greatest(sum(v * v) / count(v) - (sum(v) / count(v)) * (sum(v) / count(v)), 0)) + 2.3e-8, 6) AS std
    FROM g GROUP BY scene_id""",
)
def f3_mergeable_stats(spark, sf):
    """Partials per frame, merged per scene."""
    parts = Z.mergeable_stats(M.candidates(spark, sf), "mu_min", ["scene_id", "frame_id"])
    out = Z.merge_stats(parts, ["scene_id"])
    return out.select("scene_id", *COUNTS, "min", "max", *r6("mean", "std"))


RECORD_COLS = ["fused", "model_score", "base_score", "model_z"]


@register(
    "f4_rerank_records",
    f"""WITH {M.ZED}, f AS (SELECT *, {M.fused_sql(0.7)} FROM zed),
    k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_id ORDER BY fused DESC, cand_idx) AS fr,
                 row_number() OVER (PARTITION BY scene_id, frame_id ORDER BY base_score DESC, cand_idx) AS br FROM f)
    SELECT scene_id, frame_id, count(*) AS candidate_count, round(max(fused) + 2.3e-8, 6) AS top1_fused,
           max(CASE WHEN fr = 1 THEN base_score END) AS top1_base_after, max(base_score) AS top1_base_before,
           max(CASE WHEN br = 1 THEN cand_idx END) AS base_top1_idx, max(CASE WHEN fr = 1 THEN cand_idx END) AS final_top1_idx,
           max(CASE WHEN br = 1 THEN cand_idx END) <> max(CASE WHEN fr = 1 THEN cand_idx END) AS top1_changed,
           {", ".join(numeric_sql(c, c + "_") for c in RECORD_COLS)}
    FROM k GROUP BY scene_id, frame_id""",
)
def f4_rerank_records(spark, sf):
    out = H.rerank_records(E.rerank(M.candidates(spark, sf), 0.7), columns=RECORD_COLS)
    return out.select(
        "scene_id",
        "frame_id",
        "candidate_count",
        *r6("top1_fused"),
        "top1_base_after",
        "top1_base_before",
        "base_top1_idx",
        "final_top1_idx",
        "top1_changed",
        *[f"{c}_{n}" for c in RECORD_COLS for n in COUNTS],
        *r6(*[f"{c}_{n}" for c in RECORD_COLS for n in NUMERIC]),
    )


RECORDS = f"""{M.ZED}, f AS (SELECT *, {M.fused_sql(0.7)} FROM zed),
    k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_id ORDER BY fused DESC, cand_idx) AS fr,
                 row_number() OVER (PARTITION BY scene_id, frame_id ORDER BY base_score DESC, cand_idx) AS br FROM f),
    rec AS (SELECT scene_id, frame_id, count(*) AS candidate_count, max(fused) AS top1_fused,
                   max(CASE WHEN fr = 1 THEN base_score END) AS top1_base_after, max(base_score) AS top1_base_before,
                   max(CASE WHEN br = 1 THEN cand_idx END) <> max(CASE WHEN fr = 1 THEN cand_idx END) AS top1_changed
            FROM k GROUP BY scene_id, frame_id)"""


@register(
    "f5_rerank_summary",
    f"""WITH {RECORDS}
    SELECT scene_id, grouping(scene_id) = 1 AS is_total, count(*) AS num_frames, CAST(sum(candidate_count) AS BIGINT) AS num_candidates,
           count(*) FILTER (WHERE top1_changed) AS top1_changed_count, min(candidate_count) AS count_min, max(candidate_count) AS count_max,
           round(avg(candidate_count) + 2.3e-8, 6) AS count_mean, round(stddev_pop(candidate_count) + 2.3e-8, 6) AS count_std,
           round(avg(top1_base_before) + 2.3e-8, 6) AS top1_base_before_mean, round(avg(top1_base_after) + 2.3e-8, 6) AS top1_base_after_mean,
           round(avg(top1_fused) + 2.3e-8, 6) AS top1_fused_mean
    FROM rec GROUP BY ROLLUP (scene_id)""",
)
def f5_rerank_summary(spark, sf):
    records = H.rerank_records(E.rerank(M.candidates(spark, sf), 0.7), columns=["fused"])
    out = H.rerank_summary(records)
    return out.select(
        "scene_id",
        "is_total",
        "num_frames",
        "num_candidates",
        "top1_changed_count",
        "count_min",
        "count_max",
        *r6("count_mean", "count_std", "top1_base_before_mean", "top1_base_after_mean", "top1_fused_mean"),
    )


MANIFEST = f"""{M.CAND}, c AS (SELECT *, raw_collision AS is_collision, CASE WHEN isfinite(mu_min) THEN mu_min END AS fm FROM cand),
    man AS (SELECT scene_id, frame_id, camera, count(*) AS num, count(*) FILTER (WHERE fm <= 0.4::DOUBLE) AS success_count,
              count(*) FILTER (WHERE is_collision) AS collision_count, count(*) FILTER (WHERE is_empty) AS empty_count,
              count(fm) AS mu_finite_count, coalesce(sum(fm), 0) AS mu_finite_sum, coalesce(sum(fm * fm), 0) AS mu_finite_sumsq,
              coalesce(sum(base_score), 0) AS base_sum, coalesce(sum(base_score * base_score), 0) AS base_sumsq
            FROM c GROUP BY scene_id, frame_id, camera)"""
SUMS = ["mu_finite_sum", "mu_finite_sumsq", "base_sum", "base_sumsq"]


def manifest(spark, sf):
    return H.build_manifest(M.candidates(spark, sf).withColumn("is_collision", F.col("raw_collision")))


@register(
    "f6_build_manifest",
    f"""WITH {MANIFEST} SELECT scene_id, frame_id, num, success_count, collision_count, empty_count, mu_finite_count,
    {", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in SUMS)} FROM man""",
)
def f6_build_manifest(spark, sf):
    return manifest(spark, sf).select(
        "scene_id", "frame_id", *H.MANIFEST_SUMS, *[F.round(c, 4).alias(c) for c in SUMS]
    )


@register(
    "f7_summarize_manifest",
    f"""WITH {MANIFEST}, n AS (SELECT *, CASE WHEN scene_id % 30 = 7 THEN 'unknown' ELSE format('scene_{{:04d}}', scene_id) END AS scene_name FROM man)
    SELECT scene_name, grouping(scene_name) = 1 AS is_total, count(*) AS num_frames,
      {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in H.MANIFEST_SUMS)},
      round(sum(mu_finite_sum), 4) AS mu_finite_sum, round(sum(mu_finite_sumsq), 4) AS mu_finite_sumsq,
      CAST(sum(num) - sum(success_count) AS BIGINT) AS negative_count, CAST(sum(num) - sum(mu_finite_count) AS BIGINT) AS mu_nonfinite_count
    FROM n GROUP BY ROLLUP (scene_name)""",
)
def f7_summarize_manifest(spark, sf):
    """Scenes of one residue have no name and fall under "unknown"."""
    name = F.when(F.col("scene_id") % 30 != 7, F.format_string("scene_%04d", "scene_id"))
    out = H.summarize_manifest(manifest(spark, sf).withColumn("scene_name", name))
    return out.withColumns({c: F.round(c, 4) for c in ("mu_finite_sum", "mu_finite_sumsq")})


FULL = f"""{M.CAND}, pt AS (SELECT *, raw_collision AS collision, is_empty AS empty, isfinite(mu_min) AND mu_min <= 0.4::DOUBLE AS success FROM cand)"""


@register(
    "f8_full_summary",
    f"""WITH {FULL}
    SELECT 'base_scores' AS "column", {numeric_sql('base_score')} FROM pt
    UNION ALL SELECT 'mu_min', {numeric_sql('mu_min')} FROM pt
    UNION ALL SELECT 'mu_min_finite', {numeric_sql('mu_min')} FROM pt WHERE isfinite(mu_min)""",
)
def f8_full_summary(spark, sf):
    stats, _ = H.full_summary(M.candidates(spark, sf).withColumn("is_collision", F.col("raw_collision")))
    return rounded_stats(stats, "column")


@register(
    "f8_quick_summary",
    f"""WITH {M.FIL} SELECT scene, grouping(scene) = 1 AS is_total, count(*) AS num_files, CAST(sum(size) AS BIGINT) AS bytes_total
    FROM fil GROUP BY ROLLUP (scene)""",
)
def f8_quick_summary(spark, sf):
    return H.quick_summary(M.files(spark, sf))


@register(
    "f9_dataset_summary",
    f"""WITH {FULL}
    SELECT 'success' AS "column", {boolean_sql('success')} FROM pt
    UNION ALL SELECT 'collision', {boolean_sql('collision')} FROM pt
    UNION ALL SELECT 'empty', {boolean_sql('empty')} FROM pt""",
)
def f9_dataset_summary(spark, sf):
    """The flag half of the data-set summary."""
    _, flags = H.full_summary(M.candidates(spark, sf).withColumn("is_collision", F.col("raw_collision")))
    return flags.select("column", "count", "true_count", "false_count", *r6("true_rate", "false_rate"))


@register(
    "f9_cloud_points",
    f"""WITH n AS (SELECT l_orderkey, count(*) FILTER (WHERE l_discount <> 0 OR l_tax <> 0) AS points FROM lineitem GROUP BY l_orderkey)
    SELECT 'points' AS "column", {numeric_sql('CAST(points AS DOUBLE)')} FROM n""",
)
def f9_cloud_points(spark, sf):
    """Non-zero points per cloud, the cloud being an order's line items."""
    real = F.count_if((F.col("l_discount") != 0) | (F.col("l_tax") != 0)).alias("points")
    clouds = M.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(real)
    return rounded_stats(Z.numeric_stats(clouds, "points"), "column")


CLOUDED = f"{FULL}, c AS (SELECT *, (cand_idx % 5 - (cand_idx % 5) // 3)::DOUBLE AS points FROM pt)"


def clouded(spark, sf):
    """Candidates with clouds of up to four points, of which every third is a zero point."""
    point = lambda i: F.struct(*[F.when(i % 3 == 0, F.lit(0.0)).otherwise(F.lit(0.5)).alias(a) for a in "xyz"])
    n = (F.col("cand_idx") % 5).cast("int")
    cloud = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), point)).otherwise(F.array().cast("array<struct<x:double,y:double,z:double>>"))
    return M.candidates(spark, sf).withColumns({"is_collision": F.col("raw_collision"), "cloud": cloud})


@register(
    "f9_dataset_blocks",
    f"""WITH {CLOUDED}
    SELECT 'base_scores' AS "column", {numeric_sql('base_score')} FROM c
    UNION ALL SELECT 'mu_min', {numeric_sql('mu_min')} FROM c
    UNION ALL SELECT 'mu_min_finite', {numeric_sql('mu_min')} FROM c WHERE isfinite(mu_min)
    UNION ALL SELECT 'cloud_points', {numeric_sql('points')} FROM c""",
)
def f9_dataset_blocks(spark, sf):
    """The numeric blocks of the data-set summary, points per cloud among them."""
    stats, _ = H.dataset_summary(clouded(spark, sf))
    return rounded_stats(stats, "column")


@register(
    "f9_manifest_only",
    f"""WITH {MANIFEST} SELECT count(*) AS num_archives, CAST(sum(num) AS BIGINT) AS num_samples FROM man""",
)
def f9_manifest_only(spark, sf):
    """The summary from a manifest alone."""
    _, counts = H.dataset_summary(manifest=manifest(spark, sf).withColumn("scene_name", F.format_string("scene_%04d", "scene_id")))
    return counts


TOPS = f"""{M.ZED}, f AS (SELECT *, {M.fused_sql(0.7)} FROM zed),
    k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_id, camera ORDER BY fused DESC, cand_idx) AS fr FROM f),
    t AS (SELECT count(*)::DOUBLE AS candidate_count, max(fused) AS top1_fused, max(CASE WHEN fr = 1 THEN model_score END) AS top1_model,
                 max(base_score) AS top1_base_before, max(CASE WHEN fr = 1 THEN base_score END) AS top1_base_after
          FROM k GROUP BY scene_id, frame_id, camera)"""


@register(
    "f5_rerank_series",
    f"WITH {TOPS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {numeric_sql(c)} FROM t"
        for c in ("candidate_count", "top1_fused", "top1_model", "top1_base_before", "top1_base_after")
    ),
)
def f5_rerank_series(spark, sf):
    """Statistics with quantiles of the per-frame series (export scores are float32 and have their own query)."""
    series, _ = H.rerank_statistics(E.rerank(M.candidates(spark, sf), 0.7, export=True))
    return rounded_stats(series.where(F.col("column") != "top1_export"), "column")


@register(
    "f5_candidate_scores",
    f"WITH {TOPS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS count, count(*) AS finite_count, 0::BIGINT AS nonfinite_count,
        round(min({c}) + 2.3e-8, 6) + 0.0 AS min, round(max({c}) + 2.3e-8, 6) + 0.0 AS max, round(avg({c}) + 2.3e-8, 6) + 0.0 AS mean,
        round(stddev_pop({c}) + 2.3e-8, 5) + 0.0 AS std FROM f"""
        for c in ("fused", "model_score", "base_score")
    ),
)
def f5_candidate_scores(spark, sf):
    """Candidate-level statistics merged from one partial per frame."""
    _, scores = H.rerank_statistics(E.rerank(M.candidates(spark, sf), 0.7, export=True), ["fused", "model_score", "base_score"])
    return scores.select("column", *COUNTS, *r6("min", "max", "mean"), F.round(F.col("std") + 2.3e-8, 5).alias("std"))


@register(
    "f10_latency_summary",
    """WITH b AS (SELECT l_linenumber AS run, l_extendedprice / 1000 AS ms, l_quantity AS frames,
                         row_number() OVER (PARTITION BY l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS ord
                  FROM lineitem),
    u AS (SELECT run, 'batch' AS unit, ms FROM b WHERE ord >= 5 UNION ALL SELECT run, 'frame', ms / frames FROM b WHERE ord >= 5)
    SELECT run, unit, count(*) AS count, round(avg(ms), 4) AS mean_ms, round(quantile_cont(ms, 0.5), 4) AS median_ms,
           round(quantile_cont(ms, 0.95), 4) AS p95_ms, round(min(ms), 4) AS min_ms, round(max(ms), 4) AS max_ms,
           round(stddev_pop(ms), 4) AS std_ms FROM u GROUP BY run, unit""",
)
def f10_latency_summary(spark, sf):
    """Line numbers as runs, line items as batches in shipping order."""
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    batches = M.table(spark, sf, "lineitem").select(
        *order,
        F.col("l_linenumber").alias("run"),
        (F.col("l_extendedprice") / 1000).alias("ms"),
        F.col("l_quantity").alias("frames"),
    )
    return Z.latency_summary(batches, "ms", order, "frames", ["run"])


@register(
    "f11_progress_report",
    """WITH l AS (SELECT o_orderpriority AS run, o_orderstatus = 'F' AS fin, (o_orderkey % 977) / 10::DOUBLE AS sec FROM orders),
    g AS (SELECT run, count(*) AS total, count(*) FILTER (WHERE fin) AS done, max(sec) AS el FROM l GROUP BY run)
    SELECT run, done, total, round(100.0 * done / total::DOUBLE, 2) AS percent, round(done / el, 3) AS rate, round(el, 1) AS elapsed_sec,
           round(CASE WHEN done > 0 THEN (total - done) / (done / el) END, 1) AS eta_sec FROM g""",
)
def f11_progress_report(spark, sf):
    log = M.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("run"), "o_orderstatus", ((F.col("o_orderkey") % 977) / 10).alias("sec")
    )
    return Z.progress_report(log, ["run"], F.col("o_orderstatus") == "F", "sec")




@register(
    "f12_multitask_loss",
    f"""WITH {M.PRED}, g AS (
      SELECT *, l_linenumber - 2 AS object_id, [l_tax * 10 * i - l_discount * (i - 3) * (i - 3) FOR i IN range(0, 8)] AS lg FROM pred),
    p AS (SELECT *, abs(pred - target) AS d,
            CASE WHEN object_id >= 0 THEN ln(list_sum([exp(x) FOR x IN lg])) - lg[object_id + 1] END AS nll,
            CASE WHEN object_id >= 0 THEN CAST(list_position(lg, list_max(lg)) - 1 = object_id AS INTEGER) END AS hit FROM g),
    m AS (SELECT l_returnflag, count(*) AS num_samples, avg(CASE WHEN d < 1 THEN d * d / 2 ELSE d - 0.5 END) AS loss_score,
            avg(greatest(collision_logit, 0) - collision_logit * is_collision::INT + ln(1 + exp(-abs(collision_logit)))) AS loss_coll,
            avg(greatest(empty_logit, 0) - empty_logit * is_empty::INT + ln(1 + exp(-abs(empty_logit)))) AS loss_empty,
            avg(nll) AS loss_obj, avg(hit) AS obj_acc_top1 FROM p GROUP BY l_returnflag)
    SELECT l_returnflag, num_samples, {s6('loss_score', 'loss_coll', 'loss_empty', 'loss_obj', 'obj_acc_top1')},
           round(loss_score + 0.1 * loss_coll + 0.05 * loss_empty + 0.05 * loss_obj + 2.3e-8, 6) + 0.0 AS loss FROM m""",
)
def f12_multitask_loss(spark, sf):
    logits = F.array(
        *[F.col("l_tax") * 10 * i - F.col("l_discount") * ((i - 3) * (i - 3)) for i in range(8)]
    )
    df = M.predictions(spark, sf).withColumns({"object_logits": logits, "object_id": F.col("l_linenumber") - 2})
    out = Z.multitask_loss(df, by=["l_returnflag"])
    return out.select(
        "l_returnflag", "num_samples", *r6("loss_score", "loss_coll", "loss_empty", "loss_obj", "obj_acc_top1", "loss")
    )


@register(
    "f12_full_logits",
    f"""WITH {M.PRED}, g AS (
      SELECT *, l_linenumber - 2 AS object_id, [l_tax * 10 * i - l_discount * (i - 3) * (i - 3) FOR i IN range(0, 88)] AS lg FROM pred),
    p AS (SELECT *, abs(pred - target) AS d,
            CASE WHEN object_id >= 0 THEN ln(list_sum([exp(x) FOR x IN lg])) - lg[object_id + 1] END AS nll,
            CASE WHEN object_id >= 0 THEN CAST(list_position(lg, list_max(lg)) - 1 = object_id AS INTEGER) END AS hit FROM g),
    m AS (SELECT l_returnflag, count(*) AS num_samples, avg(CASE WHEN d < 1 THEN d * d / 2 ELSE d - 0.5 END) AS loss_score,
            avg(greatest(collision_logit, 0) - collision_logit * is_collision::INT + ln(1 + exp(-abs(collision_logit)))) AS loss_coll,
            avg(greatest(empty_logit, 0) - empty_logit * is_empty::INT + ln(1 + exp(-abs(empty_logit)))) AS loss_empty,
            avg(nll) AS loss_obj, avg(hit) AS obj_acc_top1 FROM p GROUP BY l_returnflag)
    SELECT l_returnflag, num_samples, {s6('loss_score', 'loss_coll', 'loss_empty', 'loss_obj', 'obj_acc_top1')},
           round(loss_score + 0.1 * loss_coll + 0.05 * loss_empty + 0.05 * loss_obj + 2.3e-8, 6) + 0.0 AS loss FROM m""",
)
def f12_full_logits(spark, sf):
    # As a list of 88 expressions they make a method that the JVM never compiles.
    logits = F.transform(F.sequence(F.lit(0), F.lit(87)), lambda i: F.col("l_tax") * 10 * i - F.col("l_discount") * ((i - 3) * (i - 3)))
    df = M.predictions(spark, sf).withColumns({"object_logits": logits, "object_id": F.col("l_linenumber") - 2})
    out = Z.multitask_loss(df, by=["l_returnflag"])
    return out.select(
        "l_returnflag", "num_samples", *r6("loss_score", "loss_coll", "loss_empty", "loss_obj", "obj_acc_top1", "loss")
    )


@register(
    "f13_pred_target_stats",
    f"""WITH {M.PRED}
    SELECT l_returnflag, l_linestatus, count(*) AS num_samples, round(avg(pred) + 2.3e-8, 6) + 0.0 AS pred_mean, round(stddev_pop(pred) + 2.3e-8, 6) AS pred_std,
           round(corr(pred, target) + 2.3e-8, 6) + 0.0 AS pred_target_corr, stddev_pop(pred) <= 0.0001 AS score_collapse
    FROM pred GROUP BY ALL""",
)
def f13_pred_target_stats(spark, sf):
    out = Z.pred_target_stats(M.predictions(spark, sf), by=["l_returnflag", "l_linestatus"])
    return out.select(
        "l_returnflag", "l_linestatus", "num_samples", *r6("pred_mean", "pred_std", "pred_target_corr"), "score_collapse"
    )


# ---- data quality --------------------------------------------------------------


@register(
    "h1_pending",
    """SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (
      SELECT l.doc_id FROM labels l WHERE l.quality IS NOT NULL AND l.toxic = 0 AND l.doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 100))""",
)
def h1_pending(spark, sf):
    """Documents without a usable label record: one with both fields and a long enough text."""
    inputs = M.table(spark, sf, "documents").select("doc_id", "n_chars")
    outputs = M.table(spark, sf, "labels").select(
        "doc_id",
        F.array_compact(
            F.array(
                F.when(F.col("quality").isNotNull(), F.lit("quality")), F.when(F.col("toxic") == 0, F.lit("clean"))
            )
        ).alias("fields"),
    )
    sidecar = inputs.where("n_chars > 100")
    return H.pending(inputs, outputs, ["quality", "clean"], sidecar, keys=["doc_id"]).select("doc_id")


@register(
    "h2_validate_manifest",
    f"""WITH {M.FIL},
    man AS (SELECT file_id, CASE WHEN lang = 'de' THEN size + 1 ELSE size END AS size, length(source) AS mtime,
                   CASE WHEN size > 5000 THEN 0.5 ELSE 0.4 END AS tau FROM fil WHERE size >= 60),
    disk AS (SELECT file_id, size, CASE WHEN size % 7 = 0 THEN 0 ELSE length(source) END AS mtime FROM fil WHERE lang <> 'fr'),
    j AS (SELECT coalesce(m.file_id, d.file_id) AS path, m.file_id IS NOT NULL AS rec, d.file_id IS NOT NULL AS here,
                 m.size AS ms, d.size AS ds, m.mtime AS mm, d.mtime AS dm, m.tau FROM man m FULL JOIN disk d ON m.file_id = d.file_id)
    SELECT path, 'missing record' AS problem FROM j WHERE NOT rec
    UNION ALL SELECT path, 'missing file' FROM j WHERE rec AND NOT here
    UNION ALL SELECT path, 'stale size' FROM j WHERE rec AND here AND ms <> ds
    UNION ALL SELECT path, 'stale mtime' FROM j WHERE rec AND here AND mm <> dm
    UNION ALL SELECT path, 'threshold mismatch' FROM j WHERE rec AND here AND abs(tau - 0.4) > 1e-12""",
)
def h2_validate_manifest(spark, sf):
    """Records stale for one language, absent for tiny files; one language is not on disk."""
    files = M.files(spark, sf).withColumnRenamed("file_id", "path")
    recorded = files.where("size >= 60").select(
        "path",
        F.when(F.col("lang") == "de", F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.length("source").alias("mtime"),
        F.when(F.col("size") > 5000, 0.5).otherwise(0.4).alias("tau"),
    )
    disk = files.where("lang <> 'fr'").select(
        "path", "size", F.when(F.col("size") % 7 == 0, 0).otherwise(F.length("source")).alias("mtime")
    )
    return H.validate_manifest(recorded, disk, 0.4)


@register(
    "h3_test_rows",
    """SELECT event_id FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'train' WHEN 'view' THEN 'test' END AS p,
           CASE WHEN user_id % 190 < 100 THEN 'train' ELSE 'test' END AS m FROM events) WHERE coalesce(p, m) = 'test'""",
)
def h3_test_rows(spark, sf):
    df = M.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", "train").when(F.col("event_type") == "view", "test").alias("path_split"),
        F.when(F.col("user_id") % 190 < 100, "train").otherwise("test").alias("meta_split"),
    )
    return H.test_rows(df).select("event_id")


@register(
    "h4_count_mismatches",
    """WITH r AS (SELECT o_orderkey AS frame_id, 4 AS recorded FROM orders),
    a AS (SELECT l_orderkey AS frame_id, count(*) AS actual FROM lineitem GROUP BY l_orderkey)
    SELECT coalesce(r.frame_id, a.frame_id) AS frame_id, coalesce(recorded, 0) AS recorded, coalesce(actual, 0) AS actual
    FROM r FULL JOIN a ON r.frame_id = a.frame_id WHERE coalesce(recorded, 0) <> coalesce(actual, 0)""",
)
def h4_count_mismatches(spark, sf):
    """Orders recorded with four items each against the items they have."""
    recorded = M.table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"), F.lit(4).alias("num"))
    rows = M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_id"))
    return H.count_mismatches(recorded, rows, keys=["frame_id"]).select("frame_id", "recorded", "actual")


@register(
    "h5_changed_candidates",
    f"""WITH {M.CAND}, b AS (SELECT scene_id, frame_id, base_score FROM cand),
    a AS (SELECT scene_id, frame_id, CASE WHEN is_empty THEN round(base_score) ELSE base_score END AS base_score FROM cand),
    d AS (SELECT *, 1 AS d FROM b UNION ALL SELECT *, -1 FROM a)
    SELECT scene_id, frame_id, base_score, CAST(sum(d) AS BIGINT) AS excess FROM d GROUP BY ALL HAVING sum(d) <> 0""",
)
def h5_changed_candidates(spark, sf):
    """A re-ranking that wrongly rounds one kind of row, as the signed row difference."""
    before = M.candidates(spark, sf)
    after = before.withColumn("base_score", F.when(F.col("is_empty"), F.round("base_score")).otherwise(F.col("base_score")))
    return H.changed_candidates(before, after, ["scene_id", "frame_id", "base_score"])


SHARDS = f"""{M.FIL},
    piece AS (SELECT scene, substr(sha256, 1, 2) AS b, sha256(string_agg(sha256, '' ORDER BY sha256)) AS h, sum(size) AS sz, count(*) AS n
              FROM fil GROUP BY scene, substr(sha256, 1, 2)),
    sc AS (SELECT scene, sha256(string_agg(h, '' ORDER BY b)) AS h, sum(sz) AS sz, sum(n) AS n FROM piece GROUP BY scene),
    pl AS (SELECT *, (row_number() OVER (ORDER BY scene) - 1) // 5 AS shard FROM sc),
    shards AS (SELECT 'scenes-' || min(scene) || '-' || max(scene) AS path, CAST(sum(sz) AS BIGINT) AS size,
                      sha256(string_agg(h, '' ORDER BY scene)) AS sha256, string_agg(scene, ',' ORDER BY scene) AS scenes,
                      CAST(sum(n) AS BIGINT) AS files FROM pl GROUP BY shard)"""


@register("h6_shard_index", f"WITH {SHARDS} SELECT path, size, sha256, scenes, files FROM shards")
def h6_shard_index(spark, sf):
    return H.shard_index(M.files(spark, sf)).withColumn("scenes", F.array_join("scenes", ","))


@register(
    "h7_upsert_shards",
    f"""WITH {M.FIL}, old AS (SELECT file_id AS path, size, sha256 FROM fil WHERE lang <> 'fr'),
    new AS (SELECT file_id AS path, CASE WHEN lang = 'de' THEN size + 1 ELSE size END AS size, sha256 FROM fil WHERE size >= 60)
    SELECT coalesce(n.path, o.path) AS path, coalesce(n.size, o.size) AS size, coalesce(n.sha256, o.sha256) AS sha256,
           n.path IS NOT NULL AND (o.path IS NULL OR o.size <> n.size OR o.sha256 <> n.sha256) AS changed
    FROM old o FULL JOIN new n ON o.path = n.path""",
)
def h7_upsert_shards(spark, sf):
    files = M.files(spark, sf).select(F.col("file_id").alias("path"), "size", "sha256", "lang")
    index = files.where("lang <> 'fr'").drop("lang")
    new = files.where("size >= 60").select(
        "path", F.when(F.col("lang") == "de", F.col("size") + 1).otherwise(F.col("size")).alias("size"), "sha256"
    )
    return H.upsert_shards(index, new)


@register(
    "h8_verify_shards",
    f"""WITH {M.FIL},
    f AS (SELECT file_id AS path, CASE WHEN lang = 'de' THEN size + 1 ELSE size END AS size,
                 CASE WHEN size % 7 = 0 THEN upper(sha256) ELSE sha256 END AS sha256 FROM fil WHERE lang <> 'fr')
    SELECT i.file_id AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN i.size <> f.size THEN 'size mismatch' ELSE 'hash mismatch' END AS problem
    FROM fil i LEFT JOIN f ON i.file_id = f.path WHERE f.path IS NULL OR i.size <> f.size OR i.sha256 <> f.sha256""",
)
def h8_verify_shards(spark, sf):
    files = M.files(spark, sf).withColumnRenamed("file_id", "path")
    disk = files.where("lang <> 'fr'").select(
        "path",
        F.when(F.col("lang") == "de", F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(F.col("size") % 7 == 0, F.upper("sha256")).otherwise(F.col("sha256")).alias("sha256"),
    )
    return H.verify_shards(files, disk)


@register(
    "h9_verify_tree",
    f"""WITH {M.FIL}, e AS (SELECT lang, count(*) AS expected FROM fil GROUP BY lang),
    a AS (SELECT lang, count(*) AS actual, count(*) FILTER (WHERE size - 20 <= 0) AS empty_files FROM fil WHERE source <> 'web' OR lang = 'en' GROUP BY lang),
    m AS (SELECT d.lang, count(*) AS lines FROM documents d JOIN labels USING (doc_id) GROUP BY d.lang)
    SELECT e.lang, expected, coalesce(actual, 0) AS actual, coalesce(empty_files, 0) AS empty_files, coalesce(lines, 0) AS lines,
           coalesce(actual, 0) = expected AND coalesce(empty_files, 0) = 0 AND coalesce(lines, 0) = expected AS complete
    FROM e LEFT JOIN a USING (lang) LEFT JOIN m USING (lang)""",
)
def h9_verify_tree(spark, sf):
    """Languages as trees: expected files, present files, label lines."""
    files = M.files(spark, sf)
    expected = files.groupBy("lang").agg(F.count(F.lit(1)).alias("expected"))
    disk = files.where("source <> 'web' OR lang = 'en'").select("lang", (F.col("size") - 20).alias("size"))
    lines = (
        M.table(spark, sf, "labels")
        .join(M.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    return H.verify_tree(expected, disk, ["lang"], manifest_lines=lines)


