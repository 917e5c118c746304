"""Queries for scoring, ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge import schemas as S
from rankforge.operators import evaluation as G
from rankforge.operators import scoring as E
from rankforge.plans.pipelines import compare_orders
from suite import mappings as M
from suite.registry import r6, register, s6

KEYS = S.FRAME_KEYS
IDS = ["scene_id", "frame_id", "cand_idx"]


@register("e1_zscore", f"WITH {M.ZED} SELECT scene_id, frame_id, cand_idx, {s6('base_z', 'model_z')} FROM zed")
def e1_zscore(spark, sf):
    df = E.zscore(M.candidates(spark, sf), {"base_z": "base_score", "model_z": "model_score"})
    return df.select(*IDS, *r6("base_z", "model_z"))


@register(
    "e2_fuse",
    f"WITH {M.ZED}, f AS (SELECT *, {M.fused_sql(0.8)} FROM zed) SELECT scene_id, frame_id, cand_idx, {s6('fused')} FROM f",
)
def e2_fuse(spark, sf):
    df = E.zscore(M.candidates(spark, sf), {"base_z": "base_score", "model_z": "model_score"})
    return df.select(*IDS, E.fuse("base_z", "model_z", 0.8).alias("fused")).select(*IDS, *r6("fused"))


@register(
    "e3_rank_candidates",
    f"""WITH {M.CAND}
    SELECT scene_id, frame_id, cand_idx,
           row_number() OVER (PARTITION BY scene_id, frame_id, camera ORDER BY base_score DESC, cand_idx) AS rank
    FROM cand""",
)
def e3_rank_candidates(spark, sf):
    return E.rank_candidates(M.candidates(spark, sf), "base_score").select(*IDS, "rank")


# Scores of eight levels between 1/2 and 1, where a float32 step is 2^-24, so that ties are common.
LEVEL = "0.5 + ((cand_idx * 7919) % 8 + 1) / 16.0"


@register(
    "e4_strictly_descending",
    f"""WITH {M.CAND}, s AS (SELECT scene_id, frame_id, camera, cand_idx, ({LEVEL})::DOUBLE AS score FROM cand),
    r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_id, camera ORDER BY score DESC, cand_idx) AS rank FROM s)
    SELECT scene_id, frame_id, cand_idx, rank,
           min(score + rank * power(2, -24)) OVER (PARTITION BY scene_id, frame_id, camera ORDER BY rank) - rank * power(2, -24) AS export_score
    FROM r""",
)
def e4_strictly_descending(spark, sf):
    """Export scores of an order with many ties: each at least one float32 step below the one before."""
    level = F.lit(0.5) + ((F.col("cand_idx") * 7919) % 8 + 1) / 16.0
    ranked = E.rank_candidates(M.candidates(spark, sf).withColumn("score", level), "score")
    out = E.strictly_descending(ranked, "score")
    return out.select(*IDS, "rank", F.col("export_score").cast("double").alias("export_score"))


@register(
    "e5_top1_change",
    f"""WITH {M.ZED}, f AS (SELECT *, {M.fused_sql(0.8)} FROM zed),
    b AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_id, camera ORDER BY base_score DESC, cand_idx) AS br,
                 row_number() OVER (PARTITION BY scene_id, frame_id, camera ORDER BY fused DESC, cand_idx) AS fr FROM f)
    SELECT scene_id, frame_id, count(*) AS candidate_count,
           max(CASE WHEN br = 1 THEN cand_idx END) AS base_top1_idx,
           max(CASE WHEN fr = 1 THEN cand_idx END) AS final_top1_idx,
           max(CASE WHEN br = 1 THEN cand_idx END) <> max(CASE WHEN fr = 1 THEN cand_idx END) AS top1_changed
    FROM b GROUP BY scene_id, frame_id, camera""",
)
def e5_top1_change(spark, sf):
    df = E.zscore(M.candidates(spark, sf), {"base_z": "base_score", "model_z": "model_score"})
    return E.top1_change(df.withColumn("fused", E.fuse("base_z", "model_z", 0.8))).drop("camera")


@register(
    "e6_restore_order",
    f"""WITH {M.CAND}
    SELECT scene_id, frame_id, model_score,
           row_number() OVER (PARTITION BY scene_id, frame_id, camera ORDER BY cand_idx) - 1 AS original_idx
    FROM cand""",
)
def e6_restore_order(spark, sf):
    """Rank by model score, then bring the rows back to detector order."""
    df = E.rank_within(M.candidates(spark, sf), KEYS, [F.asc("cand_idx")], "_p")
    ranked = E.rank_candidates(df.withColumn("original_idx", F.col("_p") - 1), "model_score")
    return E.restore_order(ranked).select("scene_id", "frame_id", "model_score", "original_idx")


@register(
    "e7_match_rows",
    f"""WITH {M.CAND},
    c AS (SELECT scene_id, frame_id, base_score, raw_collision, is_empty, cand_idx, model_score FROM cand),
    s AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_id, base_score, raw_collision, is_empty ORDER BY cand_idx) AS cp FROM c),
    t AS (SELECT scene_id, frame_id, base_score, raw_collision, is_empty, cand_idx AS selected_idx,
                 row_number() OVER (PARTITION BY scene_id, frame_id, base_score, raw_collision, is_empty ORDER BY cand_idx) AS cp
          FROM c WHERE model_score >= 0.5)
    SELECT t.scene_id, t.frame_id, t.selected_idx, s.cand_idx AS source_idx
    FROM t JOIN s USING (scene_id, frame_id, base_score, raw_collision, is_empty, cp)""",
)
def e7_match_rows(spark, sf):
    content = ["scene_id", "frame_id", "base_score", "raw_collision", "is_empty"]
    df = M.candidates(spark, sf)
    source = df.withColumnRenamed("cand_idx", "source_idx")
    selected = df.where(F.col("model_score") >= 0.5).withColumnRenamed("cand_idx", "selected_idx")
    return E.match_rows(source, selected, content, "source_idx", "selected_idx").select(
        "scene_id", "frame_id", "selected_idx", "source_idx"
    )


@register(
    "e8_rerank",
    f"""WITH {M.ZED}, f AS (SELECT *, {M.fused_sql(0.5)} FROM zed)
    SELECT scene_id, frame_id, cand_idx, {s6('base_z', 'model_z', 'fused')},
           row_number() OVER (PARTITION BY scene_id, frame_id, camera ORDER BY f.fused DESC, cand_idx) AS rank
    FROM f""",
)
def e8_rerank(spark, sf):
    return E.rerank(M.candidates(spark, sf), 0.5).select(*IDS, *r6("base_z", "model_z", "fused"), "rank")


SWEEP_ROWS = ", ".join(f"({w!r}::DOUBLE)" for w in S.SWEEP_WEIGHTS)


@register(
    "e9_lambda_sweep",
    f"""WITH {M.ZED},
    f AS (SELECT *, (1 - lam) * base_z + lam * model_z AS fused FROM zed CROSS JOIN (VALUES {SWEEP_ROWS}) w(lam)),
    {M.cells_sql('fused', 'f', 'cells', 'lam, ')}
    SELECT lam, {M.AP_COLS} FROM cells GROUP BY lam""",
)
def e9_lambda_sweep(spark, sf):
    return sweep_means(E.lambda_sweep(M.candidates(spark, sf)))


@register(
    "e9_lambda_sweep_frames",
    f"""WITH {M.ZED}, {M.LISTED},
    f AS (SELECT *, (1 - lam) * base_z + lam * model_z AS fused FROM zed CROSS JOIN (VALUES {SWEEP_ROWS}) w(lam)),
    {M.cells_sql('fused', 'f', 'filled', 'lam, ')},
    cells AS (SELECT lam, friction_idx, precision FROM filled
              UNION ALL SELECT lam, friction_idx, 0.0 FROM (SELECT DISTINCT lam, friction_idx, k FROM filled) CROSS JOIN absent)
    SELECT lam, {M.AP_COLS} FROM cells GROUP BY lam""",
)
def e9_lambda_sweep_frames(spark, sf):
    """The sweep over all listed frames: one without candidates scores zero."""
    return sweep_means(E.lambda_sweep(M.candidates(spark, sf), frames=M.listed_frames(spark, sf)))


def sweep_means(cells):
    at = {f: i for i, f in enumerate(S.FRICTIONS)}
    return cells.groupBy("lam").agg(
        F.round(F.avg("ap") * 100, 4).alias("ap"),
        *[
            F.round(F.avg(F.when(F.col("friction") == f, F.col("ap"))) * 100, 4).alias(n)
            for f, n in ((S.FRICTIONS[1], "ap_04"), (S.FRICTIONS[3], "ap_08"))
        ],
    )


@register(
    "g1_precision_at_k",
    f"""WITH {M.ZED}, f AS (SELECT *, {M.fused_sql(0.8)} FROM zed), {M.cells_sql('fused', 'f', 'cells')}
    SELECT scene_id, frame_id, k, friction_idx, {s6('precision')} FROM cells""",
)
def g1_precision_at_k(spark, sf):
    df = E.zscore(M.candidates(spark, sf), {"base_z": "base_score", "model_z": "model_score"})
    cells = G.precision_at_k(df.withColumn("fused", E.fuse("base_z", "model_z", 0.8)))
    return cells.select("scene_id", "frame_id", "k", "friction_idx", *r6("precision"))


@register(
    "g2_ap_summary",
    f"WITH {M.CAND}, {M.cells_sql('base_score', 'cand', 'cells')} SELECT {M.AP_COLS} FROM cells",
)
def g2_ap_summary(spark, sf):
    return G.ap_summary(G.precision_at_k(M.candidates(spark, sf), "base_score"))


@register(
    "g3_ap_by_split",
    f"""WITH {M.CAND}, {M.cells_sql('base_score', 'cand', 'cells')},
    g AS (SELECT *, {M.GROUP_CASE} AS grp FROM cells)
    SELECT 'overall' AS split, {M.AP_COLS} FROM g
    UNION ALL SELECT grp AS split, {M.AP_COLS} FROM g GROUP BY grp""",
)
def g3_ap_by_split(spark, sf):
    return G.ap_by_split(G.frame_ap(M.candidates(spark, sf), "base_score"))


@register(
    "g4_missing_frames",
    f"""WITH {M.CAND}, have AS (SELECT DISTINCT scene_id, frame_id % 256 AS frame_id FROM cand),
    want AS (SELECT s AS scene_id, f AS frame_id FROM range(100, 190) a(s) CROSS JOIN range(0, 256) b(f))
    SELECT CAST(scene_id AS INTEGER) AS scene_id, CAST(frame_id AS INTEGER) AS frame_id
    FROM (SELECT * FROM want EXCEPT SELECT * FROM have)""",
)
def g4_missing_frames(spark, sf):
    have = M.candidates(spark, sf).select("scene_id", (F.col("frame_id") % 256).alias("frame_id"))
    return G.missing_frames(have)


@register(
    "g5_complete_scenes",
    f"""WITH {M.FRM}, k AS (SELECT scene_id, count(*) AS frames, count(*) FILTER (WHERE num > 0) AS filled FROM frm GROUP BY scene_id)
    SELECT scene_id, frames FROM k WHERE frames = filled AND frames = (SELECT max(frames) FROM k WHERE frames = filled)""",
)
def g5_complete_scenes(spark, sf):
    """Scenes whose every frame holds a value, at the largest frame count such a scene reaches."""
    cells = M.frames(spark, sf).select(
        "scene_id", "frame_id", F.when(F.col("num") > 0, F.col("num")).alias("precision")
    )
    full = (
        cells.groupBy("scene_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count("precision").alias("f"))
        .where("n = f")
        .agg(F.max("n"))
        .first()[0]
    )
    return G.complete_scenes(cells, per_scene=full, cells=1)


DELTAS = f"""{M.ZED}, f AS (SELECT *, {M.fused_sql(0.8)} FROM zed),
    {M.cells_sql('base_score', 'f', 'cb')}, {M.cells_sql('fused', 'f', 'ct')},
    mb AS (SELECT scene_id, 100 * avg(precision) AS ap, 100 * avg(CASE WHEN friction_idx = 1 THEN precision END) AS ap_04,
                  100 * avg(CASE WHEN friction_idx = 3 THEN precision END) AS ap_08 FROM cb GROUP BY scene_id),
    mt AS (SELECT scene_id, 100 * avg(precision) AS ap, 100 * avg(CASE WHEN friction_idx = 1 THEN precision END) AS ap_04,
                  100 * avg(CASE WHEN friction_idx = 3 THEN precision END) AS ap_08 FROM ct GROUP BY scene_id),
    d AS (SELECT scene_id, mb.ap AS base_ap, mb.ap_04 AS base_ap_04, mb.ap_08 AS base_ap_08,
                 mt.ap AS treated_ap, mt.ap_04 AS treated_ap_04, mt.ap_08 AS treated_ap_08,
                 mt.ap - mb.ap AS delta_ap, mt.ap_04 - mb.ap_04 AS delta_ap_04, mt.ap_08 - mb.ap_08 AS delta_ap_08
          FROM mb JOIN mt USING (scene_id))"""
DELTA_COLS = [f"{a}_{m}" for a in ("base", "treated", "delta") for m in ("ap", "ap_04", "ap_08")]


def scene_deltas(spark, sf):
    ranked = E.rerank(M.candidates(spark, sf), 0.8)
    return G.paired_delta(G.frame_ap(ranked, "base_score"), G.frame_ap(ranked, "fused"))


@register("g6_paired_delta", f"WITH {DELTAS} SELECT scene_id, {s6(*DELTA_COLS)} FROM d")
def g6_paired_delta(spark, sf):
    return scene_deltas(spark, sf).select("scene_id", *r6(*DELTA_COLS))


@register(
    "g7_bootstrap_ci",
    f"""WITH {DELTAS},
    u AS (SELECT delta_ap AS d, row_number() OVER (ORDER BY scene_id) - 1 AS i, count(*) OVER () AS n FROM d),
    sz AS (SELECT count(*) AS n FROM d),
    slots AS (SELECT draw, CAST('0x' || substr(md5('7:' || draw || ':' || slot), 1, 8) AS BIGINT) % n AS i
              FROM sz, range(0, 10000) a(draw), range(0, n) b(slot)),
    means AS (SELECT draw, avg(d) AS m FROM slots JOIN u USING (i) GROUP BY draw)
    SELECT (SELECT round(avg(d) + 2.3e-8, 6) + 0.0 FROM u) AS mean_delta,
           round(quantile_cont(m, 0.025) + 2.3e-8, 6) + 0.0 AS ci_low, round(quantile_cont(m, 0.975) + 2.3e-8, 6) + 0.0 AS ci_high,
           (SELECT count(*) FROM u WHERE d > 0) AS positive_count,
           (SELECT round(count(*) FILTER (WHERE d > 0) / count(*)::DOUBLE + 2.3e-8, 6) FROM u) AS positive_fraction,
           (SELECT count(*) FROM u) AS scene_count
    FROM means""",
)
def g7_bootstrap_ci(spark, sf):
    out = G.bootstrap_ci(scene_deltas(spark, sf).select("scene_id", "delta_ap"))
    return out.select(*r6("mean_delta", "ci_low", "ci_high"), "positive_count", *r6("positive_fraction"), "scene_count")


@register(
    "g8_results_table",
    f"""WITH {M.ZED},
    f AS (SELECT * EXCLUDE (camera), CASE WHEN is_empty THEN 'kinect' ELSE 'realsense' END AS camera, {M.fused_sql(0.8)} FROM zed),
    {M.cells_sql('base_score', 'f', 'cb')}, {M.cells_sql('fused', 'f', 'ct')},
    g AS (SELECT camera, 'baseline' AS v, {M.GROUP_CASE} AS grp, 100 * avg(precision) AS ap FROM cb GROUP BY ALL
          UNION ALL SELECT camera, 'treated', {M.GROUP_CASE} AS grp, 100 * avg(precision) FROM ct GROUP BY ALL),
    w AS (SELECT camera, {", ".join(f"max(CASE WHEN v = '{v}' AND grp = '{g}' THEN ap END) AS {v}_{g}" for g in ("seen", "similar", "novel") for v in ("baseline", "treated"))} FROM g GROUP BY camera)
    SELECT camera, {s6(*[f"{v}_{g}" for g in ("seen", "similar", "novel") for v in ("baseline", "treated")])},
           round((baseline_seen + baseline_similar + baseline_novel) / 3 + 2.3e-8, 6) AS baseline_average,
           round((treated_seen + treated_similar + treated_novel) / 3 + 2.3e-8, 6) AS treated_average
    FROM w""",
)
def g8_results_table(spark, sf):
    df = E.zscore(M.candidates(spark, sf), {"base_z": "base_score", "model_z": "model_score"})
    df = df.withColumn("fused", E.fuse("base_z", "model_z", 0.8)).withColumn(
        "camera", F.when(F.col("is_empty"), "kinect").otherwise("realsense")
    )
    prec = G.frame_ap(df, "base_score").withColumn("variant", F.lit("baseline")).unionByName(
        G.frame_ap(df, "fused").withColumn("variant", F.lit("treated"))
    )
    out = G.results_table(prec, ["camera"])
    return out.select("camera", *r6(*[c for c in out.columns if c != "camera"]))


@register(
    "compare_orders",
    f"""WITH {M.ZED}, f AS (SELECT *, {M.fused_sql(0.8)} FROM zed),
    {M.cells_sql('base_score', 'f', 'cb')}, {M.cells_sql('fused', 'f', 'ct')},
    g AS (SELECT 'detector' AS "order", *, {M.GROUP_CASE} AS grp FROM cb
          UNION ALL SELECT 'fused', *, {M.GROUP_CASE} AS grp FROM ct)
    SELECT "order", 'overall' AS split, {M.AP_COLS} FROM g GROUP BY "order"
    UNION ALL SELECT "order", grp AS split, {M.AP_COLS} FROM g GROUP BY "order", grp""",
)
def flagship(spark, sf):
    return compare_orders(M.candidates(spark, sf), 0.8)


@register(
    "compare_orders_frames",
    f"""WITH {M.ZED}, {M.LISTED}, f AS (SELECT *, {M.fused_sql(0.8)} FROM zed),
    {M.cells_sql('base_score', 'f', 'cb')}, {M.cells_sql('fused', 'f', 'ct')},
    e AS (SELECT absent.*, x.k, x.friction_idx, x.friction, 0.0::DOUBLE AS precision
          FROM absent CROSS JOIN (SELECT DISTINCT k, friction_idx, friction FROM cb) x),
    g AS (SELECT 'detector' AS "order", scene_id, friction_idx, precision, {M.GROUP_CASE} AS grp FROM cb
          UNION ALL SELECT 'fused', scene_id, friction_idx, precision, {M.GROUP_CASE} AS grp FROM ct
          UNION ALL SELECT o, scene_id, friction_idx, precision, {M.GROUP_CASE} AS grp FROM e CROSS JOIN (VALUES ('detector'), ('fused')) t(o))
    SELECT "order", 'overall' AS split, {M.AP_COLS} FROM g GROUP BY "order"
    UNION ALL SELECT "order", grp AS split, {M.AP_COLS} FROM g GROUP BY "order", grp""",
)
def compare_orders_frames(spark, sf):
    """Both orders over all listed frames."""
    return compare_orders(M.candidates(spark, sf), 0.8, frames=M.listed_frames(spark, sf))
