"""Queries for splits, shards, offsets and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.operators import splits as I
from suite import mappings as M
from suite.registry import register

BATCH = 512


@register(
    "i1_split_by_scene",
    f"""WITH {M.CAND}, u AS (SELECT DISTINCT scene_id FROM cand),
    r AS (SELECT scene_id, row_number() OVER (ORDER BY md5('7:' || scene_id), scene_id) AS n, count(*) OVER () AS total FROM u)
    SELECT cand_idx, scene_id, n <= least(greatest(round_even(total * 0.1, 0), 1), total - 1) AS is_val
    FROM cand JOIN r USING (scene_id)""",
)
def i1_split_by_scene(spark, sf):
    return I.split_by_scene(M.candidates(spark, sf)).select("cand_idx", "scene_id", "is_val")


@register(
    "i2_split_by_frame",
    f"""WITH {M.FRM},
    r AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || scene_id || ':' || frame_id), scene_id, frame_id) AS n, count(*) OVER () AS total FROM frm)
    SELECT frame_id, scene_id, n <= least(greatest(round_even(total * 0.1, 0), 1), total - 1) AS is_val FROM r""",
)
def i2_split_by_frame(spark, sf):
    return I.split_by_frame(M.frames(spark, sf)).select("frame_id", "scene_id", "is_val")


@register(
    "i3_strided_shard",
    f"""WITH {M.FRM} SELECT frame_id, scene_id, CAST((row_number() OVER (ORDER BY scene_id, frame_id) - 1) % 7 AS INTEGER) AS shard FROM frm""",
)
def i3_strided_shard(spark, sf):
    return I.strided_shard(M.frames(spark, sf), 7).select("frame_id", "scene_id", "shard")


@register(
    "i4_scene_chunks",
    f"""WITH {M.FRM}, wide AS (SELECT frame_id, scene_id % 19 AS scene_id FROM frm)
    SELECT frame_id, scene_id, (row_number() OVER (PARTITION BY scene_id ORDER BY frame_id) - 1) // 256 AS chunk FROM wide""",
)
def i4_scene_chunks(spark, sf):
    """Ten scenes joined to one, so that a scene fills several chunks."""
    frames = M.frames(spark, sf).withColumn("scene_id", F.col("scene_id") % 19)
    return I.scene_chunks(frames, 256).select("frame_id", "scene_id", "chunk")


OFFSETS = f"""{M.FRM}, off AS (SELECT frame_id, num, CAST(sum(num) OVER (ORDER BY frame_id) AS BIGINT) AS e,
      CAST(sum(num) OVER (ORDER BY frame_id) AS BIGINT) - num AS s FROM frm)"""


@register("i5_pack_offsets", f'WITH {OFFSETS} SELECT frame_id, num, s AS "start", e AS "end" FROM off')
def i5_pack_offsets(spark, sf):
    return I.pack_offsets(M.frames(spark, sf)).select("frame_id", "num", "start", "end")


@register(
    "i6_packed_lookup",
    f"""WITH {OFFSETS}, q AS (SELECT event_id, CASE WHEN event_type = 'error' THEN -1 - event_id ELSE event_id END AS idx FROM events),
    a AS (SELECT event_id, idx, CASE WHEN idx < 0 THEN idx + (SELECT max(e) FROM off) ELSE idx END AS pos FROM q)
    SELECT event_id, idx, frame_id, pos - s AS local_idx FROM a JOIN off ON pos >= s AND pos < e""",
)
def i6_packed_lookup(spark, sf):
    idx = F.when(F.col("event_type") == "error", -1 - F.col("event_id")).otherwise(F.col("event_id"))
    wanted = M.table(spark, sf, "events").select("event_id", idx.alias("idx"))
    return I.packed_lookup(wanted, I.pack_offsets(M.frames(spark, sf)))


@register(
    "i7_batches_contiguous",
    f"""WITH {M.FRM}, t AS (SELECT CAST(sum(num) AS BIGINT) AS total FROM frm),
    c AS (SELECT b AS batch, b * {BATCH} AS "start", least((b + 1) * {BATCH}, total) AS stop FROM t, range(0, total // {BATCH}) r(b))
    SELECT batch, "start", stop, row_number() OVER (ORDER BY md5('12:' || batch), batch) - 1 AS position FROM c""",
)
def i7_batches_contiguous(spark, sf):
    return I.batches_contiguous(M.frames(spark, sf), BATCH, seed=7, epoch=5, drop_last=True)


@register(
    "i8_batches_mixed",
    f"""WITH {M.FRM}, live AS (SELECT frame_id, num, row_number() OVER (ORDER BY md5('10:' || frame_id), frame_id) AS n FROM frm WHERE num > 0),
    o AS (SELECT frame_id, CAST(sum(num) OVER (ORDER BY n) AS BIGINT) AS t, CAST(sum(num) OVER (ORDER BY n) AS BIGINT) - num AS f FROM live),
    p AS (SELECT *, unnest(range(f // {BATCH}, (t - 1) // {BATCH} + 1)) AS batch FROM o)
    SELECT batch, frame_id, greatest(f, batch * {BATCH}) - f AS local_start, least(t, (batch + 1) * {BATCH}) - f AS local_stop FROM p""",
)
def i8_batches_mixed(spark, sf):
    return I.batches_mixed(M.frames(spark, sf), BATCH, seed=7, epoch=3)


@register(
    "i9_batches_whole_frames",
    f"""WITH RECURSIVE {M.FRM},
    p AS (SELECT frame_id, num, row_number() OVER (ORDER BY frame_id) AS pos, CAST(sum(num) OVER (ORDER BY frame_id) AS BIGINT) AS e FROM frm WHERE num > 0),
    rec AS (SELECT CAST(1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS no
      UNION ALL
      SELECT max(q.pos) + 1, r.no + 1 FROM rec r JOIN p a ON a.pos = r.pos JOIN p q ON q.pos >= r.pos AND (q.pos = r.pos OR q.e <= a.e - a.num + {BATCH})
      WHERE r.pos <= (SELECT max(pos) FROM p) GROUP BY r.pos, r.no)
    SELECT frame_id, num, (SELECT max(no) FROM rec WHERE rec.pos <= p.pos) AS batch FROM p""",
)
def i9_batches_whole_frames(spark, sf):
    return I.batches_whole_frames(M.frames(spark, sf), BATCH)


@register(
    "i10_contiguous_runs",
    """WITH u AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
    g AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS p FROM u)
    SELECT l_suppkey, min(l_partkey) AS "start", count(*) AS length, min(p) - 1 AS position FROM g GROUP BY l_suppkey, l_partkey - p""",
)
def i10_contiguous_runs(spark, sf):
    ids = M.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return I.contiguous_runs(ids, "l_partkey", keys=["l_suppkey"])


@register(
    "i10_requested_runs",
    """WITH o AS (SELECT o_custkey AS idx, o_orderstatus AS k, o_orderkey AS seq FROM orders),
    l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS p, CASE WHEN idx = lag(idx) OVER (PARTITION BY k ORDER BY seq) + 1 THEN 0 ELSE 1 END AS op FROM o),
    r AS (SELECT *, sum(op) OVER (PARTITION BY k ORDER BY seq) AS run FROM l)
    SELECT k, arg_min(idx, p) AS "start", count(*) AS length, min(p) - 1 AS position FROM r GROUP BY k, run""",
)
def i10_requested_runs(spark, sf):
    """Runs in request order, where ids repeat and jump."""
    ids = M.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("idx"), F.col("o_orderstatus").alias("k"), F.col("o_orderkey").alias("seq")
    )
    return I.contiguous_runs(ids, "idx", order="seq", keys=["k"])


PACKED = """
ix AS (SELECT doc_id AS frame_id, CASE WHEN lang = 'en' THEN '/data/' || source || '/' || doc_id END AS absolute_path,
              CAST(n_chars % 2 AS INTEGER) AS root_index, source || '/' || CAST(doc_id AS VARCHAR) AS relative_path FROM documents),
rq AS (SELECT doc_id AS request, '/data/' || source || '/' || doc_id AS absolute_path, 0 AS root_index,
              source || '/' || CAST(CASE WHEN lang = 'de' THEN -doc_id ELSE doc_id END AS VARCHAR) AS relative_path FROM documents),
res AS (SELECT rq.*, coalesce(a.frame_id, b.frame_id, c.frame_id) AS frame_id FROM rq
        LEFT JOIN ix a ON a.absolute_path = rq.absolute_path
        LEFT JOIN ix b ON b.root_index = rq.root_index AND b.relative_path = rq.relative_path
        LEFT JOIN (SELECT relative_path, min(frame_id) AS frame_id FROM ix GROUP BY relative_path HAVING count(*) = 1) c ON c.relative_path = rq.relative_path)"""


def packed_request(spark, sf):
    docs = M.table(spark, sf, "documents")
    absolute = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))

    def relative(i):
        return F.concat(F.col("source"), F.lit("/"), i.cast("string"))

    index = docs.select(
        F.col("doc_id").alias("frame_id"),
        F.when(F.col("lang") == "en", absolute).alias("absolute_path"),
        (F.col("n_chars") % 2).cast("int").alias("root_index"),
        relative(F.col("doc_id")).alias("relative_path"),
    )
    requested = docs.select(
        F.col("doc_id").alias("request"),
        absolute.alias("absolute_path"),
        F.lit(0).alias("root_index"),
        relative(F.when(F.col("lang") == "de", -F.col("doc_id")).otherwise(F.col("doc_id"))).alias("relative_path"),
    )
    return I.select_packed(index, requested)


@register("i11_select_packed", f"WITH {PACKED} SELECT request, frame_id FROM res WHERE frame_id IS NOT NULL")
def i11_select_packed(spark, sf):
    return packed_request(spark, sf)[0].select("request", "frame_id")


@register("i11_missing_packed", f"WITH {PACKED} SELECT request, relative_path FROM res WHERE frame_id IS NULL")
def i11_missing_packed(spark, sf):
    return packed_request(spark, sf)[1].select("request", "relative_path")
