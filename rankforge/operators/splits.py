"""Splits, shards, packed offsets and batch assignment.

Batches are described over *frames* (counts and ranges); candidate rows find
their batch by a join or by arithmetic, never by a pass over all candidates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.functions.expressions import hash_order
from rankforge.plans.groups import GROUP_LIMIT, groups_bounded, rank_within, ranged, require_none, scan_within
from rankforge.session import materialise


def _split_units(df: DataFrame, unit: Sequence[str], ratio: float, seed: int, limit: int) -> DataFrame:
    units = df.select(*unit).distinct()
    n = units.count()
    if ratio <= 0 or n <= 1:
        return df.withColumn("is_val", F.lit(False))
    # Python's round: halves go to the even neighbour.
    val = min(max(round(n * ratio), 1), n - 1)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in unit])
    order = [hash_order(seed, key), *[F.asc(c) for c in unit]]
    ranked = rank_within(units, [], order, "_n", limit)
    flags = ranked.select(*unit, (F.col("_n") <= val).alias("is_val"))
    return df.join(flags, list(unit))


def split_by_scene(
    df: DataFrame, ratio: float = 0.1, seed: int = 7, scene: str = "scene_id", limit: int = GROUP_LIMIT
) -> DataFrame:
    """Seeded split by scene: ``is_val`` per row, no scene on both sides."""
    return _split_units(df, [scene], ratio, seed, limit)


def split_by_frame(
    df: DataFrame,
    ratio: float = 0.1,
    seed: int = 7,
    frame: Sequence[str] = ("scene_id", "frame_id"),
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Seeded split by frame; scenes may fall on both sides."""
    return _split_units(df, list(frame), ratio, seed, limit)


def strided_shard(
    df: DataFrame,
    shards: int,
    shard: int | None = None,
    order: Sequence[str] = ("scene_id", "frame_id"),
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Ordinal modulo ``shards`` over sorted frames; one shard's frames if given."""
    if shards <= 0 or (shard is not None and not 0 <= shard < shards):
        raise ValueError("need shards > 0 and 0 <= shard < shards")
    out = rank_within(df, [], [F.asc(c) for c in order], "_n", limit)
    out = out.withColumn("shard", ((F.col("_n") - 1) % shards).cast("int")).drop("_n")
    return out if shard is None else out.where(F.col("shard") == shard)


def scene_chunks(
    frames: DataFrame, size: int = 256, scene: str = "scene_id", order: str = "frame_id", limit: int = GROUP_LIMIT
) -> DataFrame:
    """Chunk number of each frame inside its scene."""
    out = rank_within(frames, [scene], [F.asc(order)], "_n", limit)
    return out.withColumn("chunk", F.floor((F.col("_n") - 1) / size)).drop("_n")


def pack_offsets(
    frames: DataFrame,
    order: Sequence[Column | str] = ("frame_id",),
    count: str = "num",
    start: str = "start",
    end: str = "end",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Half-open row range of every frame in packed order; empty frames keep a zero range."""
    cols = [F.asc(c) if isinstance(c, str) else c for c in order]
    out = scan_within(frames, [], cols, {end: ("sum", F.col(count).cast("long"))}, limit)
    return out.withColumn(start, F.col(end) - F.col(count))


def packed_lookup(
    wanted: DataFrame, offsets: DataFrame, idx: str = "idx", frame: Sequence[str] = ("frame_id",), width: int | None = None
) -> DataFrame:
    """Global row number to (frame, local index); negatives count from the end.

    An interval join by equal buckets: each range is listed under the buckets it
    touches. The default bucket is the mean frame size, so a bucket holds few frames.
    """
    size = offsets.agg(
        F.max("end").alias("total"), F.count_if(F.col("end") > F.col("start")).alias("filled")
    ).first()
    total = size.total or 0
    if width is None:
        width = max(1, total // max(size.filled, 1))
    at = F.when(F.col(idx) < 0, F.col(idx) + total).otherwise(F.col(idx))
    q = wanted.withColumn("_at", at)
    require_none(q.where((F.col("_at") < 0) | (F.col("_at") >= total)), f"index outside 0..{total - 1}")
    ranges = offsets.where(F.col("end") > F.col("start")).select(
        *frame,
        F.col("start").alias("_start"),
        F.col("end").alias("_end"),
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bucket"),
    )
    hit = (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end"))
    return (
        q.withColumn("_bucket", F.floor(F.col("_at") / width))
        .join(ranges, "_bucket")
        .where(hit)
        .select(*wanted.columns, *frame, (F.col("_at") - F.col("_start")).alias("local_idx"))
    )


def batches_contiguous(
    frames: DataFrame,
    batch: int,
    seed: int = 0,
    epoch: int = 0,
    shuffle: bool = True,
    drop_last: bool = False,
    count: str = "num",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Fixed chunks of the packed row order: ``batch``, row range, place in the epoch.

    A row's batch is its packed index divided by the batch size.
    """
    if batch <= 0:
        raise ValueError("batch size must be positive")
    total = frames.agg(F.sum(F.greatest(F.col(count), F.lit(0)))).first()[0] or 0
    n = total // batch if drop_last else -(-total // batch)
    chunks = frames.sparkSession.range(n).select(
        F.col("id").alias("batch"),
        (F.col("id") * batch).alias("start"),
        F.least((F.col("id") + 1) * batch, F.lit(total)).alias("stop"),
    )
    if not shuffle:
        return chunks.withColumn("position", F.col("batch"))
    order = [hash_order(seed + epoch, F.col("batch")), F.asc("batch")]
    ranked = rank_within(chunks, [], order, "_n", limit)
    return ranked.withColumn("position", F.col("_n") - 1).drop("_n")


def batches_mixed(
    frames: DataFrame,
    batch: int,
    seed: int = 0,
    epoch: int = 0,
    shuffle: bool = True,
    drop_last: bool = False,
    frame: str = "frame_id",
    count: str = "num",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Frames in seeded order, ranges concatenated and cut every ``batch`` rows.

    One row per piece: batch, frame and the local row range inside the frame.
    """
    if batch <= 0:
        raise ValueError("batch size must be positive")
    live = frames.where(F.col(count) > 0)
    order = [hash_order(seed + epoch, F.col(frame)), F.asc(frame)] if shuffle else [F.asc(frame)]
    placed = pack_offsets(live, order, count, "_from", "_to", limit)
    pieces = placed.select(
        frame,
        "_from",
        "_to",
        F.explode(F.sequence(F.floor(F.col("_from") / batch), F.floor((F.col("_to") - 1) / batch))).alias("batch"),
    ).select(
        "batch",
        frame,
        (F.greatest(F.col("_from"), F.col("batch") * batch) - F.col("_from")).alias("local_start"),
        (F.least(F.col("_to"), (F.col("batch") + 1) * batch) - F.col("_from")).alias("local_stop"),
    )
    if not drop_last:
        return pieces
    total = live.agg(F.sum(count)).first()[0] or 0
    return pieces.where(F.col("batch") < total // batch)


def _block_exits(first: int, reach: int):
    """Per block of frames: where a batch chain entering at each of the first rows leaves."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, nxt = pdf["pos"].to_numpy(), pdf["next"].to_numpy()
        low, out = pos[0], nxt.copy()
        for i in range(len(pos) - 1, -1, -1):
            if nxt[i] - low < len(pos):
                out[i] = out[nxt[i] - low]
        keep = slice(0, min(reach, len(pos))) if low > first else slice(0, 1)
        return pd.DataFrame({"pos": pos[keep], "to": out[keep]})

    return run


def _mark_starts(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("pos")
    pos, nxt = pdf["pos"].to_numpy(), pdf["next"].to_numpy()
    flags = np.zeros(len(pos), dtype=np.int64)
    at = int(pdf["entry"].iloc[0]) - pos[0]
    while at < len(pos):
        flags[at] = 1
        at = nxt[at] - pos[0]
    return pd.DataFrame({"pos": pos, "opens": flags})


def _chain_entries(nexts: DataFrame, entries: DataFrame, batch: int, total: int) -> DataFrame:
    """First batch start of every block, by pointer doubling over block exits."""
    jump = materialise(nexts.groupBy("block").applyInPandas(_block_exits(1, batch + 1), "pos long, to long"))
    known = 1
    while True:
        fresh = entries.join(jump, "pos").select(F.col("to").alias("pos")).where(F.col("pos") <= total)
        entries = materialise(entries.unionByName(fresh).distinct())
        reached = entries.count()
        if reached == known:
            return entries
        known = reached
        jump = materialise(
            jump.alias("a")
            .join(jump.alias("b"), F.col("a.to") == F.col("b.pos"), "left")
            .select("a.pos", F.coalesce("b.to", "a.to").alias("to"))
        )


def batches_whole_frames(
    frames: DataFrame,
    batch: int,
    seed: int = 0,
    epoch: int = 0,
    shuffle: bool = False,
    frame: str = "frame_id",
    count: str = "num",
    block: int = 262_144,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Fill batches with whole frames in order: (frame, num, batch).

    A batch closes before a frame that would overflow it; a frame of at least
    ``batch`` rows stands alone; empty frames are skipped. Where a batch starting
    at frame i ends depends only on prefix sums, so every frame first learns its
    successor start in parallel. Blocks of fixed size then reduce their chains to
    entry -> exit pairs, pointer doubling links the blocks, and each block marks
    its own starts. No task walks more than one block.
    """
    if batch <= 0:
        raise ValueError("batch size must be positive")
    block = max(block, batch)
    live = frames.where(F.col(count) > 0).select(frame, F.col(count).cast("long").alias("num"))
    order = [hash_order(seed + epoch, F.col(frame)), F.asc(frame)] if shuffle else [F.asc(frame)]
    bounded = groups_bounded(live, [], limit)
    placed = materialise(
        scan_within(live, [], order, {"pos": ("rank", F.lit(1)), "end": ("sum", F.col("num"))}, limit, bounded)
    )
    # Last frame whose end lies within start + batch: a running maximum in
    # buckets of ``batch`` rows, each holding at most ``batch`` frames.
    ends = placed.select(F.col("end").alias("v"), F.lit(0).alias("kind"), "pos")
    probes = placed.select((F.col("end") - F.col("num") + batch).alias("v"), F.lit(1).alias("kind"), "pos")
    both = ends.unionByName(probes).withColumn("bucket", F.floor(F.col("v") / batch))
    upto = Window.partitionBy("bucket").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("last", F.max(F.when(F.col("kind") == 0, F.col("pos"))).over(upto)).where("kind = 1")
    before = ends.groupBy((F.floor(F.col("v") / batch) + 1).alias("bucket")).agg(F.max("pos").alias("prev"))
    nexts = materialise(
        near.join(before, "bucket", "left").select(
            "pos",
            (F.greatest(F.col("pos"), F.coalesce("last", "prev", "pos")) + 1).alias("next"),
            F.floor((F.col("pos") - 1) / block).alias("block"),
        )
    )
    total = placed.count()
    entries = frames.sparkSession.createDataFrame([(1,)], "pos long")
    if total > block:
        entries = _chain_entries(nexts, entries, batch, total)
    heads = entries.groupBy(F.floor((F.col("pos") - 1) / block).alias("block")).agg(F.min("pos").alias("entry"))
    starts = nexts.join(heads, "block").groupBy("block").applyInPandas(_mark_starts, "pos long, opens long")
    numbered = scan_within(
        placed.join(starts, "pos"), [], [F.asc("pos")], {"_opened": ("sum", F.col("opens"))}, limit, bounded
    )
    return numbered.select(frame, "num", (F.col("_opened") - 1).alias("batch"))


def contiguous_runs(
    df: DataFrame,
    idx: str = "idx",
    order: str | None = None,
    keys: Sequence[str] = (),
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Maximal runs of consecutive ids: run start, length and first position.

    With ``order`` the ids are read in that order, otherwise sorted and unique. Rows are
    sorted by ranges of (keys, order) and shuffled once; each batch of them gives its own runs.
    Only the groups at the edges of batches, two a batch, are compared with each other.
    """
    keys, by = list(keys), order or idx
    rows = df.select(*dict.fromkeys([*keys, by, idx]))
    placed = ranged(rows, keys, [F.asc(by)], limit).sortWithinPartitions(*keys, F.asc(by))
    schema = T.StructType(
        [
            *[rows.schema[k] for k in keys],
            T.StructField("start", rows.schema[idx].dataType),
            *T.StructType.fromDDL("length long, position long, _run long, _edge boolean, _block long").fields,
        ]
    )
    pieces = materialise(placed.select(*keys, F.col(idx).alias("_idx"), F.spark_partition_id().alias("_part")).mapInArrow(_batch_runs(keys), schema))
    out = [*keys, "start", "length", "position"]
    edges = pieces.where("_edge")
    blocks = edges.groupBy(*keys, "_block").agg(
        F.sum("length").alias("_rows"),
        F.max("_run").alias("_runs"),
        F.min_by("start", "_run").alias("_first"),
        F.min_by("length", "_run").alias("_head"),
        F.max_by(F.col("start") + F.col("length") - 1, "_run").alias("_last"),
    )
    ordered = Window.partitionBy(*keys).orderBy("_block")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns(
        {
            "_base": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
            "_goes_on": F.coalesce(F.col("_first") == F.lag("_last").over(ordered) + 1, F.lit(False)),
        }
    )
    # The block in which the run opened that a block goes on with.
    opened = F.when((F.col("_runs") > 1) | ~F.col("_goes_on"), F.col("_block"))
    blocks = materialise(blocks.withColumn("_from", F.max(opened).over(earlier)))
    named = {k: F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)}

    def of_block(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
        return left.join(right, [*same, F.col("_block") == F.col("_b")], how).drop("_b", *[f"_g{i}" for i in range(len(keys))])

    more = blocks.where("_goes_on").groupBy(*keys, "_from").agg(F.sum("_head").alias("_more"))
    known = of_block(blocks, more.select(*named.values(), F.col("_from").alias("_b"), "_more"), "left")
    known = materialise(known.select(*named.values(), F.col("_block").alias("_b"), "_runs", "_base", "_goes_on", F.coalesce("_more", F.lit(0)).alias("_more")))
    joined = of_block(edges, known, "inner").where(~(F.col("_goes_on") & (F.col("_run") == 1)))
    joined = joined.withColumns(
        {
            "length": F.col("length") + F.when(F.col("_run") == F.col("_runs"), F.col("_more")).otherwise(0),
            "position": F.col("position") + F.col("_base"),
        }
    )
    return pieces.where("NOT _edge").select(*out).unionByName(joined.select(*out))


def _batch_runs(keys: list[str]):
    """Runs inside each batch of sorted rows; ``_edge`` marks those of its first and last group."""

    def differs(a: pa.Array, b: pa.Array) -> np.ndarray:
        other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(a.type):
            other = pc.and_(other, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
        return other.to_numpy(zero_copy_only=False)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(len(keys))
            value, there = pc.fill_null(ids, 0).cast(pa.int64()).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False)
            fresh = np.ones(n, dtype=bool)
            fresh[1:] = False
            for i in range(len(keys)):
                fresh[1:] |= differs(batch.column(i)[1:], batch.column(i)[:-1])
            opens = fresh.copy()
            opens[1:] |= ~(there[1:] & there[:-1] & (value[1:] == value[:-1] + 1))
            at = np.flatnonzero(opens)
            group = (np.cumsum(fresh) - 1)[at]
            heads = np.searchsorted(group, np.arange(group[-1] + 1))
            block = (batch.column(len(keys) + 1)[0].as_py() << 32) + number
            found = [
                np.diff(np.append(at, n)),
                at - np.flatnonzero(fresh)[group],
                np.arange(len(at)) - heads[group] + 1,
                (group == 0) | (group == group[-1]),
                np.full(len(at), block),
            ]
            named = [*keys, "start", "length", "position", "_run", "_edge", "_block"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(at)) for i in range(len(keys) + 1)], *map(pa.array, found)], named)

    return runs


def select_packed(index: DataFrame, requested: DataFrame, frame: str = "frame_id") -> tuple[DataFrame, DataFrame]:
    """Resolve requested archives in the packed index: (found, missing).

    By absolute path, else by (root, relative path), else by a relative path
    that is unique in the index. Both tables carry ``absolute_path``,
    ``root_index`` and ``relative_path``; the index also ``frame``.
    """
    by_abs = index.where(F.col("absolute_path").isNotNull()).select("absolute_path", F.col(frame).alias("_a"))
    by_root = index.select("root_index", "relative_path", F.col(frame).alias("_b"))
    by_rel = (
        index.groupBy("relative_path")
        .agg(F.count(F.lit(1)).alias("_n"), F.first(frame).alias("_c"))
        .where("_n = 1")
        .drop("_n")
    )
    out = (
        requested.join(by_abs, "absolute_path", "left")
        .join(by_root, ["root_index", "relative_path"], "left")
        .join(by_rel, "relative_path", "left")
        .select(*requested.columns, F.coalesce("_a", "_b", "_c").alias(frame))
    )
    return out.where(F.col(frame).isNotNull()), out.where(F.col(frame).isNull()).drop(frame)
