"""Hard negatives by angular triangle filtering.

Every vector stores its angles to a few reference directions. For two vectors
the differences of these angles bound the angle between them from below and the
sums bound it from above; times the norms that bounds their score from both
sides. Rows lie in blocks of one label and one nearest reference, sorted by the
angle to it, so that the rows whose bounds can reach a wanted window of scores
stand next to each other: only these are scored, in exact integers. Blocks whose
ranges of angles rule them out are not even joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import pick
from rankforge.session import materialise

REFERENCES = 8
REFERENCE_SAMPLE = 2048
BLOCK_ROWS = 4096
ANCHOR_BLOCK = 256
STRIP = 64
TASK_SCORES = 20_000_000
#: Angles are off by less than 1e-7 after rounding; relative slack of score bounds.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
EXACT = 2.0**53
LARGEST = 2**63 - 1

_PACKED = "n long, dim int, kind string, vectors binary, rows binary, ids binary, known binary, norms binary, angles binary"
_SUMMARY = "norm_low double, norm_high double, angle_low array<double>, angle_high array<double>"


def _angles(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to unit directions; a zero vector has none and stands at a right angle."""
    if not len(references):
        return np.zeros((len(vectors), 0))
    lengths = np.where(norms > 0, norms, 1.0)[:, None]
    # Divided first: neither squares nor products of very large components overflow.
    return np.arccos(np.clip((vectors / lengths) @ references.T, -1.0, 1.0))


def _norms(vectors: np.ndarray) -> np.ndarray:
    if not vectors.size:
        return np.zeros(len(vectors))
    largest = np.abs(vectors).max(axis=1)
    scale = np.where(largest > 0, largest, 1.0)
    return scale * np.sqrt(((vectors / scale[:, None]) ** 2).sum(axis=1))


def _matrix(data: Sequence[bytes]) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled up with zeros."""
    found = [np.frombuffer(d, "<f8") for d in data]
    out = np.zeros((len(found), max(map(len, found), default=0)))
    for row, vector in zip(out, found):
        row[: len(vector)] = vector
    return out


def _pack(vectors: np.ndarray, rows, ids, known, norms: np.ndarray, angles: np.ndarray) -> dict:
    """Columns of a block, vectors in the narrowest type that holds them."""
    kind = next((k for k in ("<i2", "<i4") if not vectors.size or np.abs(vectors).max() <= np.iinfo(k).max), "<f8")
    return {
        "n": len(vectors), "dim": vectors.shape[1], "kind": kind, "vectors": vectors.astype(kind).tobytes(),
        "rows": np.asarray(rows, "<i8").tobytes(), "ids": np.asarray(ids, "<i8").tobytes(), "known": np.asarray(known, "?").tobytes(),
        "norms": norms.astype("<f8").tobytes(), "angles": angles.astype("<f8").tobytes(),
        "norm_low": float(norms.min()), "norm_high": float(norms.max()),
        "angle_low": angles.min(axis=0), "angle_high": angles.max(axis=0),
    }


class _Block:
    """A packed block, opened."""

    def __init__(self, row, prefix: str):
        def get(name: str):
            return getattr(row, prefix + name)

        self.vectors = np.frombuffer(get("vectors"), get("kind")).reshape(get("n"), get("dim")).astype(np.float64)
        self.rows, self.ids = (np.frombuffer(get(c), "<i8") for c in ("rows", "ids"))
        self.known = np.frombuffer(get("known"), "?")
        self.norms = np.frombuffer(get("norms"), "<f8")
        self.angles = np.frombuffer(get("angles"), "<f8").reshape(get("n"), -1)


def scores(left: np.ndarray, right: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products of all pairs; ``largest`` bounds their size.

    Beyond 53 bits they are computed in unbounded integers. A score that a signed
    64-bit integer cannot hold becomes the nearest one.
    """
    dim = min(left.shape[1], right.shape[1])
    left, right = left[:, :dim], right[:, :dim]
    if largest < EXACT:
        return (left @ right.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    if not dim:
        return np.zeros((len(left), len(right)), np.int64)
    return np.clip(np.dot(whole(left), whole(right).T), -LARGEST, LARGEST).astype(np.int64)


def _reach(low: np.ndarray, high: np.ndarray, norms: np.ndarray, angle: np.ndarray, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Angles to a reference that a row of norm ``least`` to ``most`` may have if its score lies in [low, high].

    ``norms`` and ``angle`` belong to the other side. The angle between both is
    not smaller than the difference of their angles and not larger than the sum,
    nor than what the sum leaves of a full turn.
    """
    slack = SCORE_SLACK * (np.abs(low) + norms * most) + 1
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        down = low - slack
        widest = np.where(down > 0, down / (norms * most), down / (norms * least))
        widest = np.arccos(np.clip(np.where(np.isnan(widest), -1.0, widest), -1.0, 1.0))
        up = high + SCORE_SLACK * (np.abs(high) + norms * most) + 1
        nearest = np.where(up > 0, up / (norms * least), up / (norms * most))
        nearest = np.arccos(np.clip(np.where(np.isnan(nearest), 1.0, nearest), -1.0, 1.0))
    first = np.maximum(angle - widest, nearest - angle) - ANGLE_SLACK
    last = np.minimum(angle + widest, 2 * np.pi - angle - nearest) + ANGLE_SLACK
    return first, last


def _hits(anchors: _Block, chosen: np.ndarray, block: _Block, ref: int, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
    """Pairs of the chosen anchors and the block's rows with a score in [low, high]: anchor and row indices, scores.

    Anchors with neighbouring windows of angles are scored together, strip by strip.
    """
    along = block.angles[:, ref]
    first, last = _reach(low, high, anchors.norms[chosen], anchors.angles[chosen, ref], block.norms.min(), block.norms.max())
    start, stop = np.searchsorted(along, first, "left"), np.searchsorted(along, last, "right")
    order = np.argsort(start, kind="stable")
    order = order[start[order] < stop[order]]
    largest = float(anchors.norms.max() * block.norms.max()) * 1.001
    for at in range(0, len(order), STRIP):
        some = order[at : at + STRIP]
        begin, end = start[some].min(), stop[some].max()
        found = scores(anchors.vectors[chosen[some]], block.vectors[begin:end], largest)
        a, x = np.nonzero((found >= low[some, None]) & (found <= high[some, None]))
        yield chosen[some[a]], x + begin, found[a, x]


def _first_of_each(group: np.ndarray, score: np.ndarray, known: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: higher scores first, then smaller ids, null ids last."""
    order = np.lexsort((rows, ids, ~known, -score, group))
    grouped = group[order]
    begins = np.flatnonzero(np.diff(grouped, prepend=-1))
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[place < k]


def _pick_references(rows: DataFrame, count: int, sample: int) -> np.ndarray:
    """Unit directions, each far from the ones before it, among ``sample`` rows.

    They decide how much the bounds rule out, never what is found.
    """
    some = rows.orderBy(F.xxhash64("row"), "row").limit(sample).select("vector").collect()
    vectors = _matrix([r["vector"] for r in some])
    norms = _norms(vectors)
    vectors = vectors[norms > 0] / norms[norms > 0][:, None]
    chosen: list[int] = []
    closest = np.full(len(vectors), -2.0)
    while len(vectors) and len(chosen) < count:
        best = int(np.argmin(closest))
        if chosen and closest[best] > 1 - 1e-9:
            break
        chosen.append(best)
        closest = np.maximum(closest, vectors @ vectors[best])
    return vectors[chosen] if chosen else np.zeros((0, vectors.shape[1]))


def whole_vectors(table: DataFrame, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``row, id, label, vector``: rows that take part, with components ``floor(scale * x)``.

    Rows with a null label, a null vector, or a null or non-finite component
    (also after scaling) take no part. An id may be null or repeated: ``row`` tells
    rows apart. Vectors of different lengths are compared as if the shorter ended
    in zeros. Other columns are not read. The table is written.
    """
    rows = pick(table, key, label, vector).toDF("id", "label", "_v").withColumn("_v", F.col("_v").cast("array<double>"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(scale)) < F.lit(float("inf"))))
    rows = rows.where(F.col("label").isNotNull() & F.col("_v").isNotNull() & finite)

    @F.pandas_udf("binary")
    def whole(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.floor(scale * np.asarray(v, np.float64)).astype("<f8").tobytes() for v in vectors], dtype=object)

    named = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole("_v").alias("vector")
    )
    return materialise(named)


def _with_angles(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """``norm, angles, ref, angle`` of every row: all angles, the nearest reference and the angle to it."""
    shared = rows.sparkSession.sparkContext.broadcast(references)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for frame in frames:
            if not len(frame):
                continue
            vectors = _matrix(frame["vector"].tolist())
            norms, dim = _norms(vectors), min(vectors.shape[1], known.shape[1])
            angles = _angles(vectors[:, :dim], norms, known[:, :dim])
            ref = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(frame), int)
            nearest = angles[np.arange(len(frame)), ref] if angles.shape[1] else np.zeros(len(frame))
            yield frame.assign(norm=norms, angles=list(angles), ref=ref.astype(np.int32), angle=nearest)

    # Ids travel as text, so that null and very large ones come back as they were.
    return rows.withColumn("id", F.col("id").cast("string")).mapInPandas(
        run, "row long, id string, label long, vector binary, norm double, angles array<double>, ref int, angle double"
    )


def _opened(frame: pd.DataFrame) -> tuple:
    known = frame["id"].notna().to_numpy()
    ids = np.array([int(i) if k else 0 for i, k in zip(frame["id"].tolist(), known.tolist())], np.int64)
    angles = np.array([list(a) for a in frame["angles"]]).reshape(len(frame), -1)
    return _matrix(frame["vector"].tolist()), frame["row"].to_numpy(np.int64), ids, known, frame["norm"].to_numpy(float), angles


def _blocks(rows: DataFrame, positives: int, anchor_every: int) -> DataFrame:
    """All rows in written blocks of one label and nearest reference, sorted by the angle to it.

    Blocks are cut from range partitions, so a label or direction with most rows
    fills many tasks. ``seeds`` lists the anchors of a block with the score of
    their last positive inside it (null if the block has fewer): no final positive
    scores less.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, part = 0, TaskContext.get().partitionId()
        held: pd.DataFrame | None = None

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            vectors, row, ids, known, norms, angles = _opened(frame)
            anchors = np.flatnonzero(known & (ids % anchor_every == 0))
            found = scores(vectors[anchors], vectors, float(norms.max() ** 2) * 1.001)
            found[np.arange(len(anchors)), anchors] = -LARGEST
            enough = len(frame) > positives
            last = np.sort(found, axis=1)[:, -positives].tolist() if enough and len(anchors) else [None] * len(anchors)
            block = {"block": (part << 33) + number, "label": int(frame["label"].iloc[0]), "ref": int(frame["ref"].iloc[0])}
            number += 1
            return pd.DataFrame([block | _pack(vectors, row, ids, known, norms, angles) | {"seeds": list(zip(row[anchors].tolist(), last))}])

        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            changes = np.flatnonzero((np.diff(held["label"]) != 0) | (np.diff(held["ref"]) != 0)) + 1
            edges = [0, *changes.tolist(), len(held)]
            for begin, end in zip(edges, edges[1:]):
                while end - begin > BLOCK_ROWS or (end < len(held) and end > begin):
                    yield pack(held.iloc[begin : min(end, begin + BLOCK_ROWS)])
                    begin = min(end, begin + BLOCK_ROWS)
            held = held.iloc[begin:]
        if held is not None and len(held):
            yield pack(held)

    order = [F.col(c) for c in ("label", "ref", "angle", "row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"block long, label long, ref int, {_PACKED}, {_SUMMARY}, seeds array<struct<row long, score long>>"
    return materialise(ranged.mapInPandas(cut, schema))


def _anchor_blocks(anchors: DataFrame, limits: str) -> DataFrame:
    """Anchors in written blocks: of one nearest reference, dealt by a hash of their row.

    ``limits`` names the lists of least and largest scores wanted per anchor.
    """
    count = anchors.count()
    buckets = max(1, -(-count // (ANCHOR_BLOCK * REFERENCES)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        vectors, row, ids, known, norms, angles = _opened(frame)
        low, high = (np.array([[e[side] for e in w] for w in frame[limits]], "<i8") for side in ("low", "high"))
        wanted = low <= high
        extra = {
            "block": int(row.min()),
            "labels": frame["label"].tolist(),
            "low": low.tobytes(),
            "high": high.tobytes(),
            "least": float(low[wanted].min()) if wanted.any() else float("inf"),
            "most": float(high[wanted].max()) if wanted.any() else float("-inf"),
        }
        return pd.DataFrame([_pack(vectors, row, ids, known, norms, angles) | extra])

    schema = f"block long, {_PACKED}, {_SUMMARY}, labels array<long>, low binary, high binary, least double, most double"
    dealt = anchors.withColumn("_deal", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    return materialise(dealt.groupBy("ref", "_deal").applyInPandas(pack, schema))


def _possible(same: bool) -> Column:
    """Whether some pair of two blocks can score within the wanted limits."""
    apart = F.zip_with(
        F.arrays_zip(F.col("a_angle_low").alias("l"), F.col("a_angle_high").alias("h")),
        F.arrays_zip(F.col("b_angle_low").alias("l"), F.col("b_angle_high").alias("h")),
        lambda a, b: F.greatest(a["l"] - b["h"], b["l"] - a["h"], F.lit(0.0)),
    )
    sums = F.zip_with("a_angle_high", "b_angle_high", lambda a, b: a + b)
    gap = F.greatest(F.coalesce(F.array_max(apart), F.lit(0.0)) - F.lit(2 * ANGLE_SLACK), F.lit(0.0))
    spread = F.least(F.coalesce(F.array_min(sums), F.lit(np.pi)) + F.lit(2 * ANGLE_SLACK), F.lit(np.pi))
    top = F.col("a_norm_high") * F.col("b_norm_high")
    slack = F.lit(SCORE_SLACK) * top + 2
    reaches = (F.col("a_least") <= 0) | (top * F.cos(gap) + slack >= F.col("a_least"))
    bottom = F.col("a_norm_low") * F.col("b_norm_low") * F.cos(spread) - slack
    exceeds = (F.cos(spread) > 0) & (bottom > F.col("a_most"))
    of_label = F.exists("a_labels", lambda x: (x == F.col("b_label")) if same else (x != F.col("b_label")))
    return of_label & reaches & ~exceeds & (F.col("a_least") <= F.col("a_most"))


def _tiles(anchors: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """Every anchor block beside every row block that it may need.

    Summaries of blocks meet first and are filtered by the bounds; only then the
    vectors follow. Tasks are cut by the number of scores.
    """
    salts = max(1, blocks.count() // 256)
    light = ["block", "n", "norm_low", "norm_high", "angle_low", "angle_high"]
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in (*light, "labels", "least", "most")])
    a = a.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    b = blocks.select(*[F.col(c).alias(f"b_{c}") for c in (*light, "label")])
    b = b.withColumn("_salt", F.pmod(F.xxhash64("b_block"), F.lit(salts)).cast("int"))
    pairs = materialise(a.join(b, "_salt").where(_possible(same)).select("a_block", "b_block", (F.col("a_n") * F.col("b_n")).alias("work")))
    work = pairs.agg(F.sum("work")).first()[0] or 0
    tasks = max(int(pairs.sparkSession.sparkContext.defaultParallelism), -(-work // TASK_SCORES))
    heavy = ["n", "dim", "kind", "vectors", "rows", "ids", "known", "norms", "angles"]
    left = anchors.select(*[F.col(c).alias(f"a_{c}") for c in ("block", *heavy, "labels", "low", "high")])
    right = blocks.select(*[F.col(c).alias(f"b_{c}") for c in ("block", *heavy, "label", "ref")])
    return pairs.drop("work").join(left, "a_block").repartition(int(tasks), "b_block").join(right, "b_block")


def _search(tiles: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor, slot, score, id, row``: of each tile the first ``k`` rows in each score window of each anchor."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tile in frame.itertuples(index=False):
                anchors, block = _Block(tile, "a_"), _Block(tile, "b_")
                low, high = (np.frombuffer(x, "<i8").reshape(tile.a_n, -1) for x in (tile.a_low, tile.a_high))
                labels = np.asarray(tile.a_labels, np.int64)
                wanted = low <= high
                chosen = np.flatnonzero(((labels == tile.b_label) == same) & wanted.any(axis=1))
                if not len(chosen):
                    continue
                least = np.where(wanted, low, LARGEST).min(axis=1)[chosen]
                most = np.where(wanted, high, -LARGEST).max(axis=1)[chosen]
                if not block.angles.shape[1]:
                    block.angles, anchors.angles = np.zeros((len(block.rows), 1)), np.zeros((len(anchors.rows), 1))
                for a, x, score in _hits(anchors, chosen, block, tile.b_ref, least, most):
                    if same:
                        other = anchors.rows[a] != block.rows[x]
                        a, x, score = a[other], x[other], score[other]
                    for slot in range(low.shape[1]):
                        inside = np.flatnonzero((score >= low[a, slot]) & (score <= high[a, slot]))
                        if not len(inside):
                            continue
                        aa, xx, ss = a[inside], x[inside], score[inside]
                        best = _first_of_each(aa, ss, block.known[xx], block.ids[xx], block.rows[xx], k)
                        aa, xx, ss = aa[best], xx[best], ss[best]
                        ids = [str(i) if o else None for i, o in zip(block.ids[xx].tolist(), block.known[xx].tolist())]
                        yield pd.DataFrame({"anchor": anchors.rows[aa], "slot": slot, "score": ss, "id": ids, "row": block.rows[xx]})

    return tiles.mapInPandas(run, "anchor long, slot int, score long, id string, row long").withColumn("id", F.col("id").cast("long"))


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchor_every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    references: int = REFERENCES,
    sample: int = REFERENCE_SAMPLE,
) -> DataFrame:
    """Hard negatives of each anchor and positive, for rows of ``whole_vectors``.

    Anchors are rows whose id is divisible by ``anchor_every``. Scores are integer
    inner products; higher scores come first, ties by smaller id, null ids last.
    An anchor's positives are its first ``positives`` other rows of the same
    label. For each of them its first ``negatives`` rows of other labels follow
    whose score is at least ``window[0]`` and at most ``window[1]`` hundredths of
    the positive's. Columns: ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``. Anchors of repeated ids count one by one; a
    zero vector scores zero. Without rows, anchors, positives or negatives there
    are no result rows. ``references`` directions are chosen among ``sample`` rows;
    both bound the work spared, not the result.
    """
    directions = _pick_references(rows, references, sample)
    placed = _with_angles(rows, directions)
    blocks = _blocks(placed, positives, anchor_every)

    seeds = blocks.select(F.inline("seeds")).select("row", F.coalesce("score", F.lit(-LARGEST)).alias("_low"))
    known = placed.where((F.col("id").cast("long") % anchor_every) == 0)
    limits = F.array(F.struct(F.col("_low").alias("low"), F.lit(LARGEST).alias("high")))
    anchors = materialise(known.join(seeds, "row").withColumn("limits", limits).drop("_low"))
    first = _search(_tiles(_anchor_blocks(anchors, "limits"), blocks, True), True, positives)
    best = _best(first, ["anchor"], positives).select(
        "anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    best = materialise(best)

    # Least and largest score in whole numbers: multiplied by parts, so that nothing overflows.
    def share(score: Column, hundredths: int, up: bool) -> Column:
        whole = F.floor(score / F.lit(100).cast("decimal(3,0)")).cast("long") * hundredths
        part = F.pmod(score, F.lit(100)) * hundredths
        return whole + (F.ceil(part / F.lit(100)) if up else F.floor(part / F.lit(100))).cast("long")

    score = F.col("positive_score")
    span = F.struct("slot", share(score, window[0], True).alias("low"), share(score, window[1], False).alias("high"))
    never = F.struct(F.lit(0).alias("slot"), F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_list(span)).alias("_w"))
    filled = F.concat("_w", F.array_repeat(never, F.lit(positives) - F.size("_w")))
    ready = anchors.drop("limits").join(windows.withColumnRenamed("anchor", "row"), "row").withColumn("limits", filled).drop("_w")
    second = _search(_tiles(_anchor_blocks(ready, "limits"), blocks, False), False, negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").cast("long").alias("anchor_id"))
    ranked = _best(second, ["anchor", "slot"], negatives)
    return (
        ranked.join(best, ["anchor", "slot"])
        .join(names, "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
