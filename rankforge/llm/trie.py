"""Prefix trie of conversations, with a count-min screen in front of the shuffle.

A node is a distinct sequence of first turns. Every turn is hashed together with
its position, and running sums of these hashes name all prefixes of a
conversation. A count-min sketch over all prefix names follows. Where a sketch
row has counted a name once, the prefix belongs to one conversation only, and so
do all longer ones: these tails are whole nodes already and are written where
they lie. Only prefixes in front of them are shuffled and grouped exactly.

Sums over subtrees need no walk over the trie. The smallest member of a node is
also the smallest member of one of its children, or ends there, so that each
conversation owns one chain of nodes; a subtree is the rest of one chain and the
whole chains of all its other members.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import pick
from rankforge.plans.groups import attach_stats, groups_bounded, scan_within
from rankforge.session import materialise

SKETCH_ROWS = 4
LEAST_WIDTH, MOST_WIDTH = 2**16, 2**24
SLAB = 2**16
PIECE_CHARS = 1_000_000
NO_END = hashlib.sha256(b"").hexdigest()


def _lanes(digest: Column) -> list[Column]:
    """A hash as four numbers of 32 bits, whose sums cannot overflow."""
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _names(sums: list[str]) -> tuple[Column, Column]:
    low = [F.col(s).bitwiseAND(F.lit(0xFFFFFFFF)) for s in sums]
    return (
        F.shiftleft(low[0], 32).bitwiseOR(low[1]),
        F.shiftleft(low[2], 32).bitwiseOR(low[3]),
    )


def prefix_names(turns: DataFrame) -> DataFrame:
    """``conv, pos, a, b, size, length`` for ``conv, pos, role, text``: two halves of the prefix name of each turn.

    Positions count from 1 without gaps. ``size`` is the length of the turn's
    text in code points, ``length`` the number of turns of the conversation.
    """
    spelt = F.concat_ws(
        ":", F.col("pos").cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text")
    )
    lanes = [f"_h{i}" for i in range(4)]
    hashed = turns.select("conv", "pos", F.length("text").cast("long").alias("size"), F.sha2(spelt.cast("binary"), 256).alias("_d"))
    hashed = hashed.select("conv", "pos", "size", *[v.alias(n) for v, n in zip(_lanes(F.col("_d")), lanes)])
    small = groups_bounded(hashed, ["conv"])
    summed = scan_within(hashed, ["conv"], [F.col("pos")], {f"_s{i}": ("sum", F.col(n)) for i, n in enumerate(lanes)}, bounded=small)
    summed = attach_stats(summed, ["conv"], {"length": F.max("pos")}, small)
    a, b = _names([f"_s{i}" for i in range(4)])
    return summed.select("conv", "pos", a.alias("a"), b.alias("b"), "size", "length")


def _cells(a: np.ndarray, b: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """One cell per sketch row; ``width`` is a power of two."""
    with np.errstate(over="ignore"):
        for row in range(SKETCH_ROWS):
            mixed = a * np.uint64(2 * row + 1) + b * np.uint64(0x9E3779B97F4A7C15 + 2 * row)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            yield ((mixed >> np.uint64(40)) & np.uint64(width - 1)).astype(np.int64)


def _halves(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(frame[c].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))


def count_min(names: DataFrame, width: int) -> np.ndarray:
    """Cells of a count-min sketch over ``a, b`` that have counted more than one: one row of bits per sketch row.

    Counters need not go beyond two. Tasks count on their own and pass on the
    slabs they have touched; slabs are merged by shuffle, and 4 x ``width`` bits
    (8 MB at most) reach the driver, whatever the number of rows.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((SKETCH_ROWS, width), np.uint8)
        for frame in frames:
            for row, cells in enumerate(_cells(*_halves(frame), width)):
                cells, found = np.unique(cells, return_counts=True)
                counts[row, cells] = np.minimum(counts[row, cells] + np.minimum(found, 2), 2)
        slabs = counts.reshape(-1, min(SLAB, width))
        touched = np.flatnonzero(slabs.any(axis=1))
        for slab in touched.tolist():
            yield pd.DataFrame({"slab": [slab], "counts": [zlib.compress(slabs[slab].tobytes(), 1)]})

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for slab, data in zip(frame["slab"].tolist(), frame["counts"].tolist()):
                part = np.frombuffer(zlib.decompress(data), np.uint8)
                sums[slab] = np.minimum(sums[slab] + part, 2) if slab in sums else part
        for slab, counts in sums.items():
            yield pd.DataFrame({"slab": [slab], "bits": [np.packbits(counts > 1).tobytes()]})

    parts = names.select("a", "b").mapInPandas(count, "slab int, counts binary")
    merged = parts.repartition(F.col("slab")).mapInPandas(merge, "slab int, bits binary").collect()
    slabs = np.zeros((SKETCH_ROWS * width // min(SLAB, width), min(SLAB, width) // 8), np.uint8)
    for row in merged:
        slabs[row["slab"]] = np.frombuffer(row["bits"], np.uint8)
    return slabs.reshape(SKETCH_ROWS, width // 8)


def screened(names: DataFrame, width: int) -> DataFrame:
    """``names`` and ``alone``: the sketch proves that no other conversation has this prefix."""
    crowded = names.sparkSession.sparkContext.broadcast(count_min(names, width))

    @F.pandas_udf("boolean")
    def alone(a: pd.Series, b: pd.Series) -> pd.Series:
        bits, proven = crowded.value, np.zeros(len(a), bool)
        halves = _halves(pd.DataFrame({"a": a, "b": b}))
        for row, cells in enumerate(_cells(*halves, width)):
            proven |= (bits[row, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 0
        return pd.Series(proven)

    return names.withColumn("alone", alone("a", "b"))


def _digests_of_ids(ends: DataFrame) -> DataFrame:
    """``pos, a, b, ends_sha256`` for ``pos, a, b, conv``: the hash of all ids of a node in ascending order.

    Ids are spelt out in pieces by range partitions, so a node with very many ends
    is spread over tasks; what one task then hashes is a stream of pieces.
    """
    node = ["pos", "a", "b"]
    order = [F.col(c) for c in (*node, "conv")]

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, ids, size = None, None, [], 0

        def piece() -> pd.DataFrame:
            return pd.DataFrame([(*at, first, ",".join(ids))], columns=[*node, "conv", "piece"])

        for frame in frames:
            for *key, conv in zip(*(frame[c].tolist() for c in (*node, "conv"))):
                if key != at or size >= PIECE_CHARS:
                    if ids:
                        yield piece()
                    at, first, ids, size = key, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        done: list[tuple] = []
        for frame in frames:
            for *key, piece in zip(*(frame[c].tolist() for c in (*node, "piece"))):
                if key == at:
                    state.update(b",")
                else:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256()
                state.update(piece.encode())
            yield pd.DataFrame(done, columns=[*node, "ends_sha256"])
            done = []
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=[*node, "ends_sha256"])

    schema = "pos long, a long, b long"
    ranged = ends.select(*node, "conv").repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranged.mapInPandas(spell, f"{schema}, conv long, piece string")
    gathered = pieces.repartition(*node).sortWithinPartitions(*order)
    return gathered.mapInPandas(digest, f"{schema}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, most_width: int = MOST_WIDTH) -> DataFrame:
    """One row per node of the trie over conversations.

    ``turns`` holds ``conv, pos, role, text`` (positions from 1 without gaps, no
    nulls), ``conversations`` every ``conv`` once, those without turns too. Names
    of prefixes are sums of SHA-256 values and taken as exact. Columns, all long
    but the last: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    No conversations give no rows. ``most_width`` bounds the sketch; beyond it
    fewer tails are proven and more prefixes shuffle, with the same result. One
    conversation or one node may hold most rows.
    """
    spark, node = turns.sparkSession, ["pos", "a", "b"]
    names = materialise(prefix_names(turns))
    width = LEAST_WIDTH
    while width < min(most_width, 8 * names.count()):
        width *= 2
    width = min(width, most_width)

    # A tail starts at the first prefix that is proven to be alone.
    flagged = materialise(screened(names, width))
    small = groups_bounded(flagged, ["conv"])
    flagged = attach_stats(flagged, ["conv"], {"tail": F.min(F.when(F.col("alone"), F.col("pos")))}, small)
    flagged = flagged.withColumn("tail", F.coalesce("tail", F.col("length") + 1))
    shared = materialise(flagged.where(F.col("pos") < F.col("tail")).drop("alone"))
    tails = flagged.where(F.col("pos") >= F.col("tail"))

    ended = F.col("pos") == F.col("length")
    exact = materialise(
        shared.groupBy(*node).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("conv").alias("owner"),
            F.max("size").alias("size"),
            F.sum(ended.cast("long")).alias("n_end"),
        )
    )

    # Chains: what each conversation owns among the shared nodes, and whether it ends as a leaf.
    saved = (F.col("n") - 1) * F.col("size")
    owned = materialise(
        scan_within(
            exact.withColumn("_back", -F.col("pos")), ["owner"], [F.col("_back")], {"rest": ("sum", saved)}
        ).drop("_back")
    )
    chains = owned.groupBy("owner").agg(
        F.min("pos").alias("head"),
        F.sum(saved).alias("chain_saved"),
        F.max(F.when(F.col("n_end") == F.col("n"), 1).otherwise(0)).cast("long").alias("chain_leaf"),
    )
    tailed = tails.where(F.col("pos") == F.col("tail")).select("conv", F.col("tail").alias("_tail"))
    facts = chains.withColumnRenamed("owner", "conv").join(tailed, "conv", "full").select(
        "conv",
        F.coalesce("head", "_tail").alias("head"),
        F.coalesce("chain_saved", F.lit(0)).alias("chain_saved"),
        F.when(F.col("_tail").isNotNull(), 1).otherwise(F.col("chain_leaf")).cast("long").alias("chain_leaf"),
    )
    facts = materialise(facts)

    # Each node gathers the chains of its members; the owner's own counts from here on only.
    members = shared.select(*node, "conv").join(facts, "conv")
    gathered = members.groupBy(*node).agg(
        F.sum("chain_saved").alias("all_saved"),
        F.sum("chain_leaf").alias("n_leaves"),
        F.sum((F.col("head") == F.col("pos") + 1).cast("long")).alias("begun"),
    )
    # The conversation that owns the node in front of a chain.
    heads = facts.select("conv", (F.col("head") - 1).alias("_before")).where(F.col("_before") > 0)
    fronts = shared.join(heads, "conv").where(F.col("pos") == F.col("_before")).select(*node, "conv")
    parents = fronts.join(exact.select(*node, F.col("owner").alias("parent")), node).select("conv", "parent")

    lengths = names.where(ended).select("conv", F.col("length").alias("_length"))
    n_convs, least = conversations.agg(F.count(F.lit(1)), F.min("conv")).first()
    if least is None:
        empty = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        return spark.createDataFrame([], empty)

    def parent_of() -> Column:
        front = F.when(F.col("pos") == 1, F.lit(least)).otherwise(F.col("parent"))
        return F.when(F.col("pos") == F.col("head"), front).otherwise(F.col("owner"))

    # Of a shared node: ends of all members.
    ends = _digests_of_ids(shared.where(ended))
    totals = facts.select(F.col("conv").alias("owner"), "head", F.col("chain_saved").alias("own_saved"))
    inner = (
        owned.join(gathered, node)
        .join(totals, "owner")
        .join(parents.withColumnRenamed("conv", "owner"), "owner", "left")
        .join(lengths.withColumnRenamed("conv", "owner"), "owner")
        .join(ends, node, "left")
        .select(
            F.col("owner").alias("conv_id"),
            F.col("pos").alias("depth"),
            parent_of().alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            (F.col("begun") + (F.col("_length") > F.col("pos")).cast("long")).alias("n_children"),
            "n_leaves",
            (F.col("rest") + F.col("all_saved") - F.col("own_saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NO_END)).alias("ends_sha256"),
        )
    )
    own = tails.withColumn("owner", F.col("conv")).join(facts.select("conv", "head"), "conv").join(parents, "conv", "left")
    outer = own.select(
        F.col("conv").alias("conv_id"),
        F.col("pos").alias("depth"),
        parent_of().alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        (F.col("length") > F.col("pos")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(ended, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_END)).alias("ends_sha256"),
    )
    silent = conversations.join(names.where("pos = 1").select("conv"), "conv", "left_anti")
    at_root = [F.lit(0).cast("long").alias(c) for c in node]
    root_ends = _digests_of_ids(silent.select(*at_root, "conv")).first()
    below = facts.agg(F.sum("chain_saved").alias("s"), F.sum("chain_leaf").alias("l"), F.sum((F.col("head") == 1).cast("long")).alias("c")).first()
    values = {
        "conv_id": least,
        "depth": 0,
        "parent_conv_id": None,
        "n_convs": n_convs,
        "n_children": below["c"] or 0,
        "n_leaves": below["l"] or 1,
        "saved_tokens": below["s"] or 0,
    }
    root = spark.range(1).select(
        *[F.lit(v).cast("long").alias(k) for k, v in values.items()],
        F.lit(root_ends["ends_sha256"] if root_ends else NO_END).alias("ends_sha256"),
    )
    return root.unionByName(inner).unionByName(outer)


def numbered_turns(table: DataFrame) -> DataFrame:
    """``conv, pos, role, text`` of ``conv_id, turn, role, text``: positions from 1 in the order of turns.

    Turns without a number come first; equal numbers follow role and text. A null
    role or text is empty. Rows without ``conv_id`` belong to no conversation and
    are left out. Other columns are not read.
    """
    rows = pick(table, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return scan_within(rows, ["conv"], order, {"pos": ("rank", F.lit(1))}).drop("turn")


def with_shared_openings(turns: DataFrame, opener: Column, taken: Column, most: int) -> DataFrame:
    """Conversations whose first turns come from another one.

    Of ``turns`` (``conv, pos, role, text``), each conversation drops its first
    ``taken`` turns and puts in front the first ``taken`` (``most`` or fewer) of
    the conversation ``opener``; both are expressions over ``conv``. Fewer where
    the opener is shorter, none where it is absent.
    """
    convs = turns.where(F.col("pos") == 1).select("conv", opener.alias("_from"), taken.alias("_taken"))
    openings = turns.where(F.col("pos") <= most).select(F.col("conv").alias("_from"), "pos", "role", "text")
    front = convs.join(openings, "_from").where(F.col("pos") <= F.col("_taken"))
    # Openings are short: at most ``most`` rows of each conversation are counted here.
    found = openings.groupBy("_from").agg(F.max("pos").alias("_found"))
    moved = convs.join(found, "_from", "left").select("conv", F.least("_taken", F.coalesce("_found", F.lit(0))).alias("_front"))
    rest = turns.withColumn("_taken", taken).where(F.col("pos") > F.col("_taken")).join(moved, "conv")
    rest = rest.withColumn("pos", F.col("pos") - F.col("_taken") + F.col("_front"))
    return front.select("conv", "pos", "role", "text").unionByName(rest.select("conv", "pos", "role", "text"))
