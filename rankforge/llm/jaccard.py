"""Documents linked by the Jaccard similarity of their word shingles, exactly.

T-occurrence search: a document with n shingles needs T of them in common with a
partner, so it is enough to merge its n - T + l shortest inverted lists, keep
the documents that occur l times or more, and probe the remaining, long lists
only for those (DivideSkip). Lists are the same for all documents, shortest
first: lists up to ``list_limit`` in hash order, then the longer ones by the
logarithm of their length.

On Spark the merge is a sort-merge join of posting lists that counts hits per
pair, and the probe a binary search in the sorted shingles of the other
document. Equal sets are one node. Long lists are never joined with themselves
as they are: their members are compared with one leader first, and then only
across the components that these links leave apart, where the differences from
the leader leave a link possible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import LOWER, UPPER, list_column, map_slices, pick
from rankforge.llm.components import components
from rankforge.session import materialise

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
# Words whose hashes a worker keeps, about 20 MB; hashing a word again costs little.
_CACHE_WORDS = 100_000
HITS = 3
BROADCAST_ROWS = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingles:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def of(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(codes))
        if width == 0:
            return np.zeros(0, np.int64)
        count = len(codes) - width + 1
        mixed = np.full(count, width, np.uint64)
        for i in range(width):
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + count])
        return np.unique(mixed.view(np.int64))


def _required(n, num: int, den: int):
    """Shingles that a set of n must share with any partner."""
    return -(-num * n // den)


def _sets_table(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``_key, _n, _set, _reserve`` per row: size, digest and the first shingles in hash order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for part in parts:
            sizes, digests, reserves = [], [], []
            for t in part.column("_text").to_pylist():
                s = shingles.of(t)
                n = len(s)
                sizes.append(n)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                reserves.append(s[: 2 * (n - _required(n, num, den) + 1) + 2 * HITS])
            columns = [part.column("_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), list_column(reserves)]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_n", "_set", "_reserve"])

    return map_slices(docs, "_key", run, "_n long, _set binary, _reserve array<long>")


def _full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, _all``: all shingles of the given nodes (``node, _set, _rep``), from the texts again."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for part in parts:
            sets = [shingles.of(t) for t in part.column("_text").to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(digests, pa.binary()), list_column(sets)], ["_key", "_set", "_all"])

    wanted = nodes.select(F.col("_rep").alias("_w")).distinct()
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.col("_key").eqNullSafe(F.col("_w")), "left_semi")
    sets = map_slices(texts, "_key", run, "_set binary, _all array<long>").select("_set", "_all")
    # A key that is repeated over several texts brings sets of other nodes too; the digest tells.
    return materialise(sets.join(nodes.select("node", "_set"), "_set").dropDuplicates(["node"]).select("node", "_all"))


def _reachable(num: int, den: int, shared: Column, a: str, b: str) -> Column:
    """Whether ``shared`` common shingles are enough for sets of sizes ``a`` and ``b``."""
    return shared * (num + den) >= (F.col(a) + F.col(b)) * num


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common``: shared shingles of each pair, every list probed by binary search."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for x, y in zip(frame["_x"].tolist(), frame["_y"].tolist()):
                few, many = sorted((np.asarray(x), np.asarray(y)), key=len)
                at = np.searchsorted(many, few)
                found.append(int((many[np.minimum(at, len(many) - 1)] == few).sum()))
            yield frame[["a", "b", "na", "nb"]].assign(common=found)

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("_all").alias("_x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("_all").alias("_y")), "b")
    sized = both.select("a", "b", F.size("_x").cast("long").alias("na"), F.size("_y").cast("long").alias("nb"), "_x", "_y")
    return materialise(sized.mapInPandas(run, "a long, b long, na long, nb long, common long"))


def _links(overlaps: DataFrame, num: int, den: int) -> DataFrame:
    union = F.col("na") + F.col("nb") - F.col("common")
    return overlaps.where(den * F.col("common") >= num * union).select("a", "b")


def jaccard_groups(
    docs: DataFrame,
    width: int = 3,
    similarity: tuple[int, int] = (90, 100),
    list_limit: int = 16,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    One row per input row: ``key, n_shingles, component_id, set_id``, where the
    component is the smallest key reachable by links (null if none of its keys
    is known) and ``set_id`` is equal for rows with equal sets. A text with
    fewer words than ``width`` is one shingle; null texts and texts without
    words have none and are linked with nothing. Null keys take part by their
    text; repeated rows stay. All links count, whatever ``list_limit``: it only
    says which lists are merged. Shingles are compared by 64-bit hashes. Other
    columns are not read.
    """
    num, den = similarity
    source = pick(docs, key, text).toDF("_key", "_text")
    rows = materialise(_sets_table(source, width, num, den))

    # Nodes: distinct sets. Smaller ones than ``least`` can only equal their partners.
    nodes = rows.where(F.col("_n") > 0).groupBy("_set").agg(
        F.first("_n").alias("n"), F.first("_reserve").alias("_reserve"), F.min("_key").alias("_rep")
    )
    least = num // (den - num) if den > num else 1 << 62
    nodes = materialise(nodes.where(F.col("n") >= least).withColumn("node", F.monotonically_increasing_id()))
    need = F.ceil(F.col("n") * num / den).cast("long")
    prefix = F.col("n") - need + 1  # with so many lists every partner is met once

    # Lists among the first shingles in hash order; the long ones are set apart.
    first = nodes.select("node", F.explode("_reserve").alias("h"))
    counts = first.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    counts = materialise(counts)
    flagged = counts.where(F.col("c") > list_limit).select("h", "c")
    few = flagged.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sized = lambda df: F.broadcast(df) if few else df
    wanted = prefix + F.least(F.lit(HITS), need) - 1

    def lacking(long: DataFrame, among: DataFrame) -> DataFrame:
        """Nodes without enough short lists in their reserve."""
        lost = first.join(sized(long), "h", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("_lost"))
        return among.join(lost, "node").where(F.size("_reserve") - F.col("_lost") < wanted)

    columns = ("node", "n", "_set", "_rep")
    crowded = materialise(lacking(flagged.select("h"), nodes).select(*columns))
    sets = _full_sets(source, crowded, width)
    more = sets.select(F.explode("_all").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > list_limit)
    long = flagged.union(more).groupBy("h").agg(F.floor(F.log2(F.max("c") / list_limit)).cast("int").alias("_class"))
    long = materialise(long)
    few = long.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rest = nodes.join(crowded.select("node"), "node", "left_anti")
    late = materialise(lacking(long.select("h"), rest).select(*columns))
    late_sets = _full_sets(source, late, width)
    sets, crowded = sets.union(late_sets), crowded.union(late)

    # Postings: short lists of the others, and of the crowded the first lists in full order.
    plain = first.join(crowded.select("node"), "node", "left_anti").join(sized(long.select("h")), "h", "left_anti")
    every = sets.join(crowded.select("node", "n"), "node").select("node", "n", F.explode("_all").alias("h"))
    every = every.join(sized(long), "h", "left")
    order = Window.partitionBy("node").orderBy(F.col("_class").asc_nulls_first(), "h")
    chosen = materialise(
        every.withColumn("_at", F.row_number().over(order))
        .withColumn("_short", F.sum(F.col("_class").isNull().cast("int")).over(Window.partitionBy("node")))
        .where(F.col("_at") <= wanted)
        .select("node", "n", "h", "_class", "_short")
    )
    short = plain.select("node", "h").union(chosen.where(F.col("_class").isNull()).select("node", "h"))
    shared = short.join(counts.where(F.col("c") <= list_limit).select("h").union(
        chosen.where(F.col("_class").isNull()).select("h").groupBy("h").agg(F.count(F.lit(1)).alias("c")).select("h")
    ).distinct(), "h", "left_semi")
    shared = materialise(shared)

    # Merge of short lists: hits per pair against l = lists used - (n - T).
    used = plain.groupBy("node").agg(F.count(F.lit(1)).alias("_used")).union(
        chosen.groupBy("node").agg(F.count(F.lit(1)).alias("_used"))
    )
    listed = chosen.where(F.col("_class").isNotNull()).select("h", "node", "n", "_short")
    in_long = listed.groupBy("node").agg(F.first("_short").alias("_short"))
    levels = materialise(
        nodes.select("node", "n", need.alias("_need")).join(used, "node").join(in_long, "node", "left").select(
            "node", "n", (F.col("_used") - (F.col("n") - F.col("_need"))).alias("_l"), "_short"
        )
    )
    one = shared.select("h", F.col("node").alias("a"))
    two = shared.select(F.col("h").alias("_h"), F.col("node").alias("b"))
    hits = one.join(two, (F.col("h") == F.col("_h")) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("_hits")
    )
    of = lambda c: levels.select(
        F.col("node").alias(c), F.col("n").alias(f"_n{c}"), F.col("_l").alias(f"_l{c}"), F.col("_short").alias(f"_s{c}")
    )
    paired = hits.join(of("a"), "a").join(of("b"), "b").withColumn("_enough", F.col("_hits") >= F.least("_la", "_lb"))
    # Where both are in long lists too, all their short lists were merged, so the hits say what these can give.
    both_long = F.col("_sa").isNotNull() & F.col("_sb").isNotNull()
    most = F.when(both_long, F.least(F.col("_na") - F.col("_sa"), F.col("_nb") - F.col("_sb")) + F.col("_hits"))
    most = F.least(F.coalesce(most, F.col("_na")), F.col("_na"), F.col("_nb"))
    paired = materialise(
        paired.where((F.col("_enough") | both_long) & (_reachable(num, den, most, "_na", "_nb") | both_long)).select(
            "a", "b", "_hits", both_long.alias("_long"), (_reachable(num, den, most, "_na", "_nb") & (F.col("_enough") | both_long)).alias("_open")
        )
    )
    near = paired.where("_open")
    best = near.groupBy("b").agg(F.max_by("a", F.struct("_hits", -F.col("a"))).alias("a")).select("a", "b")

    # Long lists: every member is compared with one leader, the one with the fewest short lists.
    leaders = listed.groupBy("h").agg(F.min(F.struct("_short", "node", "n")).alias("_lead"))
    leaders = leaders.select("h", F.col("_lead.node").alias("_ln"), F.col("_lead.n").alias("_lsize"))
    led = materialise(listed.join(leaders, "h"))
    toward = led.where(F.col("node") != F.col("_ln")).select(F.least("node", "_ln").alias("a"), F.greatest("node", "_ln").alias("b"))
    trial = materialise(best.union(toward).distinct())
    ends = lambda p: p.select(F.col("a").alias("node")).union(p.select("b")).distinct()
    lacks = ends(near.select("a", "b")).join(sets.select("node"), "node", "left_anti")
    sets = sets.union(_full_sets(source, nodes.join(lacks, "node").select(*columns), width))
    compared = _overlaps(trial, sets)
    links = _links(compared, num, den)
    labels = materialise(components(links))

    # Then only pairs whose components are still apart.
    def labelled(df: DataFrame, node: str, out: str) -> DataFrame:
        known = labels.select(F.col("node").alias(node), F.col("component").alias(out))
        return df.join(known, node, "left").withColumn(out, F.coalesce(out, node))

    apart = labelled(labelled(near.select("a", "b"), "a", "_ca"), "b", "_cb").where(F.col("_ca") != F.col("_cb"))
    # Two members that are linked, but not both with their leader, lack the same of its
    # shingles or have others in common: their differences from the leader overlap.
    # Without a common short list (those pairs are in ``near``) what they can share
    # beside the leader's shingles are long lists.
    pair = [F.least("node", "_ln").alias("a"), F.greatest("node", "_ln").alias("b")]
    known = led.withColumns({"a": pair[0], "b": pair[1]}).join(compared.select("a", "b", "common"), ["a", "b"], "left")
    known = known.join(paired.where("_long").select("a", "b", "_hits"), ["a", "b"], "left")
    common = F.when(F.col("node") == F.col("_ln"), F.col("n")).otherwise(F.col("common"))
    met = F.when(F.col("node") == F.col("_ln"), F.col("_short")).otherwise(F.coalesce("_hits", F.lit(0)))
    known = known.select(
        "h", "node", "n", "_short",
        (F.col("_lsize") - common).alias("_lacks"),
        (F.col("n") - common).alias("_adds"),
        (F.col("n") - common - F.col("_short") + met).alias("_others"),
    )
    members = materialise(labelled(known, "node", "_c"))
    mixed = members.groupBy("h").agg(F.min("_c").alias("_low"), F.max("_c").alias("_high")).where(F.col("_low") != F.col("_high"))
    members = materialise(members.join(mixed.select("h"), "h", "left_semi"))
    other = members.toDF(*[f"{c}_" for c in members.columns])
    apart_by = F.col("_lacks") + F.col("_adds") + F.col("_lacks_") + F.col("_adds_")
    shared = F.least("_lacks", "_lacks_") + F.least("_others", "_others_")
    long_only = F.least(F.col("n") - F.col("_short"), F.col("n_") - F.col("_short_"))
    across = members.join(
        other,
        (F.col("h") == F.col("h_"))
        & (F.col("_c") < F.col("_c_"))
        & _reachable(num, den, long_only, "n", "n_")
        & ((apart_by - 2 * shared) * (den + num) <= (F.col("n") + F.col("n_")) * (den - num)),
    ).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))
    left = materialise(apart.select("a", "b").union(across.select("a", "b")).distinct().join(trial, ["a", "b"], "left_anti"))
    joined = labels
    if not left.isEmpty():
        late_links = _links(_overlaps(left, sets), num, den)
        joined = components(links.union(late_links))

    # Back to rows: equal sets are one node, and sets too small to have partners stand alone.
    placed = nodes.select("node", "_set").join(joined, "node").select("_set", "component")
    groups = rows.groupBy("_set").agg(F.min("_key").alias("_least")).where(F.col("_set").isNotNull())
    groups = materialise(groups.join(placed, "_set", "left"))
    whole = groups.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("_least").alias("_top"))
    final = groups.join(whole, "component", "left").select("_set", F.coalesce("_top", "_least").alias("_id"))
    return rows.join(final, "_set", "left").select(
        F.col("_key").alias(key),
        F.col("_n").alias("n_shingles"),
        F.when(F.col("_n") > 0, F.col("_id")).otherwise(F.col("_key")).alias("component_id"),
        F.hex("_set").alias("set_id"),
    )
