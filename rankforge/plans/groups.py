"""Ordered computations inside groups that hold at any group size.

A window partition is one task, so a frame holding a third of all rows would
stop a plain window. Each function first finds the large groups (one count with
map-side combine over the key columns only). All others go through the plain
window and are never written. The rows of large groups are range-partitioned on
(keys, order), so that such a group spreads over many blocks; each block is scanned
on its own and receives the totals of the blocks before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.session import materialise

GROUP_LIMIT = 1_000_000
BLOCK = "_block"
# Slices of a large group's range in the first pass of its quantiles.
BUCKETS = 4096


def groups_bounded(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT) -> bool:
    """True when no group (or, without keys, the whole table) exceeds ``limit`` rows."""
    if not keys:
        return df.select(F.lit(1).alias("one")).limit(limit + 1).count() <= limit
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).isEmpty()
    )


def split_by_size(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups up to ``limit``, and those of larger groups (``None`` when there are none).

    A count with map-side combine shows whether there are any; only then are their
    keys written. Small groups keep their plan and are never written.
    """
    keys = list(keys)
    if groups_bounded(df, keys, limit):
        return df, None
    large = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys))
    named = large.toDF(*[f"_g{i}" for i in range(len(keys))])
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    return df.join(named, same, "left_anti"), df.join(named, same, "left_semi")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = GROUP_LIMIT) -> DataFrame:
    """Range-partition on (keys, order), in so many parts that one holds about ``limit`` rows at most."""
    rows = df.select(F.lit(1)).count()
    blocks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // max(limit, 10_000)))
    return df.repartitionByRange(blocks, *[F.col(k) for k in keys], *order)


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = GROUP_LIMIT) -> DataFrame:
    """Range-partition on (keys, order) and write the block number with each row.

    There are enough blocks that one holds about ``limit`` rows at most. The
    written table keeps block numbers stable however often it is read.
    """
    return materialise(ranged(df, keys, order, limit).withColumn(BLOCK, F.spark_partition_id()))


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def scan_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    specs: dict[str, tuple[str, Column]],
    limit: int = GROUP_LIMIT,
    bounded: bool | None = None,
) -> DataFrame:
    """Add inclusive running aggregates per group.

    ``specs`` maps an output column to ``(kind, value)`` with kind ``sum``,
    ``min``, ``max`` or ``rank`` (value ignored). ``order`` must be a total
    order inside a group.
    """
    keys = list(keys)
    if not bounded and keys:
        # Only large groups go through blocks; the others keep the plain window.
        small, large = split_by_size(df, keys, limit)
        found = scan_within(small, keys, order, specs, limit, True)
        return found if large is None else found.unionByName(_scan_blocks(large, keys, order, specs, limit))
    if bounded is None:
        bounded = groups_bounded(df, keys, limit)
    if bounded:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = {
            out: F.row_number().over(ordered).cast("long")
            if kind == "rank"
            else _COMBINE[kind][0](value).over(running)
            for out, (kind, value) in specs.items()
        }
        return df.withColumns(added)
    return _scan_blocks(df, keys, order, specs, limit)


def _scan_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], specs: dict[str, tuple[str, Column]], limit: int
) -> DataFrame:
    """The same for groups of any size, through written blocks."""
    fold = {
        out: ("sum", F.lit(1).cast("long")) if kind == "rank" else (kind, value)
        for out, (kind, value) in specs.items()
    }
    rows = in_blocks(df.withColumns({f"_v_{o}": v for o, (_, v) in fold.items()}), keys, order, limit)
    totals = rows.groupBy(*keys, BLOCK).agg(
        *[_COMBINE[kind][0](f"_v_{o}").alias(f"_t_{o}") for o, (kind, _) in fold.items()]
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(BLOCK).alias("_k_block"),
        *[_COMBINE[kind][0](f"_t_{o}").over(earlier).alias(f"_b_{o}") for o, (kind, _) in fold.items()],
    )
    inside = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumns(
        {f"_l_{o}": _COMBINE[kind][0](f"_v_{o}").over(inside) for o, (kind, _) in fold.items()}
    )
    match = F.col(BLOCK) == F.col("_k_block")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(before, match, "left").select(
        *df.columns,
        *[
            _COMBINE[kind][1](F.col(f"_l_{o}"), F.col(f"_b_{o}")).alias(o)
            for o, (kind, _) in fold.items()
        ],
    )


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "rank",
    limit: int = GROUP_LIMIT,
    bounded: bool | None = None,
) -> DataFrame:
    """1-based position of each row inside its group."""
    return scan_within(df, keys, order, {out: ("rank", F.lit(1))}, limit, bounded)


def attach_stats(df: DataFrame, keys: Sequence[str], stats: dict[str, Column], bounded: bool) -> DataFrame:
    """Add group aggregates to every row.

    Small groups use the window that later ranking shares; large ones use a
    map-side combined aggregate and a join, which AQE splits when skewed.
    """
    keys = list(keys)
    if bounded:
        whole = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(whole) for name, agg in stats.items()})
    totals = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in stats.items()])
    return df.join(totals, keys, "left")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    quantiles: dict[str, float],
    limit: int = GROUP_LIMIT,
    bounded: bool | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact at any size.

    Small groups use the built-in aggregate. Large ones count equal values
    before the shuffle, take running counts and read the two neighbouring order
    statistics of each quantile, so no task ever holds a whole group.
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    if not bounded and keys:
        small, large = split_by_size(rows, keys, limit)
        found = exact_quantiles(small, keys, F.col("_x"), quantiles, limit, True)
        return found if large is None else found.unionByName(_quantiles_of_counts(large, keys, quantiles, limit))
    if bounded is None:
        bounded = groups_bounded(rows, keys, limit)
    if bounded:
        return rows.groupBy(*keys).agg(
            *[F.percentile("_x", F.lit(q)).alias(name) for name, q in quantiles.items()]
        )
    return _quantiles_of_counts(rows, keys, quantiles, limit)


def _quantiles_of_counts(
    rows: DataFrame, keys: list[str], quantiles: dict[str, float], limit: int, buckets: int = BUCKETS
) -> DataFrame:
    """Quantiles of ``_x`` from counts of equal values and their running totals.

    A first pass counts ``buckets`` slices of each group's range with map-side combine;
    only the rows of slices that hold a wanted order statistic are counted by value.
    """
    groups = keys or ["_whole"]
    if not keys:
        rows = rows.withColumn("_whole", F.lit(0))
    named = [F.col(k).alias(f"_g_{k}") for k in groups]
    held = [f"_g_{k}" for k in groups]

    def of_group(df: DataFrame, other: DataFrame, *more: Column) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(groups, held)]
        return df.join(other, reduce(lambda a, b: a & b, [*same, *more])).drop(*held)

    # Halves keep the width of a range finite; values without one (NaN, infinite) are in the outer slices.
    finite = F.when(F.abs("_x") < float("inf"), F.col("_x") / 2)
    spans = materialise(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")))
    share = F.coalesce((F.col("_x") / 2 - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    slice_ = (
        F.when(F.col("_x") == float("-inf"), -1)
        .when((F.col("_x") == float("inf")) | F.isnan("_x"), buckets + 1)
        .otherwise(F.floor(share * buckets))
        .cast("int")
    )
    sliced = of_group(rows, spans.select(*named, "_lo", "_hi")).withColumn("_slice", slice_).drop("_lo", "_hi")
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_slice"))
    counted = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_below", upto - F.col("_n"))
    counted = of_group(counted, spans.select(*named, "_size"))
    places = [f(F.lit(q) * (F.col("_size") - 1)) for q in quantiles.values() for f in (F.floor, F.ceil)]
    wanted = reduce(lambda a, b: a | b, [(F.col("_below") <= at) & (at < F.col("_below") + F.col("_n")) for at in places])
    wanted = materialise(counted.where(wanted).select(*named, F.col("_slice").alias("_s"), "_below", "_size"))
    near = of_group(sliced, wanted.select(*held, "_s"), F.col("_slice") == F.col("_s")).drop("_s")
    counts = near.groupBy(*groups, "_slice", "_x").agg(F.count(F.lit(1)).alias("_n"))
    running = scan_within(counts, [*groups, "_slice"], [F.col("_x")], {"_upto": ("sum", F.col("_n"))}, limit)
    joined = of_group(running, wanted, F.col("_slice") == F.col("_s")).withColumn("_upto", F.col("_upto") + F.col("_below"))
    picks, outs = [], []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("_size") - 1)
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.min(F.when(F.col("_upto") > at, F.col("_x"))).alias(f"_{name}_{side}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{name}_at"))
        outs.append(
            (F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_at")).alias(name)
        )
    return joined.groupBy(*groups).agg(*picks).select(*keys, *outs)


def beyond_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """All rows but the first ``n`` of each group in ascending ``order``; of equal rows any.

    Only ``n`` rows per group and task are shuffled for the last of them; the others are compared with it.
    """
    keys = list(keys)
    if n <= 0:
        return df
    place, by = F.struct(*order), Window.partitionBy(*keys).orderBy(*[F.asc(c) for c in order])
    firsts = df.select(*keys, *[c for c in order if c not in keys]).withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n)
    ends = firsts.groupBy(*keys).agg(F.max(place).alias("_end"), F.collect_list(place).alias("_f"))
    ends = ends.select(*[F.col(k).alias(f"_g_{k}") for k in keys], "_end", F.size(F.filter("_f", lambda f: f == F.col("_end"))).alias("_m"))
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    placed = df.join(materialise(ends), reduce(lambda a, b: a & b, same) if same else F.lit(True))
    later = placed.where(place > F.col("_end")).select(*df.columns)
    tied = placed.where(place == F.col("_end")).withColumn("_r", F.row_number().over(by))
    return later.unionByName(tied.where(F.col("_r") > F.col("_m")).select(*df.columns))


def require_none(bad: DataFrame, message: str) -> None:
    """Raise ``ValueError`` naming up to ten offending rows, if there are any."""
    sample = bad.limit(10).collect()
    if sample:
        raise ValueError(f"{message}: {[row.asDict() for row in sample]}")
