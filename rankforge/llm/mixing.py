"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``limit`` copies. Among all rates whose
tokens meet each source's target, the ones nearest to a common prior rate in
bounded relative entropy are ``limit * sigmoid(a + lambda * size / mean size)``:
exponentially tilted odds with one multiplier per source. The multipliers
maximise a convex dual; Newton steps, kept inside a bracket, find them. A step
is one aggregation over the counts of (source, size), which is all that the
rates depend on. Rates then become whole copies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import WORD, pick
from rankforge.plans.groups import rank_within, scan_within
from rankforge.session import materialise

EXACT = "decimal(38,6)"


def _attach(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, nulls alike (and on size and cell where both have them), keeping the left's columns."""
    keys = [c for c in ("source", "size", "_cell") if c in left.columns and c in right.columns]
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match = match & (F.col(k).eqNullSafe(F.col(f"_r_{k}")) if k == "source" else F.col(k) == F.col(f"_r_{k}"))
    return left.join(named, match, how).drop(*[f"_r_{k}" for k in keys])


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, limit: float) -> DataFrame:
    """Targets per source: ``source, source_size, target``.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``total`` times all sizes. A target stops at ``limit`` times its source's
    size; the excess goes to the others by weight until none is above. With
    sources in order of size per weight the capped ones come first, so running
    sums give the level without a loop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = rank_within(materialise(per), [], [F.col("source").asc_nulls_last()], out="_place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(turn, ((F.col("_place") - 1) % len(weights) + 1).cast("int")))
    ranked = materialise(ranked.withColumn("_cap", F.col("source_size") * float(limit)))
    run = scan_within(
        ranked,
        [],
        [F.col("_cap") / F.col("_w"), F.col("_place")],
        {"_caps": ("sum", F.col("_cap")), "_ws": ("sum", F.col("_w"))},
    )
    sums = ranked.agg(F.sum("source_size").alias("all"), F.sum("_w").alias("w")).first()
    room = F.lit(float((sums["all"] or 0) * total)) - (F.col("_caps") - F.col("_cap"))
    ws = F.lit(float(sums["w"] or 0)) - (F.col("_ws") - F.col("_w"))
    whole = run.withColumn("_level", room / ws).withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    open_ = ~F.col("_full")
    level = whole.agg(
        F.min_by(F.when(open_, F.col("_level")), F.when(open_, F.col("_cap") / F.col("_w"))).alias("at")
    ).first()["at"]
    target = F.least(F.col("_cap"), F.lit(math.inf if level is None else level) * F.col("_w"))
    return whole.select(
        "source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target")
    )


def _rate(limit: float, prior: float) -> Column:
    """Copies per document of a size class; ``_full`` classes take the limit exactly."""
    odds = F.lit(math.log(prior / (limit - prior))) + F.col("_tilt") * F.col("size") / F.col("_mean")
    return F.when(F.col("_full"), F.lit(float(limit))).otherwise(F.lit(float(limit)) / (1 + F.exp(-odds)))


def balance(classes: DataFrame, targets: DataFrame, limit: float, prior: float, steps: int = 60) -> DataFrame:
    """Multipliers per source: ``source, source_size, target, _tilt, _mean, _full``.

    ``classes`` is ``source, size, n``. Each step sums tokens and their slope per
    source in exact decimals, so that reruns agree bit for bit.
    """
    n = classes.groupBy("source").agg(F.sum("n").alias("_n"))
    state = _attach(targets, n).select(
        "source",
        "source_size",
        "target",
        F.greatest(F.col("source_size") / F.col("_n"), F.lit(1e-9)).alias("_mean"),
        (F.col("target") >= F.col("source_size") * float(limit) * (1 - 1e-12)).alias("_full"),
        F.lit(0.0).alias("_tilt"),
        F.lit(-math.inf).alias("_lo"),
        F.lit(math.inf).alias("_hi"),
    )
    state = materialise(state)
    for _ in range(steps):
        tokens = F.col("size") * F.col("n") * F.col("_rate")
        slope = tokens * (1 - F.col("_rate") / float(limit)) * F.col("size") / F.col("_mean")
        sums = (
            _attach(classes, state)
            .withColumn("_rate", _rate(limit, prior))
            .groupBy("source")
            .agg(F.sum(tokens.cast(EXACT)).cast("double").alias("_sum"), F.sum(slope.cast(EXACT)).cast("double").alias("_slope"))
        )
        gap = F.col("target") - F.col("_sum")
        lo = F.when(gap > 0, F.col("_tilt")).otherwise(F.col("_lo"))
        hi = F.when(gap < 0, F.col("_tilt")).otherwise(F.col("_hi"))
        newton = F.col("_tilt") + gap / F.col("_slope")
        # A step of at most 4 before the bracket closes; bisection where Newton leaves it.
        step = F.greatest(F.col("_tilt") - 4, F.least(F.col("_tilt") + 4, newton))
        step = F.when(F.col("_slope") <= 0, F.col("_tilt") + F.signum(gap)).otherwise(step)
        inside = (step > lo) & (step < hi)
        both = (lo > -math.inf) & (hi < math.inf)
        moved = F.when(inside, step).when(both, (lo + hi) / 2).otherwise(step)
        done = F.col("_full") | (F.abs(gap) <= 1e-9 * F.col("target")) | (gap == 0)
        state = materialise(
            _attach(state, sums).select(
                "source",
                "source_size",
                "target",
                "_mean",
                "_full",
                F.when(done, F.col("_tilt")).otherwise(moved).alias("_tilt"),
                lo.alias("_lo"),
                hi.alias("_hi"),
                done.alias("_done"),
            )
        )
        if state.where(~F.col("_done")).isEmpty():
            break
        state = state.drop("_done")
    return state.select("source", "source_size", "target", "_tilt", "_mean", "_full")


def whole_copies(classes: DataFrame, state: DataFrame, limit: float, prior: float, passes: int = 6) -> DataFrame:
    """Copies per (source, size) class: ``source, size, n, _copies``.

    Running totals of the expected copies, large sizes first, are rounded, so a
    source is off by less than one large document. Each pass then moves copies
    of the largest size that fits into what is still missing or too much.
    """
    most = F.lit(int(limit)) * F.col("n")
    expected = _attach(classes, state).withColumn("_want", (F.col("n") * _rate(limit, prior)).cast(EXACT))
    run = scan_within(expected, ["source"], [F.col("size").desc()], {"_upto": ("sum", F.col("_want"))})
    half = F.lit(0.5).cast(EXACT)
    copies = F.floor(F.col("_upto") + half) - F.floor(F.col("_upto") - F.col("_want") + half)
    rounded = run.select("source", "size", "n", F.least(F.greatest(copies, F.lit(0)), most).cast("long").alias("_copies"))
    rounded = materialise(rounded)
    for _ in range(passes):
        taken = rounded.groupBy("source").agg(F.sum(F.col("size") * F.col("_copies")).alias("_taken"))
        gaps = _attach(state.select("source", "target"), taken).select(
            "source", (F.col("target") - F.col("_taken")).alias("_gap")
        )
        open_ = _attach(rounded, gaps).where(
            (F.col("size") > 0)
            & (F.col("size") <= F.abs("_gap"))
            & F.when(F.col("_gap") > 0, F.col("_copies") < most).otherwise(F.col("_copies") > 0)
        )
        room = F.when(F.col("_gap") > 0, most - F.col("_copies")).otherwise(F.col("_copies"))
        moves = F.least(room, F.floor(F.abs("_gap") / F.col("size"))) * F.signum("_gap")
        picked = open_.groupBy("source").agg(F.max_by(F.struct("size", moves.cast("long").alias("move")), "size").alias("_p"))
        picked = picked.select("source", F.col("_p.size").alias("_at"), F.col("_p.move").alias("_move"))
        named = picked.select(F.col("source").alias("_s"), "_at", "_move")
        rounded = materialise(
            rounded.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_at")), "left").select(
                "source", "size", "n", (F.col("_copies") + F.coalesce("_move", F.lit(0))).alias("_copies")
            )
        )
    return rounded


def _given(sizes: DataFrame, copies: DataFrame, cell_rows: int) -> DataFrame:
    """``sizes`` with ``_given``, the copies of each row.

    All rows of a class get its whole share, and the rest goes to the rows whose
    key hashes come first. A class of many rows is cut into cells by hash, and
    every cell gets its part of the rest by running totals of cell sizes, so no
    task ranks more than about ``cell_rows`` rows.
    """
    order = [F.xxhash64(F.col("_key").cast("string")), F.col("_key")]
    large = copies.where(F.col("n") > cell_rows).select("source", "size", F.ceil(F.col("n") / cell_rows).alias("_cells"))
    rows = _attach(sizes, large, "left")
    rows = rows.select("_key", "source", "size", F.coalesce(F.pmod(F.hash(order[0]), F.col("_cells")), F.lit(0)).cast("long").alias("_cell"))
    counted = materialise(rows.groupBy("source", "size", "_cell").agg(F.count(F.lit(1)).alias("_m")))
    run = scan_within(counted, ["source", "size"], [F.col("_cell")], {"_upto": ("sum", F.col("_m"))})
    share = F.floor(F.col("_copies") / F.col("n"))
    rest = (F.col("_copies") - share * F.col("n")).cast("decimal(19,0)")
    part = F.floor(rest * F.col("_upto") / F.col("n")) - F.floor(rest * (F.col("_upto") - F.col("_m")) / F.col("n"))
    cells = _attach(run, copies).select("source", "size", "_cell", share.alias("_share"), part.cast("long").alias("_part"))
    place = F.row_number().over(Window.partitionBy("source", "size", "_cell").orderBy(*order))
    placed = _attach(rows.withColumn("_place", place), cells)
    given = F.col("_share") + (F.col("_place") <= F.col("_part")).cast("long")
    return placed.select("_key", "source", "size", given.cast("long").alias("_given"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5,
    limit: int = 2,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cell_rows: int = 500,
) -> DataFrame:
    """Decide how often each document enters the mix: one row per input row.

    Returns ``key, size, source, source_size, target, copies, taken``. Sizes are
    words (null text: 0); a null source is a source of its own, the last one.
    Documents without words have no tokens to give: their copies follow the
    prior. Within a (source, size) class the order of key hashes decides who
    gets the extra copy; null keys and repeated rows take part like any others
    (equal rows are interchangeable). An empty table gives no rows. Other
    columns are not read.
    """
    rows = pick(docs, key, text, source).toDF("_key", "_text", "source")
    sizes = materialise(
        rows.select("_key", "source", F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    )
    classes = materialise(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = materialise(source_targets(classes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, total, limit))
    prior = min(total, limit * (1 - 1e-6))
    state = balance(classes, targets, limit, prior)
    copies = whole_copies(classes, state, limit, prior)
    done = _attach(_given(sizes, copies, cell_rows), targets)
    return done.select(
        F.col("_key").alias(key),
        "size",
        "source",
        "source_size",
        "target",
        F.col("_given").alias("copies"),
        (F.col("_given") * F.col("size")).alias("taken"),
    )
