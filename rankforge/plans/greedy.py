"""Greedy selection by priority, distributed in blocks.

"Take the first free element, drop everything near it, repeat" looks sequential,
but only elements near each other depend on one another. Space is cut into blocks
that hold a bounded number of elements (cubes that halve where it is crowded).
Each block runs the sequential pass over its own elements and those just outside;
what may depend on an undecided element outside stays undecided, everything else
is final. Rounds repeat on the rest, in blocks that grow as it thins out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.plans.grid import CELL_SLACK, around, cell_of, squared_distance
from rankforge.session import materialise

CELL = ["_c0", "_c1", "_c2"]
BLOCK = ["_level", "_b0", "_b1", "_b2"]
BLOCK_LIMIT = 20_000
LEVELS = 21
# Cells are numbered from a place that is no border of large cubes, wherever the points are.
ORIGIN = 0x2AAAAAAAAA
FREE, TAINTED, OUT = 0, 1, 2

#: Columns of a rotation matrix and the cosine below which two rotations count as different.
Turned = tuple[Sequence[str], float]


def turned_near(turned: Turned, a: str = "", b: str = "l_") -> Column:
    rotation, cos_limit = turned
    trace = sum((F.col(f"{a}{r}") * F.col(f"{b}{r}") for r in rotation[1:]), F.col(f"{a}{rotation[0]}") * F.col(f"{b}{rotation[0]}"))
    return (trace - 1.0) / 2.0 > F.lit(cos_limit)


def _spread(df: DataFrame) -> DataFrame:
    """Each row once per cell around its own."""
    out = df.withColumn("_a", F.explode(around(CELL))).drop(*CELL)
    return out.withColumns({c: F.col(f"_a.c{i}") for i, c in enumerate(CELL)}).drop("_a")


def _blocks_of_cells(cells: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """``keys, CELL, _n, BLOCK``: every cell in the largest cube of cells around it that holds ``capacity`` elements or fewer.

    A cell above that is a block of its own. Only counts per cell move.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    cubes = cells.withColumn("_level", levels).withColumns(
        {f"_b{i}": F.expr(f"shiftright({c} + {ORIGIN}L, _level)") for i, c in enumerate(CELL)}
    )
    fits = cubes.groupBy(*keys, *BLOCK).agg(F.sum("_n").alias("_all")).where((F.col("_all") <= capacity) | (F.col("_level") == 0))
    inside = cubes.join(fits.drop("_all"), [*keys, *BLOCK])
    best = inside.groupBy(*keys, *CELL).agg(F.max(F.struct(*BLOCK)).alias("_b"), F.first("_n").alias("_n"))
    return best.select(*keys, *CELL, "_n", "_b.*")


def _thresholds(undecided: DataFrame, home: DataFrame, needed: DataFrame, keys: list[str], priority: str, capacity: int) -> DataFrame | None:
    """Per block with a crowded cell in or beside it the worst priority to look at in this round.

    About ``capacity`` elements of a crowded cell lie within it. Better elements
    never depend on worse ones, so a block that stops there is still right.
    """
    crowded = home.where(F.col("_n") > capacity).select(*keys, *CELL, "_n")
    if crowded.isEmpty():
        return None
    shares = [2.0**-i for i in range(1, 31)]
    marks = F.percentile_approx(priority, F.array(*[F.lit(s) for s in shares]), F.lit(100_000))
    ranked = undecided.join(crowded, [*keys, *CELL]).groupBy(*keys, *CELL).agg(marks.alias("_m"), F.first("_n").alias("_n"))
    place = F.least(F.greatest(F.ceil(F.log2(F.col("_n") / F.lit(capacity))), F.lit(1)), F.lit(len(shares))).cast("int")
    cut = ranked.select(*keys, *CELL, F.element_at("_m", place).alias("_cut"))
    return cut.join(needed, [*keys, *CELL]).groupBy(*keys, *BLOCK).agg(F.min("_cut").alias("_cut"))


def _pass(names: list[str], priority: str, xyz: list[str], radius: float, turned: Turned | None):
    """The sequential pass over one block; an element is compared with those of the cells around it only."""

    def nearby(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All positions by cell, and per element where the ranges of the cells around it begin and end."""
        n, width = len(place), 1 << 21
        cells = np.floor(place / (radius * CELL_SLACK)) if radius > 0 else np.full_like(place, np.nan)
        spread = cells - cells.min(axis=0)
        if not (spread < width - 2).all():
            # Without a finite grid of that size every element is compared with all.
            return np.arange(n), np.zeros((n, 1), np.int64), np.full((n, 1), n)
        i, j, k = spread.astype(np.int64).T + 1
        name = (i * width + j) * width + k
        order = np.argsort(name, kind="stable")
        rows = [((i + a) * width + j + b) * width + k for a in (-1, 0, 1) for b in (-1, 0, 1)]
        begin = np.stack([np.searchsorted(name[order], r - 1, side="left") for r in rows], axis=1)
        end = np.stack([np.searchsorted(name[order], r + 1, side="right") for r in rows], axis=1)
        return order, begin, end

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(priority, kind="stable", ignore_index=True)
        place = frame[xyz].to_numpy(np.float64)
        turns = None if turned is None else frame[list(turned[0])].to_numpy(np.float64)
        own = frame["_own"].to_numpy(bool)
        state, taken = np.full(len(frame), FREE, np.int8), np.zeros(len(frame), bool)
        order, begin, end = nearby(place)
        # Elements that a certain leader has dropped are not looked at again.
        gone = np.zeros(len(frame), bool)
        for lead in range(len(frame)):
            if gone[lead]:
                continue
            certain = own[lead] and state[lead] == FREE
            around_it = np.concatenate([order[a:b] for a, b in zip(begin[lead].tolist(), end[lead].tolist()) if a < b])
            later = around_it[(around_it > lead) & ~gone[around_it]]
            d = place[later] - place[lead]
            later = later[np.einsum("ij,ij->i", d, d) < radius * radius]
            if turns is not None and len(later):
                later = later[(turns[later] @ turns[lead] - 1.0) / 2.0 > turned[1]]
            if certain:
                taken[lead] = True
                state[later] = OUT
                gone[later] = True
            else:
                state[lead] = TAINTED
                state[later] = TAINTED
        final = own & (taken | (state == OUT))
        return frame.loc[final, names].assign(_in=taken[final])

    return run


def greedy_leaders(
    df: DataFrame,
    keys: Sequence[str],
    priority: str,
    xyz: Sequence[str],
    radius: float,
    payload: Sequence[str] = (),
    turned: Turned | None = None,
    capacity: int = BLOCK_LIMIT,
) -> DataFrame:
    """Elements a sequential greedy pass in ascending ``priority`` would take.

    Two elements are near when closer than ``radius`` and, if ``turned`` is given,
    their rotations (columns of the payload) differ by less than its angle. A task
    holds about ``capacity`` elements of a block and those around it; rounds grow
    with the number of blocks that one chain of dependent elements runs through.
    """
    keys = list(keys)
    names = [priority, *xyz, *payload]
    undecided = materialise(df.select(*keys, *names).withColumns(dict(zip(CELL, cell_of(xyz, radius)))))
    fields = [undecided.schema[n] for n in (*keys, *names)]
    schema = T.StructType([*fields, T.StructField("_in", T.BooleanType())])
    run = _pass([*keys, *names], priority, list(xyz), radius, turned)
    leaders = None
    while not undecided.isEmpty():
        cells = undecided.groupBy(*keys, *CELL).agg(F.count(F.lit(1)).alias("_n"))
        home = materialise(_blocks_of_cells(cells, keys, capacity))
        # Each block also needs the elements of the cells around it.
        needed = _spread(home.select(*keys, *CELL, *BLOCK)).distinct()
        own = home.select(*keys, *CELL, F.struct(*BLOCK).alias("_home"))
        seen = undecided.join(own, [*keys, *CELL]).join(needed, [*keys, *CELL])
        seen = seen.withColumn("_own", F.struct(*BLOCK) == F.col("_home")).drop("_home", *CELL)
        cuts = _thresholds(undecided, home, needed, keys, priority, capacity)
        if cuts is not None:
            seen = seen.join(cuts, [*keys, *BLOCK], "left").where(F.col(priority) <= F.coalesce("_cut", F.col(priority))).drop("_cut")
        decided = materialise(seen.groupBy(*keys, *BLOCK).applyInPandas(run, schema))
        won = decided.where("_in").select(*keys, *names)
        rest = undecided.join(decided.select(*keys, priority), [*keys, priority], "left_anti")
        heads = won.select(*keys, *[F.col(n).alias(f"l_{n}") for n in names])
        heads = _spread(heads.withColumns(dict(zip(CELL, cell_of([f"l_{c}" for c in xyz], radius)))))
        near = squared_distance(xyz, [f"l_{c}" for c in xyz]) < F.lit(radius * radius)
        if turned is not None:
            near = near & turned_near(turned)
        gone = rest.join(heads, [*keys, *CELL]).where(near).select(*keys, priority).distinct()
        undecided = materialise(rest.join(gone, [*keys, priority], "left_anti"))
        leaders = won if leaders is None else leaders.unionByName(won)
    return df.select(*keys, *names).limit(0) if leaders is None else leaders


def assign_leaders(
    df: DataFrame,
    leaders: DataFrame,
    keys: Sequence[str],
    priority: str,
    xyz: Sequence[str],
    radius: float,
) -> DataFrame:
    """First leader within ``radius`` of every element, as ``owner``.

    Leaders keep ``radius`` apart, so the cells around an element hold few.
    """
    keys = list(keys)
    rows = df.select(*keys, priority, *xyz).withColumns(dict(zip(CELL, cell_of(xyz, radius))))
    heads = leaders.select(*keys, *[F.col(n).alias(f"l_{n}") for n in (priority, *xyz)])
    heads = _spread(heads.withColumns(dict(zip(CELL, cell_of([f"l_{c}" for c in xyz], radius)))))
    near = squared_distance(xyz, [f"l_{c}" for c in xyz]) < F.lit(radius * radius)
    same = F.col(priority) == F.col(f"l_{priority}")
    return (
        rows.join(heads, [*keys, *CELL])
        .where(near | same)
        .groupBy(*keys, priority)
        .agg(F.min(f"l_{priority}").alias("owner"))
    )
