"""Work on the points around each query without a row per pair.

Queries of one cell meet the points of the 27 cells around it in one call, so a
pair costs a few array operations and no row. A call holds at most ``BLOCK``
queries and about ``limit`` points: further queries of a cell go to other calls,
and so do further points, whose results the caller combines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.plans.grid import CROWD, around, cell_of
from rankforge.session import materialise

# Queries of one call.
BLOCK = 4096
_CELL = [f"_c{i}" for i in range(3)]
_QUERY_CELL = [f"_q{i}" for i in range(3)]

Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def query_cells(
    queries: DataFrame,
    points: DataFrame,
    radius: float,
    keys: Sequence[str],
    query_xyz: Sequence[str] = ("tx", "ty", "tz"),
    point_xyz: Sequence[str] = ("x", "y", "z"),
) -> DataFrame:
    """Cells with queries: ``keys, _q0.._q2, _queries`` and ``_points``, the points of the 27 cells around."""
    keys = list(keys)
    asked = queries.groupBy(*keys, *[c.alias(n) for c, n in zip(cell_of(query_xyz, radius), _QUERY_CELL)]).agg(F.count(F.lit(1)).alias("_queries"))
    held = points.groupBy(*keys, *[c.alias(n) for c, n in zip(cell_of(point_xyz, radius), _CELL)]).agg(F.count(F.lit(1)).alias("_n"))
    reached = _neighbours(asked).join(held, [*keys, *_CELL])
    return materialise(reached.groupBy(*keys, *_QUERY_CELL, "_queries").agg(F.sum("_n").alias("_points")))


def _neighbours(cells: DataFrame) -> DataFrame:
    listed = cells.withColumn("_c", F.explode(around(_QUERY_CELL)))
    return listed.select(*cells.columns, *[F.col(f"_c.c{i}").alias(n) for i, n in enumerate(_CELL)])


def map_near(
    queries: DataFrame,
    points: DataFrame,
    cells: DataFrame,
    radius: float,
    keys: Sequence[str],
    kernel: Kernel,
    schema: T.StructType,
    query_xyz: Sequence[str] = ("tx", "ty", "tz"),
    point_xyz: Sequence[str] = ("x", "y", "z"),
    limit: int = CROWD,
) -> DataFrame:
    """What ``kernel(queries, points)`` returns for all queries of ``cells`` (of ``query_cells``).

    Every query meets each point of the cells around it once. Where these are more than
    ``limit``, they come in several calls.
    """
    keys = list(keys)
    work = cells.select(
        *keys, *_QUERY_CELL, F.ceil(F.col("_queries") / BLOCK).cast("int").alias("_parts"), F.ceil(F.col("_points") / F.lit(limit)).cast("int").alias("_shares")
    )
    group = [*keys, *_QUERY_CELL, "_part", "_share"]
    # A number of partitions of its own: few bytes may be much work, so none are merged.
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, other: str, n: str, m: str) -> DataFrame:
        mine = F.when(F.col(n) > 1, F.pmod(F.xxhash64(*df.columns), F.col(n))).otherwise(0).cast("int")
        return df.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("_parts", "_shares", *_CELL)

    q = queries.withColumns(dict(zip(_QUERY_CELL, cell_of(query_xyz, radius)))).join(work, [*keys, *_QUERY_CELL])
    p = points.withColumns(dict(zip(_CELL, cell_of(point_xyz, radius)))).join(_neighbours(work), [*keys, *_CELL])
    q = dealt(q, "_part", "_share", "_parts", "_shares").repartition(tasks, *group)
    p = dealt(p, "_share", "_part", "_shares", "_parts").repartition(tasks, *group)

    def call(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if len(mine) and len(near):
            return kernel(mine, near)
        return pd.DataFrame({f.name: [] for f in schema.fields})

    return q.groupBy(*group).cogroup(p.groupBy(*group)).applyInPandas(call, schema)


def distances(
    queries: pd.DataFrame, points: pd.DataFrame, query_xyz: Sequence[str] = ("tx", "ty", "tz"), point_xyz: Sequence[str] = ("x", "y", "z")
) -> Iterator[tuple[int, np.ndarray]]:
    """Position of each query and its squared distance to all points, as ``squared_distance`` has it."""
    x, y, z = (points[c].to_numpy(np.float64) for c in point_xyz)
    for i, (a, b, c) in enumerate(queries[list(query_xyz)].to_numpy(np.float64)):
        dx, dy, dz = a - x, b - y, c - z
        yield i, dx * dx + dy * dy + dz * dz


def picked(queries: pd.DataFrame, points: pd.DataFrame, names: Sequence[str], found: list[tuple[int, np.ndarray]], more: dict[str, list[np.ndarray]]) -> pd.DataFrame:
    """One row per (query, chosen point): columns ``names`` of either side and arrays beside them."""
    sizes = [len(at) for _, at in found]
    at_query = np.repeat([i for i, _ in found], sizes).astype(np.int64)
    at_point = np.concatenate([np.zeros(0, np.int64), *[at for _, at in found]])
    out = {n: (queries[n].to_numpy()[at_query] if n in queries.columns else points[n].to_numpy()[at_point]) for n in names}
    return pd.DataFrame(out | {n: np.concatenate([[], *arrays]) for n, arrays in more.items()})


def nearest_pairs(
    queries: DataFrame,
    points: DataFrame,
    radius: float,
    k: int,
    keys: Sequence[str],
    query_id: str,
    point_id: str,
    strict: bool = False,
    payload: Sequence[str] = (),
    rotation: Sequence[str] = (),
    limit: int = CROWD,
) -> DataFrame:
    """Pairs within ``radius`` that may be among the ``k`` nearest of their query: keys, both ids, ``_d2``, payload.

    Ties go by point id. A call returns its own ``k`` nearest, so a query has more rows
    where its points come in several calls; it has fewer than ``k`` only if there are
    fewer. With ``rotation`` the order is by ``_d2`` in the query's own frame.
    """
    keys = list(keys)
    q = queries.select(*keys, query_id, "tx", "ty", "tz", *rotation)
    p = points.select(*keys, point_id, "x", "y", "z", *payload)
    names = [*keys, query_id, point_id, *payload]
    fields = {f.name: f for f in [*q.schema.fields, *p.schema.fields]}
    schema = T.StructType([*[fields[n] for n in names], T.StructField("_d2", T.DoubleType())])
    reach = radius * radius

    def nearest(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values([point_id, *payload], kind="stable", ignore_index=True)
        place = near[["x", "y", "z"]].to_numpy(np.float64).T
        turns = mine[list(rotation)].to_numpy(np.float64) if rotation else None
        starts = mine[["tx", "ty", "tz"]].to_numpy(np.float64)
        found, order = [], []
        for i, d2 in distances(mine, near):
            at = np.flatnonzero(d2 < reach if strict else d2 <= reach)
            value = d2[at]
            if rotation:
                value = _local_d2(place[:, at], starts[i], turns[i])
            if len(at) > k:
                # All that reach the k-th value, of which the stable order takes the first.
                close = np.flatnonzero(value <= np.partition(value, k - 1)[k - 1])
                best = close[np.argsort(value[close], kind="stable")[:k]]
                at, value = at[best], value[best]
            found.append((i, at))
            order.append(value)
        return picked(mine, near, names, found, {"_d2": order})

    return map_near(q, p, query_cells(q, p, radius, keys), radius, keys, nearest, schema, limit=limit)


def local_axes(place: np.ndarray, start: np.ndarray, turn: np.ndarray) -> list[np.ndarray]:
    """Points in a query's own frame, in the order of operations of ``rotate_into``."""
    d = [place[a] - start[a] for a in range(3)]
    return [d[0] * turn[a] + d[1] * turn[3 + a] + d[2] * turn[6 + a] for a in range(3)]


def _local_d2(place: np.ndarray, start: np.ndarray, turn: np.ndarray) -> np.ndarray:
    x, y, z = local_axes(place, start, turn)
    return x * x + y * y + z * z
