"""Distance joins as equi-joins on grid cells.

A point lies in the cell of its floored coordinates. With cells no smaller than
the radius, partners can only be in the 27 cells around, so the query side lists
those cells and Spark hash-joins on (frame, cell). A cell with very many points is
cut into sub-cells by its count, and queries go only to the sub-cells in reach.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.plans.groups import groups_bounded
from rankforge.session import materialise

# Guards the neighbour rule against rounding in the division by the cell size.
CELL_SLACK = 1.0 + 1e-9
# Points of one cell that one task may join with the queries around it.
CROWD = 100_000
# Queries and points of one frame up to which all its pairs are compared without cells.
SMALL_FRAME = 256
# Points and queries of one cell that meet in one key, points that stay together, and pairs
# that one task compares, where pairs are dealt out.
SHARE, PARTY, TILE, WORK = 2048, 3072, 128, 1 << 23
# Levels of cell counts around the density of a frame, each half as wide as the one before.
LEVELS = tuple(range(-4, 7))


def cell_of(coords: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(size * CELL_SLACK)) for c in coords]


def around(cell: Sequence[str]) -> Column:
    """Array of the 27 cells around the cell in three columns, as structs c0, c1, c2."""
    cells = (
        "struct(" + ", ".join(f"{c} + {d} AS c{i}" for i, (c, d) in enumerate(zip(cell, step))) + ")"
        for step in product((-1, 0, 1), repeat=3)
    )
    return F.expr(f"array({', '.join(cells)})")


def squared_distance(a: Sequence[str], b: Sequence[str]) -> Column:
    parts = [(F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b)]
    return parts[0] + parts[1] + parts[2]


def radius_join(
    queries: DataFrame,
    points: DataFrame,
    radius: float,
    keys: Sequence[str] = ("frame_id",),
    query_xyz: Sequence[str] = ("tx", "ty", "tz"),
    point_xyz: Sequence[str] = ("x", "y", "z"),
    strict: bool = False,
    spread: Sequence[str] = (),
    crowd: int = CROWD,
    small: int = SMALL_FRAME,
    even: bool = False,
) -> DataFrame:
    """All pairs of one frame within ``radius`` (inclusive unless ``strict``), with ``d2``.

    Cells with more than ``crowd`` points are cut into sub-cells, and sub-cells that
    still hold more, as with points in one place, into shares; no point is dropped.

    ``spread`` names the query's identity: queries are then distributed by it
    before they expand, and when the points fit a broadcast the pairs stay
    grouped by query, so a later aggregation per query needs no shuffle of pairs.

    Where no frame has more than ``small`` queries or points, frames are joined whole:
    no query is repeated for the cells around it, and pairs stay grouped by frame.

    ``even`` is for callers who want the pairs themselves: both sides of a cell are then
    cut into shares of bounded size, which meet in tasks of about ``WORK`` pairs.
    """
    keys = list(keys)

    def near(pairs: DataFrame) -> DataFrame:
        pairs, limit = pairs.withColumn("d2", squared_distance(query_xyz, point_xyz)), F.lit(radius * radius)
        return pairs.where(F.col("d2") < limit if strict else F.col("d2") <= limit)

    if keys and groups_bounded(points, keys, small) and groups_bounded(queries, keys, small):
        return near((queries.repartition(*keys) if spread else queries).join(points, keys))
    q = queries
    if spread and not even:
        parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        q = q.repartition(parts, *spread)
    q = q.withColumns({f"_q{i}": c for i, c in enumerate(cell_of(query_xyz, radius))})
    q = q.withColumn("_c", F.explode(around(["_q0", "_q1", "_q2"])))
    q = q.select(*queries.columns, *[F.col(f"_c.c{i}").alias(f"_c{i}") for i in range(3)])
    p = points.withColumns({f"_c{i}": c for i, c in enumerate(cell_of(point_xyz, radius))})
    on = [*keys, "_c0", "_c1", "_c2"]
    crowded = p.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd)
    if not crowded.isEmpty():
        q, p = _split_crowded(q, p, materialise(crowded), on, radius, query_xyz, point_xyz, crowd)
        on = [*on, "_part", "_share"]
    pairs = _dealt_pairs(q, p, on, query_xyz, point_xyz) if even else q.join(p, on)
    return near(pairs).drop("_c0", "_c1", "_c2", "_part", "_share")


def _dealt_pairs(q: DataFrame, p: DataFrame, on: list[str], query_xyz: Sequence[str], point_xyz: Sequence[str]) -> DataFrame:
    """The join of both sides on ``on``, dealt out by pairs and not by bytes, which are few for much work.

    A share of a cell's queries and one of its points meet as two arrays. Both start with
    what is nearest to the mean of the cell's points, and ``TILE`` points meet all queries
    before the next ones do: a written file then begins with close pairs, whose
    differences repeat, so that its columns keep their dictionaries.
    """
    queries = q.groupBy(*on).agg(F.count(F.lit(1)).alias("_queries"))
    held = p.groupBy(*on).agg(F.count(F.lit(1)).alias("_points"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(point_xyz)])
    cells = materialise(queries.join(held, on))
    work = cells.agg(F.sum(F.col("_queries") * F.col("_points"))).first()[0] or 0
    tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / WORK))
    means, cuts = [f"_m{i}" for i in range(3)], {"_party": F.ceil(F.col("_queries") / F.lit(PARTY)), "_block": F.ceil(F.col("_points") / F.lit(SHARE))}
    cells = cells.select(*on, *means, *[c.cast("int").alias(f"{name}s") for name, c in cuts.items()])

    def shares(df: DataFrame, xyz: Sequence[str], own: str, other: str) -> DataFrame:
        """Arrays of bounded size, one for each share of the other side."""
        rest = [c for c in df.columns if c not in on]
        share = F.pmod(F.xxhash64(*df.columns), F.col(f"{own}s")).cast("int").alias(own)
        rows = df.join(cells, on).select(*on, share, f"{other}s", F.struct(squared_distance(xyz, means).alias("_far"), *rest).alias("_row"))
        arrays = rows.groupBy(*on, own, f"{other}s").agg(F.sort_array(F.collect_list("_row")).alias(f"{own}_rows"))
        sent = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        return arrays.select(*on, own, f"{own}_rows", sent).repartition(tasks, *on, "_party", "_block")

    meet = [*on, "_party", "_block"]
    # Arrays are taken apart behind the shuffle, and the merge keeps the order of a key's rows.
    first = F.explode(F.sequence(F.lit(1), F.size("_block_rows"), F.lit(TILE))).alias("_first")
    tiles = shares(p, point_xyz, "_block", "_party").select("*", first).select(*meet, F.slice("_block_rows", F.col("_first"), F.lit(TILE)).alias("_tile"))
    asked = shares(q, query_xyz, "_party", "_block").select(*meet, F.inline("_party_rows")).drop("_far")
    return tiles.join(asked.hint("merge"), meet).select(*q.columns, F.inline("_tile")).drop("_far")


def _split_crowded(
    q: DataFrame, p: DataFrame, crowded: DataFrame, on: list[str], radius: float, query_xyz: Sequence[str], point_xyz: Sequence[str], crowd: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_part`` and ``_share``: the sub-cell, and one of several shares of a sub-cell.

    A crowded cell is cut 2, 4 or 8 times along each axis. Queries around it are sent to
    every share of the occupied sub-cells that their ball can touch. Points of other
    cells have part and share 0, and their queries too.
    """
    size = radius * CELL_SLACK
    cuts = F.when(F.col("_n") > 64 * crowd, 8).when(F.col("_n") > 8 * crowd, 4).otherwise(2)
    cells = crowded.select(*on, cuts.alias("_cuts"))
    at = [F.floor(F.col(c) / F.lit(size) * F.col("_cuts")) for c in point_xyz]
    # Sub-cells are named by their place along each axis; the name is unique inside the cell.
    p = p.join(cells, on, "left").withColumn("_at", F.when(F.col("_cuts").isNotNull(), F.struct(*[a.alias(f"a{i}") for i, a in enumerate(at)])))
    parts = (
        p.where("_at IS NOT NULL")
        .groupBy(*on, "_cuts", "_at")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*on, "_cuts", "_at", F.ceil(F.col("_n") / F.lit(crowd)).cast("int").alias("_shares"))
    )
    parts = materialise(parts)
    name = F.xxhash64("_at.a0", "_at.a1", "_at.a2")
    p = p.join(parts.drop("_cuts"), [*on, "_at"], "left").withColumns(
        {
            "_part": F.coalesce(F.when(F.col("_at").isNotNull(), name), F.lit(0)),
            # Points in one place differ in their other columns, from which the share is drawn.
            "_share": F.coalesce(F.pmod(F.xxhash64(*[c for c in p.columns if c not in ("_cuts", "_at")]), F.col("_shares")).cast("int"), F.lit(0)),
        }
    )
    # At most 8 x 8 x 8 (and rounding) sub-cells per cell make one array.
    lists = parts.groupBy(*on).agg(F.collect_list(F.struct("_at", "_cuts", "_shares")).alias("_parts"))
    out = []
    for i, c in enumerate(query_xyz):
        low = f"x._at.a{i} * ({size!r}D / x._cuts)"
        high = f"(x._at.a{i} + 1) * ({size!r}D / x._cuts)"
        gap = f"greatest({low} - {c}, {c} - {high}, 0D)"
        # Rounding of the borders must not lose a part.
        out.append(f"power(greatest({gap} - 1e-9D * ({size!r}D + abs({c})), 0D), 2)")
    reached = F.expr(f"filter(_parts, x -> {' + '.join(out)} <= {radius * radius * (1 + 1e-9)!r}D)")
    sent = F.transform(
        reached,
        lambda x: F.struct(
            F.xxhash64(x["_at"]["a0"], x["_at"]["a1"], x["_at"]["a2"]).alias("part"),
            F.sequence(F.lit(0), x["_shares"] - 1).alias("shares"),
        ),
    )
    plain = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.array(F.lit(0)).alias("shares")))
    q = q.join(lists, on, "left").withColumn("_s", F.explode(F.when(F.col("_parts").isNull(), plain).otherwise(sent)))
    q = q.withColumn("_part", F.col("_s.part")).withColumn("_share", F.explode("_s.shares"))
    return q.drop("_parts", "_s"), p.drop("_cuts", "_at", "_shares")


def neighbours_bounded(
    points: DataFrame, radius: float, limit: int, keys: Sequence[str] = ("frame_id",), xyz: Sequence[str] = ("x", "y", "z")
) -> bool:
    """True when no query can have more than ``limit`` points within ``radius``.

    Proven from cell counts of the points alone; the pairs are not computed.
    """
    cells = [c.alias(f"_c{i}") for i, c in enumerate(cell_of(xyz, radius))]
    crowd = points.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return (crowd or 0) * 27 <= limit


def start_radii(points: DataFrame, k: int, keys: Sequence[str], xyz: Sequence[str]) -> DataFrame:
    """``keys, _n, _r`` per frame: its points, and the radius of a ball that holds about ``k`` (8 at least) of the central ones.

    The box spans the middle half of each coordinate, so that points far out
    change neither their own frame's radius nor any other's.
    """
    lo, hi, least, most = ([f"{name}{i}" for i in range(3)] for name in ("_lo", "_hi", "_min", "_max"))
    box = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.percentile_approx(c, F.lit(0.25), F.lit(1000)).alias(n) for c, n in zip(xyz, lo)],
        *[F.percentile_approx(c, F.lit(0.75), F.lit(1000)).alias(n) for c, n in zip(xyz, hi)],
        *[F.min(c).alias(n) for c, n in zip(xyz, least)],
        *[F.max(c).alias(n) for c, n in zip(xyz, most)],
    )
    middle = [F.col(h) - F.col(w) for h, w in zip(hi, lo)]
    # A frame that is flat in the middle falls back to its whole extent, and a single place to any radius.
    whole = F.greatest(*[F.col(h) - F.col(w) for h, w in zip(most, least)])
    widths = [F.when(w > 0, w).otherwise(whole * 0.5) for w in middle]
    share = F.lit(max(k, 8) * 0.75 / math.pi) / (F.col("_n") / 8)
    ball = F.pow(widths[0] * widths[1] * widths[2] * share, F.lit(1 / 3))
    radius = F.when(whole > 0, F.greatest(ball, whole * 1e-6)).otherwise(F.lit(1.0))
    return box.select(*keys, "_n", radius.alias("_r"), *least, *most)


def _width(level: Column) -> Column:
    """Cell width of a level in units of the frame's radius."""
    return F.pow(F.lit(2.0), -level)


def start_levels(
    queries: DataFrame, points: DataFrame, k: int, keys: Sequence[str], query_id: str, query_xyz: Sequence[str], point_xyz: Sequence[str]
) -> DataFrame:
    """``queries`` with ``_level``: the finest level at which the query's own cell holds a quarter of ``k`` points.

    Both sides have ``_r``, the radius of their frame. Cells are counted at all ``LEVELS``
    with map-side combine; only the counts of sufficient cells meet the queries. A query
    without such a cell starts above the coarsest level, one outside of the box
    (``_min0.. _max2``) of its frame at its distance from it.
    """
    keys, levels = list(keys), F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("_level")

    def cells(xyz: Sequence[str]) -> list[Column]:
        return [F.floor(F.col(c) / (F.col("_r") * _width(F.col("_level")))).alias(f"_c{i}") for i, c in enumerate(xyz)]

    places = points.select(*keys, "_r", *point_xyz, levels).select(*keys, "_level", *cells(point_xyz))
    full = places.groupBy(*places.columns).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= max(1, math.ceil(k / 4))).drop("_k")
    own = queries.select(*keys, query_id, "_r", *query_xyz, levels).select(*keys, query_id, "_level", *cells(query_xyz))
    best = own.join(full, [*keys, "_level", "_c0", "_c1", "_c2"]).groupBy(*keys, query_id).agg(F.max("_level").alias("_level"))
    gap = F.greatest(F.lit(0.0), *[F.greatest(F.col(f"_min{i}") - F.col(c), F.col(c) - F.col(f"_max{i}")) for i, c in enumerate(query_xyz)])
    away = F.when(gap > F.col("_r"), -F.ceil(F.log2(gap / F.col("_r"))).cast("int"))
    without = F.least(F.lit(LEVELS[0] - 1), away)
    return queries.join(best, [*keys, query_id], "left").withColumn("_level", F.coalesce("_level", without))


def _finite(df: DataFrame, xyz: Sequence[str]) -> DataFrame:
    for c in xyz:
        df = df.where(F.abs(F.col(c)) < F.lit(float("inf")))
    return df


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    radius: float | None = None,
    keys: Sequence[str] = ("frame_id",),
    query_id: str = "cand_idx",
    point_id: str = "point_idx",
    query_xyz: Sequence[str] = ("tx", "ty", "tz"),
    point_xyz: Sequence[str] = ("x", "y", "z"),
    payload: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` nearest points of every query in its frame, ties by point id.

    A query is settled once ``k`` points (or all of its frame) lie within the
    radius; the others try again with twice the radius. Each round keeps at most
    ``k`` pairs per query in every map task. Every query starts at a radius of its
    own, the width of the finest cell around it that holds enough points, so neither
    a dense spot nor a far point changes the pairs of others. With ``radius`` all
    start there. A point is repeated once for each width that queries of its frame
    use. Columns: keys, query id, point id, ``d2``, ``nn`` (0-based), payload.
    Queries in frames without points, and queries or points with a null or
    non-finite coordinate, have no rows.
    """
    keys = list(keys)
    who = [*keys, query_id]
    cloud = _finite(points.select(*keys, point_id, *point_xyz, *payload), point_xyz)
    frames = start_radii(cloud, k, keys, point_xyz)
    if radius is not None:
        frames = frames.withColumn("_r", F.lit(float(radius)))
    frames = materialise(frames)
    cloud = cloud.join(frames.select(*keys, "_r"), keys)
    todo = _finite(queries.select(*who, *query_xyz), query_xyz).join(frames, keys)
    todo = todo.withColumn("_level", F.lit(0)) if radius is not None else start_levels(todo, cloud, k, keys, query_id, query_xyz, point_xyz)
    todo = materialise(todo.select(*who, *query_xyz, "_r", "_level", F.least(F.col("_n"), F.lit(k)).alias("_need")))
    # Coordinates in units of the width give one grid for all frames and levels.
    unit_q, unit_p = [f"_uq{i}" for i in range(3)], [f"_up{i}" for i in range(3)]

    def scaled(df: DataFrame, xyz: Sequence[str], names: Sequence[str]) -> DataFrame:
        return df.withColumns({u: F.col(c) / (F.col("_r") * _width(F.col("_level"))) for u, c in zip(names, xyz)}).drop("_r")

    found = None
    while not todo.isEmpty():
        nearest = Window.partitionBy(*who).orderBy("d2", point_id)
        used = todo.select(*keys, "_level").distinct()
        pairs = radius_join(
            scaled(todo, query_xyz, unit_q), scaled(cloud.join(used, keys), point_xyz, unit_p), 1 + 1e-9, [*keys, "_level"], unit_q, unit_p, spread=who
        )
        # Distances and ties are those of the given coordinates; a pair on the edge of
        # the scaled ball does not settle its query.
        pairs = pairs.withColumn("_in", F.col("d2") <= (1 - 1e-9) ** 2)
        pairs = pairs.withColumn("d2", squared_distance(query_xyz, point_xyz))
        top = pairs.withColumn("nn", F.row_number().over(nearest)).where(F.col("nn") <= k)
        complete = top.withColumn("_found", F.count_if("_in").over(Window.partitionBy(*who)))
        settled = materialise(
            complete.where(F.col("_found") >= F.col("_need")).select(
                *who, point_id, "d2", (F.col("nn") - 1).alias("nn"), *payload
            )
        )
        found = settled if found is None else found.unionByName(settled)
        todo = todo.join(settled.where("nn = 0").select(*who), who, "left_anti").withColumn("_level", F.col("_level") - 1)
        todo = materialise(todo)
    if found is None:
        return cloud.join(todo.select(*who).where("false"), keys).select(
            *who, point_id, F.lit(0.0).alias("d2"), F.lit(0).alias("nn"), *payload
        ).where("false")
    return found
