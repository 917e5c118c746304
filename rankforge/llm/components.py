"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.session import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest node around: the larger ones (large star) or the smaller ones and itself."""
    if large:
        around = links.union(links.select("b", "a")).toDF("a", "b")
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("_m"))
    placed = around.join(least, "a")
    if large:
        out = placed.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = placed.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select("a", "_m"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node in ``links`` (columns ``a, b``); the component is its smallest node.

    Only links move, by shuffles with map-side combine; no component ever lies
    in one task. Every round is a written table; rounds end when no link moves,
    after about the squared logarithm of the number of nodes at most. Null ends
    are ignored.
    """
    now = links.select("a", "b").where((F.col("a") != F.col("b")))
    now = materialise(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = materialise(_star(_star(now, True), False))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
