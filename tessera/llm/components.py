"""Connected components of a link table, by repeated contraction.

Each round every node points to the first of its neighbours in a pseudo-random order (or to
itself), pointers are followed four steps, and links between nodes that met disappear. The
graph shrinks by a constant factor, so a few rounds do whatever the size of the groups. Every
table is written to the shared folder, and all joins are between plain shuffles, so that
adaptive execution can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): equal roots for connected nodes.

    Null ends and links of a node to itself join nothing; no links give an empty table.
    """
    now = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        points = cut(best.select(F.col("a").alias("node"), F.least("m", own)["b"].alias("to")), "points")
        for _ in range(2):
            onward = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
            followed = cut(points.join(onward, "to").select("node", F.col("next").alias("to")), "points")
            release(points)
            points = followed
        ends = now
        for side in ("a", "b"):
            ends = ends.join(points.select(F.col("node").alias(side), F.col("to").alias(f"{side}_to")), side)
        met = ends.where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        left = cut(met.distinct(), "links")
        release(now)
        now = left
        if found is None:
            found = cut(points.withColumnRenamed("to", "root"), "found")
        else:
            moved = points.select(F.col("node").alias("root"), "to")
            followed = cut(found.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "found")
            release(found)
            found = followed
        release(points)
    if found is None:
        return now.select(F.col("a").alias("node"), F.col("a").alias("root"))
    release(now)
    return found
