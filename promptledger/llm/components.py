"""Connected components of an edge table by alternating stars, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True if every ``a`` has one ``b`` and no ``b`` is an ``a``: then b is a's root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)").isEmpty()


def _hung(sides: DataFrame) -> DataFrame:
    """Hang every ``v`` of a node ``u`` at the least of u and its neighbours; mins combine before the shuffle."""
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sides.join(least, "u")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` (the least node reached) for every node of ``edges(a, b)``.

    Large and small stars by turns, each a group minimum and a join: no
    neighbour list is gathered. Every turn is a written table. Null ends are no edges.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _is_forest_of_stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = _hung(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        hung = _hung(large.distinct())
        small = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(hung.select("u", "m"))
        edges = written(small.where("a <> b").distinct(), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def joined_roots(roots: DataFrame | None, edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` after more ``edges(a, b)``: only the roots that they touch are linked anew."""
    if roots is None:
        return written(components(edges, name), name)
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    up = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = written(components(up, name), name)
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return written(old.union(moved.join(roots.select("node"), "node", "left_anti").select("node", "root")), name)
