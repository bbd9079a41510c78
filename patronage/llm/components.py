"""Connected components of a link table by joins and minima; nothing but the number of links left reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.scratch import stored


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each id that has a link.

    ``links`` has longs ``a`` and ``b``; loops, repeated and reversed rows are harmless, rows with a null are left out,
    an empty table gives an empty one. Result: ``id``, ``root`` (root = id for the smallest of a component).

    Each round every id takes its smallest neighbour as parent, parents are followed to their roots, and links are
    redrawn between roots; what is left shrinks at least by half. A hub is one row on its side of a join and is summed
    up before it is shuffled, so its links spread over tasks. Rounds end in written tables: lineage stays short.
    """
    edges = stored(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parent = stored(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("root")), "parents")
        parent = _followed(parent)
        ends = edges
        for side in ("a", "b"):
            ends = ends.join(parent.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root")), side)
        edges = stored(ends.where("a_root <> b_root").select(
            F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
        if roots is None:
            roots = parent
        else:
            later = parent.select(F.col("id").alias("root"), F.col("root").alias("next"))
            roots = stored(roots.join(later, "root", "left").select(
                "id", F.coalesce("next", "root").alias("root")), "roots")
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots


def _followed(parent: DataFrame) -> DataFrame:
    """Every id with the root of its tree; the way to it halves with each pass."""
    while True:
        above = parent.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = stored(parent.join(above, "root").select(
            "id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "parents")
        parent = step.select("id", "root")
        if step.where("moved").isEmpty():
            return parent
