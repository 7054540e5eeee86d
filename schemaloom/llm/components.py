"""Connected components by alternating large-star and small-star steps.

Each step groups edges by one end with partial aggregation (a hub costs one
row per task) and joins the minimum back; both join sides are plain shuffles,
so adaptive execution can split a hub's edges. Every round is written to the
shared folder, and the edges never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v). large: every larger neighbour of u goes to the smallest
    of u and its neighbours; small: u's smaller neighbours and u itself do."""
    rows = (edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            if large else edges)
    low = saved(rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc_low")
    joined = rows.join(low, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"),
                                                           F.col("m").alias("v"))
    else:
        out = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return saved(out.where(F.col("u") != F.col("v")).distinct(), "cc_edges")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Does each u have one edge, to a v that has none of its own?"""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    bad = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
        (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))
    return bad.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """id, class_id of every end of ``links`` (columns a, b): class_id is the
    smallest id of its component. No links give no rows."""
    a, b = F.col("a"), F.col("b")
    edges = saved(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .distinct(), "cc_edges")
    while not _is_forest_of_stars(edges):
        edges = _star(_star(edges, large=True), large=False)
    roots = edges.select(F.col("v").alias("id")).distinct()
    return (edges.select(F.col("u").alias("id"), F.col("v").alias("class_id"))
            .unionByName(roots.select("id", F.col("id").alias("class_id"))))
