"""Connected components by alternating large-star and small-star steps (DataFrame joins).

Every step replaces edges by edges to a node's smallest neighbour; both steps
are a grouped minimum (combined before the shuffle) and a join, so a hub is never
gathered in one task.  Steps are written tables, which also cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges(u, v)`` with every kept neighbour v of u tied to the smallest of u and its neighbours."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(smallest, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component_id`` (the smallest id of the component) for every node of ``edges(u, v)``."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .distinct(), "components")
    state = None
    while True:
        edges = materialize(_star(_star(edges, large=True), large=False), "components")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == tuple(row):
            break
        state = tuple(row)
    # A fixed point is one star per component.
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
