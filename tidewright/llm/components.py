"""Connected components of an edge table, by alternating large and small stars.

Each round replaces edges by edges to the least neighbour, first for the larger
neighbours of every node, then for the smaller ones; the edges converge to one
star for each component in a number of rounds that grows with the logarithm of
the longest path. A node's least neighbour comes from a map-side combined
aggregation and is joined back, so that the centre of a large star is a skewed
join key (which adaptive execution splits) and never a group in one task. Every
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.scratch import Scratch

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One pass over edges (u, v); the result has u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node with an edge to another; component is the least id."""
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(now)
    for i in range(MOST_ROUNDS):
        now = scratch.save(_star(_star(now, large=True), large=False), f"round{i}")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no convergence in {MOST_ROUNDS} rounds")
    centres = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)
