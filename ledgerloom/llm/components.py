"""Connected components by alternating large-star and small-star steps.

Both steps are a partial minimum per node followed by an equi-join, so a hub with a third
of all edges is pre-aggregated before the shuffle and AQE may split it in the join. The
number of rounds grows with the logarithm of a component's size, not with its diameter.
No edge ever reaches the driver except as a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import discard, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the smallest member of u's neighbourhood."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select("u", F.col("m").alias("v"))
    rest = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(rest)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for all nodes of an edge list with long columns u and v.

    component is the smallest node that can be reached. Self-loops, repeated edges and
    either direction are allowed; edges with a null end are ignored; no edges give no rows.
    """
    ordered = edges.where("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")
    ).distinct()
    now = stored(ordered, "edges", 16)
    for _ in range(rounds):
        large = _large_star(now).distinct()
        new = stored(_small_star(large).distinct(), "edges", 16)
        # A fixed point is a star forest: every left end has one edge, and no root is a left end.
        marks = new.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        bent = marks.where("n > 1").limit(1).count() or new.join(
            marks.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        discard(now)
        now = new
        if not bent:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
