"""Connected components by alternating large-star and small-star, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(20, 0)))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest reachable node.

    Nodes may have any type with an order. Self loops, repeated edges and
    both directions are allowed; rows with a null end are ignored; no edges
    give no rows. Each round is two stars, each an aggregate by node (combined
    before the shuffle) and a join back, which adaptive execution splits where
    a node is hot; lineage is cut after every round, so a lost executor never
    repeats more than one. Nothing but one summary row reaches the driver.
    """
    now = cut(edges.where("u is not null and v is not null and u != v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    state = _state(now)
    while state[0]:
        # large-star: every larger neighbour of a node meets the smallest one
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(least, "u").where("v > u").selectExpr("v u", "m v").where("u != v").distinct()
        # small-star: a node and its smaller neighbours meet the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").selectExpr("v u", "m v")
        following = cut(small.union(least.selectExpr("u", "m v")).distinct())
        now, before, state = following, state, _state(following)
        if state == before:
            break
    return now.selectExpr("u node", "v component").union(now.selectExpr("v node", "v component")).distinct()
