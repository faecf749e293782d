"""Connected components of an edge table, by alternating large and small
stars; every round is a few joins and aggregates over slim rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.util import materialize


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Point each node's neighbours at its least neighbour (itself included):
    the greater neighbours (large star) or, of edges turned downwards, the
    lesser ones and the node (small star)."""
    if small:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = sides.join(least, F.col("u") == F.col("_u"))
    if small:
        out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 100) -> DataFrame:
    """``edges``: ``u``, ``v`` (long). Returns ``node``, ``component`` (the
    least node) for every node with an edge to another; a node that is its
    own component's least is included. No edges: no rows.

    Each round is written to the shared folder, so a lost executor costs a
    part of one round. The number of rounds grows with the logarithm of the
    graph's diameter.
    """
    now = materialize(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), name)
    seen = None
    for _ in range(max_rounds):
        now = materialize(_stars(_stars(now, small=False), small=True), name)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
