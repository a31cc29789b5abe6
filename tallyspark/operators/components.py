"""Connected components by alternating star contraction, entirely as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.skew import join_summaries
from tallyspark.session import cut

#: Far above the logarithmic number of rounds that the contraction needs; reaching it is an error.
MAX_ROUNDS = 100


def links_by_key(members: DataFrame, node: str, key: str) -> DataFrame:
    """(u, v): every member of a key linked to the key's smallest member. One row per member and key,
    never pairs within a group. Null keys link nothing."""
    members = members.where(F.col(key).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("u"), F.col(key).alias("_key"))
    groups = cut(members.groupBy("_key").agg(F.min("u").alias("v"), F.count("*").alias("_n")).where("_n > 1"))
    return join_summaries(members, groups, ["_key"], "_n").where("u <> v").select("u", "v").distinct()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step over edges (u, v) with u > v.

    large: every neighbour of a node that is larger than it is linked to the smallest of the node and its
    neighbours. Otherwise: every smaller neighbour, and the node, is linked to the smallest of them.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(
            edges.select(F.col("v").alias("n"), F.col("v").alias("m"))
        )
        mins = least.groupBy("n").agg(F.min("m").alias("m"))
        # a smallest member keeps its own edges; others hand theirs to their smallest neighbour
        out = near.where("v > u").join(mins, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # edges to smaller neighbours: only the smallest one is kept
        return out.unionByName(mins.where("n <> m").select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
    mins = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(mins.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge and is not the smallest of its component; root is that
    smallest node. ``edges``: columns u and v of one orderable type; order, repeats and loops do not matter.

    Alternating large-star and small-star steps; each round is checkpointed, and the loop ends when a round
    changes nothing. Nothing but two counters per round reaches the driver.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    before = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or (state.n, state.h) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (state.n, state.h)
        edges = cut(_stars(_stars(edges, True), False))
    raise RuntimeError(f"no convergence in {MAX_ROUNDS} rounds")
