"""Connected components by alternating large and small stars, all in joins and aggregates.

Every round is written to the shared folder, so lineage stays short and a lost executor costs no earlier round. The number
of rounds grows with the logarithm of the largest component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


#: Parts that the edges of a node are dealt into where they meet its least neighbour.
PARTS = 16


def _dealt(edges: DataFrame, by: str, moves: DataFrame, how: str) -> DataFrame:
    """edges (a, b) with m of moves (node, m) for the node in column `by`; a node's edges meet its m in PARTS places."""
    other = "b" if by == "a" else "a"
    left = edges.withColumn("__part", F.pmod(F.xxhash64(other), F.lit(PARTS)).cast("int"))
    right = moves.select(F.col("node").alias(by), "m", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("__part"))
    return left.join(right, [by, "__part"], how).drop("__part")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (a, b), root being the smallest node of its component; roots are not listed.

    Large star: the larger end of an edge moves to the least neighbour of the smaller one; only smaller ends that have a
    smaller neighbour take part, so the many edges of a root move nowhere. Small star: a node with several smaller
    neighbours hands them to the least.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        below = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        ends = edges.select(F.col("b").alias("node")).distinct()
        large = _dealt(edges, "b", below.join(ends, "node", "left_semi"), "left")
        large = stored(large.select("a", F.coalesce("m", "b").alias("b")).distinct(), "edges")
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = _dealt(large, "a", least.filter("n > 1"), "inner").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.union(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
