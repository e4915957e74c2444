"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps rewire edges towards the smallest node of a neighbourhood, so a component becomes a star within a number of
rounds logarithmic in its diameter. A neighbourhood is only ever reduced by ``min`` (pre-aggregated before the shuffle)
and joined back, so a node with very many edges is never gathered in one task: the join is one that adaptive execution
can split. Every round is checkpointed to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


#: Up to so many edges the table of least neighbours (two numbers a row) is broadcast, so edges aren't moved to meet it.
BROADCAST_EDGES = 50_000


def _beside(least: DataFrame, edges: int) -> DataFrame:
    return F.broadcast(least) if edges <= BROADCAST_EDGES else least


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(_beside(least, n), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(_beside(least, n), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root is the smallest node of its component.

    Edges with a null end and loops are left out; repeated edges count once. No edges give an empty table. Edges only ever
    become fewer, so each round is written to as many files as their number needs.
    """
    state = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(state)
    while before[0]:
        state = cut(_small_star(_large_star(state, before[0]), before[0]), 2 * before[0])
        after = _signature(state)
        if after == before:
            break
        before = after
    # Every node is the larger end of exactly one edge now, but for the roots.
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
