"""Connected components of a graph given as pairs of numbers, by alternating star rounds.

A large-star round links each node's larger neighbours to its smallest neighbour, a small-star round
links a node and its smaller neighbours to the smallest of them. Neighbours are never gathered: a
round is one aggregation and one join, and a node of very many links costs one row per link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.base import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).distinct()
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) of every node of ``edges`` (``a``, ``b``); the label is the smallest node of the component."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = written(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
    # every node but the smallest now has exactly one edge, to the smallest
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
