"""Connected components of an edge table by alternating star contractions, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, tidy


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return got["n"], got["h"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, label): the label is the smallest node reachable.  Nodes without edges are not listed.

    Self-loops and repeated edges change nothing; an edge with a null end is ignored; an empty table gives an
    empty result.  Rounds grow with the logarithm of the longest chain, each a shuffle of the edge table, whose
    state is stored so that no lineage builds up.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = _state(now)
    while was[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        state = _state(now)
        if state == was:
            break
        was = state
        tidy(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
