"""Ranking: top rows, skylines, majority votes, stratified samples, greedy choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, name: str = "rank") -> DataFrame:
    """The first k rows of each key; the order should end in a unique column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def pareto_frontier(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Rows that no other of their key beats: ``low`` small, ``high`` large; equals of a frontier row stay.

    Two objectives need no pairs: in order of the first, a row stays if its second tops all before it.
    """
    best = df.groupBy(*keys, low).agg(F.max(high).alias("_h"))
    seen = F.max("_h").over(Window.partitionBy(*keys).orderBy(low).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_seen", seen).where("_seen is null or _h > _seen").select(*keys, low, F.col("_h").alias(high))
    return df.join(front, [*keys, low, high], "left_semi")


def majority_vote(df: DataFrame, keys: Sequence[str], choice: str, weight: Column, share: float = 0.6, unknown: str = "unknown") -> DataFrame:
    """The choice with most weight if it has at least ``share`` of it, else ``unknown``; ties are alphabetical."""
    sums = df.groupBy(*keys, choice).agg(F.sum(weight).alias("votes"))
    all_votes = F.sum("votes").over(Window.partitionBy(*keys))
    first = top(sums.withColumn("total", all_votes), keys, [F.desc("votes"), F.col(choice)])
    won = F.col("votes") / F.col("total") >= share
    return first.select(*keys, F.when(won, F.col(choice)).otherwise(unknown).alias("winner"), "votes", "total")


def mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value, ties alphabetical."""
    return top(df.groupBy(*keys, value).agg(F.count("*").alias("n")), keys, [F.desc("n"), F.col(value)]).drop("rank")


def stratified_sample(df: DataFrame, stratum: str, id_col: str, most: int, seed: str = "") -> DataFrame:
    """Round-robin over the strata until ``most`` rows are chosen; inside a stratum by md5 of seed and id."""
    order = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(order, id_col))
    rows = df.withColumn("turn", turn).where(F.col("turn") <= most)  # a stratum gives no more than all of them
    return rows.orderBy("turn", stratum).limit(most)


def evenly_spaced(df: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """``count`` rows at even steps through the order (all, if fewer).  Places come from a range sort, not one window."""
    cut = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    n = cut.count()
    if n <= count:
        return cut.drop("_range")
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = cut.withColumn("_i", inside).join(F.broadcast(before), "_range").withColumn("_at", F.col("_i") + F.col("_before"))
    # the places are i * n // count: a place is one if the first i that reaches it gives it back
    i = F.expr(f"(_at * {count} + {n} - 1) div {n}")
    placed = placed.withColumn("_i", i).where(f"_i < {count} and (_i * {n}) div {count} = _at")
    return placed.drop("_range", "_i", "_before", "_at")


def suggested(value: Column, bounds: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """A label by the first bound that the value reaches."""
    out = F.when(value >= bounds[0][0], bounds[0][1])
    for low, label in bounds[1:]:
        out = out.when(value >= low, label)
    return out.otherwise(otherwise)
