"""Joins by place and order: grid cells, nearest, next above, box overlap, padded candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_semi_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, reach: float) -> DataFrame:
    """Rows of left with a row of right of equal keys within ``reach``: an equi-join on cells of that width.

    Right rows spread over three neighbouring cells and are made distinct by cell and value first.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    spread = right.select(*keys, F.col(right_value).alias("_r"), F.explode(F.array(*(cell(right_value) + d for d in (-1, 0, 1)))).alias("_cell")).distinct()
    marked = left.withColumn("_cell", cell(left_value))
    on = [marked[k] == spread[k] for k in [*keys, "_cell"]] + [F.abs(marked[left_value] - spread["_r"]) <= reach]
    return marked.join(spread, on, "left_semi").drop("_cell")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, left_value: str, right_value: str) -> DataFrame:
    """Each left row's nearest right row of equal keys by absolute difference, ties to the smaller right id.

    As-of in both directions over one sorted union, so a group of l and r rows costs (l + r) log (l + r), not l * r.
    """
    a = left.select(*keys, F.col(left_value).cast("double").alias("_v"), F.lit(1).alias("_side"), F.col(left_id).alias("_id"))
    b = right.groupBy(*keys, F.col(right_value).cast("double").alias("_v")).agg(F.min(right_id).alias("_id")).select(*keys, "_v", F.lit(0).alias("_side"), "_id")
    both = a.unionByName(b)
    hit = F.when(F.col("_side") == 0, F.struct("_v", "_id"))
    down = Window.partitionBy(*keys).orderBy("_v", "_side").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys).orderBy(F.desc("_v"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_lo", F.last(hit, True).over(down)).withColumn("_hi", F.last(hit, True).over(up)).where("_side = 1")
    far = lambda c: F.struct(F.abs(F.col("_v") - F.col(f"{c}._v")).alias("d"), F.col(f"{c}._id").alias("id"))
    best = F.array_min(F.filter(F.array(F.when(F.col("_lo").isNotNull(), far("_lo")), F.when(F.col("_hi").isNotNull(), far("_hi"))), lambda x: x.isNotNull()))
    return found.select(*keys, F.col("_id").alias(left_id), best.alias("_b")).where("_b is not null").select(*keys, left_id, F.col("_b.id").alias(right_id), F.col("_b.d").alias("distance"))


def next_after(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, order: str) -> DataFrame:
    """Each left row's first right row strictly after it in ``order``, ties to the smaller id; null if none.  One window."""
    a = left.select(*keys, F.col(order).alias("_o"), F.lit(1).alias("_side"), F.col(left_id).alias("_id"))
    b = right.groupBy(*keys, F.col(order).alias("_o")).agg(F.min(right_id).alias("_id")).select(*keys, "_o", F.lit(0).alias("_side"), "_id")
    w = Window.partitionBy(*keys).orderBy(F.desc("_o"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_n", F.last(F.when(F.col("_side") == 0, F.struct("_o", "_id")), True).over(w))
    return found.where("_side = 1").select(*keys, F.col("_id").alias(left_id), F.col("_n._id").alias(right_id), F.col("_n._o").alias(f"next_{order}"))


def box_overlaps(df: DataFrame, keys: Sequence[str], id_col: str, box: Sequence[str], cell: float) -> DataFrame:
    """Pairs a < b of equal keys whose boxes (min x, max x, min y, max y) share area, and that area.

    Boxes spread over the cells of ``cell`` width they touch in x; a pair is kept in the cell of its overlap's start only.
    """
    x0, x1, y0, y1 = box
    marks = df.select(*keys, F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(n) for c, n in zip(box, ("x0", "x1", "y0", "y1"), strict=True)))
    marks = marks.withColumn("cell", F.explode(F.sequence(F.floor(F.col("x0") / cell).cast("long"), F.floor(F.col("x1") / cell).cast("long"))))
    a, b = marks.alias("a"), marks.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "cell"]]
    width = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    height = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    once = F.floor(F.greatest("a.x0", "b.x0") / cell).cast("long") == F.col("a.cell")
    pairs = a.join(b, [*on, F.col("a.id") < F.col("b.id"), width > 0, height > 0, once])
    return pairs.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id").alias("a"), F.col("b.id").alias("b"), (width * height).alias("overlap"))


def padded_pairs(lower: DataFrame, upper: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lower with upper candidates of equal keys; a key with one side only keeps it, with the status that says so."""
    a, b = lower.withColumn("_l", F.lit(True)), upper.withColumn("_u", F.lit(True))
    status = F.when(F.col("_l").isNull(), "no-lower").when(F.col("_u").isNull(), "no-upper").otherwise("both")
    return a.join(b, list(keys), "full_outer").withColumn("status", status).drop("_l", "_u")


def lookup(df: DataFrame, dictionary: DataFrame, index: str, key: str, value: str, name: str, default: str = "") -> DataFrame:
    """Dictionary lookup by index, ``default`` out of range."""
    d = dictionary.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return df.join(d, df[index] == d["_k"], "left").withColumn(name, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def last_write(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each composite key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
