"""Dictionary encoding, quantization of coordinates, deduplication of points, undirected segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import quantized
from .graph import settled


def dictionary(df: DataFrame, value: str, position: str) -> DataFrame:
    """(value, id): ids from 0 in order of first appearance.

    Values are aggregated, then sorted by ranges; each value's id is its number in its range and the sizes of the
    ranges before (one small row a range), so no window holds all values.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(position).alias("_p"))
    # stored with its range, as a range sort that runs again may cut elsewhere
    cut = settled(first.repartitionByRange("_p", value).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_p", value)) - 1
    return cut.withColumn("_i", inside).join(F.broadcast(before), "_range").select(value, (F.col("_i") + F.col("_before")).cast("long").alias("id"))


def encode(df: DataFrame, names: DataFrame, value: str, code: str) -> DataFrame:
    return df.join(names.withColumnRenamed("id", code), value, "left").drop(value)


def decode(df: DataFrame, names: DataFrame, value: str, code: str) -> DataFrame:
    return df.join(names.withColumnRenamed("id", code), code, "left").drop(code)


def quantize(df: DataFrame, keys: Sequence[str], axes: Sequence[str], max_error: float = 0.001) -> DataFrame:
    """Per key and axis whole numbers of 16 bits if half a step stays within the error, else of 32: q_, min_ and scale_ columns."""
    ends = df.groupBy(*keys).agg(*(f(a).alias(f"_{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))  # without keys ends is one row
    for a in axes:
        low, high = F.col(f"_lo_{a}"), F.col(f"_hi_{a}")
        steps = F.when((high - low) / 65535 / 2 <= max_error, 65535.0).otherwise(4294967295.0)
        scale = F.when(high > low, (high - low) / steps).otherwise(1.0)
        out = out.withColumn(f"min_{a}", low).withColumn(f"scale_{a}", scale)
        out = out.withColumn(f"q_{a}", F.floor((F.col(a) - F.col(f"min_{a}")) / F.col(f"scale_{a}") + 0.5).cast("long"))
    return out.drop(*ends.columns[len(keys) :])


def dequantize(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{a}_back": F.col(f"min_{a}") + F.col(f"q_{a}") * F.col(f"scale_{a}") for a in axes})


def unique_points(df: DataFrame, keys: Sequence[str], axes: Sequence[str], position: str, digits: int = 9) -> DataFrame:
    """Points equal to ``digits`` places become one, numbered per key by first appearance."""
    rounded = [F.round(a, digits).alias(a) for a in axes]
    first = df.select(*keys, *rounded, position).groupBy(*keys, *axes).agg(F.min(position).alias("_p"))
    return first.select(*keys, *axes, (F.row_number().over(Window.partitionBy(*keys).orderBy("_p")) - 1).alias("point"))


def undirected(df: DataFrame, start: tuple[str, str], end: tuple[str, str]) -> DataFrame:
    """Segments with quantized ends, the smaller end first, and a key that both directions share."""
    a, b = (F.struct(quantized(x).alias("x"), quantized(z).alias("z")) for x, z in (start, end))
    return df.withColumn("start", F.least(a, b)).withColumn("end", F.greatest(a, b)).withColumn("key", F.sha2(F.to_json(F.struct("start", "end")), 256))
