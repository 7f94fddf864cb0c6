"""Design advice: recommendations from the analyses of rooms, merged and ranked, and a seeded search over design variables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio, seeded_uniform
from .boundaries import undominated

SEVERITIES = ("critical", "warning", "info")


@dataclass(frozen=True)
class Advice:
    """When it holds for a row, what is advised: an override of the design with its factor, or none."""

    when: Column
    category: str
    severity: str
    title: str
    confidence: float
    override: str | None = None
    factor: float | None = None


def room_advice() -> list[Advice]:
    """Rules on rooms with quality, access, air_changes, ventilation, cooling_kw and luminaires."""
    # fixed values: titles, thresholds, confidences and factors
    air = F.col("air_changes")
    return [
        Advice(F.col("quality") == "insufficient", "missing project data", "critical", "Insufficient Geometry Data", 1.0),
        Advice(F.col("access").isin("isolated", "unreachable"), "circulation/access", "warning", "Inaccessible Room", 0.95),
        Advice((air > 0) & (air < 2), "natural ventilation", "warning", "Poor Natural Ventilation", 0.8, "windowAreaMultiplier", 1.5),
        Advice((air == 0) & (F.col("ventilation") == "no_exterior_ventilation"), "natural ventilation", "warning", "No Natural Ventilation", 0.85, "windowAreaMultiplier", 1.5),
        Advice(F.col("cooling_kw") > 10, "AC capacity", "warning", "High Cooling Load", 0.8, "solarFactorMultiplier", 0.6),
        Advice(F.col("luminaires") > 20, "lighting quantity", "info", "High Fixture Count", 0.9),
    ]


def building_advice(threshold: float) -> list[Advice]:
    """Rules on a building with ottv and has_north."""
    # fixed values, as above
    high = F.col("ottv") > threshold
    return [
        Advice(~F.col("has_north"), "missing project data", "critical", "Missing Project North", 1.0, "projectNorthDeg", 0.0),
        Advice(high, "envelope insulation", "warning", "High Overall Thermal Transfer Value (OTTV)", 0.9, "wallUValueMultiplier", 0.8),
        Advice(high, "solar shading", "warning", "High Solar Heat Gain", 0.8, "shadingCoefficientMultiplier", 0.7),
    ]


def advised(df: DataFrame, keys: Sequence[str], rules: Sequence[Advice], room: str | None = None) -> DataFrame:
    """A row for each rule that holds: keys, room (null for a building), category, severity, title, confidence, override, factor."""
    rows = [F.when(r.when, F.struct(F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title"), F.lit(r.confidence).alias("confidence"), F.lit(r.override).cast("string").alias("override"), F.lit(r.factor).cast("double").alias("factor"))) for r in rules]
    found = F.filter(F.array(*rows), lambda x: x.isNotNull())
    name = F.col(room).cast("string") if room else F.lit(None).cast("string")
    return df.select(*keys, name.alias("room"), F.explode(found).alias("a")).select(*keys, "room", "a.*")


def merged_advice(rows: DataFrame, keys: Sequence[str], many: int = 5) -> DataFrame:
    """Advice that says the same merged, with its number of rooms, ranked by severity, confidence, rooms and title.

    Advice of more than ``many`` rooms is of the building; larger windows conflict with a warning on insulation.
    """
    same = [*keys, "category", "severity", "title", "confidence", "override", "factor"]
    # a room counts once however often it was advised; counts of distinct rooms are two steps of partial sums
    merged = rows.groupBy(*same, "room").agg(F.lit(1).alias("one")).groupBy(*same).agg(F.count("room").alias("rooms"), F.max(F.col("room").isNull().cast("int")).alias("_whole"))
    merged = merged.withColumn("scope", F.when((F.col("_whole") == 1) | (F.col("rooms") > many), "building").otherwise("room"))
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    order = Window.partitionBy(*keys).orderBy(place, F.desc("confidence"), F.desc("rooms"), "title")
    warned = F.max(((F.col("category") == "envelope insulation") & (F.col("severity") == "warning")).cast("int")).over(Window.partitionBy(*keys))
    wider = (F.col("override") == "windowAreaMultiplier") & (F.col("factor") > 1)
    return merged.select(*same, "rooms", "scope", F.concat(F.lit("REC-"), F.row_number().over(order).cast("string")).alias("id"), F.coalesce(wider & (warned == 1), F.lit(False)).alias("conflict"))


@dataclass(frozen=True)
class Variable:
    name: str
    low: float
    high: float
    step: float


def designs(spark: SparkSession, variables: Sequence[Variable], count: int, seed: int) -> DataFrame:
    """(design, one column per variable, distance): seeded choices on the steps of each variable.

    The k-th number of the seeded generator is computed from k alone, so designs need no order and no state.
    """
    n = len(variables)
    out, away = spark.range(count).withColumnRenamed("id", "design"), F.lit(0.0)
    for k, v in enumerate(variables):
        steps = int((v.high - v.low) / v.step + 1e-9)
        chosen = F.lit(v.low) + F.floor(seeded_uniform(seed, F.col("design") * n + k + 1) * (steps + 1)) * F.lit(v.step)
        out = out.withColumn(v.name, chosen)
        away = away + F.abs(F.col(v.name) - v.low) / ((v.high - v.low) or 1.0)
    return out.withColumn("distance", away)


def feasibility(rules: dict[str, Column]) -> Column:
    """Names of the rules that a design breaks; a measure that is missing breaks none."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())


def best_designs(evaluated: DataFrame, objectives: Sequence[str], reasons: str = "reasons", id_col: str = "design") -> DataFrame:
    """The undominated feasible designs, with the sum of their objectives scaled to the frontier, and the one of least sum.

    Objectives are to be small.  An objective that is the same on the whole frontier adds nothing.
    """
    front = undominated(evaluated.where(F.size(reasons) == 0), [], objectives)
    ends = front.agg(*(f(c).alias(f"_{n}_{c}") for c in objectives for n, f in (("lo", F.min), ("hi", F.max))))
    total = F.lit(0.0)
    for c in objectives:
        total = total + ratio(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
    scored = front.crossJoin(F.broadcast(ends)).withColumn("balance", total).drop(*ends.columns)  # ends is one row
    first = scored.agg(F.min(F.struct("balance", id_col)).alias("_first"))
    return scored.crossJoin(F.broadcast(first)).withColumn("recommended", F.col(id_col) == F.col(f"_first.{id_col}")).drop("_first")  # one row
