"""Scenarios: overrides over a base, comparisons with direction-aware status, objectives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import _c, half_up, ratio


def with_overrides(base: DataFrame, overrides: Column, names: Sequence[str]) -> DataFrame:
    """Columns replaced by the scenario's map where it has the key."""
    return base.withColumns({n: F.coalesce(F.element_at(overrides, F.lit(n)), F.col(n)) for n in names})


def change(base: Column | str, proposed: Column | str) -> Column:
    """The difference to three places, 0 under 0.00001 and where a side is null or not finite."""
    d = half_up(_c(proposed) - _c(base), 3)
    return F.when(F.abs(d) >= 1e-5, d).otherwise(0.0)


def percentage(base: Column | str, proposed: Column | str) -> Column:
    """The change in percent of the base's size to two places, 0 for a base of nothing."""
    size = F.abs(_c(base))
    return F.when(size > 1e-6, half_up(100 * change(base, proposed) / size, 2)).otherwise(0.0)


def delta_status(base: Column | str, proposed: Column | str, lower_is_better: bool) -> Column:
    """improved, degraded or unchanged; not_applicable where a side is null or not finite."""
    d = half_up(_c(proposed) - _c(base), 3)
    better = d < 0 if lower_is_better else d > 0
    return (
        F.when(d.isNull(), "not_applicable")
        .when(F.abs(d) < 1e-5, "unchanged")
        .when(better, "improved")
        .otherwise("degraded")
    )


def compare(base: DataFrame, proposed: DataFrame, keys: Sequence[str], metrics: dict[str, bool]) -> DataFrame:
    """Full outer by key: presence (both, missing_in_base, missing_in_proposed), and for each metric its two values,
    difference, percentage and status; True: lower is better."""
    b = base.select(*keys, *(F.col(m).alias(f"base_{m}") for m in metrics), F.lit(True).alias("_b"))
    p = proposed.select(*keys, *(F.col(m).alias(f"proposed_{m}") for m in metrics), F.lit(True).alias("_p"))
    out = b.join(p, list(keys), "full_outer")
    out = out.withColumn("presence", F.when(F.col("_b").isNull(), "missing_in_base").when(F.col("_p").isNull(), "missing_in_proposed").otherwise("both")).drop("_b", "_p")
    for m, lower in metrics.items():
        x, y = F.col(f"base_{m}"), F.col(f"proposed_{m}")
        out = out.withColumn(f"{m}_delta", change(x, y)).withColumn(f"{m}_pct", percentage(x, y)).withColumn(f"{m}_status", delta_status(x, y, lower))
    return out


def normalized_objective(df: DataFrame, objectives: dict[str, bool]) -> DataFrame:
    """Sum of min-max-normalized objectives (True: lower is better); the bounds are one aggregate, joined as one row."""
    ends = df.agg(*(f(c).alias(f"_{n}_{c}") for c in objectives for n, f in (("lo", F.min), ("hi", F.max))))
    total = F.lit(0.0)
    for c, lower in objectives.items():
        x = ratio(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
        total = total + (x if lower else 1 - x)
    return df.join(F.broadcast(ends)).withColumn("objective", total).drop(*ends.columns)


def recommended(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The row of the smallest objective in each key, ties to the smaller id."""
    w = Window.partitionBy(*keys).orderBy("objective", id_col)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: fixed values: the least and the greatest value of an override, and whether the least itself is allowed; null: no bound
OVERRIDE_LIMITS: dict[str, tuple[float | None, float | None, bool]] = {
    "indoorDesignTempC": (-50, 60, True),
    "outdoorDesignTempC": (-60, 60, True),
    "relativeHumidityPercent": (0, 100, True),
    "localWindSpeedMs": (0, 100, True),
    "localWindDirectionDeg": (None, None, True),
    "projectNorthDeg": (None, None, True),
    "coefficientOfUtilization": (0, 1, False),
    "lightLossFactor": (0, 1, False),
    "defaultLuminaireFluxLm": (0, None, False),
    "acSafetyMargin": (0, 2, True),
    "defaultWallUValue": (0, None, True),
    "defaultGlazingUValue": (0, None, True),
    "wwrOverride": (0, 1, True),
    "occupancyMultiplier": (0, None, True),
    "wallUValueMultiplier": (0, None, True),
    "glazingUValueMultiplier": (0, None, True),
    "shadingCoefficientMultiplier": (0, None, True),
    "solarFactorMultiplier": (0, None, True),
}


def override_issues(overrides: Column | str) -> Column:
    """Names, in order, of the overrides in a map that are not finite or out of their bounds; null values and names
    without bounds raise no issue."""
    m = _c(overrides)
    issues = []
    for name, (low, high, closed) in OVERRIDE_LIMITS.items():
        v = m[name]  # of a map made of columns Spark takes the column itself and makes no map
        bad = F.isnan(v) | (F.abs(v) == float("inf"))
        if low is not None:
            bad = bad | (v < low if closed else v <= low)
        if high is not None:
            bad = bad | (v > high)
        issues.append(F.when(v.isNotNull() & bad, F.lit(name)))
    return F.filter(F.array(*issues), lambda x: x.isNotNull())
