"""Number rules: rounding half up toward +inf, clamping, bins, safe division, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
#: fixed values: solar factor in W/m2 by orientation, and that of a roof
SOLAR_FACTORS = {"N": 130.0, "NE": 113.0, "E": 243.0, "SE": 176.0, "S": 130.0, "SW": 176.0, "W": 243.0, "NW": 113.0, "roof": 320.0}


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def half_up(x: Column | str, digits: int = 0) -> Column:
    """Round half toward +infinity (Spark's round goes away from zero); null and non-finite give null."""
    k = float(10**digits)
    v = _c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), F.floor(v * k + 0.5) / k + 0.0)


def quantized(x: Column | str, step: float = 0.001) -> Column:
    """The nearest multiple of ``step``, halves up, without a negative zero."""
    return F.floor(_c(x) / step + 0.5) * step + 0.0


def millimetres(x: Column | str) -> Column:
    """Text of the value in whole thousandths."""
    return F.floor(_c(x) * 1000 + 0.5).cast("bigint").cast("string")


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.when(_c(b) != 0, _c(a) / _c(b)).otherwise(F.lit(0.0))


def positive(x: Column | str) -> Column:
    """The value where it is finite and above 0, else 0."""
    v = _c(x).cast("double")
    return F.when((v > 0) & ~F.isnan(v) & (v != float("inf")), v).otherwise(F.lit(0.0))


def finite(x: Column | str, bound: float = 100_000.0) -> Column:
    """The number if it is one and within the bound, else null."""
    v = _c(x).try_cast("double") if hasattr(Column, "try_cast") else _c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) <= bound), v)


def azimuth(dx: Column | str, dz: Column | str) -> Column:
    """Azimuth of the outward normal of a plan segment, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(_c(dz), -_c(dx))), F.lit(360.0))


def compass(degrees: Column | str, north: float = 0.0) -> Column:
    """One of eight directions, each 45 degrees wide and centred."""
    k = F.floor(F.pmod(_c(degrees) - north + 22.5, F.lit(360.0)) / 45).cast("int")
    return F.element_at(F.array(*(F.lit(n) for n in COMPASS)), k + 1)


def solar_factor(direction: Column | str) -> Column:
    return F.create_map(*(F.lit(x) for kv in SOLAR_FACTORS.items() for x in kv))[_c(direction)]


def sun_exposure(degrees: Column | str) -> Column:
    """Between 0.72 for facades to the north and south and 1.14 for those to the east and west."""
    return 0.72 + 0.42 * F.abs(F.sin(F.radians(_c(degrees))))


def heading(degrees: Column | str) -> Column:
    """Unit vector (x, y, z) of a compass direction in plan."""
    turn = F.radians(_c(degrees))
    return F.struct(F.sin(turn).alias("x"), F.lit(0.0).alias("y"), F.cos(turn).alias("z"))


def turn_between(a: Column | str, b: Column | str) -> Column:
    """The smaller angle between two directions, 0 to 180."""
    d = F.abs(_c(a) - _c(b))
    return F.least(d, 360 - d)


def decimal_comma(x: Column | str, digits: int = 0) -> Column:
    """The number as text with points between thousands and a decimal comma."""
    return F.translate(F.format_number(half_up(x, digits), digits), ",.", ".,")


def wrapping_product(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers modulo 2**32, in two halves so that nothing overflows."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def seeded_uniform(seed: int, turn: Column) -> Column:
    """The turn-th number (from 1) in [0, 1) of the public-domain generator mulberry32, for any turn at once."""
    mask = F.lit(0xFFFFFFFF)
    # fixed values: the generator's step and its shifts
    s = (F.lit(seed) + turn * F.lit(0x6D2B79F5)).bitwiseAND(mask)
    t = wrapping_product(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + wrapping_product(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def cell_hash(x: Column | str, y: Column | str, z: Column | str, cell: float) -> Column:
    """An unsigned 32-bit hash of the cube of a grid that a point lies in; neighbouring cubes may share one."""
    # fixed values: a large prime an axis
    turn = lambda v, p: (F.floor(_c(v) / cell).cast("bigint") * F.lit(p)).bitwiseAND(F.lit(0xFFFFFFFF))
    return turn(x, 73856093).bitwiseXOR(turn(y, 19349663)).bitwiseXOR(turn(z, 83492791))


def overlap(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str) -> Column:
    """Length that two intervals share, 0 if apart."""
    return F.greatest(F.lit(0.0), F.least(_c(a1), _c(b1)) - F.greatest(_c(a0), _c(b0)))


def gap(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str) -> Column:
    """Distance between two intervals, 0 if they meet."""
    return F.greatest(F.lit(0.0), F.greatest(_c(a0), _c(b0)) - F.least(_c(a1), _c(b1)))


def overlap_ratio(a0: Column | str, a1: Column | str, b0: Column | str, b1: Column | str) -> Column:
    """Shared length over the shorter interval."""
    return ratio(overlap(a0, a1, b0, b1), F.least(_c(a1) - _c(a0), _c(b1) - _c(b0)))


def tolerance(scale: Column | str) -> Column:
    return clamp(_c(scale) * 0.004, 0.08, 0.45)
