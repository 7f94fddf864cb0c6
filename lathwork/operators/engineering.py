"""Engineering estimates per row or group: light, cooling, facade heat transfer, comfort, ventilation, crowds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import _c, clamp, half_up, ratio, solar_factor, sun_exposure, turn_between

#: fixed values: watts to BTU per hour, and BTU per hour of one PK
BTU_PER_WATT, BTU_PER_PK = 3.412142, 9000.0


def lamps(area: Column | str, lux: Column | str | float, lumens: Column | str | float, utilisation: float = 0.6, maintenance: float = 0.8) -> Column:
    """Whole lamps by the lumen method; none for no area."""
    return F.ceil(ratio(_c(area) * _c(lux) / (utilisation * maintenance), _c(lumens))).cast("long")


def lamp_grid(count: Column | str, width: Column | str, depth: Column | str) -> Column:
    """Rows and columns for the count in the room's proportions."""
    columns = F.greatest(F.lit(1), F.ceil(F.sqrt(_c(count) * ratio(width, depth)))).cast("long")
    return F.struct(F.ceil(_c(count) / columns).cast("long").alias("rows"), columns.alias("columns"))


def cooling_watts(area: Column | str, people: Column | str, watts_per_m2: float = 150.0, watts_per_person: float = 120.0, margin: float = 0.1) -> Column:
    return (_c(area) * watts_per_m2 + _c(people) * watts_per_person) * (1 + margin)


def to_btu(watts: Column | str) -> Column:
    return _c(watts) * BTU_PER_WATT


def to_pk(watts: Column | str) -> Column:
    return to_btu(watts) / BTU_PER_PK


def facade_transfer(walls: DataFrame, glazing: DataFrame, direction: str, area: str, warmer: float, u_wall: str, absorption: str, u_glass: str, shading: str, td_eq: float = 15.0, least_area: float = 0.1) -> DataFrame:
    """Overall transfer of heat by facade direction and for the building (direction null), in W/m2 to one place.

    Both tables have ``direction`` and ``area``; walls, whose area includes their windows, have a U-value and an
    absorption, glazing a U-value and a shading coefficient.  With WWR the share of glass in the gross wall:
    absorption U (1 - WWR) td_eq + U_glass WWR max(0, warmer) + shading WWR solar factor, properties weighted by area.
    Directions of less than ``least_area`` are left out; the building is the mean of its facades by their area.
    """
    w = walls.groupBy(direction).agg(F.sum(area).alias("_gross"), *(F.sum(F.col(area) * F.col(c)).alias(n) for c, n in ((u_wall, "_wu"), (absorption, "_wa"))))
    g = glazing.groupBy(direction).agg(F.sum(area).alias("_glass"), *(F.sum(F.col(area) * F.col(c)).alias(n) for c, n in ((u_glass, "_gu"), (shading, "_gs"))))
    f = w.join(g, direction, "full_outer").fillna(0.0, ["_gross", "_glass", "_wu", "_wa", "_gu", "_gs"])
    wwr = F.when(F.col("_gross") > 0, clamp(F.col("_glass") / F.col("_gross"), 0.0, 1.0)).otherwise((F.col("_glass") > 0).cast("double"))
    f = f.withColumn("facade_area", F.greatest(F.col("_gross"), F.col("_glass"))).where(F.col("facade_area") >= least_area).withColumn("wwr", wwr)
    wall = ratio("_wa", "_gross") * ratio("_wu", "_gross") * (1 - F.col("wwr")) * td_eq
    glass = ratio("_gu", "_glass") * F.col("wwr") * max(0.0, warmer)
    sun = ratio("_gs", "_glass") * F.col("wwr") * solar_factor(direction)
    f = f.select(direction, "facade_area", "_glass", "wwr", half_up(wall, 1).alias("conduction_wall"), half_up(glass, 1).alias("conduction_glass"), half_up(sun, 1).alias("radiation"), half_up(wall + glass + sun, 1).alias("ottv"))
    whole = f.groupBy().agg(F.sum("facade_area").alias("_area"), F.sum("_glass").alias("_glass"), F.sum(F.col("ottv") * F.col("facade_area")).alias("_sum")).where("_area is not null")
    none = F.lit(None).cast("double")
    building = whole.select(F.lit(None).cast("string").alias(direction), F.col("_area").alias("facade_area"), half_up(ratio("_glass", "_area"), 3).alias("wwr"), none.alias("conduction_wall"), none.alias("conduction_glass"), none.alias("radiation"), half_up(ratio("_sum", "_area"), 1).alias("ottv"))
    return f.drop("_glass").unionByName(building)


def area_weighted(df: DataFrame, keys: list[str], value: str, area: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(ratio(F.sum(F.col(value) * F.col(area)), F.sum(area)).alias(name), F.sum(area).alias("area"))


def pmv(air: Column | str, radiant: Column | str | None = None, humidity: Column | str | float = 50.0, speed: Column | str | float = 0.1, clothing: Column | str | float = 0.5, activity: Column | str | float = 1.1) -> Column:
    """A linear estimate of the predicted mean vote, within -3 and 3: 0.35 for each kelvin that the operative
    temperature lies above the neutral one, and 0.015 for each percent of humidity above 50."""
    operative = _c(air) if radiant is None else (_c(air) + _c(radiant)) / 2
    neutral = 24 - 3 * (_c(activity) - 1.2) - 4 * (_c(clothing) - 0.6) + 1.5 * (_c(speed) - 0.15)
    return clamp(0.35 * (operative - neutral) + 0.015 * (_c(humidity) - 50), -3.0, 3.0)


def vote_status(vote: Column | str) -> Column:
    v = half_up(vote, 2)
    return F.when(v > 0.5, "warm").when(v < -0.5, "cool").otherwise("comfortable")


def ppd(vote: Column | str) -> Column:
    """Percentage dissatisfied from a mean vote, 5 to 100, one decimal."""
    p = _c(vote)
    return half_up(clamp(100 - 95 * F.exp(-0.03353 * p * p * p * p - 0.2179 * p * p), 5.0, 100.0), 1)


def adaptive_band(outdoor: Column | str) -> Column:
    """Comfort temperature for ventilated rooms and its band of 3.5 K to each side."""
    t = 17.8 + 0.31 * _c(outdoor)
    return F.struct((t - 3.5).alias("low"), t.alias("neutral"), (t + 3.5).alias("high"))


def comfort_method(eligible: Column | str, exterior_window: Column, conditioned: Column) -> Column:
    """adaptive, or mechanical: by what the use of the room allows, its windows and whether it is air-conditioned."""
    e = _c(eligible)
    return F.when((e == "adaptive") | ((e == "both") & exterior_window & ~conditioned), "adaptive").otherwise("mechanical")


def air_changes(flow_m3_s: Column | str, volume: Column | str) -> Column:
    """Air changes an hour to one place, of a volume of one cubic metre at least."""
    return half_up(_c(flow_m3_s) * 3600 / F.greatest(_c(volume), F.lit(1.0)), 1)


def wind_flow(area: Column | str, speed: Column | str | float) -> Column:
    """Flow through openings by wind."""
    return 0.6 * _c(area) * _c(speed)


def stack_flow(area: Column | str, height: Column | str, inside: Column | str | float, outside: Column | str | float) -> Column:
    """Flow by buoyancy, up or down."""
    return 0.65 * _c(area) * F.sqrt(2 * 9.81 * _c(height) * F.abs(_c(inside) - _c(outside)) / (_c(outside) + 273.15))


def ventilation(rooms: DataFrame, openings: DataFrame, room: str, volume: str, inside: float, outside: float, wind_speed: float, wind_from: float, least_area: float = 0.1, use: str | None = None) -> DataFrame:
    """Per room its kind of ventilation, effective opening area, flow (m3/s), air changes an hour and side of the wind.

    openings are exterior ones with room, area, direction (degrees), sill and head.  Some two of a room face more
    than 45 degrees apart just when the widest gap between directions next to each other leaves more than 45 of
    the circle: a window by direction, not the pairs.  With ``use``, a column of rooms, a staircase draws air up whatever
    its openings' rise.
    """
    o = openings.where(F.col("area") > least_area).select(room, "area", F.coalesce("direction", F.lit(0.0)).alias("direction"), "sill", "head")
    w = Window.partitionBy(room).orderBy("direction")
    away = turn_between("direction", F.lit(wind_from))
    o = o.withColumn("_gap", F.col("direction") - F.lag("direction").over(w)).withColumn("_away", away)
    per = o.groupBy(room).agg(F.count("*").alias("openings"), F.sum("area").alias("_all"), F.max("area").alias("_largest"), (F.max("head") - F.min("sill")).alias("_rise"), F.min("_away").alias("_away"), F.greatest(F.coalesce(F.max("_gap"), F.lit(0.0)), F.min("direction") + 360 - F.max("direction")).alias("_widest"))
    stairs = F.coalesce(F.col(use) == "staircase", F.lit(False)) if use else F.lit(False)
    out = rooms.select(room, F.col(volume).alias("_volume"), stairs.alias("_stairs")).join(per, room, "left")
    cross, many = F.col("_widest") < 315, F.col("openings") > 1
    out = out.withColumn("kind", F.when(F.col("openings").isNull(), "no_exterior_ventilation").when(cross, "cross_ventilation").when(((F.col("_rise") > 2.5) | F.col("_stairs")) & many, "stack_assisted").otherwise("single_sided"))
    rest = F.col("_all") - F.col("_largest")
    through = F.sqrt(F.lit(2.0)) * F.col("_largest") * rest / F.sqrt(F.col("_largest") * F.col("_largest") + rest * rest)
    out = out.withColumn("_a", F.coalesce(F.when(cross & many, through).otherwise(F.col("_all") / 2), F.lit(0.0)))
    flow = half_up(F.greatest(wind_flow("_a", wind_speed), stack_flow("_a", F.coalesce("_rise", F.lit(0.0)), inside, outside)), 2)
    side = F.when(F.col("_away") <= 45, "windward").when(F.col("_away") >= 135, "leeward").when(F.col("_away").isNotNull(), "parallel").otherwise("unknown")
    out = out.withColumn("flow", flow)
    return out.select(room, "kind", half_up("_a", 2).alias("effective_area"), "flow", air_changes("flow", "_volume").alias("air_changes"), side.alias("wind_side"))


#: fixed values: by room function lux, work plane (m), m2 a person, sensible and latent W a person, equipment and
#: lighting W/m2, metabolic rate, clothing, air changes expected an hour, method of comfort
USE_PROFILES = {
    "living": (150, 0.75, 5.0, 70, 45, 8.0, 6.0, 1.1, 0.5, 2.0, "both"),
    "bedroom": (100, 0.75, 10.0, 60, 40, 4.0, 5.0, 0.8, 0.8, 1.5, "both"),
    "bathroom": (200, 0.85, 4.0, 65, 60, 2.0, 8.0, 1.2, 0.3, 6.0, "mechanical"),
    "kitchen": (300, 0.90, 6.0, 85, 75, 35.0, 10.0, 1.6, 0.5, 8.0, "both"),
    "dining": (200, 0.75, 3.0, 75, 55, 5.0, 7.0, 1.2, 0.5, 3.0, "both"),
    "office": (500, 0.75, 8.0, 75, 55, 15.0, 9.0, 1.1, 0.6, 4.0, "both"),
    "corridor": (100, 0.0, 15.0, 80, 60, 1.0, 4.0, 1.4, 0.5, 1.0, "both"),
    "balcony": (100, 0.0, 5.0, 70, 50, 0.0, 3.0, 1.2, 0.5, 15.0, "adaptive"),
    "staircase": (150, 0.0, 12.0, 100, 80, 1.0, 5.0, 2.0, 0.5, 2.0, "both"),
    "utility": (200, 0.85, 10.0, 80, 60, 25.0, 6.0, 1.4, 0.5, 5.0, "mechanical"),
    "storage": (100, 0.0, 25.0, 70, 50, 2.0, 4.0, 1.4, 0.5, 1.0, "both"),
    "garage": (100, 0.0, 20.0, 80, 60, 5.0, 3.0, 1.4, 0.5, 6.0, "adaptive"),
    "unassigned": (200, 0.75, 8.0, 70, 50, 8.0, 6.0, 1.2, 0.5, 2.0, "both"),
}
_PROFILE = "use string, lux int, work_plane double, area_per_person double, sensible int, latent int, equipment double, lighting double, met double, clo double, air_changes double, comfort string"


def use_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in USE_PROFILES.items()], _PROFILE)


def with_profile(rooms: DataFrame, use: str, prefix: str = "p_") -> DataFrame:
    """Rooms with the profile of their use; an unknown or null use gets that of unassigned rooms."""
    p = use_profiles(rooms.sparkSession)
    p = p.select(*(F.col(c).alias(prefix + c) for c in p.columns))
    known = F.when(F.col(use).isin(*USE_PROFILES), F.col(use)).otherwise("unassigned")
    return rooms.join(F.broadcast(p), known == F.col(prefix + "use")).drop(prefix + "use")  # thirteen rows


def illuminance(rooms: DataFrame, use: str, confidence: str, candidates: str) -> DataFrame:
    """Target lux and work plane of each room, and how well its use is known."""
    match = F.when(F.coalesce(F.col(use), F.lit("unassigned")) == "unassigned", "generic_default").when((F.col(confidence) < 0.6) | (F.col(candidates) > 1), "uncertain_fallback").otherwise("direct_match")
    return with_profile(rooms, use).withColumn("applicability", match)


#: fixed values: kelvin that sun on a surface of that role adds to the difference of the air
ROLE_EXTRA = {"exterior_wall": 6.0, "ceiling": 12.0, "roof": 12.0, "interior_wall": -3.0, "floor": -3.0}


def cooling_loads(rooms: DataFrame, surfaces: DataFrame, windows: DataFrame, room: str, warmer: float, use: str = "use", area: str = "area", people: str = "people", u_default: float = 2.8, u_glass: float = 5.8, shading: float = 0.81, solar: float = 0.7, humidity: float = 60.0, margin: float = 0.15, components: DataFrame | None = None) -> DataFrame:
    """Eight parts of each room's cooling load in W, sensible, latent and total, and the capacity to be put in.

    surfaces have room, role, area, u (null or 0: ``u_default``), windows room and area; rooms a use, a floor area and people.
    components (room, load in W, null for none, and count) add their loads to the equipment.
    """
    dt = max(0.0, warmer)
    extra = F.create_map(*(F.lit(x) for kv in ROLE_EXTRA.items() for x in kv))[F.col("role")]
    u = F.when(F.coalesce("u", F.lit(0.0)) != 0, F.col("u")).otherwise(u_default)
    walls = surfaces.groupBy(room).agg(F.sum(F.col("area") * u * F.greatest(F.coalesce(extra + dt, F.lit(0.0)), F.lit(0.0))).alias("envelope"))
    glass = windows.groupBy(room).agg(F.sum("area").alias("_glass"))
    r = rooms.join(walls, room, "left").join(glass, room, "left")
    if components is not None:
        r = r.join(components.groupBy(room).agg(F.sum(F.col("load") * F.col("count")).alias("_machines")), room, "left")
    else:
        r = r.withColumn("_machines", F.lit(0.0))
    r = with_profile(r.fillna(0.0, ["envelope", "_glass", "_machines"]), use)
    n = F.when(F.coalesce(people, F.lit(0)) != 0, F.col(people)).otherwise(1)
    fresh = n * 0.008 + F.col(area) * 0.0003
    parts = {
        "envelope": F.col("envelope"), "glazing": F.col("_glass") * u_glass * dt, "sun": F.col("_glass") * shading * solar * 350.0,
        "people_sensible": n * F.col("p_sensible"), "people_latent": n * F.col("p_latent"), "light": F.col(area) * F.col("p_lighting") * 1.2, "equipment": F.col(area) * F.col("p_equipment") + F.col("_machines"),
        "air_sensible": 1.2 * 1000 * fresh * dt, "air_latent": 1.2 * 2500 * fresh * (max(0.0, humidity - 50) * 0.00015),
    }
    r = r.select(room, *(v.alias("_" + k) for k, v in parts.items()))
    sensible = half_up(F.col("_envelope") + F.col("_glazing") + F.col("_sun") + F.col("_people_sensible") + F.col("_light") + F.col("_equipment") + F.col("_air_sensible"), 1)
    r = r.withColumn("sensible", sensible).withColumn("latent", half_up(F.col("_people_latent") + F.col("_air_latent"), 1)).withColumn("total", half_up(F.col("sensible") + F.col("latent"), 1))
    watts = half_up(F.col("total") * (1 + margin))
    whole = [half_up("_" + k).alias(k) for k in ("envelope", "glazing", "sun", "people_sensible", "people_latent", "light", "equipment")]
    r = r.withColumn("watts", watts).withColumn("btu", half_up(F.col("watts") * BTU_PER_WATT))
    return r.select(room, *whole, half_up(F.col("_air_sensible") + F.col("_air_latent")).alias("air"), "sensible", "latent", "total", "watts", half_up(F.col("watts") / 1000, 2).alias("kilowatts"), "btu", half_up(F.col("btu") / BTU_PER_PK, 1).alias("pk"))


#: fixed values: U-value and absorption, or U-value and solar gain, by material
WALL_MATERIALS = {"brick_plaster": (2.3, 0.55), "concrete": (3.1, 0.68)}
GLASS_MATERIALS = {"clear_glass": (5.8, 0.78), "tinted_glass": (5.6, 0.48)}
ROOF_MATERIALS = {"spandek_no_insulation": (4.8, 0.72), "spandek_insulated": (1.8, 0.48)}


def graded(x: Column, good: float, fair: float, high_is_good: bool = True) -> Column:
    """good, warn or bad."""
    if high_is_good:
        return F.when(x > good, "good").when(x > fair, "warn").otherwise("bad")
    return F.when(x <= good, "good").when(x <= fair, "warn").otherwise("bad")


def early_transfer(wall_area: Column | str, glass_percent: Column | str, degrees: Column | str, wall: str = "brick_plaster", glass: str = "clear_glass") -> Column:
    """A first estimate of the facade's transfer in W/m2 from wall area and percentage of glass alone."""
    (uw, aw), (ug, gain) = WALL_MATERIALS[wall], GLASS_MATERIALS[glass]
    pane = _c(wall_area) * _c(glass_percent) / 100
    opaque = F.greatest(_c(wall_area) - pane, F.lit(0.0))
    return (opaque * uw * aw * 12 + pane * ug * 5 + pane * gain * 194 * sun_exposure(degrees)) / F.greatest(_c(wall_area), F.lit(1.0))


def early_comfort(roof_area: Column | str, wall_area: Column | str, floor_area: Column | str, roof: str = "spandek_no_insulation", wall: str = "brick_plaster") -> Column:
    """0 to 100 from the envelope's gains over the floor."""
    (ur, ar), (uw, aw) = ROOF_MATERIALS[roof], WALL_MATERIALS[wall]
    gains = clamp((_c(roof_area) * ur * ar + _c(wall_area) * uw * aw) / F.greatest(_c(floor_area), F.lit(1.0)), 0.0, 100.0)
    return 100 - clamp(gains * 2.4, 0.0, 92.0)


def early_flow_of_people(doors: Column | str, people_capacity: Column, people: Column | str) -> Column:
    return clamp((_c(doors) * 18 + people_capacity * 3) / F.greatest(_c(people), F.lit(1)), 0.0, 100.0)


def early_wind(wind_degrees: Column | str, degrees: Column | str, openings: Column | str) -> Column:
    """0 to 100: how the facade lies to the wind, and how many openings there are."""
    along = F.abs(F.cos(F.radians(_c(wind_degrees) - _c(degrees))))
    return clamp((0.35 + 0.4 * along + 0.25 * clamp(_c(openings) / 8, 0.1, 1.0)) * 100, 0.0, 100.0)


def readiness(blockers: Column, defaults: Column, confidence: Column | str) -> Column:
    """Status blocked, estimate or ready, and a confidence that falls with what is missing or assumed."""
    status = F.when(blockers > 0, "blocked").when(defaults > 0, "estimate").otherwise("ready")
    return F.struct(status.alias("status"), clamp(_c(confidence) - blockers * 0.16 - defaults * 0.04, 0.15, 0.95).alias("confidence"))


def capacity(area: Column | str, density: Column | str | float) -> Column:
    """People: at least one."""
    return F.greatest(F.lit(1), F.floor(ratio(area, density))).cast("long")
