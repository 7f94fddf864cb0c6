"""Plan boundaries: segments of polygons, how much of them walls cover, shared stretches, hulls, and choices in order of rank."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, gap, overlap, ratio
from . import stats
from .graph import settled


def segments(polygons: DataFrame, keys: Sequence[str], points: str, straight: float = 0.02, shortest: float = 0.05) -> DataFrame:
    """(keys, axis, plane, lo, hi): sides of plan polygons (arrays of x, z structs) that run along an axis and occur an odd
    number of times to the centimetre, so that sides between adjoining polygons of a key cancel.  axis is the one along which a side runs."""
    ahead = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    sides = polygons.select(*keys, F.explode(F.zip_with(points, ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s"))
    a, b = "s.a", "s.b"
    upright = F.abs(F.col(f"{a}.x") - F.col(f"{b}.x")) <= straight
    level = F.abs(F.col(f"{a}.z") - F.col(f"{b}.z")) <= straight
    side = lambda axis, run, across: F.struct(F.lit(axis).alias("axis"), ((F.col(f"{a}.{across}") + F.col(f"{b}.{across}")) / 2).alias("plane"), F.least(f"{a}.{run}", f"{b}.{run}").alias("lo"), F.greatest(f"{a}.{run}", f"{b}.{run}").alias("hi"))
    rows = sides.select(*keys, F.when(upright, side("z", "z", "x")).when(level, side("x", "x", "z")).alias("g")).where("g is not null").select(*keys, "g.*").where(F.col("hi") - F.col("lo") >= shortest)
    marks = [F.floor(F.col(c) * 100 + 0.5).alias(f"_{c}") for c in ("plane", "lo", "hi")]
    marked = rows.select("*", *marks).groupBy(*keys, "axis", "_plane", "_lo", "_hi").agg(F.count("*").alias("_n"), *(F.min(c).alias(c) for c in ("plane", "lo", "hi")))
    return marked.where("_n % 2 = 1").select(*keys, "axis", "plane", "lo", "hi")


def coverage(sides: DataFrame, walls: DataFrame, keys: Sequence[str], group: Sequence[str], tolerance: float) -> DataFrame:
    """(group, perimeter, covered, coverage): the share of a group's sides that walls within ``tolerance`` of their plane cover.

    Both have keys, axis, plane, lo and hi; they meet in cells of the plane as wide as the tolerance, and what walls
    cover of a side is the union of their stretches.
    """
    cell = lambda c, d=0: F.floor(F.col(c) / tolerance).cast("long") + d
    s = sides.withColumn("side", F.struct("axis", "plane", "lo", "hi"))
    w = walls.select(*keys, "axis", F.col("plane").alias("wp"), F.col("lo").alias("wl"), F.col("hi").alias("wh"), F.explode(F.array(*(cell("plane", d) for d in (-1, 0, 1)))).alias("cell"))
    near = s.withColumn("cell", cell("plane")).join(w, [*keys, "axis", "cell"])
    near = near.where((F.abs(F.col("plane") - F.col("wp")) <= tolerance) & (F.least("hi", "wh") > F.greatest("lo", "wl")))
    parts = near.select(*group, "side", F.greatest("lo", "wl").alias("start"), F.least("hi", "wh").alias("end"))
    covered = stats.interval_union(parts, [*group, "side"], "start", "end").groupBy(*group).agg(F.sum("covered").alias("covered"))
    around = sides.groupBy(*group).agg(F.sum(F.col("hi") - F.col("lo")).alias("perimeter"))
    out = around.join(covered, list(group), "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    return out.withColumn("coverage", F.least(ratio("covered", "perimeter"), F.lit(1.0)))


def shared_boundaries(sides: DataFrame, keys: Sequence[str], room: str, tolerance: float, least: float = 0.2) -> DataFrame:
    """(keys, left, right, axis, plane, lo, hi, gap, overlap): for each two rooms of equal keys the longest stretch where
    their sides run within ``tolerance`` of each other; ties to the smaller gap, axis and place."""
    cell = F.floor(F.col("plane") / tolerance).cast("long")
    a = sides.withColumn("cell", cell).alias("a")
    b = sides.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "axis", "cell"]]
    apart, lo, hi = F.abs(F.col("a.plane") - F.col("b.plane")), F.greatest("a.lo", "b.lo"), F.least("a.hi", "b.hi")
    pairs = a.join(b, [*on, F.col(f"a.{room}") < F.col(f"b.{room}"), apart <= tolerance, hi - lo >= least])
    found = pairs.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col(f"a.{room}").alias("left"), F.col(f"b.{room}").alias("right"), F.struct((lo - hi).alias("minus"), apart.alias("gap"), F.col("a.axis").alias("axis"), ((F.col("a.plane") + F.col("b.plane")) / 2).alias("plane"), lo.alias("lo"), hi.alias("hi")).alias("s"))
    best = found.groupBy(*keys, "left", "right").agg(F.min("s").alias("s"))
    return best.select(*keys, "left", "right", "s.axis", "s.plane", "s.lo", "s.hi", "s.gap", (-F.col("s.minus")).alias("overlap"))


def _hull(x: np.ndarray, z: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the smallest; points on its sides are left out."""
    points = sorted(set(zip(x.tolist(), z.tolist(), strict=True)))
    if len(points) < 3:
        return points

    def chain(rows: list[tuple[float, float]]) -> list[tuple[float, float]]:
        kept: list[tuple[float, float]] = []
        for p in rows:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return chain(points) + chain(points[::-1])


def convex_hulls(points: DataFrame, keys: Sequence[str], x: str, z: str, salts: int = 32) -> DataFrame:
    """(keys, place, x, z): corners of each key's convex hull in order.

    A hull of hulls: each of ``salts`` shares of a key gives its own first, so that a key of any size meets in one
    group by its corners only.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys).schema)

    def corners(frame: pd.DataFrame) -> pd.DataFrame:
        found = _hull(frame["x"].to_numpy(np.float64), frame["z"].to_numpy(np.float64))
        out = pd.DataFrame({"place": np.arange(len(found), dtype=np.int32), "x": [p[0] for p in found], "z": [p[1] for p in found]})
        for k in reversed(keys):
            out.insert(0, k, frame[k].iloc[0])
        return out

    rows = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(z).cast("double").alias("z")).where("x is not null and z is not null")
    shared = rows.withColumn("_salt", F.pmod(F.xxhash64("x", "z"), F.lit(salts)))
    parts = shared.groupBy(*keys, "_salt").applyInPandas(corners, f"{schema}, place int, x double, z double")
    return parts.groupBy(*keys).applyInPandas(corners, f"{schema}, place int, x double, z double")


def kept_in_order(rows: DataFrame, pairs: DataFrame, id_col: str, rank: str) -> DataFrame:
    """Rows kept when they are taken by rank and each one like an earlier kept one is left out.

    pairs are (a, b) of like rows, in either order; ranks are distinct.  A row all of whose earlier like rows are
    left out is kept; all rows like a kept one and later are left out: round after round, until none is open.
    """
    r = rows.select(F.col(id_col).alias("id"), F.col(rank).alias("r"))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct()
    ranks = both.join(r.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(r.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
    later = settled(ranks.where("ra < rb").select(F.col("a").alias("first"), F.col("b").alias("then")))
    gone = lost_in_order(later)
    return rows if gone is None else rows.join(gone.withColumnRenamed("id", id_col), id_col, "left_anti")


def lost_in_order(later: DataFrame) -> DataFrame | None:
    """(id), each once: those left out, from the stored edges (first, then) between like rows; None if there are no edges."""
    gone, open_edges = None, later
    while not open_edges.isEmpty():
        heads = open_edges.select(F.col("first").alias("id")).distinct().join(open_edges.select(F.col("then").alias("id")).distinct(), "id", "left_anti")
        lost = settled(open_edges.join(heads, open_edges["first"] == heads["id"]).select(F.col("then").alias("id")).distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        # what is lost loses nothing any more; what is kept has done its part
        left = open_edges.join(lost, open_edges["then"] == lost["id"], "left_anti").join(lost, F.col("first") == lost["id"], "left_anti")
        open_edges = settled(left)
    return gone


def like_surfaces(faces: DataFrame, keys: Sequence[str], tolerance: float, cell: float = 4.0) -> DataFrame:
    """(a, b): flat faces of equal keys at one height that differ by at most 15 % in area and share 92 % of the smaller one's bounds."""
    mid = (F.col("y0") + F.col("y1")) / 2
    span = lambda a: F.sequence(F.floor(F.col(f"{a}0") / cell).cast("long"), F.floor(F.col(f"{a}1") / cell).cast("long"))
    placed = faces.withColumn("mid", mid).withColumn("cx", F.explode(span("x"))).withColumn("cz", F.explode(span("z")))
    a, b = placed.alias("a"), placed.alias("b")
    c = lambda s, n: F.col(f"{s}.{n}")
    plan = lambda s: (c(s, "x1") - c(s, "x0")) * (c(s, "z1") - c(s, "z0"))
    both = overlap(c("a", "x0"), c("a", "x1"), c("b", "x0"), c("b", "x1")) * overlap(c("a", "z0"), c("a", "z1"), c("b", "z0"), c("b", "z1"))
    near = (F.abs(c("a", "mid") - c("b", "mid")) <= tolerance) & (F.abs(c("a", "area") - c("b", "area")) / F.greatest(c("a", "area"), c("b", "area"), F.lit(0.001)) <= 0.15)
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "cx", "cz"]]
    alike = a.join(b, [*on, F.col("a.id") < F.col("b.id"), near, both / F.greatest(F.least(plan("a"), plan("b")), F.lit(0.001)) >= 0.92])
    return alike.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def opening_kind(name: Column, wall_distance: Column, wall_overlap: Column, floor_gap: Column, width: Column, height: Column, depth: Column, transparent: Column) -> Column:
    """Struct (kind, door, window): scores of an opening from its names, its place in a wall and its size."""
    t = F.trim(F.regexp_replace(F.lower(name), "[_-]+", " "))
    # fixed values: words and weights
    door_name, window_name = t.rlike(r"\b(p\d{4,}|pintu|door)\b"), t.rlike(r"\b(j\d{4,}|jendela|window)\b")
    frame, glass = t.rlike("kusen|frame|daun|leaf|panel"), t.rlike("kaca|glass|glaz") | (transparent >= 0.25)
    furniture = t.rlike("lemari|cabinet|furniture|furnitur|kitchen|wardrobe")
    in_wall = clamp(1 - wall_distance / 0.35, 0.0, 1.0) * clamp(wall_overlap / 0.6, 0.0, 1.0)
    door_size = width.between(0.55, 2.4) & height.between(1.75, 3.2) & (depth <= 0.6)
    window_size = width.between(0.3, 5.0) & height.between(0.3, 2.8) & (floor_gap >= 0.3)
    n = lambda c: c.cast("double")
    door = clamp(n(door_name) * 0.45 + in_wall * 0.2 + clamp(1 - floor_gap / 0.2, 0.0, 1.0) * 0.15 + n(door_size) * 0.15 + n(frame) * 0.05, 0.0, 1.0)
    window = clamp(n(window_name) * 0.4 + in_wall * 0.2 + n(floor_gap >= 0.3) * 0.12 + n(window_size) * 0.13 + n(glass) * 0.1 + n(frame) * 0.05, 0.0, 1.0)
    kind = F.when(furniture | (in_wall < 0.25), "rejected").when((door >= 0.72) & (door >= window + 0.08), "door").when((window >= 0.68) & (window >= door + 0.05), "window").otherwise("unresolved_opening")
    return F.struct(kind.alias("kind"), door.alias("door"), window.alias("window"))


def box_distance(a: str, b: str) -> Column:
    """Distance between two boxes, 0 if they meet."""
    d = [gap(F.col(f"{a}.{k}0"), F.col(f"{a}.{k}1"), F.col(f"{b}.{k}0"), F.col(f"{b}.{k}1")) for k in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def undominated(df: DataFrame, keys: Sequence[str], objectives: Sequence[str], block: int = 4096) -> DataFrame:
    """Rows that no other of their key beats: none worse and one better, small values being good, in any number of objectives.

    Each partition first drops what its own rows beat: a batch's distinct rows in order are held against its best ones so far, and
    up to ``block`` best ones of former batches go along for each of the first keys.  What is left of a key is dealt into blocks and every
    block is held against every other one, so no task holds more than two blocks and those best ones.
    """
    n_keys, names = len(keys), list(objectives)

    def beaten(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256, None, :]
            out[i : i + 256] = ((by[None] <= part).all(axis=2) & (by[None] < part).any(axis=2)).any(axis=1)
        return out

    def best_of(rows: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Which of the rows, distinct and in order, neither the known ones nor another row beats; only an earlier row beats a later one."""
        good = np.zeros(len(rows), bool)
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            left = np.flatnonzero(~beaten(part, known))
            left = left[~beaten(part[left], part[left])]
            good[i + left] = True
            known = np.concatenate([known, part[left]])
        return good

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[object, np.ndarray] = {}
        for f in frames:
            keep = np.ones(len(f), bool)
            for key, at in (f.groupby(list(keys), dropna=False).indices if n_keys else {0: np.arange(len(f))}).items():
                v, place = np.unique(f[names].to_numpy(np.float64)[at], axis=0, return_inverse=True)
                known = best.get(key, v[:0])
                good = best_of(v, known)
                keep[at] = good[place.reshape(-1)]
                if key in best or len(best) < 64:
                    best[key] = np.concatenate([known[~beaten(known, v[good])], v[good]])[:block]
            yield f[keep]

    few = settled(df.where(" and ".join(f"{c} is not null" for c in names)).mapInPandas(local, df.schema))
    count = few.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    count = count.withColumn("_k", F.lit(1)) if not n_keys else count
    placed = (few.crossJoin(F.broadcast(count)) if not n_keys else few.join(count, list(keys))).withColumn("_block", F.pmod(F.xxhash64(*names), F.col("_blocks")).cast("int"))
    placed = settled(placed.withColumn("_id", F.monotonically_increasing_id()))
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    rows = placed.select(*keys, "_id", *names, F.col("_block").alias("_mine"), F.explode(every).alias("_other"))
    others = placed.select(*keys, *names, F.col("_block").alias("_other"), F.explode(every).alias("_mine"))
    on = [*keys, "_mine", "_other"]

    def across(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        lost = beaten(mine[names].to_numpy(np.float64), other[names].to_numpy(np.float64))
        return pd.DataFrame({"_id": mine["_id"][lost]})

    lost = rows.groupBy(*on).cogroup(others.groupBy(*on)).applyInPandas(across, "_id long").distinct()
    return placed.join(lost, "_id", "left_anti").select(*df.columns)
