"""Rooms from wall lines: the faces of a planar graph on each storey, their measures, ranks, holes and neighbours.

Everything is joins and windows.  A half-edge's successor around its face comes from a window over the edges at a
node in angular order; the faces are the cycles of that successor, found by pointer doubling in a number of
rounds that grows with the logarithm of the longest loop.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, numbers
from . import grid
from .graph import settled


def barrier_edges(segments: DataFrame, storey: str, start: tuple[str, str], end: tuple[str, str], step: float = 0.001) -> DataFrame:
    """(storey, a, b): distinct undirected edges between points snapped to ``step``; points are (x, z) structs, a < b."""
    point = lambda x, z: F.struct(numbers.quantized(x, step).alias("x"), numbers.quantized(z, step).alias("z"))
    p, q = point(*start), point(*end)
    out = segments.select(F.col(storey).alias("storey"), F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    return out.where("a <> b and a.x is not null and a.z is not null and b.x is not null and b.z is not null").distinct()


def half_edges(edges: DataFrame) -> DataFrame:
    """(storey, a, b, c, id, next): each edge in both directions with the node c after b around the face to its left.

    At b the successor is the edge before the twin (b to a) in counter-clockwise order, the last one for the first.
    ``id`` is a number for each row, next the successor's; those of twins differ in the last bit only.
    """
    numbered = settled(edges.select("storey", "a", "b", (F.monotonically_increasing_id() * 2).alias("id")))
    both = numbered.unionByName(numbered.select("storey", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("id") + 1).alias("id")))
    angle = F.atan2(F.col("b.z") - F.col("a.z"), F.col("b.x") - F.col("a.x"))
    around = Window.partitionBy("storey", "a").orderBy("angle", "b")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.lag(c).over(around), F.last(c).over(whole))
    turn = both.withColumn("angle", angle).withColumn("c", before("b")).withColumn("next", before("id"))
    # the row (b, a) says what follows a to b
    return turn.select("storey", F.col("b").alias("a"), F.col("a").alias("b"), "c", F.col("id").bitwiseXOR(F.lit(1)).alias("id"), "next")


def face_cycles(half: DataFrame, most_rounds: int = 32) -> DataFrame:
    """(storey, a, b, face, place, id): the face each half-edge bounds (its smallest half-edge) and its place from there on.

    Rounds double the reach: number and distance of the half-edge of the smallest number within 1, 2, 4 ... steps ahead.
    Only numbers move in them; the points come back once, and a face's smallest half-edge takes the place of its smallest number.
    """
    sides = settled(half.where("storey is not null").select("storey", "a", "b", "id", "next"))
    now = sides.select("id", "next", F.col("id").alias("least"), F.lit(0).cast("bigint").alias("ahead"))
    for k in range(most_rounds):
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("least").alias("l2"), F.col("ahead").alias("a2"))
        moved = F.col("l2") < F.col("least")
        closer = [F.when(moved, F.col("l2")).otherwise(F.col("least")).alias("least"), F.when(moved, F.col("a2") + 2**k).otherwise(F.col("ahead")).alias("ahead")]
        new = settled(now.join(ahead, "next").select("id", F.col("n2").alias("next"), *closer, moved.alias("moved")))
        if new.where("moved").isEmpty():
            break
        now = new.drop("moved")
    rows = sides.drop("next").join(now.select("id", "least", "ahead"), "id")
    around = Window.partitionBy("least")
    first = F.min(F.struct(F.struct("a", "b").alias("h"), "ahead")).over(around)
    rows = rows.withColumn("_first", first).withColumn("_n", F.count("*").over(around))
    return rows.select("storey", "a", "b", F.col("_first.h").alias("face"), F.pmod(F.col("_first.ahead") - F.col("ahead"), F.col("_n")).alias("place"), "id")


def loops(cycles: DataFrame, least_area: float = 1e-9) -> DataFrame:
    """(storey, face, n, vertices, area, perimeter) of inner faces: those that run counter-clockwise.

    The outer face of each component runs the other way and so falls out, as do lone lines, of no area.
    """
    ring = cycles.groupBy("storey", "face").agg(F.array_sort(F.collect_list(F.struct("place", "a"))).alias("r"))
    ring = ring.select("storey", "face", F.transform("r", lambda v: v["a"]).alias("vertices"))
    ring = ring.withColumn("signed", geometry.signed_area("vertices")).where(F.col("signed") > least_area)
    return ring.select("storey", "face", F.size("vertices").alias("n"), "vertices", F.col("signed").alias("area"), geometry.perimeter("vertices").alias("perimeter"))


def ranked(found: DataFrame, least_area: float = 0.25, longest: float = 25.0) -> DataFrame:
    """Loops with compactness, aspect, flags and a rank in their storey: sliver and too small ones come last."""
    b = geometry.bounds("vertices")
    w, d = b["max_x"] - b["min_x"], b["max_z"] - b["min_z"]
    out = found.withColumn("compactness", 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).withColumn("aspect", numbers.ratio(F.greatest(w, d), F.least(w, d)))
    flags = F.filter(F.array(F.when(F.col("area") < least_area, F.lit("small")), F.when(F.col("aspect") > longest, F.lit("sliver"))), lambda x: x.isNotNull())
    out = out.withColumn("flags", flags).withColumn("score", 100 * F.col("compactness") - 40 * F.size("flags"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("storey").orderBy(F.round("score", 9).desc(), "face")))


def adjacency(cycles: DataFrame, inner: DataFrame) -> DataFrame:
    """(storey, left, right, shared): pairs of inner faces and the length of wall between them.

    The twin of a half-edge bounds the room next door, so neighbours are one join, without comparing rooms in pairs.
    """
    keep = inner.select("storey", "face")
    c = cycles.join(keep, ["storey", "face"], "left_semi")
    length = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.z") - F.col("a.z"))
    twin = c.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("face").alias("other"))
    pairs = c.select("storey", "id", "face", length.alias("_length")).join(twin, "id").where("face < other")
    return pairs.groupBy("storey", F.col("face").alias("left"), F.col("other").alias("right")).agg(F.sum("_length").alias("shared"))


def holes(found: DataFrame) -> DataFrame:
    """(storey, inner, outer): loops that lie inside a larger one of their storey, by bounds first, then by all their corners.

    Bounds meet through cells of the larger one's size, and corners move only for pairs whose bounds are nested.
    """
    b = geometry.bounds("vertices")
    rows = settled(found.select("storey", "face", "vertices", "area", *(b[f"{e}_{k}"].alias(f"{k}{n}") for k in "xz" for e, n in (("min", 0), ("max", 1)))))
    ends = [f"{k}{e}" for k in "xz" for e in "01"]
    near = grid.touching(rows, ["storey"], "face", carry=["area", *ends])
    flip = F.col("a_area") > F.col("b_area")
    pick = lambda c, big: F.when(flip == big, F.col(f"a{c}")).otherwise(F.col(f"b{c}"))
    pairs = near.where("a_area <> b_area").select("storey", pick("", False).alias("inner"), pick("", True).alias("outer"), *(pick(f"_{c}", side).alias(f"{n}{c}") for c in ends for n, side in (("i", False), ("o", True))))
    pairs = pairs.where("ix0 >= ox0 and ix1 <= ox1 and iz0 >= oz0 and iz1 <= oz1").select("storey", "inner", "outer")
    inner, outer = (rows.select("storey", F.col("face").alias(n), F.col("vertices").alias(f"_{n}")) for n in ("inner", "outer"))
    inside = F.forall("_inner", lambda p: geometry.contains("_outer", p["x"], p["z"]))
    return pairs.join(inner, ["storey", "inner"]).join(outer, ["storey", "outer"]).where(inside).select("storey", "inner", "outer")


def candidate_pairs(walls: DataFrame, keys: Sequence[str], thick: tuple[float, float] = (0.05, 0.6), least_overlap: float = 0.45) -> DataFrame:
    """(keys, left, right, thickness, overlap): sides of opposite sign at a wall's thickness from each other that overlap.

    Columns: id, axis, at (place across), lo, hi (extent along), side (+1 or -1); joined by axis and cell of the greatest thickness.
    """
    width = thick[1]
    plus = walls.where("side > 0").withColumn("cell", F.floor(F.col("at") / width).cast("long"))
    minus = walls.where("side < 0").withColumn("cell", F.explode(F.array(*(F.floor(F.col("at") / width).cast("long") + d for d in (-1, 0, 1)))))
    a, b = plus.alias("a"), minus.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "axis", "cell"]]
    apart = F.abs(F.col("a.at") - F.col("b.at"))
    shared = numbers.overlap_ratio(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi"))
    pairs = a.join(b, [*on, apart.between(*thick)]).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id").alias("left"), F.col("b.id").alias("right"), apart.alias("thickness"), shared.alias("overlap"))
    return pairs.where(F.col("overlap") >= least_overlap)


def opposite_walls(walls: DataFrame, keys: Sequence[str], thick: tuple[float, float] = (0.05, 0.6), least_overlap: float = 0.45) -> DataFrame:
    """Wall sides that face each other: the pairs of :func:`candidate_pairs`, each side in one pair at most.

    A pair is taken if it is the best of both its sides, round after round until none is left.
    """
    open_pairs = settled(candidate_pairs(walls, keys, thick, least_overlap))
    taken = None
    while not open_pairs.isEmpty():
        best = [F.desc("overlap"), F.col("thickness"), F.col("left"), F.col("right")]
        mark = lambda side: F.row_number().over(Window.partitionBy(*keys, side).orderBy(*best)) == 1
        chosen = settled(open_pairs.withColumn("_l", mark("left")).withColumn("_r", mark("right")).where("_l and _r").drop("_l", "_r"))
        taken = chosen if taken is None else taken.unionByName(chosen)
        left, right = chosen.select(*keys, "left"), chosen.select(*keys, "right")
        open_pairs = settled(open_pairs.join(left, [*keys, "left"], "left_anti").join(right, [*keys, "right"], "left_anti"))
    return taken if taken is not None else open_pairs


def split_edges(edges: DataFrame, cell: float = 2.0, tolerance: float = 0.001) -> DataFrame:
    """The same lines cut wherever another one crosses, touches or runs along them: (storey, a, b), distinct.

    Edges meet in the cells of ``cell`` width that their bounds cover.  Cut points are proper crossings and the ends of
    other edges within ``tolerance``; lines that overlap are cut at each other's ends, and equal parts become one.
    """
    span = lambda k: F.sequence(*(F.floor(f(f"a.{k}", f"b.{k}") / cell).cast("long") for f in (F.least, F.greatest)))
    spread = edges.withColumn("cx", F.explode(span("x"))).withColumn("cz", F.explode(span("z")))
    e, f = spread.alias("e"), spread.alias("f")
    meet = F.expr("e.storey = f.storey and e.cx = f.cx and e.cz = f.cz and not (e.a = f.a and e.b = f.b)")
    pairs = e.join(f, meet).select("e.storey", "e.a", "e.b", F.col("f.a").alias("p"), F.col("f.b").alias("q")).distinct()
    minus = lambda u, v: {k: F.col(f"{u}.{k}") - F.col(f"{v}.{k}") for k in "xz"}
    cross = lambda u, v: u["x"] * v["z"] - u["z"] * v["x"]
    along, other, off = minus("b", "a"), minus("q", "p"), minus("p", "a")
    turn = cross(along, other)
    safe = F.when(F.abs(turn) > 1e-12, turn)
    t, u = cross(off, other) / safe, cross(off, along) / safe
    at = lambda s, point: F.struct(s.alias("s"), *(numbers.quantized(point[k], tolerance).alias(k) for k in "xz"))
    inner = lambda s: (s > 1e-9) & (s < 1 - 1e-9)
    cuts = [F.when(inner(t) & (u >= -1e-9) & (u <= 1 + 1e-9), at(t, {k: F.col(f"a.{k}") + t * along[k] for k in "xz"}))]
    square = along["x"] * along["x"] + along["z"] * along["z"]
    for end in ("p", "q"):
        d = minus(end, "a")
        s = (d["x"] * along["x"] + d["z"] * along["z"]) / square
        near = F.abs(cross(along, d)) / F.sqrt(square) <= tolerance
        cuts.append(F.when(inner(s) & near, at(s, {k: F.col(f"{end}.{k}") for k in "xz"})))
    found = pairs.select("storey", "a", "b", F.explode(F.filter(F.array(*cuts), lambda c: c.isNotNull())).alias("c")).groupBy("storey", "a", "b").agg(F.array_sort(F.collect_set("c")).alias("c"))
    ends = lambda name: F.array(F.struct(F.col(f"{name}.x").alias("x"), F.col(f"{name}.z").alias("z")))
    marks = edges.join(found, ["storey", "a", "b"], "left")
    middle = F.transform(F.coalesce("c", F.expr("cast(array() as array<struct<s:double,x:double,z:double>>)")), lambda c: F.struct(c["x"].alias("x"), c["z"].alias("z")))
    line = marks.select("storey", F.concat(ends("a"), middle, ends("b")).alias("v"))
    part = line.select("storey", F.explode(F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("u"), F.slice("v", 2, F.size("v") - 1).alias("w"))).alias("e"))
    return part.select("storey", F.least("e.u", "e.w").alias("a"), F.greatest("e.u", "e.w").alias("b")).where("a <> b").distinct()
