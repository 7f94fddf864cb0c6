from pyspark.sql import functions as F

from lathwork.functions import geometry
from lathwork.operators import graph, rooms


def square(x, z, w, s="s"):
    c = [(x, z), (x + w, z), (x + w, z + w), (x, z + w)]
    return [(s, *c[i], *c[(i + 1) % 4]) for i in range(4)]


def loops_of(spark, segments):
    df = spark.createDataFrame([(s, *(float(v) for v in c)) for s, *c in segments], "s string, ax double, az double, bx double, bz double")
    cycles = graph.settled(rooms.face_cycles(rooms.half_edges(rooms.barrier_edges(df, "s", ("ax", "az"), ("bx", "bz")))))
    return cycles, graph.settled(rooms.loops(cycles))


def test_loops_neighbours_and_holes(spark):
    two = square(0, 0, 4) + square(4, 0, 4)  # they share a wall, given twice
    yard = square(20, 0, 10) + square(23, 3, 2)  # one inside the other
    stray = [("s", 4, 4, 4, 9), ("other", 0, 0, 1, 1)]
    cycles, found = loops_of(spark, two + yard + stray)
    rows = {(r.storey, r.vertices[0].x, r.vertices[0].z): r for r in found.collect()}
    assert {k: (r.area, r.perimeter, r.n) for k, r in rows.items()} == {("s", 0, 0): (16, 16, 4), ("s", 4, 0): (16, 16, 4), ("s", 20, 0): (100, 40, 4), ("s", 23, 3): (4, 8, 4)}
    near = rooms.adjacency(cycles, found).collect()
    assert [(r.left.a.x, r.right.a.x, r.shared) for r in near] == [(0.0, 4.0, 4.0)]
    inside = rooms.holes(found).collect()
    assert [(r.inner.a.x, r.outer.a.x) for r in inside] == [(23.0, 20.0)]
    best = rooms.ranked(found).where("rank = 1").first()
    assert round(best.compactness, 4) == 0.7854 and best.flags == []


def test_points_and_crossings(spark):
    ring = lambda *ps: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z")) for x, z in ps))
    ell = ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))
    r = spark.range(1).select(*(geometry.contains(ell, F.lit(x), F.lit(z)).alias(n) for n, x, z in (("a", 0.5, 3.0), ("b", 3.0, 3.0), ("c", 3.0, 0.5), ("d", -1.0, 0.5))), geometry.crosses_itself(ell).alias("e"), geometry.crosses_itself(ring((0, 0), (2, 2), (2, 0), (0, 2))).alias("f")).first()
    assert tuple(r) == (True, False, True, False, False, True)


def test_opposite_walls(spark):
    rows = [("l", "x", 0.0, 0.0, 5.0, 1), ("r", "x", 0.2, 0.0, 5.0, -1), ("far", "x", 3.0, 0.0, 5.0, -1), ("part", "x", 0.3, 4.0, 9.0, -1), ("l2", "x", 0.1, 4.5, 9.0, 1), ("z", "z", 0.1, 0.0, 5.0, -1)]
    df = spark.createDataFrame(rows, "id string, axis string, at double, lo double, hi double, side int").withColumn("storey", F.lit(1))
    got = {(r.left, r.right, round(r.thickness, 3)) for r in rooms.opposite_walls(df, ["storey"]).collect()}
    assert got == {("l", "r", 0.2), ("l2", "part", 0.2)}
    assert rooms.opposite_walls(df.where("side > 0"), ["storey"]).count() == 0


def test_crossing_touching_and_overlapping_walls(spark):
    lines = square(0, 0, 4) + square(2, 2, 4) + [("s", 10, 0, 14, 0), ("s", 12, 0, 16, 0), ("s", 11, 0, 11, 3), ("s", 20, 20, 21, 21)]
    df = spark.createDataFrame([(s, *(float(v) for v in c)) for s, *c in lines], "s string, ax double, az double, bx double, bz double")
    edges = rooms.split_edges(rooms.barrier_edges(df, "s", ("ax", "az"), ("bx", "bz")))
    got = {((r.a.x, r.a.z), (r.b.x, r.b.z)) for r in edges.where("a.x >= 10 and a.x < 20").collect()}
    assert got == {((10, 0), (11, 0)), ((11, 0), (12, 0)), ((12, 0), (14, 0)), ((14, 0), (16, 0)), ((11, 0), (11, 3))}
    found = rooms.loops(rooms.face_cycles(rooms.half_edges(edges))).collect()
    assert sorted(r.area for r in found) == [4.0, 12.0, 12.0]
