"""Assemblies in deep trees, openings that repeat, rooms that are one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lathwork.operators import assemblies


def test_topmost_in_deep_trees(spark):
    rng = random.Random(1)
    n = 300
    parent = {i: (None if i % 100 == 0 else i - 1 if i % 100 < 60 else rng.randrange(i - i % 100, i)) for i in range(n)}
    flag = {i: rng.random() < 0.05 for i in range(n)}
    parent[7] = 9999  # no such node

    def top(i):
        path = []
        while i is not None and i in parent:
            path.append(i)
            i = parent[i]
        return next((x for x in reversed(path) if flag[x]), None)

    df = spark.createDataFrame([(i, parent[i], flag[i]) for i in range(n)], "node int, parent int, flag boolean").repartition(3)
    assert {r.node: r.top for r in assemblies.topmost(df, "node", "parent", "flag").collect()} == {i: top(i) for i in range(n)}
    loop = spark.createDataFrame([(1, 2, True), (2, 1, False)], "node int, parent int, flag boolean")
    with pytest.raises(ValueError):
        assemblies.topmost(loop, "node", "parent", "flag", 6)


def test_assemblies_and_their_parts(spark):
    rows = [(1, None, "Group", "g"), (2, 1, "Pintu_utama", "own"), (3, 2, "Kusen kayu", "a"), (4, 2, "daun", "b"), (5, 4, "kaca", "c"), (6, 5, "jendela kecil", None), (7, 6, "handle", "d"), (8, 1, "P12", "x"), (9, 1, "J1200", None), (10, 9, None, "e"), (11, 4, "glass", "c")]
    got = {r.node: r for r in assemblies.opening_assemblies(spark.createDataFrame(rows, "node int, parent int, name string, mesh string")).collect()}
    a = got[2]
    assert (a.name, a.n_nodes, a.meshes, a.leaf, a.frame, a.glass, a.trim) == ("Pintu_utama", 7, ["a", "b", "c", "d"], ["b"], ["a"], ["c"], ["d"])
    assert set(got) == {2, 9} and (got[9].n_nodes, got[9].meshes, got[9].leaf) == (2, ["e"], [])


def test_openings_that_repeat_like_one_pass(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        x, y, z, w = rng.randrange(4) * 0.1, rng.choice([0.0, 0.05, 0.2]), rng.randrange(3) * 0.015, 1 + rng.randrange(3) * 0.06
        rows.append((i % 2, f"o{i:03d}", rng.choice(["door", "window"]), float(rng.randrange(2)), float(rng.randrange(5)), x, x + w, y, y + 2.0, z, z + 0.1))
    size = lambda r, k: r[6 + 2 * k] - r[5 + 2 * k]

    def like(a, b):
        shared = [max(0.0, min(a[6 + 2 * k], b[6 + 2 * k]) - max(a[5 + 2 * k], b[5 + 2 * k])) for k in (0, 2)]
        small = max(min(size(a, 0) * size(a, 2), size(b, 0) * size(b, 2)), 0.001)
        away = math.sqrt(sum(((a[5 + 2 * k] + a[6 + 2 * k]) / 2 - (b[5 + 2 * k] + b[6 + 2 * k]) / 2) ** 2 for k in range(3)))
        return a[0] == b[0] and a[2] == b[2] and shared[0] * shared[1] / small >= 0.8 and away <= 0.12 and max(abs(size(a, k) - size(b, k)) for k in range(3)) <= 0.12

    kept, want = [], {}
    for r in sorted(rows, key=lambda r: (-r[3], -r[4], r[1])):
        want[r[1]] = next((k[1] for k in kept if like(k, r)), None)
        if want[r[1]] is None:
            kept.append(r)
    df = spark.createDataFrame(rows, "model int, id string, kind string, name_score double, area double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double").repartition(4)
    assert {r.id: r.of for r in assemblies.distinct_openings(df).collect()} == want and any(want.values())


def test_rooms_that_are_one(spark):
    room = lambda i, x0, x1, z0, z1, g="g", f=0.0, h=3.0, w=1, e=False: (g, i, f, h, float((x1 - x0) * (z1 - z0)), 0.5 + i / 100, w, e, float(x0), float(x1), float(z0), float(z1))
    rows = [room(1, 0, 2, 0, 2), room(2, 2.05, 4, 0, 2, h=3.3), room(3, 4, 6, 1.9, 4), room(4, 0, 2, 2, 4, f=0.2), room(5, 2, 4, 2, 4, e=True), room(6, 0, 2, 2, 4, g="k"), room(7, 8, 9, 0, 1, w=0), room(8, 10, 11, 0, 1), room(9, 11, 12, 0, 1)]
    fields = "group string, id int, floor double, height double, area double, coverage double, walls int, evaluated boolean, x0 double, x1 double, z0 double, z1 double"
    df = spark.createDataFrame(rows, fields)
    got = {r.room: r for r in assemblies.merged_rooms(df).collect()}
    assert {k: r.members for k, r in got.items()} == {1: [1, 2], 3: [3], 4: [4], 5: [5], 6: [6], 7: [7], 8: [8, 9]}
    a = got[1]
    assert a.height == pytest.approx((4 * 3 + 3.9 * 3.3) / 7.9) and a.volume == pytest.approx(4 * 3 + 3.9 * 3.3, abs=1e-5) and a.coverage == 0.51 and (a.walls, a.state, got[7].state) == (2, "valid", "incomplete boundary")
    said = spark.createDataFrame([(5, 1, 0.1, 0.5, 0), (8, 9, 0.0, 1.0, 1), (7, 9, 0.5, 1.0, 0)], "a int, b int, gap double, overlap double, walls int")
    assert {r.room: r.members for r in assemblies.merged_rooms(df.orderBy(F.desc("id")), said).collect()} == {1: [1, 2, 5], 3: [3], 4: [4], 6: [6], 7: [7], 8: [8], 9: [9]}
