"""Envelopes, closed rooms, surfaces, units and the use of rooms, on small shapes and against plain loops."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lathwork.operators import detection, envelopes, grid, semantics, surfaces

ASSIGNED = "assignment string, loop string, role string, status string, score double, elevation double, coverage double, approximate boolean, conflict boolean"


def made(spark, loops, sides):
    lp = spark.createDataFrame([(a, "s", s, float(x)) for a, s, x in loops], "loop string, storey string, status string, area double")
    rows = [(f"a{i}", lo, r, st, float(sc), float(el), 1.0, False, False) for i, (lo, r, st, sc, el) in enumerate(sides)]
    return {r.envelope: r for r in envelopes.vertical_envelopes(lp, spark.createDataFrame(rows, ASSIGNED)).collect()}


def test_envelopes_of_pairs_and_lone_sides(spark):
    low, up = "lower-support", "upper-cover"
    got = made(spark, [("p", "primary", 12), ("n", "noise", 9), ("o", "primary", 5), ("q", "secondary", 4)], [("p", low, "primary", 90, 0), ("p", up, "primary", 80, 3), ("p", up, "noise", 95, 2.5), ("o", low, "primary", 90, 2), ("o", up, "primary", 90, 1), ("q", up, "primary", 90, 3), ("n", low, "primary", 99, 0)])
    best = got["env:p|a0|a1"]
    assert (best.score, best.clear_height, best.volume, best.status, best.rank, best.plausible, best.multiple) == (85.0, 3.0, 36.0, "primary", 1, True, False)
    assert got["env:p|a0|a2"].status == "noise" and got["env:p|a0|a2"].score == pytest.approx(92.5 * 0.3)
    assert (got["env:o|a3|a4"].non_positive, got["env:o|a3|a4"].score, got["env:o|a3|a4"].status) == (True, 0.0, "noise")
    assert got["env:q|no-lower|a5"].missing_lower and not any(k.startswith("env:n") for k in got) and len(got) == 4


def test_profiles_and_refinement(spark):
    lp = spark.createDataFrame([("p", "s", "primary", 0.0, 14.0, False), ("bare", "s", "primary", None, 10.0, False), ("n", "s", "noise", 0.0, 1.0, False)], "loop string, storey string, status string, floor double, perimeter double, ambiguous boolean")
    walls = spark.createDataFrame([("w1", -0.2, 3.0, 5.0, 1.0), ("w2", 0.0, 3.1, 4.0, None), ("w3", 0.0, 9.0, 0.1, 1.0)], "evidence string, base double, top double, length double, quality double")
    refs = spark.createDataFrame([("p", "w1"), ("p", "w2"), ("p", "w3"), ("p", "lost"), ("n", "w1")], "loop string, evidence string")
    p = {r.loop: r for r in envelopes.extent_profiles(lp, refs, walls).collect()}
    assert (p["p"].referenced, p["p"].found, p["p"].used, p["p"].robust_base, p["p"].robust_top) == (4, 3, 3, 0.0, 3.0)
    assert p["p"].inconsistent_tops and not p["p"].inconsistent_bases and p["bare"].insufficient and "n" not in p
    loops = spark.createDataFrame([("p", "s", "primary", 12.0), ("bare", "s", "primary", 8.0)], "loop string, storey string, status string, area double")
    side = [("a", "p", "lower-support", 0.0), ("b", "p", "upper-cover", 3.0), ("c", "p", "upper-cover", 1.9), ("d", "bare", "lower-support", 0.0), ("e", "bare", "upper-cover", 3.0)]
    e = envelopes.vertical_envelopes(loops, spark.createDataFrame([(a, lo, r, "primary", 90.0, el, 1.0, False, False) for a, lo, r, el in side], ASSIGNED))
    r = {x.envelope: x for x in envelopes.refined_envelopes(e, envelopes.extent_profiles(lp, refs, walls)).collect()}
    assert (r["env:p|a|b"].score, r["env:p|a|b"].status, r["env:p|a|b"].eligible, r["env:p|a|b"].reasons) == (90.0, "primary", True, ["base-aligned", "top-aligned", "substantial-span-coverage"])
    short = r["env:p|a|c"]  # 1.1 from the walls' top of 3 with a tolerance of 0.3, and 1.9 / 3 of their height
    assert short.score == pytest.approx(90 * 0.85 - 0.8 * 30 - (0.8 - 1.9 / 3) * 60) and (short.moved, short.status) == ("demoted", "noise")  # under half of the best
    assert not r["env:bare|d|e"].eligible and r["env:bare|d|e"].ineligible == ["insufficient-evidence"] and r["env:bare|d|e"].moved == "demoted"
    c = {x.loop: x for x in envelopes.room_candidates(loops.withColumn("score", F.lit(70.0)).withColumn("perimeter", F.lit(14.0)), envelopes.refined_envelopes(e, envelopes.extent_profiles(lp, refs, walls))).collect()}
    assert (c["p"].outcome, c["p"].envelope, c["p"].alternatives, c["p"].score, c["p"].volume) == ("primary", "env:p|a|b", [], 80.0, 36.0) and c["bare"].outcome == "no_envelope"


def square(x, z, w, d):
    return [(float(x), float(z)), (float(x + w), float(z)), (float(x + w), float(z + d)), (float(x), float(z + d))]


def detect(spark, loops, envs=None, openings=(), diagonal=50.0):
    """loops: name to (storey, status, ring); a wall stands on every side."""
    lp = spark.createDataFrame([("m", k, s, st, [{"x": x, "z": z} for x, z in ring], 0) for k, (s, st, ring) in loops.items()], "model string, loop string, storey string, status string, ring array<struct<x:double,z:double>>, snapped int")
    envs = [(k, f"e-{k}") for k in loops] if envs is None else envs
    rows = [(lo, e[0] if isinstance(e, tuple) else e, 90.0, True, 0.0, 3.0, 0.0, 3.0, 3.0, False, e[1] if isinstance(e, tuple) else False) for lo, e in envs]
    ev = spark.createDataFrame(rows, "loop string, envelope string, score double, eligible boolean, robust_base double, robust_top double, lower double, upper double, clear_height double, missing_lower boolean, missing_upper boolean")
    ed = spark.createDataFrame([(k, *a, *b) for k, (_, _, ring) in loops.items() for a, b in zip(ring, ring[1:] + ring[:1])] or [("none", 0.0, 0.0, 0.0, 0.0)], "loop string, x0 double, z0 double, x1 double, z1 double")
    op = spark.createDataFrame([("m", n, *map(float, v)) for n, v in openings], "model string, opening string, x0 double, z0 double, x1 double, z1 double, width double")
    found = detection.detected_rooms(lp, ev, ed, op, diagonal)
    return {r.loop: r for r in found.collect()}, found


def test_closed_rooms(spark):
    loops = {
        "a": ("s1", "primary", square(0, 0, 5, 5)), "b": ("s1", "primary", square(5, 0, 5, 5)[::-1]), "c": ("s1", "noise", square(20, 0, 5, 5)), "d": ("s1", "primary", [(30.0, 0.0), (35.0, 0.0)]), "e": ("s1", "primary", square(40, 0, 5, 0.04)),
        "f": ("s2", "primary", square(0, 0, 5, 5)), "g": ("s1", "primary", square(60, 0, 4, 4)), "h": ("s1", "primary", [(80.0, 0.0), (86.0, 0.0), (86.0, 3.0), (83.0, 3.0), (83.0, 6.0), (80.0, 6.0)]),
    }
    got, found = detect(spark, loops, [(k, (f"e-{k}", k == "h")) for k in loops if k != "g"], [("door", (10, 2, 10, 3, 1))])
    assert {k: r.outcome for k, r in got.items()} == {"a": "valid", "b": "valid", "d": "no_polygon", "e": "sliver", "f": "valid", "g": "no_envelope", "h": "ambiguous"}
    a = got["a"]
    assert (a.area, a.perimeter, a.floor, a.ceiling, a.height, a.volume, a.cx, a.cy, a.cz, a.confidence, a.level, a.bridges) == (25.0, 20.0, 0.0, 3.0, 3.0, 75.0, 2.5, 1.5, 2.5, 1.0, "high", 0)
    assert got["b"].bridges == 1 and got["b"].confidence == pytest.approx(0.95) and got["b"].direct == pytest.approx(0.8) and got["b"].notes == ["opening_bridge_used"]
    assert got["a"].room != got["f"].room and got["h"].area == 27.0 and got["h"].notes == ["missing_ceiling"]
    c = detection.detection_counts(found).first()
    assert (c.loops, c.closed, c.accepted, c.ambiguous, c.rejected, c.slivers, c.holes, c.bridges, c.duplicates, c.copies) == (7, 5, 3, 1, 1, 1, 0, 1, 0, 0)


def test_holes_copies_and_duplicates(spark):
    loops = {
        "big": ("s", "primary", square(0, 0, 20, 20)), "core": ("s", "primary", square(8, 8, 4, 4)), "room": ("s", "primary", square(1, 1, 4, 4)), "wide": ("s", "primary", square(2, 2, 19.5, 19.5)),
        "far": ("s", "primary", square(100, 0, 6, 6)), "far2": ("s", "primary", square(100, 0, 6, 6)), "far3": ("s", "primary", square(100.1, 0, 6, 6)), "far4": ("t", "primary", square(100.1, 0, 6, 6)),
    }
    got, _ = detect(spark, loops, [(k, "shaft" if k in ("big", "core") else f"e-{k}") for k in loops])
    assert got["core"].outcome == "hole" and got["core"].other == "big" and (got["big"].area, got["big"].holes) == (384.0, 1) and got["big"].notes == ["hole_subtracted"]
    assert got["room"].outcome == "valid"  # it has an envelope of its own
    assert (got["far2"].outcome, got["far2"].other) == ("copy", "far") and got["far4"].outcome == "valid"
    assert {got["far"].outcome, got["far3"].outcome} == {"duplicate", "valid"} and got["far3"].outcome == "valid"  # of equals the later stays
    assert {got["big"].outcome, got["wide"].outcome} == {"valid"}  # centres 1.75 apart, a tenth of the size is 1.96, but areas differ by the hole and stay over 0.9


def brute_fold(rows):
    """The leaders' passes over all rooms of all storeys in order."""
    used, out = set(), []

    def alike(a, b):
        d, size = math.hypot(a["cx"] - b["cx"], a["cz"] - b["cz"]), math.sqrt((a["net"] + b["net"]) / 2)
        share = min(a["net"], b["net"]) / max(a["net"], b["net"])
        return a["storey"] == b["storey"] and d <= size * 0.5 and share >= 0.5 and (a["envelope"] == b["envelope"] or (share > 0.9 and d < size * 0.1))

    for lead in rows:
        if lead["room"] in used:
            continue
        best = lead
        for o in rows:
            if o["room"] == lead["room"] or o["room"] in used or not alike(best, o):
                continue
            used.add(o["room"])
            best = best if (best["confidence"], best["direct"]) > (o["confidence"], o["direct"]) else o
        used.add(best["room"])
        out.append(best["loop"])
    return set(out)


def test_same_places_like_one_pass_over_all(spark):
    rng = random.Random(4)
    rows = [{"loop": i, "room": f"r{i}", "storey": rng.choice("ab"), "envelope": rng.choice(["x", "y", f"e{i}"]), "net": rng.choice([4.0, 6.0, 9.0, 40.0]), "cx": round(rng.uniform(0, 12), 1), "cz": round(rng.uniform(0, 12), 1), "confidence": rng.choice([0.5, 0.8, 1.0]), "direct": rng.choice([0.5, 1.0])} for i in range(120)]
    df = spark.createDataFrame(rows, "loop long, room string, storey string, envelope string, net double, cx double, cz double, confidence double, direct double").repartition(3)
    lost = {r.loop for r in detection.same_places(df).collect()}
    assert {r["loop"] for r in rows} - lost == brute_fold(rows) and lost


def test_touching_boxes_of_all_sizes(spark):
    rng = random.Random(6)
    boxes = []
    for i in range(160):
        s = 10 ** rng.uniform(-3, 2)
        p = [rng.uniform(-30, 30) for _ in range(3)]
        boxes.append((i, rng.randrange(2), *(v for k in range(3) for v in (p[k], p[k] + s * rng.random()))))
    boxes += [(1000, 0, *([0.0, 0.0] * 3)), (1001, 0, *([0.0, 0.0] * 3)), (1002, 0, 0.0, 0.5, 0.0, 0.5, 0.5, 1.0), (1003, 0, None, *([0.0] * 5)), (None, 0, *([0.0] * 6)), (1004, 0, -0.2, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(boxes, "id int, k int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    for tol in (0.0, 0.3):
        want = {(a[0], b[0]) for a, b in itertools.combinations(sorted((b for b in boxes if b[0] is not None and b[2] is not None)), 2) if a[1] == b[1] and all(a[2 + 2 * k] - b[3 + 2 * k] <= tol and b[2 + 2 * k] - a[3 + 2 * k] <= tol for k in range(3))}
        got = [(r.a, r.b) for r in grid.touching(df, ["k"], "id", "xyz", tol).collect()]
        assert sorted(got) == sorted(want)
    points = spark.createDataFrame([(i, i % 2, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(80)] + [(900, 0, 0.0, 0.0)], "p int, k int, x double, z double")
    inside = {(b[0], p.p) for b in boxes if b[0] is not None and b[2] is not None for p in points.collect() if p.k == b[1] and b[2] <= p.x <= b[3] and b[6] <= p.z <= b[7]}
    assert sorted((r.box, r.point) for r in grid.covering(df.where("id is not null"), points, ["k"], "id", "p").collect()) == sorted(inside)
    assert grid.touching(df.limit(0), ["k"], "id").count() == 0


def faces(spark, rows):
    """rows: (object, face, material, points, normal)."""
    p = lambda v: {"x": float(v[0]), "y": float(v[1]), "z": float(v[2])}
    return spark.createDataFrame([(o, f, m, None if pts is None else [p(v) for v in pts], p(n), 1.0) for o, f, m, pts, n in rows], "object int, face int, material int, points array<struct<x:double,y:double,z:double>>, normal struct<x:double,y:double,z:double>, area double")


def test_surfaces_by_loops(spark):
    rng = random.Random(2)
    rows = []
    for f in range(150):
        i, j, wall, bend = rng.randrange(5), rng.randrange(5), rng.random() < 0.2, rng.random() < 0.15
        off = rng.choice([0.0, 0.0, 0.0004, 0.0015])  # on the edge of the tolerances
        y = 0.05 if bend else 0.0
        pts = [(i, off, j), (i, off, j + 1), (i, 2.0, j + 1), (i, 2.0, j)] if wall else [(i, off, j), (i, off, j + 1), (i + 1, y + off, j + 1), (i + 1, y + off, j)]
        n = (-1, 0, 0) if wall else (-y / math.hypot(1, y), 1 / math.hypot(1, y), 0)
        rows.append((f % 2, f, rng.choice([0, 0, 1]), pts, n))
    rows += [(0, 900, 0, [], (0, 1, 0)), (0, 901, 0, None, (0, 1, 0))]
    cell = lambda p: tuple(math.floor(v / 0.002 + 0.5) for v in p)
    near = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q)) <= 1e-6
    edges = {r[1]: list(zip(r[3], r[3][1:] + r[3][:1])) if r[3] else [] for r in rows}

    def shared(a, b):
        return any({cell(p), cell(q)} == {cell(r), cell(s)} and ((near(p, r) and near(q, s)) or (near(p, s) and near(q, r))) for p, q in edges[a] for r, s in edges[b])

    def groups(like):
        at = {r[1]: r[1] for r in rows}
        while True:
            was = dict(at)
            for a, b in like:
                at[a] = at[b] = min(at[a], at[b])
            if at == was:
                return at

    one = [(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and shared(a[1], b[1])]
    by = {r[1]: r for r in rows}
    flat = lambda a, b: max(abs(sum((p[k] - by[a][3][0][k]) * by[a][4][k] for k in range(3))) for p in by[b][3]) <= 0.002
    two = [(a, b) for a, b in one if by[a][2] == by[b][2] and sum(x * y for x, y in zip(by[a][4], by[b][4])) >= math.cos(math.radians(8)) and flat(a, b)]
    df = faces(spark, rows)
    assert {r.face: r.component for r in surfaces.connected_faces(df).collect()} == groups(one)
    got = surfaces.surface_clusters(df)
    assert {r.face: r.cluster for r in got.collect()} == groups(two)
    assert {r.face: r.cluster for r in surfaces.surface_clusters(df.repartition(7)).collect()} == groups(two)
    rec = {r.cluster: r for r in surfaces.cluster_records(df.where("size(points) > 0"), got).collect()}
    assert sum(r.n_faces for r in rec.values()) == 150 and max(r.plane_error for r in rec.values()) < 0.01


def test_a_thousand_faces_on_one_edge(spark):
    rows = [(1, f, 0, [(0, 0, 0), (0, 0, 1), (math.cos(f / 300), math.sin(f / 300), 0.5)], (-math.sin(f / 300), math.cos(f / 300), 0)) for f in range(1000)]
    df = faces(spark, rows)
    assert {r.component for r in surfaces.connected_faces(df).collect()} == {0}
    assert surfaces.surface_pairs(df).count() < 1000  # neighbours in angle only, of half a million pairs


def test_units_join_like_surfaces_and_say_why_not(spark):
    flat = lambda f, x, y, z, m=0, w=0.2: (1, f, m, [(x, y, z), (x, y, z + 0.2), (x + w, y, z + 0.2), (x + w, y, z)], (0, 1, 0))
    # 3 mm apart: one unit; of another material; 5 mm above; too far; a wall
    rows = [flat(1, 0, 0, 0), flat(2, 0.203, 0, 0), flat(3, 0.403, 0, 0, 1), flat(4, 0, 0.005, 0), flat(5, 9, 0, 9), (1, 6, 0, [(0, 0, 0), (0, 0, 0.2), (0, 1, 0.2), (0, 1, 0)], (-1, 0, 0)), (2, 7, 0, [(0, 0, 0), (0, 0, 1), (1, 0, 1)], (0, 1, 0))]
    df = faces(spark, rows)
    rec = surfaces.cluster_records(df, surfaces.surface_clusters(df))
    units = surfaces.annotation_units(rec)
    assert {r.cluster: r.unit for r in units.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    u = surfaces.unit_records(rec, units)
    assert {(r.unit, r.n_clusters, r.orientation) for r in u.collect()} == {(1, 2, "horizontal"), (3, 1, "horizontal"), (4, 1, "horizontal"), (5, 1, "horizontal"), (6, 1, "vertical"), (7, 1, "horizontal")}
    adj = surfaces.unit_adjacency(u)
    assert {(r.a, r.b, r.why) for r in adj.collect()} == {(1, 3, "material"), (1, 6, "normal_angle"), (4, 6, "normal_angle")}
    why = {r.unit: (r.neighbours, r.reasons) for r in surfaces.split_reasons(u, adj).collect()}
    assert why[1] == (2, ["disconnected", "material", "normal_angle"]) and why[5] == (0, ["disconnected"]) and why[7] == (0, ["lone"])


def uses(spark, rooms, connections=None, objects=None, scale=1.0):
    """rooms: (name, width, depth, names); objects: (room, name, x, z)."""
    ring = lambda w, d: [{"x": x, "z": z} for x, z in square(0, 0, w, d)]
    rm = spark.createDataFrame([("m", n, "s", float(w * d), 2.0 * (w + d), ring(w, d), t) for n, w, d, t in rooms], "model string, room string, storey string, area double, perimeter double, ring array<struct<x:double,z:double>>, names array<string>")
    cn = None if connections is None else spark.createDataFrame(connections, "room string, other string, kind string, traversable boolean")
    ob = None if objects is None else spark.createDataFrame([("m", i, r, x, z, n, None, None) for i, (r, n, x, z) in enumerate(objects)], "model string, object int, room string, x double, z double, name string, layer string, category string")
    return {r.room: r for r in semantics.room_semantics(rm, cn, ob, scale).collect()}


def test_uses_of_rooms(spark):
    rooms = [("bed", 3, 3, []), ("bath", 2, 2, []), ("corr", 2, 10, []), ("big", 5, 7, []), ("kt", 4, 4, ["Kamar Tidur Utama"]), ("plain", 3, 4, []), ("two", 4, 4, None), ("tiny", 1.2, 1.2, []), ("room-stair", 2, 4, []), ("zero", 0, 0, [])]
    ways = [("bed", "corr", "door", True), ("corr", "r1", "door", True), ("corr", "r2", "door", True), ("corr", "r3", "door", True), ("big", "r4", "opening", True), ("big", "r5", "opening", True), ("big", "r6", "opening", True), ("plain", "x", "door", True), ("tiny", "y", "door", True), ("room-stair", "hall", "vertical_connection", True), ("two", None, "window", False)]
    things = [("bed", "King Bed", None, None), ("bath", "WC Toilet Sanitary", None, None), ("big", "L-Shape Sofa TV Lounge", None, None), ("big", "6-Seat Dining Table", None, None), ("two", "Master King Bed", None, None), ("two", "Kitchen Stove Oven", None, None)]
    got = uses(spark, rooms, ways, things)
    assert {k: got[k].use for k in ("bed", "bath", "corr", "kt", "room-stair")} == {"bed": "bedroom", "bath": "bathroom", "corr": "corridor", "kt": "bedroom", "room-stair": "staircase"}
    # 0.2 * 0.8 of its shape, 0.2 * 0.5 as a dead end, 0.35 * 0.9 by the bed
    assert got["bed"].confidence == pytest.approx(0.2 * 0.8 + 0.2 * 0.5 + 0.35 * 0.9) and got["bath"].confidence > 0.5
    assert {"living", "dining"} <= {c.use for c in got["big"].candidates[:3]} and "conflicting_evidence" in got["two"].issues and got["tiny"].use in ("utility", "storage", "bathroom")
    assert got["plain"].confidence > 0.2 and got["plain"].use != "unassigned" and {"objects: bedroom", "place: dead end"} <= set(got["bed"].evidence)
    alone = uses(spark, [("zero", 0, 0, [])])["zero"]
    assert (alone.use, alone.confidence, alone.issues) == ("unassigned", 0.0, ["no_evidence"])
    a, b = uses(spark, [("m", 3, 3, [])])["m"], uses(spark, [("m", 3000, 3000, [])], scale=0.001)["m"]
    assert (a.use, a.confidence) == (b.use, b.confidence)


def test_objects_by_their_place(spark):
    got = uses(spark, [("r", 4, 4, [])], [], [(None, "desk", 1.0, 1.0), (None, "desk", 9.0, 9.0), ("r", "sink", 2.0, 2.0)])["r"]
    scores = {c.use: c.objects for c in got.candidates}
    assert scores["office"] == 0.8 and scores["kitchen"] == 0.9
