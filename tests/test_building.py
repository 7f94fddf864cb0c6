import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lathwork.functions import numbers, text
from lathwork.operators import advice, boundaries, encode, engineering, faces, graph, quality, rank, scenario, stats
from lathwork.plans import building


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_text_rules(spark):
    r = one(
        spark, text.repetition_key(F.lit("Root > Wall-Type_A > Face")).alias("a"), text.repetition_key(F.lit(" > Únder > ")).alias("b"), text.repetition_key(F.lit(">>")).alias("c"),
        text.date_prefix(F.lit("2026-07-13")).alias("d"), text.date_prefix(F.lit("2026-07-13 later")).alias("e"), text.date_prefix(F.lit(None).cast("string")).alias("f"), text.folded(F.lit("ŁódŹ ǅ ṩ")).alias("g"), text.metadata_text(F.lit("Pintu_01/[Kayu]  É")).alias("h"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.h) == ("wall type a", "under", "root", "2026-07-13", "2026-07-13 later", "", "pintu 01 kayu e")
    assert r.g == "odz s" and one(spark, text.unmarked(F.lit("é"[:1] + "́x")).alias("u")).u == "éx"[0].replace("é", "e") + "x"


def mulberry(seed, n):
    out, a = [], seed
    for _ in range(n):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ a >> 15) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61))) & 0xFFFFFFFF
        out.append((t ^ t >> 14) / 4294967296)
    return out


@pytest.mark.parametrize("seed", [0, 42, 4294967295])
def test_seeded_numbers_of_any_turn(spark, seed):
    got = [r.u for r in spark.range(1, 201).select(numbers.seeded_uniform(seed, F.col("id")).alias("u"), "id").orderBy("id").collect()]
    assert got == mulberry(seed, 200)


def test_numbers(spark):
    r = one(spark, numbers.decimal_comma(F.lit(1234567.891), 2).alias("a"), numbers.decimal_comma(F.lit(12.5)).alias("b"), numbers.turn_between(F.lit(350.0), F.lit(20.0)).alias("c"), numbers.sun_exposure(F.lit(90.0)).alias("d"), numbers.heading(F.lit(90.0)).alias("e"), numbers.solar_factor(F.lit("roof")).alias("f"))
    assert (r.a, r.b, r.c, round(r.d, 9), round(r.e.x, 9), round(r.e.z, 9), r.f) == ("1.234.567,89", "13", 30.0, 1.14, 1.0, 0.0, 320.0)


def test_comfort_and_transfer(spark):
    r = one(spark, engineering.pmv(F.lit(27.0), F.lit(29.0), 60.0, 0.15, 0.6, 1.2).alias("a"), engineering.pmv(F.lit(60.0)).alias("b"), engineering.vote_status(F.lit(0.51)).alias("c"), engineering.vote_status(F.lit(0.504)).alias("d"))
    assert round(r.a, 9) == round((28 - 24) * 0.35 + 0.15, 9) and (r.b, r.c, r.d) == (3.0, "warm", "comfortable")
    walls = spark.createDataFrame([("N", 20.0, 2.0, 0.5), ("N", 10.0, 3.0, 0.8), ("E", 5.0, 2.0, 0.5), ("S", 0.05, 2.0, 0.5)], "d string, area double, u double, a double")
    panes = spark.createDataFrame([("N", 6.0, 5.8, 0.8), ("W", 4.0, 5.0, 0.5)], "d string, area double, ug double, sc double")
    got = {r.d: r for r in engineering.facade_transfer(walls, panes, "d", "area", 9.0, "u", "a", "ug", "sc").collect()}
    north = (0.6 * (70 / 30) * 0.8 * 15) + 5.8 * 0.2 * 9 + 0.8 * 0.2 * 130
    west = 5.0 * 9 + 0.5 * 243
    east = 0.5 * 2 * 15
    assert {k: v.ottv for k, v in got.items() if k} == {"N": round(north, 1), "E": east, "W": west} and got["N"].wwr == 0.2 and got["W"].wwr == 1
    assert got[None].facade_area == 39.0 and got[None].ottv == round((round(north, 1) * 30 + east * 5 + west * 4) / 39, 1)
    assert engineering.facade_transfer(walls.limit(0), panes.limit(0), "d", "area", 9.0, "u", "a", "ug", "sc").count() == 0


def test_models_without_floors_have_their_lowest_level(spark):
    df = spark.createDataFrame([(1, "floor", 3.0), (1, "floor", 0.5), (1, "floor", 3.0), (1, "wall", -1.0), (2, "wall", 2.0), (2, "other", 1.0)], "model int, surface string, y0 double")
    assert {r.model: r.levels for r in building.floor_levels(df).collect()} == {1: [0.5, 3.0], 2: [1.0]}


def test_staircases_and_machines(spark):
    openings = spark.createDataFrame([(r, 1.0, 10.0 * k, 1.0, 2.0) for r in (1, 2) for k in (0, 1)] + [(3, 1.0, 0.0, 1.0, 2.0)], "room int, area double, direction double, sill double, head double")
    rooms = spark.createDataFrame([(1, 50.0, "staircase"), (2, 50.0, "living"), (3, 50.0, "staircase"), (4, 50.0, None)], "room int, volume double, use string")
    got = {r.room: r.kind for r in engineering.ventilation(rooms, openings, "room", "volume", 24.0, 33.0, 2.5, 180.0, use="use").collect()}
    assert got == {1: "stack_assisted", 2: "single_sided", 3: "single_sided", 4: "no_exterior_ventilation"}
    rooms = spark.createDataFrame([(1, "office", 20.0, 2), (2, "office", 20.0, 2)], "room int, use string, area double, people int")
    none = spark.createDataFrame([], "room int, role string, area double, u double")
    machines = spark.createDataFrame([(1, 100.0, 3), (1, None, 5), (1, 50.0, 1)], "room int, load double, count int")
    got = {r.room: r for r in engineering.cooling_loads(rooms, none, none.select("room", "area"), "room", 9.0, components=machines).collect()}
    assert got[1].equipment - got[2].equipment == 350.0 and got[1].sensible - got[2].sensible == pytest.approx(350.0)


def test_ventilation_like_pairs(spark):
    rng = random.Random(2)
    rooms = [(i, rng.uniform(0.2, 90)) for i in range(60)]
    openings = [(i, round(rng.uniform(0.05, 3), 2), float(rng.choice([0, 30, 44, 45, 90, 180, 316, 350])), rng.uniform(0, 2), rng.uniform(2, 5)) for i, _ in rooms for _ in range(rng.randint(0, 4))]
    got = {r.room: r for r in engineering.ventilation(spark.createDataFrame(rooms, "room int, volume double"), spark.createDataFrame(openings, "room int, area double, direction double, sill double, head double"), "room", "volume", 24.0, 33.0, 2.5, 180.0).collect()}
    for i, volume in rooms:
        o = [x for x in openings if x[0] == i and x[1] > 0.1]
        apart = [min(abs(a[2] - b[2]), 360 - abs(a[2] - b[2])) for a, b in itertools.combinations(o, 2)]
        rise = max(x[4] for x in o) - min(x[3] for x in o) if o else 0
        kind = "no_exterior_ventilation" if not o else "cross_ventilation" if any(d > 45 for d in apart) else "stack_assisted" if rise > 2.5 and len(o) > 1 else "single_sided"
        area = sum(x[1] for x in o) / 2
        if kind == "cross_ventilation":
            first = max(x[1] for x in o)
            rest = 2 * area - first
            area = math.sqrt(2) * first * rest / math.hypot(first, rest)
        flow = math.floor(max(0.6 * area * 2.5, 0.65 * area * math.sqrt(2 * 9.81 * rise * 9 / 306.15)) * 100 + 0.5) / 100
        assert got[i].kind == kind and math.isclose(got[i].flow, flow, abs_tol=0.0101) and math.isclose(got[i].air_changes, got[i].flow * 3600 / max(1, volume), abs_tol=0.051)


def test_face_rules(spark):
    square = [(0, 0), (4, 0), (4, 3), (0, 3)]
    points = lambda p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z")) for x, z in p))
    r = one(spark, faces.runs_along_axes(points(square)).alias("a"), faces.runs_along_axes(points([(0, 0), (4, 1), (4, 3), (0, 3)])).alias("b"), faces.runs_along_axes(points(square[:3])).alias("c"), faces.part_of_category(F.lit("stair")).alias("d"), faces.part_of_category(F.lit("?")).alias("e"), faces.surface_of(F.lit("odd"), F.lit("J1 kaca")).alias("f"), faces.surface_of(F.lit("floor"), F.lit("pintu")).alias("g"), faces.suggested_use(F.lit("WC 2"), F.lit(90.0)).alias("h"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (True, False, False, "structure", "other", "window", "floor", "servis")
    room = spark.createDataFrame([("lantai keramik", "floor", 0.0, 5.0, 0.0, 0.0, 0.0, 4.0, 19.0), ("x", "floor", 0.0, 5.0, 0.0, 0.0, 0.0, 4.0, 12.0), ("kusen", "floor", 0.0, 5.0, 0.0, 0.0, 0.0, 4.0, 19.0)], "path string, part string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, area double")
    a, b, c = [r.s for r in room.select(faces.room_score(F.lit(6), F.lit(True)).alias("s")).collect()]
    assert a.shape == "rectangle" and math.isclose(a.score, 0.38 + 0.26 + 0.18 + 0.14 + 0.095) and b.shape == "l_shape" and c is None
    box = "x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"
    pair = spark.createDataFrame([(0.0, 0.1, 0.0, 2.0, 0.0, 1.0)], box).alias("a").crossJoin(spark.createDataFrame([(0.2, 0.3, 2.5, 3.0, 1.0, 2.0), (1.0, 1.1, 0.0, 2.0, 0.0, 1.0)], box).alias("b"))
    assert [None if r.d is None else round(r.d, 6) for r in pair.select(faces.opening_distance("a", "b").alias("d")).collect()] == [1.9, None]
    assert [round(r.d, 6) for r in pair.select(boundaries.box_distance("a", "b").alias("d")).collect()] == [round(math.hypot(0.1, 0.5), 6), 0.9]


def test_boundaries(spark):
    corner = "array<struct<x:double,z:double>>"
    rows = [(1, "a", [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (1, "b", [(4.1, 0.0), (8.0, 0.0), (8.0, 3.0), (4.1, 3.0)])]
    sides = graph.settled(boundaries.segments(spark.createDataFrame(rows, f"k int, room string, p {corner}"), ["k", "room"], "p"))
    assert sides.count() == 8
    whole = boundaries.segments(spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]), (1, [(4.0, 0.0), (8.0, 0.0), (8.0, 3.0), (4.0, 3.0)])], f"k int, p {corner}"), ["k"], "p")
    assert whole.where("axis = 'z'").count() == 2  # the side between the two cancels
    got = [tuple(r) for r in boundaries.shared_boundaries(sides, ["k"], "room", 0.2).collect()]
    assert [(r[1], r[2], r[3], round(r[7], 6), r[8]) for r in got] == [("a", "b", "z", 0.1, 3.0)]
    walls = spark.createDataFrame([(1, "x", 0.05, 1.0, 3.0), (1, "x", 0.0, 2.0, 3.5), (1, "z", 9.0, 0.0, 3.0)], "k int, axis string, plane double, lo double, hi double")
    cover = {r.room: (r.perimeter, r.covered) for r in boundaries.coverage(sides, walls, ["k"], ["room"], 0.1).collect()}
    assert cover["a"] == (14.0, 2.5) and cover["b"][1] == 0


def test_hulls_like_half_planes(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for k in range(4) for _ in range(3 + 40 * k)] + [(9, 1.0, 1.0), (9, 1.0, 1.0), (8, 0.0, 0.0), (8, 1.0, 1.0), (8, 2.0, 2.0), (8, None, 1.0)]
    got = {}
    for r in boundaries.convex_hulls(spark.createDataFrame(rows, "k int, x double, z double"), ["k"], "x", "z", 3).orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r.x, r.z))
    assert got[9] == [(1.0, 1.0)] and got[8] == [(0.0, 0.0), (2.0, 2.0)]
    for k in range(4):
        p = {(x, z) for i, x, z in rows if i == k}
        ring = got[k]
        for a, b in zip(ring, ring[1:] + ring[:1]):
            assert all((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) >= 0 for q in p)
        assert set(ring) <= p and len(set(ring)) == len(ring)


@pytest.mark.parametrize("block", [7, 4096])
def test_undominated_like_all_pairs(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.randint(0, 2), *(float(rng.randint(0, 9)) for _ in range(3))) for i in range(300)]
    beats = lambda a, b: a[1] == b[1] and all(x <= y for x, y in zip(a[2:], b[2:])) and a[2:] != b[2:]
    df = spark.createDataFrame(rows, "i int, k int, a double, b double, c double").repartition(5)
    assert {r.i for r in boundaries.undominated(df, ["k"], ["a", "b", "c"], block).collect()} == {a[0] for a in rows if not any(beats(b, a) for b in rows)}
    assert boundaries.undominated(df.limit(0), ["k"], ["a"]).count() == 0 and boundaries.undominated(df, [], ["a"]).select("a").distinct().count() == 1


def test_kept_in_order_like_a_loop(spark):
    rng = random.Random(4)
    pairs = [(a, b) for a, b in itertools.combinations(range(60), 2) if rng.random() < 0.06]
    order = {i: (rng.random(), i) for i in range(60)}
    kept = []
    for i in sorted(order, key=order.get):
        if not any((i, j) in pairs or (j, i) in pairs for j in kept):
            kept.append(i)
    rows = spark.createDataFrame([(i, r[0]) for i, r in order.items()], "id int, r double")
    assert {r.id for r in boundaries.kept_in_order(rows, spark.createDataFrame(pairs, "a int, b int"), "id", "r").collect()} == set(kept)
    assert boundaries.kept_in_order(rows, spark.createDataFrame([], "a int, b int"), "id", "r").count() == 60


def test_medians_in_ranges_like_sorting(spark):
    rng = random.Random(6)
    rows = [("a", float(rng.randint(0, 500)), rng.random()) for _ in range(900)] + [("b", 1.0, 5.0), ("b", 9.0, 4.0), ("c", 3.0, 0.0), ("d", None, 1.0)]

    def median(vw):
        vw, run = sorted(vw), 0.0
        for v, w in vw:
            run += w
            if run >= sum(w for _, w in vw) / 2 - 1e-12:
                return v

    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(4)
    got = {r.k: (r.median, r.mad) for r in stats.weighted_mad(df, ["k"], "v", "w").collect()}
    for k in "abc":
        vw = [(v, w) for x, v, w in rows if x == k]
        m = median(vw)
        assert got[k] == (m, median([(abs(v - m), w) for v, w in vw]))
    assert set(got) == {"a", "b", "c"}
    assert stats.weighted_median(df.drop("k"), [], "v", "w", ranges=5).first()[0] == median([(v, w) for _, v, w in rows if v is not None])
    assert stats.weighted_mad(df.limit(0), ["k"], "v", "w").count() == 0


def test_numbering_in_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("p"), (F.col("id") % 113).cast("string").alias("v")).repartition(7)
    names = {r.v: r.id for r in encode.dictionary(df, "v", "p").collect()}
    first = {}
    for r in df.collect():
        first[r.v] = min(first.get(r.v, 10**9), r.p)
    assert names == {v: i for i, v in enumerate(sorted(first, key=lambda v: (first[v], v)))}
    assert sorted(r.p for r in rank.evenly_spaced(df, ["p", "v"], 17).collect()) == [i * 1000 // 17 for i in range(17)]
    assert rank.evenly_spaced(df.limit(5), ["p"], 17).count() == 5


def test_large_fingerprints_do_not_depend_on_order(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("r"))
    a, b = ({r.k: (r.fingerprint, r.n) for r in quality.fingerprint_of_many(d, ["k"], F.col("r"), 1).collect()} for d in (df, df.orderBy(F.desc("r")).repartition(9)))
    assert a == b and len(set(a.values())) == 3 and quality.fingerprint_of_many(df.limit(0), ["k"], F.col("r")).count() == 0


def test_advice(spark):
    rooms = spark.createDataFrame([("b", i, "good", "isolated" if i < 7 else "open", 0.0 if i == 0 else 5.0, "no_exterior_ventilation" if i == 0 else "single_sided", 3.0, 30 if i == 1 else 2) for i in range(9)], "k string, room int, quality string, access string, air_changes double, ventilation string, cooling_kw double, luminaires int")
    whole = spark.createDataFrame([("b", 50.0, True), ("c", 10.0, False)], "k string, ottv double, has_north boolean")
    raw = advice.advised(rooms, ["k"], advice.room_advice(), "room").unionByName(advice.advised(whole, ["k"], advice.building_advice(45.0)))
    got = [(r.k, r.id, r.title, r.rooms, r.scope, r.conflict) for r in advice.merged_advice(raw.union(raw), ["k"]).orderBy("k", "id").collect()]
    assert got == [
        ("b", "REC-1", "Inaccessible Room", 7, "building", False), ("b", "REC-2", "High Overall Thermal Transfer Value (OTTV)", 0, "building", False), ("b", "REC-3", "No Natural Ventilation", 1, "room", True),
        ("b", "REC-4", "High Solar Heat Gain", 0, "building", False), ("b", "REC-5", "High Fixture Count", 1, "room", False), ("c", "REC-1", "Missing Project North", 0, "building", False),
    ]


def test_search_over_designs(spark):
    v = [advice.Variable("w", 0.0, 1.0, 0.25), advice.Variable("u", 2.0, 2.0, 1.0)]
    d = advice.designs(spark, v, 40, 7).orderBy("design").collect()
    u = mulberry(7, 80)
    assert [r.w for r in d] == [math.floor(u[2 * i] * 5) * 0.25 for i in range(40)] and {r.u for r in d} == {2.0} and all(r.distance == r.w for r in d)
    e = spark.createDataFrame([(1, 1.0, 5.0, []), (2, 5.0, 1.0, []), (3, 2.0, 2.0, []), (4, 0.0, 0.0, ["max"]), (5, 6.0, 6.0, [])], "design int, a double, b double, reasons array<string>")
    got = {r.design: (r.balance, r.recommended) for r in advice.best_designs(e, ["a", "b"]).collect()}
    assert got == {1: (1.0, False), 2: (1.0, False), 3: (0.5, True)}
    assert one(spark, advice.feasibility({"x": F.lit(1) > 2, "y": F.lit(None).cast("boolean"), "z": F.lit(True)}).alias("r")).r == ["x"]


def test_deep_hierarchies_and_long_paths(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}", "root" if i == 0 else None) for i in range(8)], "n int, p int, name string, a string")
    assert graph.hierarchy(chain, "n", "p", "a", "name").where("depth = 7 and inherited = 'root'").count() == 1
    with pytest.raises(ValueError):
        graph.hierarchy(chain, "n", "p", "a", "name", limit=5).count()


def test_metric_changes(spark):
    df = spark.createDataFrame([(1.0, 1.0004), (1.0, 1.001), (0.0, 5.0), (None, 1.0), (1.0, float("nan"))], "b double, p double")
    got = [(r.d, r.q, r.s) for r in df.select(scenario.change("b", "p").alias("d"), scenario.percentage("b", "p").alias("q"), scenario.delta_status("b", "p", False).alias("s")).collect()]
    assert got == [(0.0, 0.0, "unchanged"), (0.001, 0.1, "improved"), (5.0, 0.0, "improved"), (0.0, 0.0, "not_applicable"), (0.0, 0.0, "not_applicable")]
