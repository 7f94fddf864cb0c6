import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lathwork.functions import geometry, numbers, text
from lathwork.operators import encode, engineering, graph, joins, quality, rank, rules, scenario, stats
from lathwork.streaming import incremental


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_number_rules(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.1234567,), (float("nan"),), (None,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(numbers.half_up("x")).collect()] == [-2.0, 3.0, 0.0, None, None, None]
    assert [r[0] for r in df.select(numbers.positive("x")).collect()] == [0.0, 2.5, 0.1234567, 0.0, 0.0, 0.0]
    r = one(spark, numbers.quantized(F.lit(1.23449)).alias("q"), numbers.millimetres(F.lit(-0.0004)).alias("m"), numbers.compass(F.lit(350.0)).alias("n"), numbers.compass(F.lit(100.0), 10.0).alias("e"), numbers.ratio(F.lit(1.0), F.lit(0.0)).alias("z"), numbers.azimuth(F.lit(1.0), F.lit(0.0)).alias("a"), numbers.overlap(F.lit(0), F.lit(2), F.lit(1), F.lit(5)).alias("o"), numbers.gap(F.lit(0), F.lit(2), F.lit(3), F.lit(5)).alias("g"))
    assert (round(r.q, 9), r.m, r.n, r.e, r.z, round(r.a), r.o, r.g) == (1.234, "0", "N", "E", 0.0, 180, 1.0, 1.0)


def test_text_rules(spark):
    r = one(spark, text.folded(F.lit("  Été--à  la_Plage! 9")).alias("f"), text.plain_name(F.lit("A_b-C  d")).alias("p"), text.repetition_key(F.lit("a>b>c")).alias("k"), text.repetition_key(F.lit("a>b")).alias("l"), text.date_prefix(F.lit("2026-07-13T01:02")).alias("d"), text.rgba(F.lit("#AA5522")).alias("c"), text.rgba(F.lit("no")).alias("n"), text.escaped_html(F.lit("<a & 'b'>")).alias("h"))
    assert (r.f, r.p, r.k, r.l, r.d, tuple(r.c), tuple(r.n), r.h) == ("ete a la plage 9", "a b c d", "b", "b", "2026-07-13", (170, 85, 34, 255), (200, 200, 200, 255), "&lt;a &amp; &#39;b&#39;&gt;")


def pts(*xz):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z")) for x, z in xz))


def test_polygons(spark):
    p = pts((0, 0), (4, 0), (4, 3), (0, 3))
    r = one(spark, geometry.signed_area(p).alias("a"), geometry.perimeter(p).alias("p"), geometry.centroid(p).alias("c"), geometry.bounds(p).alias("b"), geometry.clockwise(p).alias("w"), geometry.area(geometry.clipped(p, F.lit(1.0), F.lit(9.0), F.lit(-1.0), F.lit(2.0))).alias("k"), geometry.area(geometry.clipped(p, F.lit(5.0), F.lit(9.0), F.lit(0.0), F.lit(2.0))).alias("none"), geometry.centroid(pts((1, 1), (3, 1))).alias("flat"))
    assert (r.a, r.p, tuple(r.c), tuple(r.b), r.w[0].x, r.w[0].z, r.k, r.none, tuple(r.flat)) == (12.0, 14.0, (2.0, 1.5), (0.0, 4.0, 0.0, 3.0), 0.0, 3.0, 6.0, 0.0, (2.0, 1.0))


def test_normals_and_matrices(spark):
    p3 = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for v, k in zip(p, "xyz", strict=True))) for p in ((0, 0, 5), (2, 0, 5), (2, 2, 5), (0, 2, 5))))
    move = [1, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1, 0, 5, 6, 7, 1]
    m = F.array(*(F.lit(float(v)) for v in move))
    r = one(spark, geometry.newell_normal(p3).alias("n"), geometry.surface_of(geometry.newell_normal(p3)).alias("s"), geometry.polygon_area_3d(p3).alias("a"), F.size(geometry.fan(p3)).alias("t"), geometry.moved(geometry.matrix_product(m, m), p3[1]).alias("v"), geometry.decomposed(m).alias("d"), geometry.to_world(p3[1]).alias("w"), geometry.orientation_of(F.lit(0.1)).alias("o"))
    assert (tuple(r.n), r.s, r.a, r.t, tuple(r.v), tuple(r.d), tuple(r.w), r.o) == ((0.0, 0.0, 1.0), "floor", 4.0, 2, (12.0, 18.0, 19.0), (5.0, 6.0, 7.0, 1.0, 2.0, 1.0), (2.0, 5.0, 0.0), "vertical")


def test_bands_differ_from_gaps(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 0.1, 0.2, 0.3, 1.0)], "k string, v double")
    assert [(r.band, r.anchor, r.n_values) for r in stats.anchored_bands(df, ["k"], "v", 0.15).orderBy("band").collect()] == [(1, 0.0, 2), (2, 0.2, 2), (3, 1.0, 1)]
    w = df.withColumn("w", F.lit(1.0))
    assert [round(r.level, 3) for r in stats.running_mean_bands(w, ["k"], "v", "w", 0.15).orderBy("band").collect()] == [0.05, 0.25, 1.0]  # 0.2 is further than 0.15 from the mean so far


def test_interval_union_random(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), a := rng.randint(0, 60), a + rng.randint(0, 8)) for _ in range(120)]
    got = {r.k: r.covered for r in stats.interval_union(spark.createDataFrame(rows, "k int, a int, b int"), ["k"], "a", "b").collect()}
    assert got == {k: len({x for j, a, b in rows if j == k for x in range(a, b)}) for k in {r[0] for r in rows}}


def test_odd_segments_and_summary(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "k int, s string")
    assert [tuple(r) for r in stats.odd_segments(df, ["k"], ["s"]).collect()] == [(1, "b")]
    assert tuple(stats.value_summary(df.where("k > 5"), "k").first()) == (0.0, 0.0, 0.0, 0)


def test_joins_random(spark):
    rng = random.Random(2)
    a = [(i, rng.randint(0, 2), round(rng.uniform(0, 20), 2)) for i in range(80)]
    b = [(i, rng.randint(0, 2), round(rng.uniform(0, 20), 2)) for i in range(50)]
    left, right = spark.createDataFrame(a, "a int, k int, x double"), spark.createDataFrame(b, "b int, k int, y double")
    near = {i for i, k, x in a if any(k == l and abs(x - y) <= 0.3 for _, l, y in b)}
    assert {r.a for r in joins.grid_semi_join(left, right, ["k"], "x", "y", 0.3).collect()} == near
    want = {i: min((abs(x - y), j) for j, l, y in b if l == k)[1] for i, k, x in a}
    assert {r.a: r.b for r in joins.nearest(left, right, ["k"], "a", "b", "x", "y").collect()} == want
    after = {i: min(((y, j) for j, l, y in b if l == k and y > x), default=(None, None))[1] for i, k, x in a}
    assert {r.a: r.b for r in joins.next_after(left, right.withColumnRenamed("y", "x"), ["k"], "a", "b", "x").collect()} == after
    boxes = [(i, i % 2, x := rng.uniform(0, 30), x + rng.uniform(0, 9), y := rng.uniform(0, 30), y + rng.uniform(0, 9)) for i in range(60)]
    df = spark.createDataFrame(boxes, "id int, k int, x0 double, x1 double, y0 double, y1 double")
    hit = {(p[0], q[0]) for p in boxes for q in boxes if p[0] < q[0] and p[1] == q[1] and min(p[3], q[3]) > max(p[2], q[2]) and min(p[5], q[5]) > max(p[4], q[4])}
    assert {(r.a, r.b) for r in joins.box_overlaps(df, ["k"], "id", ("x0", "x1", "y0", "y1"), 4.0).collect()} == hit
    assert [r.name for r in joins.lookup(spark.createDataFrame([(0,), (9,)], "i int"), spark.createDataFrame([(0, "zero")], "k int, v string"), "i", "k", "v", "name").orderBy("i").collect()] == ["zero", ""]


def test_ranking(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 3), rng.randint(0, 15), rng.randint(0, 15)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, k int, lo int, hi int")
    best = {i for i, k, lo, hi in rows if not any(m == k and a <= lo and b >= hi and (a < lo or b > hi) for _, m, a, b in rows)}
    assert {r.id for r in rank.pareto_frontier(df, ["k"], "lo", "hi").collect()} == best
    s = rank.stratified_sample(df, "k", "id", 10, "7").collect()
    assert len(s) == 10 and {r.k for r in s} == {r[1] for r in rows} and s == rank.stratified_sample(df.repartition(7), "k", "id", 10, "7").collect()
    assert [r.id for r in rank.evenly_spaced(df, ["id"], 5).orderBy("id").collect()] == [0, 30, 60, 90, 120]
    votes = spark.createDataFrame([("x", "a", 3.0), ("x", "b", 2.0), ("y", "a", 1.0), ("y", "b", 1.0)], "u string, c string, w double")
    assert {r.u: r.winner for r in rank.majority_vote(votes, ["u"], "c", F.col("w")).collect()} == {"x": "a", "y": "unknown"}


def test_graphs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (60, 61), (61, 62), (62, 60), (62, 70)], "a int, b int")
    comp = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert comp[40] == 1 and comp[51] == 50 and comp[70] == 60
    assert {r.node: r.hops for r in graph.hops(edges, spark.createDataFrame([(1,), (62,)], "n int"), 3).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 62: 0, 60: 1, 61: 1, 70: 1}
    assert {r.node for r in graph.on_cycles(edges).collect()} == {60, 61, 62}
    assert {r.node: r.degree for r in graph.degrees(edges).collect()}[62] == 3
    tree = spark.createDataFrame([("r", None, "wood", "root"), ("c", "r", None, "child"), ("g", "c", "brick", "grand"), ("l", "g", None, "leaf")], "id string, up string, m string, name string")
    assert {r.node: (r.depth, r.path, r.inherited) for r in graph.hierarchy(tree, "id", "up", "m", "name").collect()}["l"] == (3, "root/child/grand/leaf", "brick")


BANK = [{"rule_id": "a", "category": "door", "base": 0.2, "signals": {"tall": 0.5, "glass": -0.3}, "required_all": ["tall"]}, {"rule_id": "b", "category": "window", "base": 0.2, "signals": {"glass": 0.6}, "required_any": ["glass", "frame"]}]


def test_rule_bank(spark):
    rows = [(1, "tall", 1.0), (2, "glass", 1.0), (2, "glass", 0.4), (3, "tall", 1.0), (3, "glass", 0.9), (4, "other", 1.0), (5, "frame", 1.0)]
    e = rules.strongest(spark.createDataFrame(rows, "id int, key string, strength double"), "id")
    got = {r.id: r for r in rules.classify(e, "id", BANK).collect()}
    assert [got[i].category for i in range(1, 6)] == ["door", "window", "window", "unknown", "unknown"]
    assert got[2].rule_id == "b" and math.isclose(got[2].score, 0.8) and got[1].trace == ["tall"]
    assert rules.rule_table(spark, BANK).count() == 2
    r = one(spark, rules.exactly_one(F.lit("red door"), {"d": "door", "w": "window"}).alias("x"), rules.exactly_one(F.lit("door window"), {"d": "door", "w": "window"}).alias("y"), rules.penalties(1.0, [(F.lit(True), 0.3, "gap"), (F.lit(False), 0.5, "no")]).alias("p"))
    assert r.x == "d" and r.y is None and r.p.level == "medium" and r.p.reasons == ["gap"]


def test_encoding(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.choice("ab"), rng.uniform(-9, 9), rng.uniform(0, 500)) for i in range(200)], "id int, k string, x double, z double")
    back = encode.dequantize(encode.quantize(df, ["k"], ["x", "z"]), ["x", "z"])
    assert back.where("abs(x - x_back) > 0.0011 or abs(z - z_back) > 0.0011 or q_x < 0").count() == 0
    names = encode.dictionary(spark.createDataFrame([(3, "p"), (1, "q"), (2, "q")], "i int, v string"), "v", "i")
    assert {r.v: r.id for r in names.collect()} == {"q": 0, "p": 1}
    seg = encode.undirected(spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 0.0)], "a double, b double, c double, d double"), ("a", "b"), ("c", "d"))
    assert seg.select("key").distinct().count() == 1
    assert encode.unique_points(spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 2.0)], "i int, x double").withColumn("k", F.lit(1)), ["k"], ["x"], "i").count() == 2


def test_engineering(spark):
    r = one(spark, engineering.lamps(F.lit(20.0), 300.0, 1600.0).alias("l"), engineering.lamps(F.lit(0.0), 300.0, 1600.0).alias("z"), engineering.ppd(F.lit(0.0)).alias("p"), engineering.ppd(F.lit(3.0)).alias("q"), engineering.capacity(F.lit(1.0), 4.0).alias("c"), engineering.air_changes(F.lit(0.1), F.lit(0.0)).alias("a"), engineering.stack_flow(F.lit(1.0), F.lit(3.0), F.lit(20.0), F.lit(25.0)).alias("s"), engineering.to_pk(F.lit(9000 / 3.412142)).alias("k"))
    assert (r.l, r.z, r.p, r.c, r.a, round(r.s, 4), round(r.k, 9)) == (8, 0, 5.0, 1, 360.0, 0.6458, 1.0) and r.q > 99


def test_scenarios(spark):
    b, p = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.0)], "k string, m double"), spark.createDataFrame([("a", 0.5), ("c", 0.0), ("d", 1.0)], "k string, m double")
    got = {r.k: (r.m_status, r.m_pct) for r in scenario.compare(b, p, ["k"], {"m": True}).collect()}
    assert got == {"a": ("improved", -50.0), "b": ("not_applicable", 0.0), "c": ("unchanged", 0.0), "d": ("not_applicable", 0.0)}
    there = {r.k: r.presence for r in scenario.compare(b, p, ["k"], {"m": True}).collect()}
    assert there == {"a": "both", "b": "missing_in_proposed", "c": "both", "d": "missing_in_base"}
    s = spark.createDataFrame([(1.0, {"u": 9.0})], "u double, o map<string,double>")
    assert scenario.with_overrides(s, F.col("o"), ["u"]).first().u == 9.0


def test_quality(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (2, None)], "id int, v int")
    good, bad = quality.quarantine(df, {"range": F.col("v") >= 0, "id": F.col("id") > 0})
    assert good.count() == 1 and {tuple(r.reasons) for r in bad.collect()} == {("range",)}
    assert quality.duplicates(df, ["id"], "twice").collect() == [Row(reason="twice", id="2")]
    assert quality.leakage(df, df.where("id = 2"), ["id"]).count() == 1


EVENTS = [(i % 5, f"2026-01-01 00:{i % 60:02d}:{(i * 7) % 60:02d}", i) for i in range(120)]


def test_stream_like_batch(spark, tmp_path):
    df = spark.createDataFrame([(u, t, i) for u, t, i in EVENTS], "user_id int, ts string, event_id int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    schema = df.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    snap = incremental.Snapshot(f"{tmp_path}/out", ["user_id", "event_id"])
    seen = []
    incremental.run_to_end(stream, lambda b, n: (snap(b, n), seen.append(n)), f"{tmp_path}/ck")
    assert sorted(map(tuple, snap.read(spark, max(seen)).collect())) == sorted(map(tuple, df.dropDuplicates(["user_id", "event_id"]).collect()))
    rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    got = []
    q = incremental.burst_stream(rows, "user_id", "ts", 90).writeStream.outputMode("append").foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination()
    want = incremental.bursts(df, "user_id", "ts", "event_id", 90)
    assert sum(r.n for r in got) <= want.agg(F.sum("n")).first()[0]
    assert incremental.first_arrivals(rows, ["event_id"], "ts").isStreaming


@pytest.mark.parametrize("gap", [60, 600])
def test_bursts(spark, gap):
    df = spark.createDataFrame(EVENTS, "user_id int, ts string, event_id int").withColumn("ts", F.col("ts").cast("timestamp"))
    want = 0
    for u in range(5):
        at = sorted(r.ts.timestamp() for r in df.where(f"user_id = {u}").collect())
        want += 1 + sum(b - a > gap for a, b in zip(at, at[1:], strict=False))
    assert incremental.bursts(df, "user_id", "ts", "event_id", gap).count() == want
