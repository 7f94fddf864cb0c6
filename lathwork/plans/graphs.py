"""Queries of bands, cut lines, cycles, quarantine and samples on the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import graph, joins, quality, rank, rooms, scenario, stats
from .registry import query, table


@query("""
    WITH RECURSIVE v AS (SELECT s_nationkey AS k, floor(s_acctbal / 100 + 0.5) AS v, count(*)::DOUBLE AS w, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 100 + 0.5)) AS n FROM supplier GROUP BY 1, 2),
    b AS (SELECT k, n, 0 AS band, v AS level, w AS weight FROM v WHERE n = 1
          UNION ALL SELECT v.k, v.n, CASE WHEN abs(v.v - level) > 6 THEN band + 1 ELSE band END, CASE WHEN abs(v.v - level) > 6 THEN v.v ELSE (level * weight + v.v * v.w) / (weight + v.w) END, CASE WHEN abs(v.v - level) > 6 THEN v.w ELSE weight + v.w END FROM b JOIN v ON v.k = b.k AND v.n = b.n + 1)
    SELECT k AS s_nationkey, band, round(arg_max(level, n), 6) AS level, max(weight) AS weight FROM b GROUP BY 1, 2
""")
def level_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands around their running weighted mean."""
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey", numbers.half_up(F.col("s_acctbal") / 100).alias("v")).agg(F.count("*").alias("w"))
    return stats.running_mean_bands(rows, ["s_nationkey"], "v", "w", 6.0).select("s_nationkey", "band", F.round("level", 6).alias("level"), "weight")


_CYCLE = "SELECT DISTINCT c_custkey AS a, (c_custkey * 7 + c_nationkey) % (SELECT count(*) FROM customer) AS b FROM customer"


@query(f"""
    WITH RECURSIVE e AS ({_CYCLE}), r AS (SELECT a AS start, b AS here FROM e UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.here)
    SELECT DISTINCT start AS node FROM r WHERE start = here
""")
def cycle_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that lie on cycles, where every node has one successor."""
    c = table(spark, sf_dir, "customer")
    n = c.count()
    return graph.on_cycles(c.select(F.col("c_custkey").alias("a"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % n).alias("b")).distinct())


@query("""
    WITH w AS (SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'z' END AS axis, o_totalprice / 5000 AS at, (o_orderkey % 13) AS lo, (o_orderkey % 13) + 4 + o_orderkey % 5 AS hi, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS side FROM orders)
    SELECT a.k AS o_custkey, a.id AS "left", b.id AS "right", round(abs(a.at - b.at), 6) AS thickness FROM w a JOIN w b ON a.k = b.k AND a.axis = b.axis AND a.side = 1 AND b.side = -1 AND abs(a.at - b.at) BETWEEN 0.05 AND 0.6
    WHERE greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / least(a.hi - a.lo, b.hi - b.lo) >= 0.45
      AND NOT EXISTS (SELECT 1 FROM w c JOIN w d ON c.k = d.k AND c.axis = d.axis AND c.side = 1 AND d.side = -1 AND abs(c.at - d.at) BETWEEN 0.05 AND 0.6 AND greatest(0, least(c.hi, d.hi) - greatest(c.lo, d.lo)) / least(c.hi - c.lo, d.hi - d.lo) >= 0.45
                      WHERE c.k = a.k AND (c.id = a.id OR d.id = b.id) AND (c.id <> a.id OR d.id <> b.id))
""")
def facing_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall sides that face each other and no other one."""
    key = F.col("o_orderkey")
    w = table(spark, sf_dir, "orders").select("o_custkey", key.alias("id"), F.when(key % 2 == 0, "x").otherwise("z").alias("axis"), (F.col("o_totalprice") / 5000).alias("at"), (key % 13).cast("double").alias("lo"), ((key % 13) + 4 + key % 5).cast("double").alias("hi"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("side"))
    pairs = graph.settled(rooms.candidate_pairs(w, ["o_custkey"]))
    alone = lambda c: pairs.groupBy("o_custkey", c).agg(F.count("*").alias("n")).where("n = 1").select("o_custkey", c)
    only = pairs.join(alone("left"), ["o_custkey", "left"], "left_semi").join(alone("right"), ["o_custkey", "right"], "left_semi")
    return only.select("o_custkey", "left", "right", F.round("thickness", 6).alias("thickness"))


@query("""
    WITH s AS (SELECT l_suppkey AS k, least(l_quantity, l_linenumber * 5) AS a, greatest(l_quantity, l_linenumber * 5) AS b FROM lineitem)
    SELECT k AS l_suppkey, a, b FROM s WHERE a < b GROUP BY ALL HAVING count(*) % 2 = 1
""")
def open_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments left when those that occur in pairs cancel."""
    at = F.col("l_linenumber") * 5.0
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", F.least("l_quantity", at).alias("a"), F.greatest("l_quantity", at).alias("b")).where("a < b")
    return stats.odd_segments(s, ["l_suppkey"], ["a", "b"])


@query("""
    WITH r AS (SELECT o_orderkey, o_totalprice >= 2000 AS p, o_orderstatus IN ('F', 'O') AS s, o_custkey % 3 <> 0 AS c FROM orders)
    SELECT o_orderkey, concat_ws(',', CASE WHEN NOT p THEN 'price' END, CASE WHEN NOT s THEN 'status' END, CASE WHEN NOT c THEN 'customer' END) AS reasons FROM r WHERE NOT (p AND s AND c)
""")
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that break a rule, with the names of those they break."""
    rules = {"price": F.col("o_totalprice") >= 2000, "status": F.col("o_orderstatus").isin("F", "O"), "customer": F.col("o_custkey") % 3 != 0}
    return quality.quarantine(table(spark, sf_dir, "orders"), rules)[1].select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def leaked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on both sides of a split."""
    li = table(spark, sf_dir, "lineitem")
    return quality.leakage(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), ["l_partkey"])


@query("SELECT user_id, event_type, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY 1, 2")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and kind, with how many there were."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return joins.last_write(e, ["user_id", "event_type"], ["event_id"]).join(n, ["user_id", "event_type"])


@query("""
    WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey FROM o WHERE place IN (SELECT (i * (SELECT max(n) FROM o)) // 250 FROM range(250) t(i))
""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """250 orders at even steps of value."""
    return rank.evenly_spaced(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 250).select("o_orderkey")


@query("""
    WITH e AS (SELECT o_custkey AS a, l_suppkey AS b, l_quantity AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey),
    u AS (SELECT a, b, q FROM e UNION ALL SELECT b, a, q FROM e)
    SELECT a AS node, count(DISTINCT b) AS degree, count(*) AS links, round(sum(q), 1) AS cost FROM u GROUP BY 1
""")
def neighbour_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours, links and summed cost of every node."""
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = li.count()
    if o.count() > graph.ROWS_OF_A_TASK:  # fewer may be broadcast
        li, o = graph.dealt(li, rows, "l_orderkey"), graph.dealt(o, rows, "o_orderkey")
    n = graph.neighbours(li.join(o, F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", "l_suppkey", "l_quantity", rows)
    return n.groupBy("node").agg(F.count("*").alias("degree"), F.sum("links").alias("links"), F.round(F.sum("cost"), 1).alias("cost"))


@query("""
    WITH w AS (SELECT o_custkey AS a, o_custkey + 1 AS b, o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS open FROM orders)
    SELECT c_custkey, (SELECT count(*) FROM w WHERE a = c_custkey OR b = c_custkey) AS walls FROM customer WHERE c_custkey NOT IN (SELECT a FROM w WHERE open) AND c_custkey NOT IN (SELECT b FROM w WHERE open)
""")
def closed_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rooms that no way leads to, and how many walls they have: each order stands between a customer and the next one, urgent ones in process are ways."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1).alias("b"), ((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).alias("open"))
    walls = o.select("a").union(o.select("b")).groupBy(F.col("a").alias("c_custkey")).agg(F.count("*").alias("walls"))
    closed = graph.without_access(table(spark, sf_dir, "customer").select("c_custkey"), o.where("open"), "c_custkey")
    return closed.join(walls, "c_custkey", "left").select("c_custkey", F.coalesce("walls", F.lit(0)).alias("walls"))


@query(r"""
    WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda p: trim(regexp_replace(regexp_replace(lower(strip_accents(p)), '[_/\\|:;,.()\[\]{}-]+', ' ', 'g'), '\s+', ' ', 'g'))), lambda p: p <> '') AS p FROM documents)
    SELECT doc_id, md5(CASE WHEN len(p) >= 3 THEN p[len(p) - 1] WHEN len(p) > 0 THEN p[len(p)] ELSE 'root' END) AS key FROM d
""")
def repetition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a path that names what is repeated, with sentences as its parts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.repetition_key(F.coalesce("text", F.lit("")), r"\.").cast("binary")).alias("key"))


@query("""
    WITH d AS (SELECT o_orderpriority AS k, sha256(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR) AS d FROM orders), r AS (SELECT k, substr(d, 1, 3) AS p, sha256(string_agg(d, '' ORDER BY d)) AS r, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT k AS o_orderpriority, sha256(string_agg(r, '' ORDER BY p)) AS fingerprint, sum(n)::BIGINT AS n FROM r GROUP BY 1
""")
def fingerprint_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digests of large groups, in two levels."""
    return quality.fingerprint_of_many(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")))


@query("""
    WITH RECURSIVE r AS (SELECT c_custkey AS room, CASE c_mktsegment WHEN 'MACHINERY' THEN 'corridor' ELSE 'office' END AS use, 0.7 + (c_custkey % 9) / 10 AS width FROM customer),
    w AS (SELECT o_custkey AS room, CASE WHEN o_orderkey % 10 <> 0 THEN (o_custkey * 3 + o_orderkey % 2) % (SELECT count(*) FROM customer) END AS other, CASE o_orderstatus WHEN 'F' THEN 'door' ELSE 'open_passage' END AS kind, o_orderkey % 10 = 0 AS exterior, 0.6 + (o_orderkey % 7) / 10 AS width FROM orders),
    x AS (SELECT room FROM r WHERE use = 'corridor' UNION SELECT room FROM w WHERE exterior AND kind = 'door'),
    u AS (SELECT room AS a, other AS b FROM w WHERE other IS NOT NULL UNION SELECT other, room FROM w WHERE other IS NOT NULL),
    h(node, steps) USING KEY (node) AS (SELECT room, 0 FROM x UNION (SELECT u.b, min(h.steps) + 1 FROM h JOIN u ON u.a = h.node LEFT JOIN recurring.h AS k ON k.node = u.b WHERE k.node IS NULL GROUP BY u.b)),
    p AS (SELECT w.room, count(*) AS ways, bool_or(exterior AND kind = 'door') AS door, sum((exterior OR x.room IS NOT NULL)::INTEGER) AS entrances, min(width) AS narrow FROM w LEFT JOIN x ON x.room = w.other GROUP BY 1),
    q AS (SELECT r.room, coalesce(ways, 0) AS ways, coalesce(entrances, 0)::BIGINT AS entrances, steps, use, coalesce(ways, 0) = 0 AS isolated, coalesce(ways, 0) = 1 AND NOT door AS dead, floor(least(r.width, coalesce(narrow, r.width))::DOUBLE * 100 + 0.5) / 100 AS clear_width FROM r LEFT JOIN p USING (room) LEFT JOIN h ON h.node = r.room),
    l AS (SELECT *, CASE WHEN use = 'corridor' THEN 0.95::DOUBLE WHEN ways >= 3 THEN 0.7::DOUBLE WHEN dead OR isolated THEN 0.05::DOUBLE ELSE 0.2::DOUBLE END AS likelihood FROM q)
    SELECT room, ways, entrances, steps, CASE WHEN isolated THEN 'isolated' WHEN steps IS NULL THEN 'unreachable' WHEN dead THEN 'dead_end' ELSE 'accessible' END AS access, likelihood, round(clear_width, 4) AS clear_width,
           CASE WHEN isolated THEN 0 ELSE floor(least(100, ways * 20 + likelihood * 40 + CASE WHEN dead THEN 0 ELSE 20 END) + 0.5) END::DOUBLE AS movement FROM l
""")
def human_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access, steps to an exit and movement, with customers as rooms and orders as openings."""
    c, key = table(spark, sf_dir, "customer"), F.col("o_orderkey")
    rooms_ = c.select(F.col("c_custkey").alias("room"), F.when(F.col("c_mktsegment") == "MACHINERY", "corridor").otherwise("office").alias("use"), (0.7 + (F.col("c_custkey") % 9) / 10).alias("width"))
    o = table(spark, sf_dir, "orders")
    openings = o.select(F.col("o_custkey").alias("room"), F.when(key % 10 != 0, (F.col("o_custkey") * 3 + key % 2) % c.count()).alias("other"), F.when(F.col("o_orderstatus") == "F", "door").otherwise("open_passage").alias("kind"), (key % 10 == 0).alias("exterior"), (0.6 + (key % 7) / 10).alias("width"))
    out = graph.circulation(rooms_, openings)
    return out.select("room", "ways", "entrances", "steps", "access", "likelihood", F.round("clear_width", 4).alias("clear_width"), "movement")


@query("""
    SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, concat_ws(',', CASE WHEN l_quantity * 2 > 60 THEN 'indoorDesignTempC' END, CASE WHEN l_linenumber * 20 > 100 THEN 'relativeHumidityPercent' END,
           CASE WHEN l_discount <= 0 THEN 'lightLossFactor' END, CASE WHEN l_tax * 40 > 2 THEN 'acSafetyMargin' END, CASE WHEN l_tax - 0.02 < 0 THEN 'defaultWallUValue' END) AS issues FROM lineitem
""")
def override_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of a design that are out of their bounds."""
    li = table(spark, sf_dir, "lineitem")
    m = F.create_map(F.lit("indoorDesignTempC"), F.col("l_quantity") * 2, F.lit("relativeHumidityPercent"), F.col("l_linenumber") * 20.0, F.lit("lightLossFactor"), F.col("l_discount"), F.lit("acSafetyMargin"), F.col("l_tax") * 40, F.lit("defaultWallUValue"), F.col("l_tax") - 0.02, F.lit("unbounded"), F.lit(-1.0))
    return li.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id"), F.array_join(scenario.override_issues(m), ",").alias("issues"))


@query("""
    WITH c AS (SELECT s_suppkey, s_nationkey, list_transform(string_split(s_name, ''), lambda c: ord(c)::BIGINT) AS codes, s_acctbal AS x, (s_suppkey % 50)::DOUBLE AS z FROM supplier),
    r AS (SELECT s_nationkey, list_sort(list(printf('%.3f', floor(x / 0.001 + 0.5) * 0.001) || ',' || printf('%.3f', z))) AS p FROM c GROUP BY 1)
    SELECT s_suppkey, list_reduce(list_prepend(2166136261::BIGINT, codes), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS hash,
           'detected-room:' || s_nationkey || ':' || substr(sha256('room:' || s_nationkey || ':' || array_to_string(p, '|')), 1, 12) AS room,
           xor(xor(((floor(x / 2)::BIGINT * 73856093) & 4294967295)::BIGINT, ((floor(z / 2)::BIGINT * 19349663) & 4294967295)::BIGINT), ((floor(1.0) ::BIGINT * 83492791) & 4294967295)::BIGINT) AS cell
    FROM c JOIN r USING (s_nationkey)
""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of names, ids of rooms by their corners and of cells in space."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 50).cast("double").alias("z"))
    r = s.groupBy("s_nationkey").agg(text.room_id(F.col("s_nationkey"), F.collect_list(F.struct("x", "z"))).alias("room"))
    return s.join(r, "s_nationkey").select("s_suppkey", F.conv(text.stable_hash("s_name"), 36, 10).cast("bigint").alias("hash"), "room", numbers.cell_hash("x", "z", F.lit(2.0), 2.0).alias("cell"))
