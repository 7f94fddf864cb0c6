"""The registered queries on the star-schema tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, numbers, text
from ..operators import encode, engineering, graph, joins, quality, rank, rooms, rules, scenario, stats
from .registry import ORACLES, QUERIES, query
from .registry import rounded as _r
from .registry import table as _t


CASCADE = [("widget|gear", "mechanical"), ("bolt|screw|nut", "fastener")]


@query("""
    SELECT label, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS share
    FROM (SELECT l_quantity, CASE WHEN regexp_matches(p_name, 'widget|gear') THEN 'mechanical' WHEN regexp_matches(p_name, 'bolt|screw|nut') THEN 'fastener' ELSE 'other' END AS label
          FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY label
""")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows labelled by an ordered cascade; count, sum and share by label."""
    label = rules.first_match(F.col("p_name"), CASCADE, "other")
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), label.alias("label"))
    sums = _t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))  # before the join
    out = sums.join(parts, "l_partkey").groupBy("label").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    total = out.agg(F.sum("q").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("label", "n", F.round("q", 2).alias("sum_qty"), F.round(F.col("q") / F.col("total"), 6).alias("share"))


BANK = [
    {"rule_id": "r1", "category": "small", "base": 0.1, "signals": {"size.small": 0.6, "price.low": 0.2}, "required_any": ["size.small"], "threshold": 0.5},
    {"rule_id": "r2", "category": "large", "base": 0.1, "signals": {"size.large": 0.6, "price.high": 0.2}, "required_any": ["size.large"], "threshold": 0.5},
    {"rule_id": "r3", "category": "premium", "base": 0.2, "signals": {"price.high": 0.6, "size.small": -0.1}, "required_all": ["price.high"], "threshold": 0.5},
    {"rule_id": "r4", "category": "budget", "base": 0.2, "signals": {"price.low": 0.55, "size.large": -0.1}, "required_all": ["price.low"], "threshold": 0.5},
]


@query("""
    WITH e AS (SELECT p_partkey, CASE WHEN p_size < 15 THEN 1.0 ELSE 0 END AS ss, CASE WHEN p_size >= 35 THEN 1.0 ELSE 0 END AS sl,
                      CASE WHEN p_retailprice < 950 THEN 0.9 ELSE 0 END AS pl, CASE WHEN p_retailprice >= 1300 THEN 1.0 ELSE 0 END AS ph FROM part),
    s AS (SELECT p_partkey, 'r1' AS rule_id, 'small' AS category, least(1, greatest(0, 0.1 + 0.6 * ss + 0.2 * pl)) AS score FROM e WHERE ss > 0
          UNION ALL SELECT p_partkey, 'r2', 'large', least(1, greatest(0, 0.1 + 0.6 * sl + 0.2 * ph)) FROM e WHERE sl > 0
          UNION ALL SELECT p_partkey, 'r3', 'premium', least(1, greatest(0, 0.2 + 0.6 * ph - 0.1 * ss)) FROM e WHERE ph > 0
          UNION ALL SELECT p_partkey, 'r4', 'budget', least(1, greatest(0, 0.2 + 0.55 * pl - 0.1 * sl)) FROM e WHERE pl > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 6) DESC, category) AS n FROM s),
    t AS (SELECT e.p_partkey, a.category, coalesce(a.score, 0) AS score, a.rule_id, coalesce(a.score, 0) - coalesce(b.score, 0) AS gap
          FROM e LEFT JOIN k a ON a.p_partkey = e.p_partkey AND a.n = 1 LEFT JOIN k b ON b.p_partkey = e.p_partkey AND b.n = 2)
    SELECT p_partkey, CASE WHEN score >= 0.5 AND gap >= 0.08 THEN category ELSE 'unknown' END AS category, round(score, 4) AS score, round(gap, 4) AS margin,
           CASE WHEN score >= 0.5 AND gap >= 0.08 THEN rule_id END AS rule_id FROM t
""")
def rule_bank_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule bank over graded evidence; best category unless weak or contested."""
    p = _t(spark, sf_dir, "part")
    pair = lambda key, when, strength: F.when(when, F.struct(F.lit(key).alias("key"), F.lit(strength).alias("value")))
    found = F.array(pair("size.small", F.col("p_size") < 15, 1.0), pair("size.large", F.col("p_size") >= 35, 1.0), pair("price.low", F.col("p_retailprice") < 950, 0.9), pair("price.high", F.col("p_retailprice") >= 1300, 1.0))
    p = p.select("p_partkey", F.map_from_entries(F.filter(found, lambda x: x.isNotNull())).alias("evidence"))
    out = rules.classify(p, "p_partkey", BANK)
    return out.select("p_partkey", "category", _r("score"), _r("margin"), "rule_id")


@query("""
    WITH r AS (SELECT quality::VARCHAR AS t, CASE WHEN n_chars >= 1500 THEN '1' ELSE '0' END AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
    l AS (SELECT DISTINCT t AS label FROM r UNION SELECT DISTINCT p FROM r),
    c AS (SELECT label, (SELECT count(*) FROM r WHERE t = label) AS support, (SELECT count(*) FROM r WHERE p = label) AS predicted, (SELECT count(*) FROM r WHERE t = label AND p = label) AS tp FROM l),
    m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM c)
    SELECT label, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM m
""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a length rule against quality labels."""
    rows = _t(spark, sf_dir, "labels").where("quality is not null").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select(F.col("quality").cast("string").alias("t"), F.when(F.col("n_chars") >= 1500, "1").otherwise("0").alias("p"))
    out = stats.confusion_metrics(rows, "t", "p")
    return out.select("label", "support", "predicted", "tp", _r("precision", 6), _r("recall", 6), _r("f1", 6))


@query("""
    WITH v AS (SELECT l_returnflag AS k, round(l_extendedprice) AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
    c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v) AS run, sum(w) OVER (PARTITION BY k) AS total FROM v),
    m AS (SELECT k, min(v) AS median FROM c WHERE run >= total / 2 GROUP BY k),
    d AS (SELECT v.k, abs(v.v - m.median) AS v, sum(w) AS w FROM v JOIN m USING (k) GROUP BY 1, 2),
    e AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v) AS run, sum(w) OVER (PARTITION BY k) AS total FROM d)
    SELECT k AS l_returnflag, m.median, a.mad FROM m JOIN (SELECT k, min(v) AS mad FROM e WHERE run >= total / 2 GROUP BY k) a USING (k)
""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted median and weighted MAD of price by quantity."""
    rows = _t(spark, sf_dir, "lineitem").select("l_returnflag", numbers.half_up("l_extendedprice").alias("v"), "l_quantity")
    return stats.weighted_mad(rows, ["l_returnflag"], "v", "l_quantity")


@query("""
    WITH i AS (SELECT l_suppkey, epoch(l_shipdate) / 86400.0 AS a, epoch(l_shipdate) / 86400.0 + l_quantity AS b FROM lineitem),
    m AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m),
    o AS (SELECT l_suppkey, g, max(b) - min(a) AS len FROM n GROUP BY 1, 2)
    SELECT l_suppkey, round(sum(len), 3) AS covered, count(*) AS islands FROM o GROUP BY 1
""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days covered by a supplier's shipments."""
    day = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400.0
    rows = _t(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("a"), (day + F.col("l_quantity")).alias("b"))
    return stats.interval_union(rows, ["l_suppkey"], "a", "b").select("l_suppkey", _r("covered", 3), "islands")


@query("""
    SELECT bucket, round(weight, 2) AS weight, round(level, 4) AS level FROM (
      SELECT floor(l_extendedprice / 2500 + 0.5)::BIGINT AS bucket, sum(l_quantity) AS weight, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS level
      FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 18)
""")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 heaviest price levels."""
    out = stats.level_histogram(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", 2500.0)
    return out.select("bucket", _r("weight", 2), _r("level"))


@query("""
    WITH RECURSIVE v AS (SELECT DISTINCT s_nationkey AS k, floor(s_acctbal / 100 + 0.5) AS v FROM supplier),
    b AS (SELECT k, min(v) AS anchor, 1 AS band FROM v GROUP BY k
          UNION ALL SELECT b.k, (SELECT min(v.v) FROM v WHERE v.k = b.k AND v.v > b.anchor + 5), b.band + 1 FROM b WHERE EXISTS (SELECT 1 FROM v WHERE v.k = b.k AND v.v > b.anchor + 5))
    SELECT b.k AS s_nationkey, b.band, b.anchor, count(*) AS n_values FROM b JOIN v ON v.k = b.k AND v.v >= b.anchor AND v.v <= b.anchor + 5 GROUP BY 1, 2, 3
""")
def storey_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands anchored at their first value."""
    rows = _t(spark, sf_dir, "supplier").select("s_nationkey", numbers.half_up(F.col("s_acctbal") / 100).alias("v"))
    return stats.anchored_bands(rows, ["s_nationkey"], "v", 5.0)


@query("""
    SELECT c_custkey, c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer
    WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND abs(c_acctbal - s_acctbal) <= 50)
""")
def grid_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers near a supplier, by cells."""
    c = _t(spark, sf_dir, "customer").withColumn("k", F.col("c_nationkey"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_acctbal")
    return joins.grid_semi_join(c, s, ["k"], "c_acctbal", "s_acctbal", 50.0).select("c_custkey", "c_nationkey", _r("c_acctbal", 2))


@query("""
    SELECT c_custkey, s_suppkey, round(d, 4) AS distance FROM (
      SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS n
      FROM customer JOIN supplier ON s_nationkey = c_nationkey) WHERE n = 1
""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's nearest supplier in balance."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_acctbal")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_acctbal")
    return joins.nearest(c, s, ["k"], "c_custkey", "s_suppkey", "c_acctbal", "s_acctbal").select("c_custkey", "s_suppkey", _r("distance"))


@query("""
    SELECT event_id, next_id, epoch_us(next_ts) AS next_us FROM (
      SELECT p.event_id, e.event_id AS next_id, e.ts AS next_ts, row_number() OVER (PARTITION BY p.event_id ORDER BY e.ts, e.event_id) AS n
      FROM events p LEFT JOIN events e ON e.user_id = p.user_id AND e.event_type = 'error' AND e.ts > p.ts WHERE p.event_type = 'purchase') WHERE n = 1
""")
def asof_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase's next error of the same user."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    bad = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("next_id"), "ts")
    out = joins.next_after(e.where("event_type = 'purchase'"), bad, ["user_id"], "event_id", "next_id", "ts")
    return out.select("event_id", "next_id", F.unix_micros(F.col("next_ts").cast("timestamp")).alias("next_us"))


@query("""
    WITH b AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate) / 86400.0 AS x0, epoch(o_orderdate) / 86400.0 + 30 AS x1, o_totalprice AS y0, o_totalprice * 1.2 AS y1 FROM orders)
    SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 2) AS overlap
    FROM b a JOIN b b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
""")
def aabb_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of date and price that overlap within a customer."""
    day = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400.0
    b = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("x0"), (day + 30).alias("x1"), F.col("o_totalprice").alias("y0"), (F.col("o_totalprice") * 1.2).alias("y1"))
    return joins.box_overlaps(b, ["o_custkey"], "o_orderkey", ("x0", "x1", "y0", "y1"), 30.0).select("o_custkey", "a", "b", _r("overlap", 2))


@query("""
    WITH l AS (SELECT o_custkey, o_orderkey AS lower_id, o_totalprice AS lp FROM orders WHERE o_totalprice < 250000), u AS (SELECT o_custkey, o_orderkey AS upper_id, o_totalprice AS up FROM orders WHERE o_totalprice >= 250000)
    SELECT o_custkey, lower_id, upper_id, CASE WHEN lower_id IS NULL THEN 'no-lower' WHEN upper_id IS NULL THEN 'no-upper' ELSE 'both' END AS status,
           row_number() OVER (PARTITION BY o_custkey ORDER BY round(coalesce(up, 0) - coalesce(lp, 0), 2) DESC, coalesce(lower_id, -1), coalesce(upper_id, -1)) AS rank
    FROM l FULL JOIN u USING (o_custkey)
""")
def envelope_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders below and above a price in pairs, padded and ranked."""
    o = _t(spark, sf_dir, "orders")
    low = o.where("o_totalprice < 250000").select("o_custkey", F.col("o_orderkey").alias("lower_id"), F.col("o_totalprice").alias("lp"))
    up = o.where("o_totalprice >= 250000").select("o_custkey", F.col("o_orderkey").alias("upper_id"), F.col("o_totalprice").alias("up"))
    pairs = joins.padded_pairs(low, up, ["o_custkey"])
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    order = [F.desc(F.round(zero("up", 0.0) - zero("lp", 0.0), 2)), zero("lower_id", -1), zero("upper_id", -1)]
    return rank.top(pairs, ["o_custkey"], order, 1 << 30).select("o_custkey", "lower_id", "upper_id", "status", F.col("rank").cast("long").alias("rank"))


@query("""
    WITH r AS (SELECT n_name, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2)
    SELECT n_name, round(b.v, 2) AS base_revenue, round(p.v, 2) AS proposed_revenue, coalesce(CASE WHEN abs(p.v - b.v) >= 0.0005 THEN round(p.v - b.v, 2) END, 0) AS revenue_delta,
           coalesce(CASE WHEN abs(p.v - b.v) >= 0.0005 AND abs(b.v) > 0.000001 THEN floor((floor((p.v - b.v) * 1000 + 0.5) / 1000) / abs(b.v) * 10000 + 0.5) / 100 END, 0) AS revenue_pct,
           CASE WHEN b.v IS NULL OR p.v IS NULL THEN 'not_applicable' WHEN abs(p.v - b.v) < 0.0005 THEN 'unchanged' WHEN p.v > b.v THEN 'improved' ELSE 'degraded' END AS revenue_status,
           CASE WHEN b.v IS NULL THEN 'missing_in_base' WHEN p.v IS NULL THEN 'missing_in_proposed' ELSE 'both' END AS presence
    FROM (SELECT * FROM r WHERE y = 1996) b FULL JOIN (SELECT * FROM r WHERE y = 1997) p USING (n_name)
""")
def scenario_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of two years by nation, compared."""
    o = _t(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")).where("y in (1996, 1997)").groupBy("o_custkey", "y").agg(F.sum("o_totalprice").alias("v"))
    c = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    per = o.join(c, "o_custkey").groupBy("n_name", "y").agg(F.sum("v").alias("revenue"))
    out = scenario.compare(per.where("y = 1996"), per.where("y = 1997"), ["n_name"], {"revenue": False})
    return out.select("n_name", _r("base_revenue", 2), _r("proposed_revenue", 2), _r("revenue_delta", 2), "revenue_pct", "revenue_status", "presence")


@query("""
    WITH w AS (SELECT list_extract(['N','NE','E','SE','S','SW','W','NW'], (floor((((l_suppkey * 45.0 + l_linenumber + 22.5) % 360)) / 45) + 1)::INTEGER) AS facade,
                      l_quantity AS wall, l_quantity * l_discount * 5 AS glass, 2 + l_tax AS u, 0.5 + l_discount AS a, 5.6 + l_tax AS ug, 0.8 - l_discount AS sc FROM lineitem),
    s AS (SELECT facade, sum(wall) AS w, sum(glass) AS g, sum(wall * u) / sum(wall) AS u, sum(wall * a) / sum(wall) AS a, CASE WHEN sum(glass) > 0 THEN sum(glass * ug) / sum(glass) ELSE 0 END AS ug,
                 CASE WHEN sum(glass) > 0 THEN sum(glass * sc) / sum(glass) ELSE 0 END AS sc,
                 CASE facade WHEN 'N' THEN 130 WHEN 'NE' THEN 113 WHEN 'E' THEN 243 WHEN 'SE' THEN 176 WHEN 'S' THEN 130 WHEN 'SW' THEN 176 WHEN 'W' THEN 243 ELSE 113 END AS sf FROM w GROUP BY 1),
    o AS (SELECT facade, greatest(0, w - g) + g AS area, g, least(1, g / w) AS wwr, floor((a * u * (1 - least(1, g / w)) * 15 + ug * least(1, g / w) * 9 + sc * least(1, g / w) * sf) * 10 + 0.5) / 10 AS ottv FROM s)
    SELECT facade, round(area, 2) AS facade_area, round(wwr, 6) AS wwr, ottv FROM o
    UNION ALL SELECT NULL, round(sum(area), 2), floor(sum(g) / sum(area) * 1000 + 0.5) / 1000, floor(sum(ottv * area) / sum(area) * 10 + 0.5) / 10 FROM o
""")
def facade_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat transfer by facade direction, and of the whole, from wall and glass areas."""
    direction = numbers.compass(F.col("l_suppkey") * 45.0 + F.col("l_linenumber"))
    rows = _t(spark, sf_dir, "lineitem").select(direction.alias("facade"), F.col("l_quantity").alias("wall"), (F.col("l_quantity") * F.col("l_discount") * 5).alias("glass"), "l_tax", "l_discount")
    walls = rows.select("facade", F.col("wall").alias("area"), (2 + F.col("l_tax")).alias("u"), (0.5 + F.col("l_discount")).alias("a"))
    panes = rows.select("facade", F.col("glass").alias("area"), (5.6 + F.col("l_tax")).alias("ug"), (0.8 - F.col("l_discount")).alias("sc"))
    out = engineering.facade_transfer(walls, panes, "facade", "area", 33.0 - 24.0, "u", "a", "ug", "sc")
    return out.select("facade", _r("facade_area", 2), _r("wwr", 6), "ottv")


@query("""
    SELECT 'R' || r_regionkey AS node, 0 AS depth, r_name AS path, r_name AS inherited FROM region
    UNION ALL SELECT 'N' || n_nationkey, 1, r_name || '/' || n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'S' || s_suppkey, 2, r_name || '/' || n_name || '/' || s_name, CASE WHEN s_acctbal < 0 THEN s_name ELSE r_name END
    FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
""")
def hierarchy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, depths and inherited attributes down a tree."""
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r = _t(spark, sf_dir, "region").select(node("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.col("r_name").alias("attr"))
    n = _t(spark, sf_dir, "nation").select(node("N", "n_nationkey").alias("node"), node("R", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("attr"))
    s = _t(spark, sf_dir, "supplier").select(node("S", "s_suppkey").alias("node"), node("N", "s_nationkey").alias("parent"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, F.col("s_name")).alias("attr"))
    return graph.hierarchy(r.unionByName(n).unionByName(s), "node", "parent", "attr", "name")


_ALL_EDGES = "SELECT DISTINCT 'C' || o_custkey AS a, 'S' || l_suppkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def _all_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with every supplier of its orders."""
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return lines.join(_t(spark, sf_dir, "orders"), "o_orderkey").select(node("C", "o_custkey").alias("a"), node("S", "l_suppkey").alias("b")).distinct()


@query(f"""
    WITH RECURSIVE e AS ({_ALL_EDGES}), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    r(node, component) USING KEY (node) AS (SELECT DISTINCT x, x FROM u
      UNION (SELECT k.node, min(r.component) FROM r JOIN u ON u.x = r.node JOIN recurring.r AS k ON k.node = u.y WHERE r.component < k.component GROUP BY k.node))
    SELECT node, component FROM r
""")
def trade_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers linked by any trade; rounds move numbers, even ones for customers, and names come back at the end."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    trade = lines.join(_t(spark, sf_dir, "orders"), "o_orderkey").select((F.col("o_custkey").cast("bigint") * 2).alias("a"), (F.col("l_suppkey").cast("bigint") * 2 + 1).alias("b"))
    name = F.concat(F.when(F.col("node") % 2 == 0, "C").otherwise("S"), F.shiftright("node", 1).cast("string"))
    found = graph.settled(graph.connected_components(trade).select(name.alias("node"), F.col("component").alias("_group")))
    return found.join(found.groupBy("_group").agg(F.min("node").alias("component")), "_group").select("node", "component")


@query(f"""
    WITH RECURSIVE e AS ({_ALL_EDGES}), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    r(node, hops) USING KEY (node) AS (SELECT min(x), 0 FROM u
      UNION (SELECT u.y, min(r.hops) + 1 FROM r JOIN u ON u.x = r.node LEFT JOIN recurring.r AS k ON k.node = u.y WHERE k.node IS NULL GROUP BY u.y))
    SELECT node, hops FROM r
""")
def trade_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from the first node over all trades, until nothing new is found."""
    e = graph.settled(_all_trade(spark, sf_dir))
    first = e.select("a").union(e.select("b")).agg(F.min("a").alias("node"))
    return graph.hops(e, first, None)


@query("""
    SELECT p.p_brand, p.p_partkey, round(p.p_retailprice, 2) AS p_retailprice, p.p_size FROM part p
    WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_retailprice <= p.p_retailprice AND q.p_size >= p.p_size AND (q.p_retailprice < p.p_retailprice OR q.p_size > p.p_size))
""")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap and large parts of each brand."""
    return rank.pareto_frontier(_t(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", "p_partkey", _r("p_retailprice", 2), "p_size")


@query("""
    SELECT o_orderkey, o_orderpriority, turn FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42' || o_orderkey::VARCHAR), o_orderkey) AS turn FROM orders)
    ORDER BY turn, o_orderpriority LIMIT 100
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin over order priorities."""
    return rank.stratified_sample(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 100, "42").select("o_orderkey", "o_orderpriority", F.col("turn").cast("long").alias("turn"))


@query("""
    WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM v)
    SELECT user_id, CASE WHEN n / total >= 0.6 THEN event_type ELSE 'unknown' END AS winner, n AS votes, total::BIGINT AS total FROM r WHERE k = 1
""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's dominant event type, unknown below 60 percent."""
    return rank.majority_vote(_t(spark, sf_dir, "events"), ["user_id"], "event_type", F.lit(1))


@query("SELECT user_id, event_type, count(*) AS arrivals, count(DISTINCT floor(value)) AS kept, count(*) - count(DISTINCT floor(value)) AS dropped FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def dedup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals deduplicated by key, with counters: two steps of partial sums."""
    e = _t(spark, sf_dir, "events").where("value is not null")
    per = e.groupBy("user_id", "event_type", F.floor("value").alias("v")).agg(F.count("*").alias("n"))
    out = per.groupBy("user_id", "event_type").agg(F.sum("n").alias("arrivals"), F.count("*").alias("kept"))
    return out.withColumn("dropped", F.col("arrivals") - F.col("kept"))


@query("""
    WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
    SELECT user_id, burst::BIGINT AS burst, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_event FROM s GROUP BY 1, 2
""")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events no further apart than an hour; the last one counts."""
    from ..streaming.incremental import bursts

    return bursts(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600)


def _quantized(rows: DataFrame) -> DataFrame:
    rows = rows.select("label", (F.col("axis") + 1).alias("axis"), F.col("x").cast("double").alias("x"))
    out = encode.dequantize(encode.quantize(rows, ["label", "axis"], ["x"]), ["x"])
    return out.groupBy("label", "axis").agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("x_back") - F.col("x"))), 6).alias("max_error"), F.max("q_x").alias("max_code"))


@query("""
    WITH u AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS axis, unnest(embedding)::DOUBLE AS x FROM embeddings),
    b AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM u WINDOW w AS (PARTITION BY label, axis)),
    s AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / CASE WHEN (hi - lo) / 65535 / 2 <= 0.001 THEN 65535.0 ELSE 4294967295.0 END ELSE 1 END AS scale FROM b)
    SELECT label, axis::INTEGER AS axis, count(*) AS n, round(max(abs(lo + floor((x - lo) / scale + 0.5) * scale - x)), 6) AS max_error, max(floor((x - lo) / scale + 0.5)::BIGINT) AS max_code FROM s GROUP BY 1, 2
""")
def quantize_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of the embeddings to whole numbers and back, per label and axis."""
    return _quantized(_t(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("axis", "x")))


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, floor(l_extendedprice * 100 + 0.5) AS z FROM lineitem),
    c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x, z) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM p),
    e AS (SELECT a.l_orderkey, a.n, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND b.k = a.k % a.n + 1)
    SELECT l_orderkey, max(n) AS n, round(abs(sum(ax * bz - bx * az)) / 2, 3) AS area, round(sum(sqrt((bx - ax) ** 2 + (bz - az) ** 2)), 1) AS perimeter, round(min(ax), 3) AS min_x, round(max(az), 3) AS max_z
    FROM e GROUP BY 1
""")
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons from an order's lines: area, perimeter, bounds by array functions."""
    point = F.struct("l_linenumber", F.col("l_quantity").alias("x"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("double").alias("z"))
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("p"))
    b = geometry.bounds("p")
    return rows.select("l_orderkey", F.size("p").cast("long").alias("n"), F.round(geometry.area("p"), 3).alias("area"), F.round(geometry.perimeter("p"), 1).alias("perimeter"), F.round(b["min_x"], 3).alias("min_x"), F.round(b["max_z"], 3).alias("max_z"))


@query("""
    WITH f AS (SELECT p_name, min(p_partkey) AS first FROM part GROUP BY 1), d AS (SELECT p_name, row_number() OVER (ORDER BY first, p_name) - 1 AS id FROM f)
    SELECT id, p_name, count(*) AS n, min(p_partkey) AS first_part FROM part JOIN d USING (p_name) GROUP BY 1, 2
""")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to ids by first appearance, and back."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = encode.dictionary(p, "p_name", "p_partkey")
    coded = encode.encode(p, names, "p_name", "id")
    return encode.decode(coded.groupBy("id").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part")).withColumnRenamed("id", "code"), names, "p_name", "code").join(names, "p_name").select("id", "p_name", "n", "first_part")


def _integrity(spark: SparkSession, sf_dir: str, documents: DataFrame) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    return quality.report(
        [
            quality.dangling(o, "o_custkey", c, "c_custkey", "order without customer", "o_orderkey"),
            quality.dangling(_t(spark, sf_dir, "labels"), "doc_id", documents.withColumnRenamed("doc_id", "d"), "d", "label without document", "doc_id"),
            quality.duplicates(_t(spark, sf_dir, "part"), ["p_name"], "repeated part name"),
            quality.broken(c, F.col("c_acctbal") >= 0, "negative balance", "c_custkey"),
        ]
    )


@query("""
    SELECT reason, count(*) AS n, min(id) AS example FROM (
      SELECT 'order without customer' AS reason, o_orderkey::VARCHAR AS id FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT 'label without document', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
      UNION ALL SELECT 'repeated part name', p_name FROM part GROUP BY p_name HAVING count(*) > 1
      UNION ALL SELECT 'negative balance', c_custkey::VARCHAR FROM customer WHERE NOT coalesce(c_acctbal >= 0, false)) GROUP BY 1
""")
def integrity_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling keys, duplicates and range errors by reason, labels held against all documents."""
    return _integrity(spark, sf_dir, _t(spark, sf_dir, "documents"))


@query("""
    SELECT o_orderpriority, sha256(string_agg(d, '' ORDER BY d)) AS fingerprint, count(*) AS n
    FROM (SELECT o_orderpriority, sha256(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR || '|' || o_orderstatus) AS d FROM orders) GROUP BY 1
""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digests of groups of rows."""
    row = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    return quality.fingerprint(_t(spark, sf_dir, "orders"), ["o_orderpriority"], row)


@query("""
    SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high, GROUPING(r_name, n_name)::INTEGER AS level
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def rollup_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level rollup with bounds; customers are summed by nation before the names join."""
    per = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("s"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    names = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")
    out = per.join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name")
    return out.agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("balance"), F.round(F.min("lo"), 2).alias("low"), F.round(F.max("hi"), 2).alias("high"), F.grouping_id().cast("int").alias("level"))


@query("""
    WITH p AS (SELECT event_id, value, greatest(-3, least(3, (value / 10 + 20 - (24 - (1.1 - 1.2) * 3 - (0.5 - 0.6) * 4 + (0.1 - 0.15) * 1.5)) * 0.35 + (50 - 50) * 0.015)) AS pmv FROM events WHERE value IS NOT NULL)
    SELECT event_id, round(pmv, 6) AS pmv, floor(greatest(5, least(100, 100 - 95 * exp(-0.03353 * pmv ** 4 - 0.2179 * pmv ** 2))) * 10 + 0.5) / 10 AS ppd,
           round(17.8 + 0.31 * (value / 10), 6) AS neutral, abs(value / 10 + 20 - (17.8 + 0.31 * (value / 10))) <= 3.5 AS comfortable FROM p
""")
def comfort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vote, dissatisfied and the adaptive band, with event values as temperatures."""
    t = F.col("value") / 10
    band = engineering.adaptive_band(t)
    vote = engineering.pmv(t + 20)
    return _t(spark, sf_dir, "events").where("value is not null").select("event_id", F.round(vote, 6).alias("pmv"), engineering.ppd(vote).alias("ppd"), F.round(band["neutral"], 6).alias("neutral"), (F.abs(t + 20 - band["neutral"]) <= 3.5).alias("comfortable"))


@query("""
    SELECT o_orderpriority, round(sum((o_totalprice / 1000 * 150 + (o_custkey % 7) * 120) * 1.1), 1) AS watts, round(sum((o_totalprice / 1000 * 150 + (o_custkey % 7) * 120) * 1.1) * 3.412142 / 9000, 3) AS pk,
           sum(greatest(1, floor(o_totalprice / 1000 / 4)))::BIGINT AS people FROM orders GROUP BY 1
""")
def cooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cooling load with order values as areas."""
    area = F.col("o_totalprice") / 1000
    per = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum(engineering.cooling_watts(area, F.col("o_custkey") % 7)).alias("watts"), F.sum(engineering.capacity(area, 4.0)).alias("people"))
    return per.select("o_orderpriority", _r("watts", 1), F.round(engineering.to_pk("watts"), 3).alias("pk"), "people")


@query("""
    WITH l AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 300 WHEN 'O' THEN 150 ELSE 100 END AS lux, o_totalprice / 1000 AS area FROM orders),
    c AS (SELECT o_orderkey, lux, ceil(area * lux / (0.6 * 0.8) / 1600)::BIGINT AS lamps FROM l)
    SELECT o_orderkey, lux, lamps, greatest(1, ceil(sqrt(lamps * 1.5)))::BIGINT AS columns, ceil(lamps / greatest(1, ceil(sqrt(lamps * 1.5))))::BIGINT AS rows FROM c
""")
def lighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lamps by the lumen method and their grid."""
    lux = F.when(F.col("o_orderstatus") == "F", 300).when(F.col("o_orderstatus") == "O", 150).otherwise(100)
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", lux.alias("lux"), engineering.lamps(F.col("o_totalprice") / 1000, lux, 1600.0).alias("lamps"))
    grid = engineering.lamp_grid("lamps", F.lit(1.5), F.lit(1.0))
    return rows.select("o_orderkey", "lux", "lamps", grid["columns"].alias("columns"), grid["rows"].alias("rows"))


@query(r"""
    SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))) AS folded_md5,
           length(trim(regexp_replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))) AS folded_chars FROM documents
""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded text of every document."""
    d = _t(spark, sf_dir, "documents").select("doc_id", text.folded("text").alias("t"))
    return d.select("doc_id", F.md5(F.col("t").cast("binary")).alias("folded_md5"), F.length("t").cast("long").alias("folded_chars"))


@query("""
    WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) = 1996), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) = 1997)
    SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'only second', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied parts of two years: in both, in one only.  One grouping answers all three."""
    y = F.year("l_shipdate")
    seen = _t(spark, sf_dir, "lineitem").where(y.isin(1996, 1997)).groupBy("l_suppkey", "l_partkey").agg(F.max((y == 1996).cast("int")).alias("a"), F.max((y == 1997).cast("int")).alias("b"))
    side = F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, "only first").otherwise("only second")
    got = seen.groupBy(side.alias("side")).agg(F.count("*").alias("n"))
    sides = spark.createDataFrame([("both",), ("only first",), ("only second",)], "side string")
    return sides.join(got, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
    WITH f AS (SELECT p_brand, p_partkey, p_retailprice, p_size FROM part), e AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, min(p_size) AS c, max(p_size) AS d FROM f),
    o AS (SELECT p_brand, p_partkey, (p_retailprice - a) / (b - a) + 1 - (p_size - c) / (d - c) AS objective FROM f, e),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY objective, p_partkey) AS n FROM o)
    SELECT p_brand, p_partkey, round(objective, 6) AS objective FROM r WHERE n = 1
""")
def recommended_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option of least normalized objective in each brand."""
    scored = scenario.normalized_objective(_t(spark, sf_dir, "part"), {"p_retailprice": True, "p_size": False})
    return scenario.recommended(scored, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", _r("objective", 6))


@query("""
    SELECT count(*) AS n, floor(min(o_totalprice) * 1e6 + 0.5) / 1e6 AS min, floor(quantile_cont(o_totalprice, 0.5) * 1e6 + 0.5) / 1e6 AS median, floor(max(o_totalprice) * 1e6 + 0.5) / 1e6 AS max FROM orders
""")
def value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min, median, max of a measure."""
    return stats.value_summary(_t(spark, sf_dir, "orders"), "o_totalprice")


def _loops(walls: DataFrame) -> DataFrame:
    found = rooms.loops(rooms.face_cycles(rooms.half_edges(walls)))
    return found.select("storey", F.col("face.a.x").alias("x"), F.col("face.a.z").alias("z"), F.col("n").cast("long").alias("n"), _r("area"), _r("perimeter"))


def _adjacency(walls: DataFrame) -> DataFrame:
    cycles = graph.settled(rooms.face_cycles(rooms.half_edges(walls)))
    out = rooms.adjacency(cycles, rooms.loops(cycles))
    return out.select("storey", F.col("left.a.x").alias("left_x"), F.col("left.a.z").alias("left_z"), F.col("right.a.x").alias("right_x"), F.col("right.a.z").alias("right_z"), _r("shared"))


_BUILDING = """
    n AS (SELECT c_custkey AS k, c_custkey // 108 AS storey, c_custkey % 12 AS x, (c_custkey // 12) % 9 AS z FROM customer),
    w AS (SELECT DISTINCT storey, x AS ax, z AS az, x + 1 AS bx, z AS bz FROM n WHERE k % 5 <> 0 UNION SELECT DISTINCT storey, x, z, x, z + 1 FROM n WHERE k % 5 = 0 OR k % 7 <> 0),
    h AS (SELECT * FROM w UNION SELECT storey, bx, bz, ax, az FROM w),
    t AS (SELECT *, coalesce(lag({'x': bx, 'z': bz}) OVER (PARTITION BY storey, ax, az ORDER BY atan2(bz - az, bx - ax), bx, bz),
                             last({'x': bx, 'z': bz}) OVER (PARTITION BY storey, ax, az ORDER BY atan2(bz - az, bx - ax), bx, bz ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS c FROM h),
    s AS (SELECT storey, bx AS ax, bz AS az, ax AS bx, az AS bz, c.x AS cx, c.z AS cz FROM t),
    o AS (SELECT storey, ax AS sx, az AS sz, bx AS tx, bz AS tz, ax, az, bx, bz, cx, cz FROM s
          UNION SELECT o.storey, o.sx, o.sz, o.tx, o.tz, s.ax, s.az, s.bx, s.bz, s.cx, s.cz FROM o JOIN s ON s.storey = o.storey AND s.ax = o.bx AND s.az = o.bz AND s.bx = o.cx AND s.bz = o.cz),
    f AS (SELECT storey, sx, sz, tx, tz, min({'ax': ax, 'az': az, 'bx': bx, 'bz': bz}) AS face, sum(ax * bz - bx * az) / 2.0 AS area, sum(abs(bx - ax) + abs(bz - az)) AS perimeter FROM o GROUP BY 1, 2, 3, 4, 5),
    g AS (SELECT * FROM f WHERE area > 0)
"""


def _building(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall lines of all customers: one or two for each, on storeys of 108."""
    n = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 108").alias("storey"), (F.col("c_custkey") % 12).cast("double").alias("x"), F.expr("cast((c_custkey div 12) % 9 as double)").alias("z"))
    ends = F.array(F.when(F.col("k") % 5 != 0, F.struct((F.col("x") + 1).alias("x"), F.col("z").alias("z"))), F.when((F.col("k") % 5 == 0) | (F.col("k") % 7 != 0), F.struct(F.col("x").alias("x"), (F.col("z") + 1).alias("z"))))
    lines = n.select("storey", "x", "z", F.explode(ends).alias("e")).where("e is not null").select("storey", "x", "z", F.col("e.x").alias("x2"), F.col("e.z").alias("z2"))
    return rooms.barrier_edges(lines, "storey", ("x", "z"), ("x2", "z2"))


@query("WITH RECURSIVE" + _BUILDING + """
    SELECT storey, face.ax::DOUBLE AS x, face.az::DOUBLE AS z, count(*) AS n, round(max(area), 4) AS area, round(max(perimeter), 4)::DOUBLE AS perimeter FROM g GROUP BY storey, face
""")
def building_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of the wall graph of each storey, over all customers."""
    return _loops(_building(spark, sf_dir))


@query("WITH RECURSIVE" + _BUILDING + """
    SELECT a.storey, a.face.ax::DOUBLE AS left_x, a.face.az::DOUBLE AS left_z, b.face.ax::DOUBLE AS right_x, b.face.az::DOUBLE AS right_z, count(*)::DOUBLE AS shared
    FROM g a JOIN g b ON a.storey = b.storey AND a.sx = b.tx AND a.sz = b.tz AND a.tx = b.sx AND a.tz = b.sz AND a.face < b.face GROUP BY a.storey, a.face, b.face
""")
def building_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring rooms and the wall they share, over all customers."""
    return _adjacency(_building(spark, sf_dir))


@query("WITH RECURSIVE" + _BUILDING + """,
    r AS (SELECT storey, face, max(area) AS area, max(perimeter) AS perimeter, greatest(max(sx) - min(sx), max(sz) - min(sz)) / least(max(sx) - min(sx), max(sz) - min(sz)) AS aspect FROM g GROUP BY storey, face),
    k AS (SELECT *, 4 * pi() * area / (perimeter * perimeter) AS compactness, (area < 0.25)::INTEGER + (aspect > 25)::INTEGER AS flags FROM r)
    SELECT storey, face.ax::DOUBLE AS x, face.az::DOUBLE AS z, round(compactness, 6) AS compactness, round(aspect, 4) AS aspect, row_number() OVER (PARTITION BY storey ORDER BY round(100 * compactness - 40 * flags, 9) DESC, face)::INTEGER AS rank FROM k
""")
def ranked_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of each storey's wall graph, the most compact first."""
    found = rooms.ranked(rooms.loops(rooms.face_cycles(rooms.half_edges(_building(spark, sf_dir)))))
    return found.select("storey", F.col("face.a.x").alias("x"), F.col("face.a.z").alias("z"), _r("compactness", 6), _r("aspect"), "rank")


from . import assembly, building, graphs, spaces  # noqa: E402, F401  they register theirs

__all__ = ["ORACLES", "QUERIES"]
