"""Queries of the building operators, on faces, rooms and designs made from the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import advice, boundaries, engineering, faces, graph, rules, scenario, stats
from .registry import query, table

NAMES = ["roof tile", "lantai keramik", "plafon gypsum", "dinding luar", "partition wall", "pintu kayu", "jendela kaca", "kolom", "balok", "tangga", "meja kursi", "block", "room boundary", "pagar", "wastafel", "void"]
SURFACES = ["floor", "wall_front", "other", "ceiling", "roof_slope", "structure"]
TEXTURES = ["glass", "oak wood", "concrete", "brick", "steel", "ceramic tile", "gypsum"]

_FACES = f"""
    f0 AS (SELECT l_suppkey AS model, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || floor(l_extendedprice * 100 + 0.5)::BIGINT AS id, list_extract({NAMES}, (l_partkey % 16 + 1)::INTEGER) AS name,
                  'Group ' || (l_partkey % 9) || '>' || list_extract({NAMES}, (l_partkey % 16 + 1)::INTEGER) || '>face' AS path,
                  list_extract({SURFACES}, ((l_partkey + l_linenumber) % 6 + 1)::INTEGER) AS surface, list_extract({TEXTURES}, (l_partkey % 7 + 1)::INTEGER) AS texture,
                  ((l_partkey * 7) % 41) * 0.5::DOUBLE AS x0, (l_orderkey % 3) * 3.0::DOUBLE + CASE WHEN l_returnflag = 'R' THEN 0.9::DOUBLE ELSE 0 END AS y0, ((l_orderkey * 3) % 37) * 0.5::DOUBLE AS z0,
                  CASE l_linenumber % 4 WHEN 0 THEN l_quantity / 5 WHEN 1 THEN l_quantity / 5 WHEN 2 THEN 0.15::DOUBLE ELSE 0.1::DOUBLE + l_tax * 2 END AS sx,
                  CASE l_linenumber % 4 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 2.8::DOUBLE WHEN 2 THEN 2.4::DOUBLE ELSE 0.3::DOUBLE + l_quantity / 20 END AS sy,
                  CASE l_linenumber % 4 WHEN 0 THEN l_quantity / 6 WHEN 1 THEN 0.15::DOUBLE WHEN 2 THEN l_quantity / 8 ELSE 0.1::DOUBLE + l_discount END AS sz,
                  3 + l_linenumber % 3 AS vertices, CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 1 ELSE 0 END AS holes FROM lineitem),
    f1 AS (SELECT *, x0 + sx AS x1, y0 + sy AS y1, z0 + sz AS z1, greatest(sx * sy, sx * sz, sy * sz) AS area FROM f0),
    f2 AS (SELECT model, id, name, path, surface, texture, x0, x1, y0, y1, z0, z1, area, vertices, holes, x1 - x0 AS sx, y1 - y0 AS sy, z1 - z0 AS sz, lower(path || ' ' || texture || ' ') AS t,
                  greatest(x1 - x0, z1 - z0) AS long, least(x1 - x0, z1 - z0) AS thin, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (z0 + z1) / 2 AS cz FROM f1),
    f AS (SELECT *, sy <= 0.08 AND sx >= 0.4 AND sz >= 0.4 AS flat,
                 CASE WHEN surface LIKE 'wall%' THEN sy >= 0.35 AND long >= 0.15 ELSE (thin <= 0.42 OR thin / greatest(long, 0.001) <= 0.08) AND sy >= 1.6 AND long >= 0.8 END AS wallish,
                 CASE WHEN regexp_matches(t, 'atap|roof|perabung|spandek|listplank|piri') THEN 'roof'
                      WHEN regexp_matches(t, 'pondasi|penggali|batu kali|batu kosong|urug|tanah|cerucuk|sloof') THEN 'foundation'
                      WHEN regexp_matches(t, '^p[0-9]|pintu|door') OR surface = 'door' THEN 'doors'
                      WHEN regexp_matches(t, '^j[0-9]|jendela|window|kusen|glass|kaca|translucent') OR surface = 'window' THEN 'windows'
                      WHEN regexp_matches(t, 'kulkas|dispenser|sofa|meja|kursi|lemari|furniture|sree') OR surface = 'furniture' THEN 'furniture'
                      WHEN regexp_matches(t, 'kolom|balok|struktur|structure|beton') OR surface = 'structure' THEN 'structure'
                      WHEN surface LIKE 'wall%' OR ((thin <= 0.42 OR thin / greatest(long, 0.001) <= 0.08) AND sy >= 1.6 AND long >= 0.8) THEN 'walls'
                      WHEN surface = 'floor' OR (sy <= 0.08 AND sx >= 0.4 AND sz >= 0.4 AND regexp_matches(t, 'lantai|floor|keramik|ubin|tile|parket|sand|ground|grass|paver|paving|brick')) THEN 'floor'
                      WHEN surface = 'ceiling' OR (sy <= 0.08 AND sx >= 0.4 AND sz >= 0.4 AND regexp_matches(t, 'plafon|ceiling|gypsum|langit')) THEN 'ceiling'
                      WHEN surface = 'roof_slope' THEN 'roof' ELSE 'other' END AS part FROM f2),
    -- a model without a floor has one level, its lowest
    lv AS (SELECT model, CASE WHEN count(*) FILTER (surface = 'floor') > 0 THEN list_sort(list(DISTINCT y0) FILTER (surface = 'floor')) ELSE [min(y0)] END AS levels FROM f GROUP BY model)
"""


def _listed(names: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))


def model_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A face of its supplier's model for every line of an order."""
    li = table(spark, sf_dir, "lineitem")
    name = _listed(NAMES, F.col("l_partkey") % 16)
    turn, q = F.col("l_linenumber") % 4, F.col("l_quantity")
    pick = lambda *v: F.when(turn == 0, v[0]).when(turn == 1, v[1]).when(turn == 2, v[2]).otherwise(v[3])
    d = li.select(
        F.col("l_suppkey").alias("model"), F.concat_ws("/", *(c.cast("string") for c in (F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.floor(F.col("l_extendedprice") * 100 + 0.5)))).alias("id"), name.alias("name"),
        F.concat(F.lit("Group "), (F.col("l_partkey") % 9).cast("string"), F.lit(">"), name, F.lit(">face")).alias("path"), F.lit(None).cast("string").alias("layer"), F.lit(None).cast("string").alias("colour"),
        _listed(SURFACES, (F.col("l_partkey") + F.col("l_linenumber")) % 6).alias("surface"), _listed(TEXTURES, F.col("l_partkey") % 7).alias("texture"),
        ((F.col("l_partkey") * 7) % 41 * 0.5).alias("x0"), ((F.col("l_orderkey") % 3) * 3.0 + F.when(F.col("l_returnflag") == "R", 0.9).otherwise(0.0)).alias("y0"), ((F.col("l_orderkey") * 3) % 37 * 0.5).alias("z0"),
        pick(q / 5, q / 5, F.lit(0.15), 0.1 + F.col("l_tax") * 2).alias("sx"), pick(F.lit(0.05), F.lit(2.8), F.lit(2.4), 0.3 + q / 20).alias("sy"), pick(q / 6, F.lit(0.15), q / 8, 0.1 + F.col("l_discount")).alias("sz"),
        (3 + F.col("l_linenumber") % 3).alias("vertices"), F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), 1).otherwise(0).alias("holes"),
    )
    area = F.greatest(F.col("sx") * F.col("sy"), F.col("sx") * F.col("sz"), F.col("sy") * F.col("sz"))
    d = d.select("*", *((F.col(f"{a}0") + F.col(f"s{a}")).alias(f"{a}1") for a in "xyz"), area.alias("area")).drop("sx", "sy", "sz")
    return d.withColumn("part", faces.part_of()).withColumn("legacy_part", F.col("part"))


def floor_levels(df: DataFrame) -> DataFrame:
    """(model, levels): the heights of a model's floors, in order; of one without floors its lowest height."""
    per = df.groupBy("model").agg(F.array_sort(F.collect_set(F.when(F.col("surface") == "floor", F.col("y0")))).alias("levels"), F.min("y0").alias("low"))
    return per.select("model", F.when(F.size("levels") > 0, F.col("levels")).otherwise(F.array("low")).alias("levels"))


@query("WITH" + _FACES + """
    SELECT id, part, CASE WHEN regexp_matches(name, '^p[0-9]|pintu|door') THEN 'doors' WHEN regexp_matches(name, '^j[0-9]|jendela|window') THEN 'windows' WHEN regexp_matches(name, 'atap|perabung|spandek|listplank') THEN 'roof_elements'
                         WHEN regexp_matches(name, 'bata|plester|dinding|wall') THEN 'wall_elements' WHEN regexp_matches(name, 'kulkas|dispenser|sofa|meja|kursi|lemari|furniture|sree') THEN 'furniture'
                         WHEN regexp_matches(name, 'kolom|balok|sloof|cerucuk|pondasi|struktur|structure') THEN 'structural' END AS name_kind,
           surface LIKE 'wall%' AND sy >= 0.18 AND (long <= 1.6 OR thin <= 0.08) AND (part IN ('doors', 'windows') OR regexp_matches(t, 'glass|kaca|translucent|window|jendela|door|pintu|kusen|wood|cherry|frame|aluminium|aluminum|metal|material11')) AS opening,
           CASE WHEN (part = 'windows' OR glazed) AND on_floor AND sy BETWEEN 1.55 AND 3.8 THEN 'doors' WHEN glazed THEN 'windows'
                WHEN surface IN ('floor', 'ceiling') AND flat THEN CASE WHEN regexp_matches(t, 'plafon|ceiling|gypsum|langit') THEN 'ceiling' WHEN regexp_matches(t, 'lantai|floor|keramik|ubin|tile|parket|sand|ground|grass|paver|paving|brick') THEN 'floor'
                     WHEN list_min(list_transform(levels, lambda v: abs(cy - v))) <= 0.35 THEN 'floor' WHEN cy - list_max(list_filter(levels, lambda v: v <= cy + 0.2)) BETWEEN 2 AND 4.2 THEN 'ceiling' ELSE part END
                ELSE part END AS refined,
           CASE WHEN regexp_matches(path, 'gudang|storage') THEN 'gudang' WHEN area > 35 THEN 'retail' WHEN area < 8 THEN 'servis' ELSE 'kantor' END AS use
    FROM (SELECT f.*, levels, surface LIKE 'wall%' AND sy >= 0.35 AND sy <= 4.5 AND long <= 12 AND regexp_matches(t, 'glass|kaca|translucent|window|jendela|door|pintu|kusen|wood|cherry') AS glazed,
                 coalesce(list_min(list_transform(list_filter(list_transform(levels, lambda v: y0 - v), lambda d: d >= -0.35), lambda d: abs(d))) <= 0.65, false) AS on_floor FROM f JOIN lv USING (model))
""")
def face_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of faces by name, material, shape and storey."""
    f = model_faces(spark, sf_dir)
    f = f.join(floor_levels(f), "model")
    return f.select("id", "part", faces.kind_of_name("name").alias("name_kind"), faces.is_opening_candidate().alias("opening"), faces.refined_part("levels").alias("refined"), faces.suggested_use("path", "area").alias("use"))


_BANK_ROWS = ", ".join(f"('{r['rule_id']}', '{r['category']}', {r['base']}::DOUBLE, {r['threshold']}::DOUBLE, '{k}', {w}::DOUBLE)" for r in faces.RULE_BANK for k, w in r["signals"].items())
_ALL_ROWS = ", ".join(f"('{r['rule_id']}', '{k}')" for r in faces.RULE_BANK for k in r.get("required_all", []))
_ANY_ROWS = ", ".join(f"('{r['rule_id']}', '{k}')" for r in faces.RULE_BANK for k in r.get("required_any", []))
_LABEL_ROWS = ", ".join(f"('label.{k}', '\\b({w})\\b')" for k, w in faces.LABELS.items())
_MATERIAL_ROWS = ", ".join(f"('material.{k}', '\\b({w})\\b')" for k, w in faces.MATERIALS.items())

_CLASSIFIED = "WITH" + _FACES + f""",
    b AS (SELECT model, min(x0) AS mx0, max(x1) AS mx1, min(y0) AS my0, max(y1) AS my1, min(z0) AS mz0, max(z1) AS mz1 FROM f GROUP BY model),
    g AS (SELECT f.*, b.* EXCLUDE (model), coalesce(levels, [my0]) AS levels, count(*) OVER (PARTITION BY f.model, f.name) AS times, name || ' ' || path AS label_text,
                 surface IN ('floor', 'ceiling') OR (sy <= long * 0.08 AND long > 0.2) AS level, surface LIKE 'wall%' OR sy >= greatest(thin * 1.8, 0.4) AS upright,
                 floor(cx / 2) AS gx, floor(cz / 2) AS gz FROM f JOIN b ON b.model = f.model LEFT JOIN lv ON lv.model = f.model),
    h AS (SELECT *, y0 - list_extract(list_sort(list_transform(levels, lambda v: {{'d': abs(y0 - v), 'v': v}})), 1).v AS above, list_max(list_filter(levels, lambda v: v < cy - 0.5)) AS below,
                 abs(x0 - mx0) <= greatest(0.3, greatest(mx1 - mx0, mz1 - mz0) * 0.04) OR abs(x1 - mx1) <= greatest(0.3, greatest(mx1 - mx0, mz1 - mz0) * 0.04)
                 OR abs(z0 - mz0) <= greatest(0.3, greatest(mx1 - mx0, mz1 - mz0) * 0.04) OR abs(z1 - mz1) <= greatest(0.3, greatest(mx1 - mx0, mz1 - mz0) * 0.04) AS edge FROM g),
    lab(key, pattern) AS (VALUES {_LABEL_ROWS}), mat(key, pattern) AS (VALUES {_MATERIAL_ROWS}),
    said AS (SELECT model, id, key FROM h JOIN lab ON regexp_matches(label_text, pattern)),
    e AS (SELECT model, id, key, 1.0::DOUBLE AS strength FROM said
      UNION ALL SELECT model, id, 'label.conflict', 1 FROM said GROUP BY model, id HAVING count(*) > 1
      UNION ALL SELECT model, id, 'label.wall', 1 FROM h WHERE regexp_matches(label_text, '\\b(dinding|wall)\\b')
      UNION ALL SELECT model, id, key, 1 FROM h JOIN mat ON regexp_matches(CASE WHEN key = 'material.roofing' THEN texture || ' ' || label_text ELSE texture END, pattern) OR (key = 'material.structural' AND surface = 'structure')
      UNION ALL SELECT model, id, 'surface.' || CASE surface WHEN 'roof_slope' THEN 'roof' WHEN 'wall_front' THEN 'wall' ELSE surface END, 1 FROM h WHERE surface IN ('roof_slope', 'floor', 'ceiling', 'wall_front')
      UNION ALL SELECT model, id, 'orientation.horizontal', 1 FROM h WHERE level UNION ALL SELECT model, id, 'orientation.vertical', 1 FROM h WHERE upright
      UNION ALL SELECT model, id, 'geometry.large', greatest(least(area / 40, 1), 0.55) FROM h WHERE area >= 8
      UNION ALL SELECT model, id, 'geometry.small', 1 FROM h WHERE area <= 4 AND greatest(sx, sy, sz) <= 3
      UNION ALL SELECT model, id, 'geometry.opening_sized', 1 FROM h WHERE upright AND long BETWEEN 0.25 AND 4.5 AND sy BETWEEN 0.4 AND 3.5 AND area <= 14
      UNION ALL SELECT model, id, 'shape.tall_slender', 1 FROM h WHERE sy >= 2 AND thin <= 0.8 AND sy / greatest(long, 0.1) >= 1.2
      UNION ALL SELECT model, id, 'shape.long_horizontal', 1 FROM h WHERE long >= 3 AND sy <= 0.8 AND thin <= 0.8
      UNION ALL SELECT model, id, 'shape.thin_linear', 1 FROM h WHERE long >= 2.5 AND thin <= 0.2 AND sy BETWEEN 0.5 AND 2.5
      UNION ALL SELECT model, id, 'shape.thin_frame', 1 FROM h WHERE upright AND long <= 0.22 AND sy BETWEEN 0.4 AND 3.5 AND area <= 1
      UNION ALL SELECT model, id, 'shape.stepped_volume', 1 FROM h WHERE sy >= 1 AND long >= 2 AND thin >= 1
      UNION ALL SELECT model, id, 'geometry.room_sized', 1 FROM h WHERE level AND area >= 4 AND long >= 1.5
      UNION ALL SELECT model, id, 'topology.enclosed_polygon', 0.8 FROM h WHERE vertices >= 4 UNION ALL SELECT model, id, 'topology.hole', 1 FROM h WHERE holes > 0
      UNION ALL SELECT model, id, 'elevation.touches_floor', 1 FROM h WHERE abs(above) <= 0.25 UNION ALL SELECT model, id, 'elevation.above_floor', 1 FROM h WHERE above > 0.35
      UNION ALL SELECT model, id, 'elevation.floor_level', 1 FROM h WHERE len(list_filter(levels, lambda v: abs(cy - v) <= 0.25)) > 0
      UNION ALL SELECT model, id, 'elevation.ceiling_height', 1 FROM h WHERE cy - below BETWEEN 2 AND 4.5
      UNION ALL SELECT model, id, 'elevation.top', 1 FROM h WHERE cy >= my0 + greatest(my1 - my0, 0.1) * 0.72
      UNION ALL SELECT model, id, CASE WHEN edge THEN 'context.perimeter' ELSE 'context.interior' END, 1 FROM h
      UNION ALL SELECT model, id, 'reuse.repeated', greatest(least(times / 8, 1), 0.6) FROM h WHERE times >= 3
      UNION ALL SELECT model, id, 'legacy.' || CASE part WHEN 'doors' THEN 'door' WHEN 'windows' THEN 'window' WHEN 'walls' THEN 'wall' ELSE part END, 0.65 FROM h
      UNION ALL SELECT model, id, 'context.wall_host', 1 FROM h a WHERE EXISTS (SELECT 1 FROM h w WHERE w.model = a.model AND w.id <> a.id AND w.surface LIKE 'wall%' AND w.area >= 8
          AND floor(w.x0 / 2) <= a.gx + 1 AND floor(w.x1 / 2) >= a.gx - 1 AND floor(w.z0 / 2) <= a.gz + 1 AND floor(w.z1 / 2) >= a.gz - 1
          AND least(a.y1, w.y1) - greatest(a.y0, w.y0) >= 0.2 AND greatest(a.x0, w.x0) - least(a.x1, w.x1) <= 0.3 AND greatest(a.z0, w.z0) - least(a.z1, w.z1) <= 0.3)
      UNION ALL SELECT model, id, 'context.opening_cluster', 1 FROM h a WHERE EXISTS (SELECT 1 FROM h w WHERE w.model = a.model AND w.id <> a.id
          AND (regexp_matches(w.name || ' ' || w.path || ' ' || w.texture, '\\b(window|jendela|glass|kaca|glazing|fenestration|translucent)\\b') OR w.part = 'windows')
          AND abs(w.gx - a.gx) <= 1 AND abs(w.gz - a.gz) <= 1 AND greatest(a.y0, w.y0) - least(a.y1, w.y1) <= 0.35
          AND sqrt(greatest(0, greatest(a.x0, w.x0) - least(a.x1, w.x1)) ** 2 + greatest(0, greatest(a.z0, w.z0) - least(a.z1, w.z1)) ** 2) <= 1.2)),
    bank(rule_id, category, base, threshold, key, weight) AS (VALUES {_BANK_ROWS}), every(rule_id, key) AS (VALUES {_ALL_ROWS}), anyone(rule_id, key) AS (VALUES {_ANY_ROWS}),
    need AS (SELECT rule_id, count(*) AS n FROM every GROUP BY 1),
    has_all AS (SELECT model, id, every.rule_id, count(*) AS n FROM e JOIN every USING (key) GROUP BY 1, 2, 3),
    has_any AS (SELECT DISTINCT model, id, anyone.rule_id FROM e JOIN anyone USING (key)),
    ok AS (SELECT model, id, rule_id FROM has_all JOIN need USING (rule_id, n) UNION ALL SELECT model, id, rule_id FROM has_any),
    scored AS (SELECT ok.model, ok.id, rule_id, any_value(category) AS category, any_value(threshold) AS threshold, greatest(0, least(1, any_value(base) + sum(coalesce(strength, 0) * weight))) AS score
               FROM ok JOIN bank USING (rule_id) LEFT JOIN e ON e.model = ok.model AND e.id = ok.id AND e.key = bank.key GROUP BY 1, 2, 3),
    best AS (SELECT *, row_number() OVER (PARTITION BY model, id, category ORDER BY round(score, 9) DESC, rule_id) AS k FROM scored WHERE score > 0),
    ranked AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS next FROM best WHERE k = 1 WINDOW w AS (PARTITION BY model, id ORDER BY round(score, 9) DESC, category)),
    top AS (SELECT f.model, f.id, f.label, category, rule_id, coalesce(score, 0) AS score, threshold, next, coalesce(score - coalesce(next, 0), 0) AS margin, c.id IS NOT NULL AS torn
            FROM (SELECT model, id, CASE WHEN (SELECT count(*) FROM said s WHERE s.model = f.model AND s.id = f.id) = 1 THEN (SELECT max(key) FROM said s WHERE s.model = f.model AND s.id = f.id) END AS label FROM f) f
            LEFT JOIN ranked r ON r.model = f.model AND r.id = f.id AND r.n = 1 LEFT JOIN e c ON c.model = f.model AND c.id = f.id AND c.key = 'label.conflict'),
    verdict AS (SELECT *, coalesce(round(score, 9) >= threshold AND (next IS NULL OR round(margin, 9) >= CASE WHEN torn THEN 0.18 ELSE 0.08 END), false) AS sure FROM top)
"""


@query(_CLASSIFIED + """
    SELECT id, CASE WHEN sure THEN category ELSE 'unknown' END AS category, round(score, 6) AS score, round(margin, 6) + 0 AS margin, CASE WHEN sure THEN rule_id END AS rule_id,
           round(CASE WHEN sure THEN score ELSE greatest(0.25, least(0.9, 1 - 0.6 * score)) END, 6) AS confidence FROM verdict
""")
def classify_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every face classified by the rule bank over its evidence."""
    f = model_faces(spark, sf_dir)
    out = faces.classified(f, floor_levels(f))
    return out.select("id", "category", F.round("score", 6).alias("score"), (F.round("margin", 6) + 0.0).alias("margin"), "rule_id", F.round("confidence", 6).alias("confidence"))


@query(_CLASSIFIED + """,
    r AS (SELECT replace(label, 'label.', '') AS t, CASE WHEN sure THEN category ELSE 'unknown' END AS p, next IS NOT NULL AND round(margin, 9) < 0.08 AS contested FROM verdict WHERE label IS NOT NULL),
    c AS (SELECT DISTINCT t FROM r),
    m AS (SELECT t, (SELECT count(*) FROM r WHERE r.t = c.t AND p = c.t) AS tp, (SELECT count(*) FROM r WHERE r.t = c.t) AS support, (SELECT count(*) FROM r WHERE p = c.t) AS predicted FROM c)
    SELECT (SELECT count(*) FROM r) AS n, round((SELECT avg((t = p)::INTEGER) FROM r), 6) AS accuracy, round(avg(CASE WHEN tp > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END), 6) AS macro_f1,
           round((SELECT avg((p = 'unknown')::INTEGER) FROM r), 6) AS unknown_rate, round((SELECT avg(contested::INTEGER) FROM r), 6) AS ambiguous_rate FROM m
""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the classification agrees with explicit labels, where a face has just one."""
    f = model_faces(spark, sf_dir)
    said = f.select(F.col("name").alias("_name"), F.col("path").alias("_path")).distinct()
    truth = rules.exactly_one(text.metadata_text(F.concat_ws(" ", "_name", "_path")), {k: rf"\b({w})\b" for k, w in faces.LABELS.items()})
    said = graph.settled(said.withColumn("truth", truth)).where("truth is not null")
    f = f.join(said, f["name"].eqNullSafe(said["_name"]) & f["path"].eqNullSafe(said["_path"]), "left").drop("_name", "_path")
    rows = faces.classified(f, floor_levels(f), ["truth"]).where("truth is not null")
    return stats.classification_report(rows, "truth", "category", F.col("contested"))


@query("WITH" + _FACES + """,
    rooms AS (SELECT * FROM f WHERE part = 'floor' AND flat),
    k AS (SELECT r.model, r.id, w.id AS wid, w.y0, w.y1, (r.y0 + r.y1) / 2 AS fy, w.y1 - (r.y0 + r.y1) / 2 AS up, w.sy AS sy,
                 greatest(least(r.sx, r.sz) * 0.08, 0.45) AS reach, least(abs(w.cx - r.x0), abs(w.cx - r.x1)) AS xe, least(abs(w.cz - r.z0), abs(w.cz - r.z1)) AS ze,
                 greatest(0, least(r.z1, w.z1) - greatest(r.z0, w.z0)) / greatest(least(r.sz, w.sz), 0.001) AS zo, greatest(0, least(r.x1, w.x1) - greatest(r.x0, w.x0)) / greatest(least(r.sx, w.sx), 0.001) AS xo,
                 w.sx AS wx, w.sz AS wz, greatest(0, least(r.x1, w.x1) - greatest(r.x0, w.x0)) * greatest(0, least(r.z1, w.z1) - greatest(r.z0, w.z0)) / greatest(w.sx * w.sz, 0.001) AS inside
          FROM rooms r JOIN f w ON w.model = r.model AND w.part = 'walls' AND w.sy BETWEEN 1.8 AND 6.8),
    h AS (SELECT model, id, wid, greatest(1.8, least(6.8, CASE WHEN up > 1.8 AND up <= 6.8 THEN up ELSE sy END)) AS h FROM k
          WHERE (abs(y0 - fy) <= 0.9 OR (y0 <= fy + 0.45 AND y1 >= fy + 1.8))
            AND greatest(CASE WHEN wz >= wx AND xe <= reach THEN zo ELSE 0 END, CASE WHEN wx >= wz AND ze <= reach THEN xo ELSE 0 END, inside * 0.35) > 0.12),
    w AS (SELECT model, id, greatest(2.1, least(6.5, list_extract(list_sort(list(h)), (count(*) // 2 + 1)::INTEGER))) AS height FROM h GROUP BY 1, 2),
    c AS (SELECT r.model, r.id, f.cy - r.cy AS rise, CASE WHEN f.surface = 'ceiling' THEN 0.35 ELSE 0 END + CASE WHEN f.part = 'ceiling' THEN 0.25 WHEN f.part = 'roof' THEN 0.08 ELSE 0 END
                 + greatest(0, least(r.x1, f.x1) - greatest(r.x0, f.x0)) * greatest(0, least(r.z1, f.z1) - greatest(r.z0, f.z0)) / greatest(r.sx * r.sz, r.area, 1) - greatest(0, f.cy - r.cy - 3) * 0.05 AS score,
                 greatest(0, least(r.x1, f.x1) - greatest(r.x0, f.x0)) * greatest(0, least(r.z1, f.z1) - greatest(r.z0, f.z0)) / greatest(r.sx * r.sz, r.area, 1) AS share
          FROM rooms r JOIN f ON f.model = r.model AND f.id <> r.id AND (f.surface IN ('ceiling', 'floor', 'roof_slope') OR f.part IN ('ceiling', 'roof')) WHERE f.cy - r.cy BETWEEN 2 AND 6.5),
    d AS (SELECT model, id, greatest(2.1, least(6.5, arg_min(rise, {'a': -score, 'b': rise}))) AS height FROM c WHERE share >= 0.58 GROUP BY 1, 2)
    SELECT rooms.id, round(coalesce(w.height, d.height, 3.2), 4) AS height, CASE WHEN w.height IS NOT NULL THEN 'walls' WHEN d.height IS NOT NULL THEN 'cover' ELSE 'fallback' END AS by
    FROM rooms LEFT JOIN w ON w.model = rooms.model AND w.id = rooms.id LEFT JOIN d ON d.model = rooms.model AND d.id = rooms.id
""")
def room_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of rooms from the walls beside them, else from what covers them."""
    f = model_faces(spark, sf_dir)
    rooms = f.where((F.col("part") == "floor") & faces.is_flat())
    return faces.room_heights(rooms, f, 3.2).select("id", F.round("height", 4).alias("height"), "by")


@query("WITH RECURSIVE" + _FACES + """,
    s AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY area DESC, id) AS r FROM f WHERE flat AND surface IN ('floor', 'ceiling')),
    k AS (SELECT model, r, [{'id': id, 'cy': cy, 'area': area, 'x0': x0, 'x1': x1, 'z0': z0, 'z1': z1}] AS kept FROM s WHERE r = 1
          UNION ALL SELECT s.model, s.r, CASE WHEN len(list_filter(kept, lambda o: abs(o.cy - s.cy) <= 0.1 AND abs(o.area - s.area) / greatest(o.area, s.area, 0.001) <= 0.15
              AND greatest(0, least(o.x1, s.x1) - greatest(o.x0, s.x0)) * greatest(0, least(o.z1, s.z1) - greatest(o.z0, s.z0)) / greatest(least((o.x1 - o.x0) * (o.z1 - o.z0), (s.x1 - s.x0) * (s.z1 - s.z0)), 0.001) >= 0.92)) > 0
              THEN kept ELSE list_append(kept, {'id': s.id, 'cy': s.cy, 'area': s.area, 'x0': s.x0, 'x1': s.x1, 'z0': s.z0, 'z1': s.z1}) END FROM k JOIN s ON s.model = k.model AND s.r = k.r + 1),
    l AS (SELECT model, arg_max(kept, r) AS kept FROM k GROUP BY model)
    SELECT model, unnest(kept).id AS id FROM l
""")
def distinct_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat faces without those that repeat a larger one of their model."""
    f = model_faces(spark, sf_dir).where(faces.is_flat() & F.col("surface").isin("floor", "ceiling"))
    pairs = boundaries.like_surfaces(f, ["model"], 0.1)
    ranked = f.select("model", "id", F.struct(-F.col("area"), "id").alias("rank"))
    return boundaries.kept_in_order(ranked, pairs, "id", "rank").select("model", "id")


@query("WITH" + _FACES + """,
    rooms AS (SELECT * FROM f WHERE part = 'floor' AND flat),
    s AS (SELECT model, id, 'z' AS axis, x0 AS plane, z0 AS lo, z1 AS hi FROM rooms UNION ALL SELECT model, id, 'z', x1, z0, z1 FROM rooms UNION ALL SELECT model, id, 'x', z0, x0, x1 FROM rooms UNION ALL SELECT model, id, 'x', z1, x0, x1 FROM rooms),
    w AS (SELECT model, unnest([{'axis': 'z', 'plane': cx, 'lo': z0, 'hi': z1}, {'axis': 'x', 'plane': cz, 'lo': x0, 'hi': x1}]) AS u FROM f WHERE part = 'walls'),
    i AS (SELECT s.id, s.axis, s.plane, greatest(u.lo, s.lo) AS a, least(u.hi, s.hi) AS b FROM s JOIN w ON w.model = s.model AND u.axis = s.axis AND abs(u.plane - s.plane) <= 0.3 AND least(u.hi, s.hi) > greatest(u.lo, s.lo)),
    m AS (SELECT *, max(b) OVER (PARTITION BY id, axis, plane ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
    n AS (SELECT id, sum(greatest(0, b - greatest(a, coalesce(reach, a)))) AS covered FROM m GROUP BY 1),
    p AS (SELECT id, sum(hi - lo) AS perimeter FROM s GROUP BY 1)
    SELECT id, round(perimeter, 4) AS perimeter, round(least(1, coalesce(covered, 0) / perimeter), 6) AS coverage FROM p LEFT JOIN n USING (id)
""")
def wall_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each floor's outline walls cover."""
    # floors are read twice and walls once, and a face's part takes longer than all that follows
    sought = F.col("part").isin("walls", "floor")
    f = graph.settled(model_faces(spark, sf_dir).where(sought).select("model", "id", "part", *(f"{a}{e}" for a in "xyz" for e in "01")))
    rooms = f.where((F.col("part") == "floor") & faces.is_flat())
    corner = lambda x, z: F.struct(F.col(x).alias("x"), F.col(z).alias("z"))
    outline = rooms.select("model", "id", F.array(corner("x0", "z0"), corner("x1", "z0"), corner("x1", "z1"), corner("x0", "z1")).alias("p"))
    sides = boundaries.segments(outline, ["model", "id"], "p")
    line = lambda axis, across, run: F.struct(F.lit(axis).alias("axis"), ((F.col(f"{across}0") + F.col(f"{across}1")) / 2).alias("plane"), F.col(f"{run}0").alias("lo"), F.col(f"{run}1").alias("hi"))
    walls = f.where("part = 'walls'").select("model", F.explode(F.array(line("z", "x", "z"), line("x", "z", "x"))).alias("w")).select("model", "w.*")
    out = boundaries.coverage(sides, walls, ["model"], ["id"], 0.3)
    return out.select("id", F.round("perimeter", 4).alias("perimeter"), F.round("coverage", 6).alias("coverage"))


@query("WITH" + _FACES + """,
    rooms AS (SELECT * FROM f WHERE part = 'floor' AND flat),
    s AS (SELECT model, id, 'z' AS axis, x0 AS plane, z0 AS lo, z1 AS hi FROM rooms UNION ALL SELECT model, id, 'z', x1, z0, z1 FROM rooms UNION ALL SELECT model, id, 'x', z0, x0, x1 FROM rooms UNION ALL SELECT model, id, 'x', z1, x0, x1 FROM rooms),
    p AS (SELECT a.model, a.id AS a, b.id AS b, a.axis, abs(a.plane - b.plane) AS gap, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap FROM s a JOIN s b ON a.model = b.model AND a.axis = b.axis AND a.id < b.id
          WHERE abs(a.plane - b.plane) <= 0.123 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 0.2)
    SELECT model, a AS room, b AS other, round(max(overlap), 4) AS overlap FROM p GROUP BY model, a, b
""")
def shared_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms of a model whose outlines run along each other, and the longest stretch."""
    f = model_faces(spark, sf_dir)
    corner = lambda x, z: F.struct(F.col(x).alias("x"), F.col(z).alias("z"))
    rooms = graph.settled(f.where((F.col("part") == "floor") & faces.is_flat()).select("model", "id", "x0", "x1", "z0", "z1"))
    outline = rooms.select("model", "id", F.array(corner("x0", "z0"), corner("x1", "z0"), corner("x1", "z1"), corner("x0", "z1")).alias("p"))
    out = boundaries.shared_boundaries(boundaries.segments(outline, ["model", "id"], "p"), ["model"], "id", 0.123)
    return out.select("model", F.col("left").alias("room"), F.col("right").alias("other"), F.round("overlap", 4).alias("overlap"))


@query("""
    WITH p AS (SELECT DISTINCT c_nationkey AS k, c_acctbal AS x, (c_custkey * 37 % 1009)::DOUBLE AS z FROM customer),
    e AS (SELECT a.k, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM p a JOIN p b ON a.k = b.k AND (a.x <> b.x OR a.z <> b.z)),
    o AS (SELECT e.k, ax, az, bx, bz FROM e JOIN p ON p.k = e.k GROUP BY 1, 2, 3, 4, 5 HAVING min((bx - ax) * (p.z - az) - (bz - az) * (p.x - ax)) >= 0)
    SELECT k AS c_nationkey, count(*) AS corners, round(abs(sum(ax * bz - bx * az)), 2) AS twice_area FROM o GROUP BY 1
""")
def customer_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex hulls of a nation's customers in a plan of balance and place."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 37 % 1009).cast("double").alias("z"))
    hull = boundaries.convex_hulls(c, ["c_nationkey"], "x", "z")
    ring = hull.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("place", "x", "z"))).alias("p"))
    from ..functions import geometry

    return ring.select("c_nationkey", F.size("p").cast("long").alias("corners"), F.round(2 * geometry.area("p"), 2).alias("twice_area"))


@query("""
    WITH o AS (SELECT l_orderkey AS room, l_quantity / 8 AS area, ((l_partkey * 7) % 360)::DOUBLE AS dir, l_linenumber * 0.5::DOUBLE AS sill, l_linenumber * 0.5::DOUBLE + 1.2 + l_tax * 10 AS head FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity / 8 > 0.1),
    x AS (SELECT DISTINCT a.room FROM o a JOIN o b ON a.room = b.room AND least(abs(a.dir - b.dir), 360 - abs(a.dir - b.dir)) > 45),
    p AS (SELECT room, count(*) AS n, sum(area) AS total, max(area) AS a1, max(head) - min(sill) AS rise, min(least(abs(dir - 180), 360 - abs(dir - 180))) AS away FROM o GROUP BY 1),
    r AS (SELECT o_orderkey AS room, o_totalprice / 1000 AS volume, o_custkey % 5 = 0 AS stairs, p.*, x.room IS NOT NULL AS across FROM orders LEFT JOIN p ON p.room = o_orderkey LEFT JOIN x ON x.room = o_orderkey),
    k AS (SELECT *, CASE WHEN n IS NULL THEN 'no_exterior_ventilation' WHEN across THEN 'cross_ventilation' WHEN (rise > 2.5 OR stairs) AND n > 1 THEN 'stack_assisted' ELSE 'single_sided' END AS kind,
                 coalesce(CASE WHEN across AND n >= 2 THEN sqrt(2.0) * a1 * (total - a1) / sqrt(a1 * a1 + (total - a1) * (total - a1)) ELSE total * 0.5 END, 0) AS a FROM r),
    q AS (SELECT *, floor(greatest(0.6 * a * 2.5, 0.65 * a * sqrt(2 * 9.81 * coalesce(rise, 0) * abs(24.0 - 33.0) / (33 + 273.15))) * 100 + 0.5) / 100 AS flow FROM k)
    SELECT room AS o_orderkey, kind, floor(a * 100 + 0.5) / 100 AS effective_area, flow, floor(flow * 3600 / greatest(1, volume) * 10 + 0.5) / 10 AS air_changes,
           CASE WHEN away <= 45 THEN 'windward' WHEN away >= 135 THEN 'leeward' WHEN away IS NOT NULL THEN 'parallel' ELSE 'unknown' END AS wind_side FROM q
""")
def ventilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural ventilation with orders as rooms and their lines as openings."""
    rooms = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("volume"), F.when(F.col("o_custkey") % 5 == 0, "staircase").otherwise("living").alias("use"))
    sill = F.col("l_linenumber") * 0.5
    o = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") / 8).alias("area"), ((F.col("l_partkey") * 7) % 360).cast("double").alias("direction"), sill.alias("sill"), (sill + 1.2 + F.col("l_tax") * 10).alias("head"))
    return engineering.ventilation(rooms, o, "o_orderkey", "volume", 24.0, 33.0, 2.5, 180.0, use="use")


_USES = {"1-URGENT": "office", "2-HIGH": "kitchen", "3-MEDIUM": "bedroom", "4-NOT SPECIFIED": "nowhere", "5-LOW": "corridor"}
_PROFILE_ROWS = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in (k, *row)) + ")" for k, row in engineering.USE_PROFILES.items())


def _use(c: str) -> Column:
    return F.create_map(*(F.lit(x) for kv in _USES.items() for x in kv))[F.col(c)]


@query(f"""
    WITH p(use, lux, plane, apa, sens, lat, equip, light, met, clo, ach, method) AS (VALUES {_PROFILE_ROWS}),
    r AS (SELECT o_orderkey AS room, CASE o_orderpriority WHEN '1-URGENT' THEN 'office' WHEN '2-HIGH' THEN 'kitchen' WHEN '3-MEDIUM' THEN 'bedroom' WHEN '5-LOW' THEN 'corridor' ELSE 'unassigned' END AS use, o_totalprice / 5000 AS area, o_custkey % 6 AS people FROM orders),
    s AS (SELECT l_orderkey AS room, sum(CASE WHEN l_linenumber <= 2 THEN l_quantity * coalesce(nullif(l_tax * 50, 0), 2.8) * 15 WHEN l_linenumber = 3 THEN l_quantity * coalesce(nullif(l_tax * 50, 0), 2.8) * 21 ELSE l_quantity * coalesce(nullif(l_tax * 50, 0), 2.8) * 6 END) AS env,
                 coalesce(sum(l_quantity / 10) FILTER (l_returnflag = 'R'), 0) AS glass FROM lineitem GROUP BY 1),
    c AS (SELECT l_orderkey AS room, sum(l_quantity * 10 * l_linenumber) AS machines FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
    l AS (SELECT room, greatest(people, 1) * 1.0 AS n, area, coalesce(env, 0) AS env, coalesce(glass, 0) AS glass, coalesce(machines, 0) AS machines, p.* FROM (SELECT r.*, env, glass, machines FROM r LEFT JOIN s USING (room) LEFT JOIN c USING (room)) JOIN p USING (use)),
    t AS (SELECT room, env, glass * 5.8 * 9 AS gc, glass * 0.81 * 0.7 * 350 AS gs, n * sens AS ps, n * lat AS pl, area * light * 1.2 AS li, area * equip + machines AS eq, 1200.0 * (n * 0.008 + area * 0.0003) * 9 AS vs, 3000.0 * (n * 0.008 + area * 0.0003) * (10 * 0.00015) AS vl FROM l),
    u AS (SELECT *, floor((env + gc + gs + ps + li + eq + vs) * 10 + 0.5) / 10 AS sensible, floor((pl + vl) * 10 + 0.5) / 10 AS latent FROM t)
    SELECT room AS o_orderkey, floor(env + 0.5) AS envelope, floor(gs + 0.5) AS sun, floor(vs + vl + 0.5) AS air, sensible, latent, round(sensible + latent, 1) AS total, round((sensible + latent) * 1.15, 0) AS watts FROM u
""")
def cooling_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the cooling load with orders as rooms and their lines as surfaces and windows."""
    rooms = table(spark, sf_dir, "orders").select("o_orderkey", _use("o_orderpriority").alias("use"), (F.col("o_totalprice") / 5000).alias("area"), (F.col("o_custkey") % 6).alias("people"))
    li = table(spark, sf_dir, "lineitem")
    role = F.when(F.col("l_linenumber") <= 2, "exterior_wall").when(F.col("l_linenumber") == 3, "ceiling").otherwise("floor")
    surfaces = li.select(F.col("l_orderkey").alias("o_orderkey"), role.alias("role"), F.col("l_quantity").alias("area"), (F.col("l_tax") * 50).alias("u"))
    windows = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") / 10).alias("area"))
    components = li.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity") * 10).alias("load"), F.col("l_linenumber").alias("count"))
    out = engineering.cooling_loads(rooms, surfaces, windows, "o_orderkey", 33.0 - 24.0, components=components)
    return out.select("o_orderkey", "envelope", "sun", "air", "sensible", "latent", F.round("total", 1).alias("total"), F.round("watts", 0).alias("watts"))


@query(f"""
    WITH p(use, lux, plane, apa, sens, lat, equip, light, met, clo, ach, method) AS (VALUES {_PROFILE_ROWS}),
    r AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'office' WHEN '2-HIGH' THEN 'kitchen' WHEN '3-MEDIUM' THEN 'bedroom' WHEN '5-LOW' THEN 'corridor' END AS use, (o_custkey % 10) / 10 AS conf, o_custkey % 3 AS cands, o_orderstatus = 'F' AS win, o_custkey % 4 = 0 AS ac FROM orders)
    SELECT o_orderkey, lux::INTEGER AS lux, plane AS work_plane, CASE WHEN r.use IS NULL THEN 'generic_default' WHEN conf < 0.6 OR cands > 1 THEN 'uncertain_fallback' ELSE 'direct_match' END AS applicability,
           CASE WHEN method = 'adaptive' OR (method = 'both' AND win AND NOT ac) THEN 'adaptive' ELSE 'mechanical' END AS comfort_method
    FROM r JOIN p ON p.use = coalesce(r.use, 'unassigned')
""")
def room_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target light and method of comfort by use."""
    use = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", _use("o_orderpriority"))
    rooms = table(spark, sf_dir, "orders").select("o_orderkey", use.alias("use"), ((F.col("o_custkey") % 10) / 10).alias("confidence"), (F.col("o_custkey") % 3).alias("candidates"), (F.col("o_orderstatus") == "F").alias("window"), (F.col("o_custkey") % 4 == 0).alias("ac"))
    out = engineering.illuminance(rooms, "use", "confidence", "candidates")
    return out.select("o_orderkey", F.col("p_lux").alias("lux"), F.col("p_work_plane").alias("work_plane"), "applicability", engineering.comfort_method("p_comfort", F.col("window"), F.col("ac")).alias("comfort_method"))


@query("""
    WITH n AS (SELECT c_nationkey, count(*) AS rooms, sum(abs(c_acctbal)) / 100 AS wall, sum(abs(c_acctbal)) / 150 AS roof, sum(abs(c_acctbal)) / 50 AS floor, (c_nationkey * 30 % 91)::DOUBLE AS glass, (c_nationkey * 47 % 360)::DOUBLE AS deg, c_nationkey % 7 AS doors FROM customer GROUP BY c_nationkey),
    o AS (SELECT *, (greatest(wall - wall * glass / 100, 0) * 2.3 * 0.55 * 12 + wall * glass / 100 * 5.8 * 5 + wall * glass / 100 * 0.78 * 194 * (0.72 + abs(sin(deg * pi() / 180)) * 0.42)) / greatest(wall, 1) AS ottv,
                 100 - greatest(0, least(92, greatest(0, least(100, (roof * 4.8 * 0.72 + wall * 2.3 * 0.55) / greatest(floor, 1))) * 2.4)) AS comfort,
                 greatest(0, least(100, (doors * 18 + greatest(1, floor(floor / 4)) * 3) / 180)) AS people,
                 greatest(0, least(100, (0.35 + abs(cos((90 - deg) * pi() / 180)) * 0.4 + greatest(0.1, least(1, doors / 8)) * 0.25) * 100)) AS wind FROM n)
    SELECT c_nationkey, round(ottv, 4) AS ottv, CASE WHEN ottv <= 35 THEN 'good' WHEN ottv <= 45 THEN 'warn' ELSE 'bad' END AS ottv_grade, round(comfort, 4) AS comfort, round(people, 4) AS people, round(wind, 4) AS wind,
           CASE WHEN wind > 70 THEN 'good' WHEN wind > 45 THEN 'warn' ELSE 'bad' END AS wind_grade, CASE WHEN doors = 0 THEN 'blocked' WHEN doors < 3 THEN 'estimate' ELSE 'ready' END AS status,
           round(greatest(0.15, least(0.95, 0.9 - (doors = 0)::INTEGER * 0.16 - (doors < 3)::INTEGER * 0.04))::DOUBLE, 4) AS confidence FROM o
""")
def early_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First estimates by nation: heat, comfort, people, wind and whether inputs suffice."""
    c, size = table(spark, sf_dir, "customer"), F.sum(F.abs("c_acctbal"))
    n = c.groupBy("c_nationkey").agg((size / 100).alias("wall"), (size / 150).alias("roof"), (size / 50).alias("floor"))
    n = n.select("*", (F.col("c_nationkey") * 30 % 91).cast("double").alias("glass"), (F.col("c_nationkey") * 47 % 360).cast("double").alias("deg"), (F.col("c_nationkey") % 7).alias("doors"))
    wind = engineering.early_wind(F.lit(90.0), "deg", "doors")
    ready = engineering.readiness((F.col("doors") == 0).cast("int"), (F.col("doors") < 3).cast("int"), F.lit(0.9))
    n = n.select("*", engineering.early_transfer("wall", "glass", "deg").alias("o"), engineering.early_comfort("roof", "wall", "floor").alias("c"), engineering.early_flow_of_people("doors", engineering.capacity("floor", 4.0), F.lit(180)).alias("p"), wind.alias("w"), ready.alias("r"))
    return n.select("c_nationkey", F.round("o", 4).alias("ottv"), engineering.graded(F.col("o"), 35, 45, False).alias("ottv_grade"), F.round("c", 4).alias("comfort"), F.round("p", 4).alias("people"), F.round("w", 4).alias("wind"), engineering.graded(F.col("w"), 70, 45).alias("wind_grade"), "r.status", F.round("r.confidence", 4).alias("confidence"))


@query("""
    WITH r AS (SELECT o_custkey AS k, o_orderkey::VARCHAR AS room, CASE WHEN o_orderkey % 17 = 0 THEN 'insufficient' ELSE 'good' END AS quality, CASE WHEN o_orderkey % 11 = 0 THEN 'isolated' ELSE 'open' END AS access, (o_orderkey % 9) / 2 AS ach, o_totalprice / 30000 AS kw, o_orderkey % 25 AS lamps FROM orders),
    a AS (SELECT k, room, 'missing project data' AS category, 'critical' AS severity, 'Insufficient Geometry Data' AS title, 1.0::DOUBLE AS confidence, NULL AS override, NULL::DOUBLE AS factor FROM r WHERE quality = 'insufficient'
          UNION ALL SELECT k, room, 'circulation/access', 'warning', 'Inaccessible Room', 0.95, NULL, NULL FROM r WHERE access = 'isolated'
          UNION ALL SELECT k, room, 'natural ventilation', 'warning', 'Poor Natural Ventilation', 0.8, 'windowAreaMultiplier', 1.5 FROM r WHERE ach > 0 AND ach < 2
          UNION ALL SELECT k, room, 'natural ventilation', 'warning', 'No Natural Ventilation', 0.85, 'windowAreaMultiplier', 1.5 FROM r WHERE ach = 0
          UNION ALL SELECT k, room, 'AC capacity', 'warning', 'High Cooling Load', 0.8, 'solarFactorMultiplier', 0.6 FROM r WHERE kw > 10
          UNION ALL SELECT k, room, 'lighting quantity', 'info', 'High Fixture Count', 0.9, NULL, NULL FROM r WHERE lamps > 20
          UNION ALL SELECT c_custkey, NULL, 'missing project data', 'critical', 'Missing Project North', 1.0, 'projectNorthDeg', 0 FROM customer WHERE c_custkey % 5 = 0
          UNION ALL SELECT c_custkey, NULL, 'envelope insulation', 'warning', 'High Overall Thermal Transfer Value (OTTV)', 0.9, 'wallUValueMultiplier', 0.8 FROM customer WHERE c_acctbal / 100 > 45
          UNION ALL SELECT c_custkey, NULL, 'solar shading', 'warning', 'High Solar Heat Gain', 0.8, 'shadingCoefficientMultiplier', 0.7 FROM customer WHERE c_acctbal / 100 > 45),
    g AS (SELECT k, category, severity, title, confidence, override, factor, count(DISTINCT room) AS rooms, bool_or(room IS NULL) AS whole FROM a GROUP BY ALL)
    SELECT k AS c_custkey, 'REC-' || row_number() OVER (PARTITION BY k ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, confidence DESC, rooms DESC, title) AS id, category, title, rooms,
           CASE WHEN whole OR rooms > 5 THEN 'building' ELSE 'room' END AS scope, coalesce(override = 'windowAreaMultiplier' AND bool_or(category = 'envelope insulation') OVER (PARTITION BY k), false) AS conflict FROM g
""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice for customers as buildings and orders as rooms, merged and ranked."""
    key = F.col("o_orderkey")
    air = (key % 9) / 2
    rooms = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.when(key % 17 == 0, "insufficient").otherwise("good").alias("quality"), F.when(key % 11 == 0, "isolated").otherwise("open").alias("access"), air.alias("air_changes"), F.when(air == 0, "no_exterior_ventilation").otherwise("single_sided").alias("ventilation"), (F.col("o_totalprice") / 30000).alias("cooling_kw"), (key % 25).alias("luminaires"))
    buildings = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("ottv"), (F.col("c_custkey") % 5 != 0).alias("has_north"))
    raw = advice.advised(rooms, ["c_custkey"], advice.room_advice(), "o_orderkey").unionByName(advice.advised(buildings, ["c_custkey"], advice.building_advice(45.0)))
    return advice.merged_advice(raw, ["c_custkey"]).select("c_custkey", "id", "category", "title", "rooms", "scope", "conflict")


@query("""
    WITH s AS (SELECT p_partkey, p_retailprice AS a, -p_size AS b, (p_partkey * 31 % 97) AS c FROM part)
    SELECT p_partkey FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.a <= x.a AND y.b <= x.b AND y.c <= x.c AND (y.a < x.a OR y.b < x.b OR y.c < x.c))
""")
def three_way_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no other beats in price, size and a third measure."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (-F.col("p_size")).alias("b"), (F.col("p_partkey") * 31 % 97).alias("c"))
    return boundaries.undominated(p, [], ["a", "b", "c"]).select("p_partkey")


VARIABLES = [advice.Variable("windows", 0.5, 2.0, 0.25), advice.Variable("wall_u", 0.4, 1.2, 0.1), advice.Variable("shading", 0.3, 1.0, 0.05)]
DESIGNS, SEED = 3000, 42


def _numbers_sql(n: int) -> str:
    mul = lambda a, b: f"((({a} & 65535) * ({b}) + ((((({a} >> 16) * ({b})) & 65535) << 16))) & 4294967295)"
    return f"""
    k AS (SELECT range AS k FROM range(1, {n + 1})), a AS (SELECT k, (({SEED} + k * 1831565813) & 4294967295)::BIGINT AS s FROM k),
    b AS (SELECT k, {mul("(xor(s, s >> 15))", "(s | 1)")}::BIGINT AS t FROM a),
    c AS (SELECT k, xor(t, (t + {mul("(xor(t, t >> 7))", "(t | 61)")}) & 4294967295)::BIGINT AS t FROM b),
    u AS (SELECT k, xor(t, t >> 14) / 4294967296.0::DOUBLE AS u FROM c)"""


_SUN = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in numbers.SOLAR_FACTORS.items())


@query(f"""
    WITH {_numbers_sql(DESIGNS * 3)}, sun(facade, factor) AS (VALUES {_SUN}),
    d AS (SELECT (k - 1) // 3 AS design, max(0.5 + floor(u * 7) * 0.25::DOUBLE) FILTER ((k - 1) % 3 = 0) AS w, max(0.4::DOUBLE + floor(u * 9) * 0.1::DOUBLE) FILTER ((k - 1) % 3 = 1) AS uw, max(0.3::DOUBLE + floor(u * 15) * 0.05::DOUBLE) FILTER ((k - 1) % 3 = 2) AS sh FROM u GROUP BY 1),
    li AS (SELECT list_extract(['N','NE','E','SE','S','SW','W','NW'], (floor((((l_suppkey * 45.0 + l_linenumber + 22.5) % 360)) / 45) + 1)::INTEGER) AS facade, l_quantity AS wall, l_quantity * l_discount * 5 AS glass FROM lineitem),
    f8 AS (SELECT facade, round(sum(wall), 3) AS wall, round(sum(glass), 3) / round(sum(wall), 3) AS share, factor FROM li JOIN sun USING (facade) GROUP BY facade, factor),
    rm AS (SELECT round(sum(o_totalprice) / count(*) / 100, 3) AS volume FROM orders),
    e AS (SELECT design, w, uw, sh, floor(sum(wall * (uw * 10 * (1 - least(1, share * w)) + 20 * least(1, share * w) + sh * least(1, share * w) * factor)) / sum(wall) * 100000000 + 0.5) / 100000000 AS ottv, abs(w - 0.5) / 1.5 + abs(uw - 0.4) / 0.8::DOUBLE + abs(sh - 0.3) / 0.7::DOUBLE AS distance FROM d, f8 GROUP BY design, w, uw, sh),
    h AS (SELECT e.*, 1500 * w / volume AS ach FROM e, rm),
    g AS (SELECT * FROM h WHERE ottv <= 45 AND ach >= 0.5),
    f AS (SELECT * FROM g x WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.ottv <= x.ottv AND -y.ach <= -x.ach AND y.distance <= x.distance AND (y.ottv < x.ottv OR -y.ach < -x.ach OR y.distance < x.distance))),
    m AS (SELECT min(ottv) AS o0, max(ottv) AS o1, min(-ach) AS a0, max(-ach) AS a1, min(distance) AS d0, max(distance) AS d1 FROM f)
    SELECT design, round(ottv, 6) AS ottv, round(ach, 6) AS ach, round(distance, 6) AS distance, round(coalesce((ottv - o0) / nullif(o1 - o0, 0), 0) + coalesce((-ach - a0) / nullif(a1 - a0, 0), 0) + coalesce((distance - d0) / nullif(d1 - d0, 0), 0), 6) AS balance FROM f, m
""")
def best_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded search over designs, held against the facades of all lines and the rooms of all orders: the feasible ones that no other beats."""
    d = advice.designs(spark, VARIABLES, DESIGNS, SEED)
    li = table(spark, sf_dir, "lineitem").select(numbers.compass(F.col("l_suppkey") * 45.0 + F.col("l_linenumber")).alias("facade"), F.col("l_quantity").alias("wall"), (F.col("l_quantity") * F.col("l_discount") * 5).alias("glass"))
    wall = F.round(F.sum("wall"), 3)
    sides = li.groupBy("facade").agg(wall.alias("wall"), (F.round(F.sum("glass"), 3) / wall).alias("share")).withColumn("factor", numbers.solar_factor("facade"))
    # eight facades and one room as one row beside each design
    sides = sides.agg(F.array_sort(F.collect_list(F.struct("facade", "wall", "share", "factor"))).alias("sides"))
    rooms = table(spark, sf_dir, "orders").agg(F.round(F.sum("o_totalprice") / F.count("*") / 100, 3).alias("volume"))
    d = d.crossJoin(F.broadcast(sides)).crossJoin(F.broadcast(rooms))
    glazed = lambda s: F.least(F.lit(1.0), s["share"] * F.col("windows"))
    heat = lambda s: s["wall"] * (F.col("wall_u") * 10 * (1 - glazed(s)) + 20 * glazed(s) + F.col("shading") * glazed(s) * s["factor"])
    total = lambda f: F.aggregate("sides", F.lit(0.0), lambda a, s: a + f(s))
    d = d.withColumn("ottv", numbers.half_up(total(heat) / total(lambda s: s["wall"]), 8)).withColumn("ach", 1500 * F.col("windows") / F.col("volume")).withColumn("less_air", -F.col("ach")).drop("sides")
    d = d.withColumn("reasons", advice.feasibility({"max_ottv": F.col("ottv") <= 45, "min_ach": F.col("ach") >= 0.5}))
    out = advice.best_designs(d, ["ottv", "less_air", "distance"])
    return out.select("design", *(F.round(c, 6).alias(c) for c in ("ottv", "ach", "distance", "balance")))


@query("""
    SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey AS id, CASE WHEN furn OR wall < 0.25 THEN 'rejected' WHEN d >= 0.72 AND d >= w + 0.08 THEN 'door' WHEN w >= 0.68 AND w >= d + 0.05 THEN 'window' ELSE 'unresolved_opening' END AS kind, round(d, 6) AS door, round(w, 6) AS window
    FROM (SELECT *, greatest(0, least(1, dn * 0.45 + wall * 0.2 + greatest(0, least(1, 1 - gap / 0.2)) * 0.15 + (wid BETWEEN 0.55 AND 2.4 AND hei BETWEEN 1.75 AND 3.2 AND dep <= 0.6)::INTEGER * 0.15 + fr * 0.05))::DOUBLE AS d,
                 greatest(0, least(1, wn * 0.4 + wall * 0.2 + (gap >= 0.3)::INTEGER * 0.12 + (wid BETWEEN 0.3 AND 5 AND hei BETWEEN 0.3 AND 2.8 AND gap >= 0.3)::INTEGER * 0.13 + gl * 0.1 + fr * 0.05))::DOUBLE AS w
          FROM (SELECT *, (nm IN ('pintu kusen', 'p10001'))::INTEGER AS dn, (nm = 'jendela_kaca')::INTEGER AS wn, (nm = 'pintu kusen')::INTEGER AS fr, (nm = 'jendela_kaca' OR l_discount >= 0.05)::INTEGER AS gl, nm = 'lemari' AS furn,
                       greatest(0, least(1, 1 - l_tax / 0.35)) * greatest(0, least(1, l_quantity / 40 / 0.6)) AS wall, l_discount * 6 AS gap, l_quantity / 20 AS wid, 1 + l_quantity / 20 AS hei, l_tax AS dep
                FROM (SELECT *, list_extract(['pintu kusen', 'p10001', 'jendela_kaca', 'lemari', 'void'], (l_partkey % 5 + 1)::INTEGER) AS nm FROM lineitem)))
""")
def opening_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doors and windows by name, place and size."""
    names = ["pintu kusen", "p10001", "jendela_kaca", "lemari", "void"]
    q = F.col("l_quantity")
    kind = boundaries.opening_kind(_listed(names, F.col("l_partkey") % 5), F.col("l_tax"), q / 40, F.col("l_discount") * 6, q / 20, 1 + q / 20, F.col("l_tax"), F.when(F.col("l_discount") >= 0.05, 0.3).otherwise(0.0))
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id"), kind.alias("k"))
    return li.select("id", "k.kind", F.round("k.door", 6).alias("door"), F.round("k.window", 6).alias("window"))


@query("""
    SELECT s_suppkey, round(0.72 + abs(sin(radians(s_acctbal))) * 0.42, 6) AS exposure, round(sin(radians(s_acctbal)), 6) AS x, round(cos(radians(s_acctbal)), 6) AS z,
           translate(format('{:,.2f}', s_acctbal), ',.', '.,') AS said FROM supplier
""")
def orientation_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure and heading of a direction, and numbers with a decimal comma."""
    v = numbers.heading("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(numbers.sun_exposure("s_acctbal"), 6).alias("exposure"), F.round(v["x"], 6).alias("x"), F.round(v["z"], 6).alias("z"), numbers.decimal_comma("s_acctbal", 2).alias("said"))


@query("""
    SELECT o_orderpriority, base_value, proposed_value, CASE WHEN base_value IS NULL OR proposed_value IS NULL THEN 'not_applicable' WHEN abs(proposed_value - base_value) < 0.0005 THEN 'unchanged' WHEN proposed_value < base_value THEN 'improved' ELSE 'degraded' END AS status
    FROM (SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS base_value, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS proposed_value FROM orders GROUP BY 1)
""")
def metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order values of two states compared, small being good."""
    value = lambda s: F.round(F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2)
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(value("F").alias("base_value"), value("P").alias("proposed_value"))
    return o.select("o_orderpriority", "base_value", "proposed_value", scenario.delta_status("base_value", "proposed_value", True).alias("status"))
