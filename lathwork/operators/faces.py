"""Faces of a building model: parts by name and shape, candidates for rooms and their heights, evidence and the rule bank.

A face is a row with model, id, name, path, surface, texture, colour, bounds x0, x1, y0, y1, z0, z1 (y up) and area.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import _c, clamp, gap, overlap
from ..functions.text import metadata_text, repetition_key
from . import rules
from .graph import settled

# fixed values: words, Indonesian and English, of parts and materials, as alternatives of a regular expression
ROOF_WORDS = "atap|roof|perabung|spandek|listplank|piri"
GROUND_WORDS = "pondasi|penggali|batu kali|batu kosong|urug|tanah|cerucuk|sloof"
DOOR_WORDS = r"^p\d|pintu|door"
WINDOW_WORDS = r"^j\d|jendela|window"
PANE_WORDS = r"^j\d|jendela|window|kusen|glass|kaca|translucent"
FURNITURE_WORDS = "kulkas|dispenser|sofa|meja|kursi|lemari|furniture|sree"
FRAME_PARTS_WORDS = "kolom|balok|struktur|structure|beton"
STRUCTURE_WORDS = "kolom|balok|sloof|cerucuk|pondasi|struktur|structure"
ROOF_ELEMENT_WORDS = "atap|perabung|spandek|listplank"
WALL_WORDS = "bata|plester|dinding|wall"
OPENING_MATERIALS = "glass|kaca|translucent|window|jendela|door|pintu|kusen|wood|cherry|color_007|color_008|#1e1e1e|#333333"
FRAME_MATERIALS = "kusen|frame|wood|cherry|aluminium|aluminum|metal|color_007|color_008|material11|#1e1e1e|#333333|#98562a|#537689"
FLOOR_MATERIALS = "lantai|floor|keramik|ubin|tile|parket|sand|ground|grass|paver|paving|brick"
CEILING_MATERIALS = "plafon|ceiling|gypsum|langit"
NOT_A_ROOM = "atap|roof|perabung|spandek|listplank|piri|pondasi|penggali|batu kali|batu kosong|urug|tanah|cerucuk|sloof|balok|kolom|kusen|jendela|pintu|group pemotong|kulkas|dispenser|sofa|meja|kursi|lemari|furniture|notasi"
SURFACES = ("floor", "ceiling", "wall_front", "wall_back", "wall_left", "wall_right", "wall", "roof_slope", "window", "door", "structure", "furniture", "other")


def size(axis: str) -> Column:
    return F.col(f"{axis}1") - F.col(f"{axis}0")


def middle(axis: str) -> Column:
    return (F.col(f"{axis}0") + F.col(f"{axis}1")) / 2


def _all_text() -> Column:
    return F.lower(F.concat_ws(" ", "path", F.coalesce("texture", F.lit("")), F.coalesce("colour", F.lit(""))))


def _is_wall(surface: Column) -> Column:
    return surface.startswith("wall")


def surface_of(surface: Column | str, name: Column | str) -> Column:
    """A known surface as it is, else one by the name."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    by_name = rules.first_match(n, [(WINDOW_WORDS, "window"), (DOOR_WORDS, "door"), (STRUCTURE_WORDS, "structure"), (FURNITURE_WORDS, "furniture"), (ROOF_ELEMENT_WORDS, "roof_slope")], "other")
    return F.when(_c(surface).isin(*SURFACES), _c(surface)).otherwise(by_name)


def kind_of_name(name: Column | str) -> Column:
    """What a component's name says it is; null if nothing."""
    n = F.lower(_c(name))
    kinds = [(DOOR_WORDS, "doors"), (WINDOW_WORDS, "windows"), (ROOF_ELEMENT_WORDS, "roof_elements"), (WALL_WORDS, "wall_elements"), (FURNITURE_WORDS, "furniture"), (STRUCTURE_WORDS, "structural")]
    return F.nullif(rules.first_match(n, kinds, ""), F.lit(""))


def is_flat() -> Column:
    return (size("y") <= 0.08) & (size("x") >= 0.4) & (size("z") >= 0.4)


def is_wall_like() -> Column:
    """A wall by its surface and size, or a thin, tall and long face."""
    long, short = F.greatest(size("x"), size("z")), F.least(size("x"), size("z"))
    thin = (short <= 0.42) | (short / F.greatest(long, F.lit(0.001)) <= 0.08)
    return F.when(_is_wall(F.col("surface")), (size("y") >= 0.35) & (long >= 0.15)).otherwise(thin & (size("y") >= 1.6) & (long >= 0.8))


def _says(t: Column, words: str) -> Column:
    """``t.rlike(words)`` for alternatives without brackets: plain ones are looked for as they are, at a fraction of a pattern's time."""
    each = words.split("|")
    plain = [w for w in each if re.fullmatch(r"[\w #]+", w)]
    anchored = [w for w in each if w not in plain]
    return reduce(or_, [*(t.contains(w) for w in plain), *((t.startswith(w[1]) & t.rlike(w) if re.match(r"\^\w", w) else t.rlike(w)) for w in anchored)])


def part_of() -> Column:
    """The part of the building that path, texture and colour, then surface and shape speak for."""
    s = F.col("surface")
    of = lambda t: (
        F.when(_says(t, ROOF_WORDS), "roof")
        .when(_says(t, GROUND_WORDS), "foundation")
        .when(_says(t, DOOR_WORDS) | (s == "door"), "doors")
        .when(_says(t, PANE_WORDS) | (s == "window"), "windows")
        .when(_says(t, FURNITURE_WORDS) | (s == "furniture"), "furniture")
        .when(_says(t, FRAME_PARTS_WORDS) | (s == "structure"), "structure")
        .when(_is_wall(s) | is_wall_like(), "walls")
        .when((s == "floor") | (is_flat() & _says(t, FLOOR_MATERIALS)), "floor")
        .when((s == "ceiling") | (is_flat() & _says(t, CEILING_MATERIALS)), "ceiling")
        .when(s == "roof_slope", "roof")
        .otherwise("other")
    )
    return F.transform(F.array(_all_text()), of)[0]  # so the text is made once, not for each pattern


def is_opening_candidate() -> Column:
    """A small or thin piece of wall whose part or material speaks for a door, a window or a frame; needs ``part``."""
    t = _all_text()
    long, short = F.greatest(size("x"), size("z")), F.least(size("x"), size("z"))
    said = F.col("part").isin("doors", "windows") | t.rlike(OPENING_MATERIALS) | t.rlike(FRAME_MATERIALS)
    return _is_wall(F.col("surface")) & (size("y") >= 0.18) & ((long <= 1.6) | (short <= 0.08)) & said


def refined_part(levels: Column | str) -> Column:
    """The part seen against the storeys' levels (an array): doors stand on one, flat faces are floor near one and
    ceiling a storey above; needs ``part``."""
    t, s, part, lv = _all_text(), F.col("surface"), F.col("part"), _c(levels)
    above = F.filter(F.transform(lv, lambda v: F.col("y0") - v), lambda d: d >= -0.35)
    on_floor = F.coalesce(F.array_min(F.transform(above, F.abs)) <= 0.65, F.lit(False))
    door_sized = size("y").between(1.55, 3.8)
    glazed = (size("y") >= 0.35) & _is_wall(s) & (size("y") <= 4.5) & (F.greatest(size("x"), size("z")) <= 12) & t.rlike(OPENING_MATERIALS)
    center = middle("y")
    near = F.array_min(F.transform(lv, lambda v: F.abs(center - v))) <= 0.35
    below = F.array_max(F.filter(lv, lambda v: v <= center + 0.2))
    flat = s.isin("floor", "ceiling") & is_flat()
    return (
        F.when(part == "openings", F.when(on_floor & door_sized, "doors").otherwise("windows"))
        .when(((part == "windows") | glazed) & on_floor & door_sized, "doors")
        .when(glazed, "windows")
        .when(flat & t.rlike(CEILING_MATERIALS), "ceiling")
        .when(flat & t.rlike(FLOOR_MATERIALS), "floor")
        .when(flat & near, "floor")
        .when(flat & (center - below).between(2.0, 4.2), "ceiling")
        .otherwise(part)
    )


def part_of_category(category: Column | str) -> Column:
    """The part that a category of the rule bank belongs to."""
    # fixed values
    parts = {"roof": "roof", "floor": "floor", "room_boundary": "floor", "ceiling": "ceiling", "exterior_wall": "walls", "interior_wall": "walls", "door": "doors", "window": "windows", "opening": "openings", "column": "structure", "beam": "structure", "stair": "structure", "railing": "structure", "furniture": "furniture", "fixture": "furniture"}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv))[_c(category)], F.lit("other"))


def suggested_use(name: Column | str, area: Column | str) -> Column:
    """Use of a room by its name, else by its area."""
    n = F.lower(F.coalesce(_c(name), F.lit("")))
    # fixed values
    uses = [("gudang|storage", "gudang"), ("koridor|selasar|hall", "koridor"), ("pantry|dapur|kitchen", "pantry"), ("toilet|wc|servis|service", "servis"), ("kantor|office", "kantor")]
    said = rules.first_match(n, uses, "")
    return F.when(said != "", said).when(_c(area) > 35, "retail").when(_c(area) < 8, "servis").otherwise("kantor")


def room_score(corners: Column | str, orthogonal: Column) -> Column:
    """Struct (shape, score, confidence) of a floor face that may be a room, else null; needs ``part``.

    corners is the number of distinct corners in plan, orthogonal whether all edges run along the axes.
    """
    w, d, n = size("x"), size("z"), _c(corners)
    fill = clamp(F.col("area") / F.greatest(w * d, F.lit(0.001)), 0.0, 1.2)
    fits = (F.col("part") == "floor") & (F.col("area") >= 3) & ~F.lower("path").rlike(NOT_A_ROOM) & (size("y") <= 0.08) & (w >= 1.2) & (d >= 1.2) & (w * d >= 4)
    square = (fill >= 0.9) & (orthogonal | (n <= 6)) & (F.least(w, d) / F.greatest(w, d) >= 0.22)
    ell = (fill >= 0.48) & (fill < 0.9) & (n >= 6) & orthogonal
    shape = F.when(square, "rectangle").when(ell, "l_shape")
    # fixed values: what floor words in the path add
    named = rules.first_match(F.lower("path"), [("keramik lantai|lantai keramik|ubin|parket", "0.26"), ("cor lantai", "0.18"), ("lantai|floor", "0.1")], "0").cast("double")
    score = 0.38 + named + F.when(square, 0.18).otherwise(0.13) + F.least(F.col("area") / 80, F.lit(0.14)) + F.least(fill, F.lit(1.0)) * 0.1
    return F.when(fits & shape.isNotNull(), F.struct(shape.alias("shape"), score.alias("score"), clamp(score, 0.45, 0.92).alias("confidence")))


def runs_along_axes(points: Column | str) -> Column:
    """Whether at least four edges of a plan polygon (x, z structs) are longer than 5 cm and all those run along an axis."""
    p = _c(points)
    ahead = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    edges = F.filter(F.zip_with(p, ahead, lambda a, b: F.struct(F.abs(b["x"] - a["x"]).alias("x"), F.abs(b["z"] - a["z"]).alias("z"))), lambda e: F.hypot(e["x"], e["z"]) >= 0.05)
    straight = F.forall(edges, lambda e: F.least(e["x"], e["z"]) / F.greatest(e["x"], e["z"]) <= 0.08)
    return (F.size(p) >= 4) & (F.size(edges) >= 4) & straight


def wall_adjacency(room: str, wall: str) -> Column:
    """How much of a room's side a wall runs along, 0 to 1, or a third of its own plan area that lies in the room."""
    c = lambda side, name: F.col(f"{side}.{name}")
    span = lambda side, a: c(side, f"{a}1") - c(side, f"{a}0")
    reach = F.greatest(F.least(span(room, "x"), span(room, "z")) * 0.08, F.lit(0.45))

    def along(across: str, run: str) -> Column:
        at = (c(wall, f"{across}0") + c(wall, f"{across}1")) / 2
        off = F.least(F.abs(at - c(room, f"{across}0")), F.abs(at - c(room, f"{across}1")))
        shared = overlap(c(room, f"{run}0"), c(room, f"{run}1"), c(wall, f"{run}0"), c(wall, f"{run}1"))
        least = F.greatest(F.least(span(room, run), span(wall, run)), F.lit(0.001))
        return F.when((span(wall, run) >= span(wall, across)) & (off <= reach), shared / least).otherwise(0.0)

    inside = overlap(c(room, "x0"), c(room, "x1"), c(wall, "x0"), c(wall, "x1")) * overlap(c(room, "z0"), c(room, "z1"), c(wall, "z0"), c(wall, "z1"))
    return F.greatest(along("x", "z"), along("z", "x"), inside / F.greatest(span(wall, "x") * span(wall, "z"), F.lit(0.001)) * 0.35)


def room_heights(rooms: DataFrame, faces: DataFrame, fallback: float, cell: float = 4.0) -> DataFrame:
    """(model, id, height, by): the upper median height of the walls beside a room; else the best cover above it; else the fallback.

    Walls and covers meet rooms in cells of the plan that they touch, with some room to spare for walls beside;
    each pair counts in one cell only.  faces need ``part``.
    """
    cells = lambda a, spare: F.sequence(F.floor((F.col(f"{a}0") - spare) / cell).cast("long"), F.floor((F.col(f"{a}1") + spare) / cell).cast("long"))
    place = lambda df, spare: df.withColumn("cx", F.explode(cells("x", spare))).withColumn("cz", F.explode(cells("z", spare)))
    spare = F.greatest(F.least(size("x"), size("z")) * 0.08, F.lit(0.45))
    r = place(rooms, spare).alias("r")
    floor = (F.col("r.y0") + F.col("r.y1")) / 2
    same = F.expr("r.model = f.model and r.cx = f.cx and r.cz = f.cz")
    tall = faces.where(F.col("part") == "walls").where(size("y").between(1.8, 6.8))
    w = r.join(place(tall, F.lit(0.0)).alias("f"), same)
    stands = (F.abs(F.col("f.y0") - floor) <= 0.9) | ((F.col("f.y0") <= floor + 0.45) & (F.col("f.y1") >= floor + 1.8))
    up = F.col("f.y1") - floor
    height = clamp(F.when((up > 1.8) & (up <= 6.8), up).otherwise(F.col("f.y1") - F.col("f.y0")), 1.8, 6.8)
    walls = w.where(stands & (wall_adjacency("r", "f") > 0.12)).select("r.model", "r.id", F.col("f.id").alias("wall"), height.alias("h")).distinct()
    order = Window.partitionBy("model", "id").orderBy("h", "wall")
    ranked = walls.withColumn("n", F.row_number().over(order)).withColumn("all", F.count("*").over(Window.partitionBy("model", "id")))
    by_walls = ranked.where("n = all div 2 + 1").select("model", "id", clamp("h", 2.1, 6.5).alias("by_walls"))
    covers = faces.where(F.col("surface").isin("ceiling", "floor", "roof_slope") | F.col("part").isin("ceiling", "roof"))
    c = r.join(place(covers, F.lit(0.0)).alias("f"), same).where("r.id <> f.id")
    rise = (F.col("f.y0") + F.col("f.y1")) / 2 - floor
    plan = F.greatest((F.col("r.x1") - F.col("r.x0")) * (F.col("r.z1") - F.col("r.z0")), F.col("r.area"), F.lit(1.0))
    share = overlap(F.col("r.x0"), F.col("r.x1"), F.col("f.x0"), F.col("f.x1")) * overlap(F.col("r.z0"), F.col("r.z1"), F.col("f.z0"), F.col("f.z1")) / plan
    bonus = F.when(F.col("f.surface") == "ceiling", 0.35).otherwise(0.0) + F.when(F.col("f.part") == "ceiling", 0.25).otherwise(0.0) + F.when(F.col("f.part") == "roof", 0.08).otherwise(0.0)
    good = c.where(rise.between(2.0, 6.5) & (share >= 0.58)).select("r.model", "r.id", rise.alias("rise"), (bonus + share - F.greatest(rise - 3, F.lit(0.0)) * 0.05).alias("score"))
    by_cover = good.groupBy("model", "id").agg(clamp(F.min_by("rise", F.struct(-F.col("score"), "rise")), 2.1, 6.5).alias("by_cover"))
    out = rooms.select("model", "id").join(by_walls, ["model", "id"], "left").join(by_cover, ["model", "id"], "left")
    found = F.coalesce("by_walls", "by_cover", clamp(F.lit(fallback), 2.4, 4.5))
    return out.select("model", "id", found.alias("height"), F.when(F.col("by_walls").isNotNull(), "walls").when(F.col("by_cover").isNotNull(), "cover").otherwise("fallback").alias("by"))


def opening_distance(a: str, b: str) -> Column:
    """Distance of two openings in one plane: twice the planes' own, that along the wall and the gap in height; null if apart."""
    c = lambda side, name: F.col(f"{side}.{name}")
    flat_x = lambda side: (c(side, "x1") - c(side, "x0")) <= (c(side, "z1") - c(side, "z0"))
    off = lambda axis: F.abs((c(a, f"{axis}0") + c(a, f"{axis}1")) / 2 - (c(b, f"{axis}0") + c(b, f"{axis}1")) / 2)
    plane, run = F.when(flat_x(a), off("x")).otherwise(off("z")), F.when(flat_x(a), off("z")).otherwise(off("x"))
    return F.when((flat_x(a) == flat_x(b)) & (plane <= 0.35), 2 * plane + run + gap(c(a, "y0"), c(a, "y1"), c(b, "y0"), c(b, "y1")))


# fixed values: words of labels and materials, as whole words of normalized metadata
LABELS = {
    "roof": "atap|roof|genteng|spandek|perabung|reng|rafter",
    "floor": "lantai|floor|slab|pelat lantai|ubin|parket",
    "ceiling": "plafon|ceiling|langit",
    "exterior_wall": "dinding luar|exterior wall|external wall|facade|fasad",
    "interior_wall": "dinding dalam|interior wall|partition|sekat",
    "door": "pintu|door|entrance|gerbang",
    "window": "jendela|window|fenestration|glazing|kaca",
    "column": "kolom|column|pillar|tiang",
    "beam": "balok|beam|sloof|girder",
    "stair": "tangga|stair|stairs|step|anak tangga",
    "railing": "railing|pagar|handrail|balustrade",
    "furniture": "furniture|meja|kursi|sofa|lemari|ranjang|bed|table|chair|cabinet",
    "fixture": "fixture|wastafel|sink|toilet|wc|lampu|sanitary|urinal|bathtub|ac unit",
    "opening": "opening|bukaan|void|lubang",
    "room_boundary": "room boundary|space boundary|batas ruang|zona boundary",
}
MATERIALS = {
    "glass": "glass|kaca|transparent|glazing",
    "wood": "wood|kayu|timber",
    "structural": "concrete|beton|steel|baja|structural",
    "masonry": "brick|bata|masonry|plaster|stucco",
    "metal": "metal|steel|baja|aluminium|aluminum",
    "roofing": "spandek|roof|genteng|shingle|tile",
    "flooring": "floor|lantai|tile|keramik|ubin|parket|paver",
    "ceiling": "ceiling|plafon|gypsum|langit",
    "fixture": "ceramic|porcelain|sanitary|chrome",
}
ANCHORS = "window|jendela|glass|kaca|glazing|fenestration|translucent"
CELL = 2.0
#: cells of a block, an axis
BLOCK = 4


def _word(text: Column, alternatives: str) -> Column:
    return text.rlike(rf"\b({alternatives})\b")


def _cell(v: Column) -> Column:
    return F.floor(v / CELL).cast("long")


def _in_blocks(df: DataFrame, x0: Column, x1: Column, z0: Column, z1: Column) -> DataFrame:
    """Rows in every block (bx, bz) of cells that the given range of cells meets."""
    block = lambda lo, hi: F.sequence(F.floor(lo / BLOCK).cast("long"), F.floor(hi / BLOCK).cast("long"))
    return df.withColumn("bx", F.explode(block(x0, x1))).withColumn("bz", F.explode(block(z0, z1)))


def _near(faces: DataFrame, others: DataFrame, rule: Column, name: str) -> DataFrame:
    """(model, id, name): faces with another that keeps the rule (columns f and o) and takes up one of the nine cells around their middle.

    Others have their cells as cx0, cx1, cz0, cz1.  A face stands in one block of cells, others, which are fewer, in each that
    they or the cells beside theirs meet.
    """
    f = _in_blocks(faces.withColumn("cx", _cell(middle("x"))).withColumn("cz", _cell(middle("z"))), *(F.col(c) for c in ("cx", "cx", "cz", "cz")))
    o = others.select("model", "id", *(f"{a}{k}" for a in "xyz" for k in "01"), "cx0", "cx1", "cz0", "cz1")
    o = _in_blocks(o, F.col("cx0") - 1, F.col("cx1") + 1, F.col("cz0") - 1, F.col("cz1") + 1)
    around = F.expr("f.cx between o.cx0 - 1 and o.cx1 + 1 and f.cz between o.cz0 - 1 and o.cz1 + 1")
    pairs = f.alias("f").join(o.alias("o"), F.expr("f.model = o.model and f.bx = o.bx and f.bz = o.bz and f.id <> o.id") & around & rule, "left_semi")
    # a face stands in one block only, so it is here once unless it is given twice
    return pairs.select("model", "id").distinct().withColumn(name, F.lit(True))


def _texts(faces: DataFrame) -> DataFrame:
    """Faces with their key of repetition (_key), whether words speak for an anchor (_anchors) and the signals that words give (_words, a map).

    Many faces share their texts, which are worked on once for each combination that occurs; the table of these is stored, so
    that its size decides how it is joined.
    """
    said = ["name", "path", "layer", "texture"]
    t = faces.select(*said).distinct()
    t = t.select(
        *(F.col(c).alias(f"_of_{c}") for c in said),
        repetition_key("path").alias("_key"),
        metadata_text(F.concat_ws(" ", "name", "path", F.coalesce("texture", F.lit("")))).alias("_all"),
        metadata_text(F.concat_ws(" ", "name", "path", F.coalesce("layer", F.lit("")))).alias("_text"),
        metadata_text(F.coalesce("texture", F.lit(""))).alias("_material"),
    )
    heard = lambda pairs: F.filter(F.array(*(F.when(when, F.lit(k)) for k, when in pairs)), lambda x: x.isNotNull())
    t = t.withColumn("_labels", heard([(f"label.{k}", _word(F.col("_text"), w)) for k, w in LABELS.items()]))
    # a roof may be named by any text, other materials by their own
    materials = [(f"material.{k}", _word(F.concat_ws(" ", "_material", "_text") if k == "roofing" else F.col("_material"), w)) for k, w in MATERIALS.items()]
    words = F.concat("_labels", heard([("label.wall", _word(F.col("_text"), "dinding|wall")), ("label.conflict", F.size("_labels") > 1), *materials]))
    words = F.map_from_entries(F.transform(words, lambda k: F.struct(k.alias("key"), F.lit(1.0).alias("value"))))
    t = settled(t.select(*(f"_of_{c}" for c in said), "_key", _word(F.col("_all"), ANCHORS).alias("_anchors"), words.alias("_words")))
    return faces.join(t, [faces[c].eqNullSafe(t[f"_of_{c}"]) for c in said]).drop(*(f"_of_{c}" for c in said))


def evidence(faces: DataFrame, levels: DataFrame) -> DataFrame:
    """(model, id, evidence): signals with their strengths, of label, surface, shape, height, place, reuse, neighbours and material.

    faces also have layer, legacy_part, vertices and holes; levels are (model, levels), an array of the storeys'
    heights in order.  Neighbours are equi-joins on cells; bounds and repetitions are aggregates by model.
    """
    d, keys = _signals(faces, levels)
    pairs = F.zip_with(F.array(*map(F.lit, keys)), "strengths", lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return d.select("model", "id", F.map_concat("words", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))).alias("evidence"))


def _signals(faces: DataFrame, levels: DataFrame, carry: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """(model, id, carried columns, words, strengths) and keys: signals by words and by the old part as a map, the others as an array in the order of the keys, null where one is not there."""
    bounds = faces.groupBy("model").agg(*(f(f"{a}{k}").alias(f"m{a}{k}") for a in "xyz" for k, f in ((0, F.min), (1, F.max))))
    told = _texts(faces)
    reuse = told.groupBy("model", "_key").agg(F.count("*").alias("_times"))
    walls = faces.where(_is_wall(F.lower("surface")) & (F.col("area") >= 8)).select("*", *(_cell(F.col(f"{a}{k}")).alias(f"c{a}{k}") for a in "xz" for k in "01"))
    anchors = told.where(F.col("_anchors") | F.coalesce(F.col("legacy_part") == "windows", F.lit(False))).select("*", *(_cell(middle(a)).alias(f"c{a}{k}") for a in "xz" for k in "01"))
    between = lambda a: gap(F.col(f"f.{a}0"), F.col(f"f.{a}1"), F.col(f"o.{a}0"), F.col(f"o.{a}1"))
    host = (overlap(F.col("f.y0"), F.col("f.y1"), F.col("o.y0"), F.col("o.y1")) >= 0.2) & (between("x") <= 0.3) & (between("z") <= 0.3)
    beside = (between("y") <= 0.35) & (F.hypot(between("x"), between("z")) <= 1.2)
    slim = faces.select("model", "id", *(f"{a}{k}" for a in "xyz" for k in "01"))
    of_model = bounds.join(levels.select("model", F.col("levels").alias("_levels")), "model", "left")
    d = told.join(of_model, "model").join(reuse, ["model", "_key"])
    d = d.withColumn("_levels", F.when(F.size("_levels") > 0, F.col("_levels")).otherwise(F.array("my0")))
    d = d.join(_near(slim, walls, host, "_host"), ["model", "id"], "left").join(_near(slim, anchors, beside, "_anchor"), ["model", "id"], "left")
    d = d.withColumn("_s", F.lower("surface"))
    long, thin, tall, area, s = F.greatest(size("x"), size("z")), F.least(size("x"), size("z")), size("y"), F.col("area"), F.col("_s")
    flat = s.isin("floor", "ceiling") | ((tall <= long * 0.08) & (long > 0.2))
    upright = _is_wall(s) | (tall >= F.greatest(thin * 1.8, F.lit(0.4)))
    nearest = F.array_min(F.transform("_levels", lambda v: F.struct(F.abs(F.col("y0") - v).alias("d"), v.alias("v"))))["v"]
    above = F.col("y0") - nearest
    below = F.array_max(F.filter("_levels", lambda v: v < middle("y") - 0.5))
    edge = F.greatest(F.lit(0.3), F.greatest(F.col("mx1") - F.col("mx0"), F.col("mz1") - F.col("mz0")) * 0.04)
    at_edge = (F.abs(F.col("x0") - F.col("mx0")) <= edge) | (F.abs(F.col("x1") - F.col("mx1")) <= edge) | (F.abs(F.col("z0") - F.col("mz0")) <= edge) | (F.abs(F.col("z1") - F.col("mz1")) <= edge)
    signals: list[tuple[str, Column, Column | float]] = [
        ("surface.roof", s.contains("roof"), 1.0),
        ("surface.floor", s == "floor", 1.0),
        ("surface.ceiling", s == "ceiling", 1.0),
        ("surface.wall", _is_wall(s), 1.0),
        ("orientation.horizontal", flat, 1.0),
        ("orientation.vertical", upright, 1.0),
        ("geometry.large", area >= 8, clamp(area / 40, 0.55, 1.0)),
        ("geometry.small", (area <= 4) & (F.greatest(long, tall) <= 3), 1.0),
        ("geometry.opening_sized", upright & long.between(0.25, 4.5) & tall.between(0.4, 3.5) & (area <= 14), 1.0),
        ("shape.tall_slender", (tall >= 2) & (thin <= 0.8) & (tall / F.greatest(long, F.lit(0.1)) >= 1.2), 1.0),
        ("shape.long_horizontal", (long >= 3) & (tall <= 0.8) & (thin <= 0.8), 1.0),
        ("shape.thin_linear", (long >= 2.5) & (thin <= 0.2) & tall.between(0.5, 2.5), 1.0),
        ("shape.thin_frame", upright & (long <= 0.22) & tall.between(0.4, 3.5) & (area <= 1), 1.0),
        ("shape.stepped_volume", (tall >= 1) & (long >= 2) & (thin >= 1), 1.0),
        ("geometry.room_sized", flat & (area >= 4) & (long >= 1.5), 1.0),
        ("topology.enclosed_polygon", F.col("vertices") >= 4, 0.8),
        ("topology.hole", F.col("holes") > 0, 1.0),
        ("elevation.touches_floor", F.abs(above) <= 0.25, 1.0),
        ("elevation.above_floor", above > 0.35, 1.0),
        ("elevation.floor_level", F.exists("_levels", lambda v: F.abs(middle("y") - v) <= 0.25), 1.0),
        ("elevation.ceiling_height", (middle("y") - below).between(2.0, 4.5), 1.0),
        ("elevation.top", middle("y") >= F.col("my0") + F.greatest(F.col("my1") - F.col("my0"), F.lit(0.1)) * 0.72, 1.0),
        ("context.perimeter", at_edge, 1.0),
        ("context.interior", ~at_edge, 1.0),
        ("reuse.repeated", F.col("_times") >= 3, clamp(F.col("_times") / 8, 0.6, 1.0)),
        ("context.wall_host", F.col("_host"), 1.0),
        ("context.opening_cluster", F.col("_anchor"), 1.0),
        # also said by words, see below
        ("material.structural", s == "structure", 1.0),
    ]
    part = F.col("legacy_part")
    legacy = F.concat(F.lit("legacy."), F.when(part == "doors", "door").when(part == "windows", "window").when(part == "walls", "wall").otherwise(part))
    words = F.map_filter("_words", lambda k, v: (k != "material.structural") | ~F.coalesce(s == "structure", F.lit(False)))
    words = F.when(part.isNotNull(), F.map_concat(words, F.create_map(legacy, F.lit(0.65)))).otherwise(words)
    strengths = F.array(*(F.when(when, x if isinstance(x, Column) else F.lit(x)).cast("double") for _, when, x in signals))
    return d.select("model", "id", *carry, words.alias("words"), strengths.alias("strengths")), [k for k, _, _ in signals]


def _named(rule_id: str, category: str, **extra: float) -> dict:
    """The rule for an explicit label; what else speaks for it is given with underscores for dots."""
    signals = {f"label.{category}": 0.78, **{k.replace("__", "."): v for k, v in extra.items()}, "label.conflict": -0.22}
    return {"rule_id": rule_id, "category": category, "base": 0.08, "signals": signals, "required_any": [f"label.{category}"], "threshold": 0.55}


def _shown(rule_id: str, category: str, threshold: float, signals: dict[str, float], every: tuple[str, ...] = (), some: tuple[str, ...] = (), base: float = 0.0) -> dict:
    return {"rule_id": rule_id, "category": category, "base": base, "signals": signals, "required_all": list(every), "required_any": list(some), "threshold": threshold}


# fixed values: the rules of version 1.0.0, their signals with weights (negative ones speak against), thresholds
RULE_BANK = [
    _named("R-ROOF-EXPLICIT-001", "roof", surface__roof=0.14, elevation__top=0.08),
    _shown("R-ROOF-GEOMETRY-002", "roof", 0.58, {"surface.roof": 0.62, "elevation.top": 0.18, "material.roofing": 0.18, "material.glass": -0.35}, some=("surface.roof",)),
    _named("R-FLOOR-EXPLICIT-001", "floor", surface__floor=0.14, elevation__floor_level=0.08),
    _shown("R-FLOOR-GEOMETRY-002", "floor", 0.58, {"surface.floor": 0.55, "elevation.floor_level": 0.22, "geometry.large": 0.12, "label.ceiling": -0.45, "elevation.top": -0.12}, ("surface.floor",)),
    _shown("R-FLOOR-MATERIAL-003", "floor", 0.58, {"legacy.floor": 0.36, "material.flooring": 0.22, "elevation.floor_level": 0.18, "geometry.large": 0.08, "material.ceiling": -0.45}, ("legacy.floor", "orientation.horizontal"), base=0.08),
    _named("R-CEILING-EXPLICIT-001", "ceiling", surface__ceiling=0.14, context__interior=0.06),
    _shown("R-CEILING-GEOMETRY-002", "ceiling", 0.58, {"surface.ceiling": 0.56, "elevation.ceiling_height": 0.2, "context.interior": 0.1, "label.roof": -0.4, "elevation.top": -0.1}, ("surface.ceiling",)),
    _shown("R-CEILING-MATERIAL-003", "ceiling", 0.58, {"legacy.ceiling": 0.36, "material.ceiling": 0.22, "elevation.ceiling_height": 0.18, "geometry.large": 0.08, "material.flooring": -0.45}, ("legacy.ceiling", "orientation.horizontal"), base=0.08),
    _named("R-EXT-WALL-EXPLICIT-001", "exterior_wall", orientation__vertical=0.1, context__perimeter=0.08),
    _shown("R-EXT-WALL-CONTEXT-002", "exterior_wall", 0.6, {"surface.wall": 0.3, "context.perimeter": 0.28, "geometry.large": 0.14, "label.wall": 0.16, "material.masonry": 0.1, "label.interior_wall": -0.55, "material.glass": -0.22}, ("orientation.vertical", "surface.wall")),
    _shown("R-EXT-WALL-MIGRATION-003", "exterior_wall", 0.58, {"legacy.wall": 0.36, "orientation.vertical": 0.2, "context.perimeter": 0.2, "geometry.large": 0.08, "material.glass": -0.3}, ("legacy.wall", "orientation.vertical", "context.perimeter"), base=0.08),
    _named("R-INT-WALL-EXPLICIT-001", "interior_wall", orientation__vertical=0.1, context__interior=0.08),
    _shown("R-INT-WALL-CONTEXT-002", "interior_wall", 0.6, {"surface.wall": 0.3, "context.interior": 0.28, "geometry.large": 0.12, "label.wall": 0.14, "label.exterior_wall": -0.55, "context.perimeter": -0.2, "material.glass": -0.35}, ("orientation.vertical", "surface.wall")),
    _shown("R-INT-WALL-MIGRATION-003", "interior_wall", 0.58, {"legacy.wall": 0.36, "orientation.vertical": 0.2, "context.interior": 0.2, "geometry.large": 0.08, "material.glass": -0.3}, ("legacy.wall", "orientation.vertical", "context.interior"), base=0.08),
    _named("R-DOOR-EXPLICIT-001", "door", orientation__vertical=0.08, geometry__opening_sized=0.07, elevation__touches_floor=0.07),
    _shown("R-DOOR-HOST-002", "door", 0.58, {"elevation.touches_floor": 0.28, "context.wall_host": 0.2, "material.wood": 0.16, "reuse.repeated": 0.08, "legacy.door": 0.08, "material.glass": -0.18, "label.window": -0.5}, ("orientation.vertical", "geometry.opening_sized", "elevation.touches_floor"), base=0.08),
    _named("R-WINDOW-EXPLICIT-001", "window", orientation__vertical=0.08, material__glass=0.08, elevation__above_floor=0.06),
    _shown("R-WINDOW-HOST-002", "window", 0.58, {"material.glass": 0.34, "context.wall_host": 0.2, "elevation.above_floor": 0.16, "reuse.repeated": 0.1, "legacy.window": 0.06, "elevation.touches_floor": -0.24, "label.door": -0.5}, ("orientation.vertical", "geometry.opening_sized", "material.glass"), base=0.06),
    _shown("R-WINDOW-CLUSTER-003", "window", 0.58, {"legacy.window": 0.4, "geometry.opening_sized": 0.18, "material.wood": 0.08, "material.glass": 0.12, "elevation.above_floor": 0.08, "elevation.touches_floor": -0.16, "label.door": -0.45}, ("legacy.window", "orientation.vertical", "geometry.opening_sized"), base=0.12),
    _shown("R-WINDOW-FRAME-004", "window", 0.58, {"context.opening_cluster": 0.36, "shape.thin_frame": 0.24, "material.wood": 0.1, "material.metal": 0.1, "legacy.window": 0.08, "label.door": -0.4}, ("orientation.vertical", "shape.thin_frame", "context.opening_cluster"), base=0.08),
    _named("R-COLUMN-EXPLICIT-001", "column", shape__tall_slender=0.12, material__structural=0.07),
    _shown("R-COLUMN-SHAPE-002", "column", 0.62, {"shape.tall_slender": 0.48, "material.structural": 0.24, "reuse.repeated": 0.12, "legacy.structure": 0.08, "material.glass": -0.3}, ("shape.tall_slender",)),
    _named("R-BEAM-EXPLICIT-001", "beam", shape__long_horizontal=0.12, material__structural=0.07),
    _shown("R-BEAM-SHAPE-002", "beam", 0.62, {"shape.long_horizontal": 0.48, "material.structural": 0.22, "elevation.above_floor": 0.1, "legacy.structure": 0.08, "surface.floor": -0.2}, ("shape.long_horizontal",)),
    _named("R-STAIR-EXPLICIT-001", "stair", reuse__repeated=0.08, shape__stepped_volume=0.08),
    _shown("R-STAIR-PATTERN-002", "stair", 0.64, {"shape.stepped_volume": 0.42, "reuse.repeated": 0.22, "context.interior": 0.1}, ("shape.stepped_volume", "reuse.repeated")),
    _named("R-RAILING-EXPLICIT-001", "railing", shape__thin_linear=0.12, material__metal=0.06),
    _shown("R-RAILING-SHAPE-002", "railing", 0.64, {"shape.thin_linear": 0.42, "reuse.repeated": 0.2, "material.metal": 0.15}, ("shape.thin_linear", "reuse.repeated")),
    _named("R-FURNITURE-EXPLICIT-001", "furniture", context__interior=0.07, reuse__repeated=0.06),
    _shown("R-FURNITURE-CONTEXT-002", "furniture", 0.64, {"geometry.small": 0.3, "reuse.repeated": 0.25, "context.interior": 0.16, "legacy.furniture": 0.16}, ("geometry.small", "reuse.repeated")),
    _named("R-FIXTURE-EXPLICIT-001", "fixture", geometry__small=0.1, context__interior=0.06),
    _shown("R-FIXTURE-CONTEXT-002", "fixture", 0.65, {"geometry.small": 0.3, "material.fixture": 0.25, "reuse.repeated": 0.14, "context.interior": 0.12}, ("geometry.small",)),
    _named("R-OPENING-EXPLICIT-001", "opening", geometry__opening_sized=0.1, context__wall_host=0.06),
    _shown("R-OPENING-TOPOLOGY-002", "opening", 0.62, {"topology.hole": 0.5, "context.wall_host": 0.2, "geometry.opening_sized": 0.12, "material.glass": -0.2, "material.wood": -0.15}, some=("topology.hole",)),
    _named("R-ROOM-BOUNDARY-EXPLICIT-001", "room_boundary", surface__floor=0.08, geometry__large=0.07),
    _shown("R-ROOM-BOUNDARY-GEOMETRY-002", "room_boundary", 0.66, {"geometry.room_sized": 0.38, "context.interior": 0.18, "topology.enclosed_polygon": 0.16, "label.floor": -0.2}, ("surface.floor", "geometry.room_sized")),
]


def classified(faces: DataFrame, levels: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(model, id, category, score, margin, rule_id, confidence, trace, contested) of every face by the rule bank over its
    evidence; ``carry`` names columns of the faces to take along."""
    found, keys = _signals(faces, levels, carry)
    found = found.withColumn("_face", F.struct("model", "id", *carry))
    out = rules.classify(found, "_face", RULE_BANK, "words", conflict="label.conflict", conflict_margin=0.18, strengths=("strengths", keys))
    return out.select("_face.*", *(c for c in out.columns if c != "_face"))
