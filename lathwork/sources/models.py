"""Model files to normalized tables, and instances expanded to world faces.

All readers give the same tables, keyed by the file they came from (``model``):

    materials(model, material_id, name, hex, opacity)   tags(model, tag_id, name, visible)
    definitions(model, definition_id, name, kind, mesh_id)
    nodes(model, node_id, owner_definition_id, definition_id, transform, material_id, tag_id, visible)
    faces(model, mesh_id, face_id, vertices, holes, material_id, tag_id, surface_hint)

Vertices are in definition-local metres.  Documents are read whole, one a row: a document is the unit of a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators.graph import settled

Tables = dict[str, DataFrame]

# fixed values: the readable format's fields that the tables need
READABLE = """
    format struct<name:string,version:string>,
    tags array<struct<id:string,name:string,visible:boolean>>,
    materials array<struct<id:string,name:string,opacity:double,color:struct<hex:string>>>,
    transforms array<array<double>>,
    meshes array<struct<id:string,definition_id:string,positions_m:array<double>,faces:array<struct<id:string,outer:array<int>,holes:array<array<int>>,front_material_id:string,tag_id:string,surface_hint:string,hidden:boolean>>>>,
    definitions array<struct<id:string,kind:string,name:string,mesh_id:string,node_ids:array<string>>>,
    nodes array<struct<id:string,name:string,kind:string,owner_definition_id:string,definition_id:string,transform_id:int,material_override_id:string,tag_id:string,visible:boolean>>
"""
# fixed values: the compact format's identifier, fields and the order inside its rows
COMPACT_ID = "model_eval_json_v1"
COMPACT = """
    format struct<identifier:string,version:string>, strings array<string>, materials array<array<double>>, tags array<array<string>>, transforms array<double>,
    meshes array<struct<id:int,definition:int,quantization:struct<minimum_m:array<double>,scale_m:array<double>>,positions:array<bigint>,loops:array<int>,faces:array<array<string>>>>,
    definitions array<array<string>>, nodes array<array<string>>, root_node int
"""


def documents(spark: SparkSession, paths: str | list[str], most_bytes: int = 1 << 30) -> DataFrame:
    """(model, text): files, gzipped or not, read whole; larger ones than ``most_bytes`` fail, by their size before they are read, packed ones when unpacked."""
    large = spark.read.format("binaryFile").load(paths).where(F.col("length") > most_bytes).select("path").head(1)  # sizes only
    if large:
        raise ValueError(f"a model file is too large: {large[0].path}")
    df = spark.read.text(paths, wholetext=True)
    text = F.when(F.octet_length("value") > most_bytes, F.raise_error(F.lit("a model file is too large"))).otherwise(F.col("value"))
    return df.select(F.input_file_name().alias("model"), text.alias("text"))


def kind(text: Column) -> Column:
    """readable, compact or unknown."""
    ident = F.get_json_object(text, "$.format.identifier")
    version = F.get_json_object(text, "$.format.version")
    return F.when(ident == COMPACT_ID, "compact").when(version.startswith("3."), "readable").otherwise("unknown")


def _rows(df: DataFrame, column: str) -> DataFrame:
    return df.select("model", F.posexplode(column).alias("at", "r"))


def _points(flat: Column) -> Column:
    """(x, y, z) structs from a flat array; null if there is none."""
    point = lambda i: F.named_struct(*(x for k, n in enumerate("xyz") for x in (F.lit(n), F.get(flat, i * 3 + k).cast("double"))))
    return F.when(F.size(flat) >= 3, F.transform(F.sequence(F.lit(0), (F.size(flat) / 3).cast("int") - 1), point))


def readable_tables(docs: DataFrame) -> Tables:
    """Tables of readable documents (format 3.x)."""
    d = docs.where(kind(F.col("text")) == "readable").select("model", F.from_json("text", READABLE).alias("d")).select("model", "d.*")
    meshes = _rows(d, "meshes").select("model", F.col("r.id").alias("mesh_id"), _points(F.col("r.positions_m")).alias("points"), F.explode("r.faces").alias("f")).where("not coalesce(f.hidden, false)")
    ring = lambda ids: F.transform(ids, lambda i: F.get(F.col("points"), i))
    return {
        "materials": _rows(d, "materials").select("model", F.col("r.id").alias("material_id"), "r.name", F.col("r.color.hex").alias("hex"), "r.opacity"),
        "tags": _rows(d, "tags").select("model", F.col("r.id").alias("tag_id"), "r.name", "r.visible"),
        "definitions": _rows(d, "definitions").select("model", F.col("r.id").alias("definition_id"), "r.name", "r.kind", "r.mesh_id"),
        "nodes": d.select("model", "transforms", F.explode("nodes").alias("r")).select("model", F.col("r.id").alias("node_id"), "r.owner_definition_id", "r.definition_id", F.get("transforms", F.col("r.transform_id")).alias("transform"), F.col("r.material_override_id").alias("material_id"), "r.tag_id", F.coalesce("r.visible", F.lit(True)).alias("visible")),
        "faces": meshes.select("model", "mesh_id", F.col("f.id").alias("face_id"), ring(F.col("f.outer")).alias("vertices"), F.transform("f.holes", ring).alias("holes"), F.col("f.front_material_id").alias("material_id"), "f.tag_id", "f.surface_hint"),
    }


def compact_tables(docs: DataFrame) -> Tables:
    """Tables of compact documents: positional rows over a string table; a negative index is no reference."""
    d = docs.where(kind(F.col("text")) == "compact").select("model", F.from_json("text", COMPACT).alias("d")).select("model", "d.*")
    at = lambda i: F.when(i >= 0, F.get(F.col("strings"), i.cast("int")))
    of = lambda table, i, place=0: F.when(i >= 0, at(F.get(F.get(F.col(table), i.cast("int")), F.lit(place)).cast("int")))
    r = lambda k: F.get(F.col("r"), F.lit(k))
    n = lambda k: r(k).cast("int")
    names = d.select("model", "strings", "materials", "tags", "definitions", "transforms", "meshes", "nodes")
    node_rows = names.select("model", "strings", "materials", "tags", "definitions", "transforms", F.posexplode("nodes").alias("node", "r"))
    owners = names.select("model", "strings", F.explode("definitions").alias("d")).select("model", at(F.get("d", F.lit(0)).cast("int")).alias("owner_definition_id"), F.explode(F.from_json(F.get("d", F.lit(4)), "array<int>")).alias("node"))
    start = n(4) * 16
    nodes = node_rows.select("model", "node", at(n(0)).alias("node_id"), of("definitions", n(3)).alias("definition_id"), F.slice("transforms", start + 1, F.lit(16)).alias("transform"), of("materials", n(5)).alias("material_id"), of("tags", n(6)).alias("tag_id"), (r(7) == "true").alias("visible"))
    mesh = names.select("model", "strings", "materials", "tags", F.posexplode("meshes").alias("mesh", "m"))
    back = F.transform("m.positions", lambda v, i: F.get(F.col("m.quantization.minimum_m"), i % 3) + v * F.get(F.col("m.quantization.scale_m"), i % 3))
    face = mesh.select("model", "strings", "materials", "tags", at(F.col("m.id")).alias("mesh_id"), _points(back).alias("points"), F.col("m.loops").alias("loops"), F.explode("m.faces").alias("r"))
    loop = lambda a, c: F.transform(F.slice("loops", a + 1, c), lambda i: F.get(F.col("points"), i))
    holes = F.transform(F.from_json(r(4), "array<array<int>>"), lambda h: loop(h[0], h[1]))
    return {
        "materials": names.select("model", "strings", F.explode("materials").alias("r")).select("model", at(r(0)).alias("material_id"), at(r(1)).alias("name"), at(r(2)).alias("hex"), r(3).alias("opacity")),
        "tags": names.select("model", "strings", F.explode("tags").alias("r")).select("model", at(n(0)).alias("tag_id"), at(n(1)).alias("name"), (r(2) == "true").alias("visible")),
        "definitions": names.select("model", "strings", "meshes", F.explode("definitions").alias("r")).select("model", at(n(0)).alias("definition_id"), at(n(1)).alias("name"), at(n(2)).alias("kind"), F.when(n(3) >= 0, at(F.get(F.col("meshes"), n(3))["id"])).alias("mesh_id")),
        "nodes": nodes.join(owners, ["model", "node"], "left").select("model", "node_id", "owner_definition_id", "definition_id", "transform", "material_id", "tag_id", "visible"),
        "faces": face.select("model", "mesh_id", at(n(0)).alias("face_id"), loop(n(2), n(3)).alias("vertices"), holes.alias("holes"), of("materials", n(7)).alias("material_id"), of("tags", n(9)).alias("tag_id"), at(n(10)).alias("surface_hint")),
    }


def read_models(spark: SparkSession, paths: str | list[str]) -> Tables:
    """Tables of all documents, whichever of the two forms each has; others are in ``unknown``."""
    docs = documents(spark, paths)
    a, b = readable_tables(docs), compact_tables(docs)
    return {k: a[k].unionByName(b[k]) for k in a} | {"unknown": docs.where(kind(F.col("text")) == "unknown").select("model")}


def instances(tables: Tables, most_depth: int = 80) -> DataFrame:
    """(model, path, node_id, definition_id, world, material_id, depth) of every visible occurrence.

    Level by level from the roots (nodes without owner): world is the parent's matrix times the node's, a node
    without material inherits the nearest one above.  A definition that holds itself fails, as do deeper levels
    than ``most_depth``.
    """
    n = tables["nodes"].where("visible")
    level = settled(n.where("owner_definition_id is null").select("model", F.col("node_id").alias("path"), "node_id", "definition_id", F.col("transform").alias("world"), "material_id", F.lit(0).alias("depth"), F.array("definition_id").alias("seen")))
    out = level
    for depth in range(1, most_depth + 2):
        up = level.select("model", F.col("definition_id").alias("owner_definition_id"), F.col("path").alias("_path"), F.col("world").alias("_world"), F.col("material_id").alias("_material"), F.col("seen").alias("_seen"))
        below = n.join(up, ["model", "owner_definition_id"])
        again = F.expr("array_contains(_seen, definition_id)")
        checked = F.when(again, F.raise_error(F.lit("a definition holds itself"))).otherwise(F.col("definition_id"))
        level = settled(below.select("model", F.concat_ws("/", "_path", "node_id").alias("path"), "node_id", checked.alias("definition_id"), geometry.matrix_product("_world", "transform").alias("world"), F.coalesce("material_id", "_material").alias("material_id"), F.lit(depth).alias("depth"), F.concat("_seen", F.array("definition_id")).alias("seen")))
        if level.isEmpty():
            return out.drop("seen")
        out = out.unionByName(level)
    raise ValueError(f"instances nest deeper than {most_depth}")


def world_faces(tables: Tables, found: DataFrame | None = None) -> DataFrame:
    """(model, path, face_id, material_id, surface, area, holes_area, normal, vertices) in world coordinates.

    The area is that of the outer loop less its holes; the face's own material comes before the instance's.
    """
    i = (found if found is not None else instances(tables)).join(tables["definitions"].select("model", "definition_id", "mesh_id"), ["model", "definition_id"])
    f = tables["faces"].withColumnRenamed("material_id", "own_material")
    ring = lambda ps: F.transform(ps, lambda p: geometry.moved("world", p))
    w = i.join(f, ["model", "mesh_id"]).select("model", "path", "face_id", F.coalesce("own_material", "material_id").alias("material_id"), ring(F.col("vertices")).alias("vertices"), F.transform("holes", ring).alias("holes"))
    inner = F.aggregate("holes", F.lit(0.0), lambda s, h: s + geometry.polygon_area_3d(h))
    w = w.withColumn("normal", geometry.newell_normal("vertices")).withColumn("holes_area", inner)
    area = F.greatest(geometry.polygon_area_3d("vertices") - F.col("holes_area"), F.lit(0.0))
    return w.select("model", "path", "face_id", "material_id", geometry.surface_of("normal").alias("surface"), area.alias("area"), "holes_area", "normal", "vertices")


def problems(tables: Tables) -> DataFrame:
    """(model, reason, id): references that lead nowhere, repeated ids, faces of fewer than three points."""

    def missing(table: str, column: str, id_col: str, other: str, other_col: str) -> DataFrame:
        keys = tables[other].select("model", F.col(other_col).alias(column)).distinct()
        bad = tables[table].where(F.col(column).isNotNull()).join(keys, ["model", column], "left_anti")
        return bad.select("model", F.lit(f"{table}: unknown {column}").alias("reason"), F.col(id_col).alias("id"))

    out = missing("nodes", "definition_id", "node_id", "definitions", "definition_id")
    for args in (("nodes", "material_id", "node_id", "materials", "material_id"), ("nodes", "tag_id", "node_id", "tags", "tag_id"), ("faces", "material_id", "face_id", "materials", "material_id"), ("faces", "tag_id", "face_id", "tags", "tag_id")):
        out = out.unionByName(missing(*args))
    for table, id_col in (("nodes", "node_id"), ("definitions", "definition_id"), ("materials", "material_id"), ("tags", "tag_id")):
        twice = tables[table].groupBy("model", id_col).count().where("count > 1")
        out = out.unionByName(twice.select("model", F.lit(f"{table}: repeated id").alias("reason"), F.col(id_col).alias("id")))
    thin = F.exists("vertices", lambda p: p.isNull()) | (F.size("vertices") < 3)
    return out.unionByName(tables["faces"].where(thin).select("model", F.lit("faces: bad loop").alias("reason"), F.col("face_id").alias("id")))


def write_faces(faces: DataFrame, path: str) -> None:
    """One gzipped JSON line for each model: its faces by id, so that the same model gives the same bytes."""
    row = F.struct("path", "face_id", "material_id", "surface", F.round("area", 6).alias("area"))
    faces.groupBy("model").agg(F.array_sort(F.collect_list(row)).alias("faces")).select(F.to_json(F.struct("model", "faces")).alias("value")).write.option("compression", "gzip").text(path)
