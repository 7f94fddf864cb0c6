import gzip
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lathwork.sources import container, meshes, models

IDENTITY = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
SHIFT = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 0, 1, 1]


def readable(loop=False):
    face = {"id": "f", "outer": [0, 1, 2, 3], "holes": [[4, 5, 6, 7]], "front_material_id": None, "tag_id": "t", "surface_hint": "floor", "hidden": False}
    flat = [0, 0, 0, 4, 0, 0, 4, 3, 0, 0, 3, 0, 1, 1, 0, 2, 1, 0, 2, 2, 0, 1, 2, 0]
    node = lambda i, owner, d, t, m=None, v=True: {"id": i, "name": i, "kind": "x", "owner_definition_id": owner, "definition_id": d, "transform_id": t, "material_override_id": m, "tag_id": "t", "visible": v}
    nodes = [node("root", None, "top", 1), node("a", "top", "panel", 0, "m"), node("b", "top", "panel", 1), node("no", "top", "panel", 0, v=False)]
    if loop:
        nodes.append(node("c", "panel", "top", 0))
    return {
        "format": {"name": "any", "version": "3.1.0"}, "tags": [{"id": "t", "name": "T", "visible": True}], "materials": [{"id": "m", "name": "M", "opacity": 1, "color": {"hex": "#336699"}}],
        "transforms": [IDENTITY, SHIFT], "meshes": [{"id": "mesh", "definition_id": "panel", "positions_m": flat, "faces": [face]}],
        "definitions": [{"id": "top", "kind": "root", "name": "Top", "mesh_id": None, "node_ids": ["a", "b", "no"]}, {"id": "panel", "kind": "c", "name": "Panel", "mesh_id": "mesh", "node_ids": []}], "nodes": nodes,
    }


COMPACT = {
    "format": {"version": "1.0.0", "identifier": models.COMPACT_ID}, "strings": ["mat", "Slate", "#336699", "tag", "T", "mesh", "face", "9", "floor", "top", "Top", "root", "panel", "Panel", "comp", "n0", "n1"],
    "materials": [[0, 1, 2, 1]], "tags": [[3, 4, True]], "transforms": IDENTITY + SHIFT,
    "meshes": [{"id": 5, "definition": 1, "quantization": {"minimum_m": [0, 0, 0], "scale_m": [0.5, 0.5, 1]}, "positions": [0, 0, 0, 2, 0, 0, 2, 2, 0, 0, 2, 0], "loops": [0, 1, 2, 3], "triangles": [0, 1, 2, 0, 2, 3], "faces": [[6, 7, 0, 4, [], 0, 6, 0, -1, 0, 8, 1]]}],
    "definitions": [[9, 10, 11, -1, [1]], [12, 13, 14, 0, []]], "nodes": [[15, 10, 1, 0, 0, -1, -1, True, -1], [16, 13, 2, 1, 1, -1, 0, True, -1]], "root_node": 0,
}


def test_documents_to_world_faces(spark, tmp_path):
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(json.dumps(readable(), indent=1).encode()))
    (tmp_path / "b.json").write_text(json.dumps(COMPACT))
    (tmp_path / "c.json").write_text('{"format": {"version": "9.0"}}')
    t = models.read_models(spark, [str(p) for p in sorted(tmp_path.iterdir())])
    assert t["unknown"].count() == 1 and models.problems(t).count() == 0
    rows = {(r.model.split("/")[-1], r.path): r for r in models.world_faces(t).collect()}
    assert sorted(rows) == [("a.json.gz", "root/a"), ("a.json.gz", "root/b"), ("b.json", "n0/n1")]
    a, b, c = (rows[k] for k in sorted(rows))
    assert (a.area, a.holes_area, a.surface, a.material_id) == (11.0, 1.0, "floor", "m") and b.material_id is None
    assert tuple(a.vertices[0]) == (5.0, 0.0, 1.0) and tuple(b.vertices[2]) == (14.0, 3.0, 2.0)
    assert math.isclose(c.area, 1.0) and c.material_id == "mat" and tuple(c.vertices[2]) == (6.0, 1.0, 1.0)
    with pytest.raises(ValueError, match="too large"):
        models.documents(spark, str(tmp_path / "b.json"), most_bytes=100)
    models.write_faces(models.world_faces(t), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_cycles_and_dangling(spark, tmp_path):
    doc = readable(loop=True)
    (tmp_path / "a.json").write_text(json.dumps(doc))
    t = models.read_models(spark, str(tmp_path / "a.json"))
    with pytest.raises(Exception, match="holds itself"):
        models.instances(t).collect()
    doc = readable()
    doc["nodes"][1]["definition_id"] = "gone"
    doc["nodes"].append(doc["nodes"][2])
    doc["meshes"][0]["faces"][0]["outer"] = [0, 1, 99]
    (tmp_path / "b.json").write_text(json.dumps(doc))
    found = {(r.reason, r.id) for r in models.problems(models.read_models(spark, str(tmp_path / "b.json"))).collect()}
    assert found == {("nodes: unknown definition_id", "a"), ("nodes: repeated id", "b"), ("faces: bad loop", "f")}


def test_container(spark, tmp_path):
    manifest = {"strings": ["a", "b"], "meshes": [{"quantization": {"minimum_m": [1, 2, 3], "scale_m": [0.5, 0.25, 2]}}]}
    sections = [(4, None, 3, np.array(IDENTITY)), (1, 0, 1, np.array([0, 4, 1, 2, 0, 65535])), (2, 0, 2, np.array([0, 1, 0]))]
    blob = container.pack(manifest, sections)
    (tmp_path / "good.bin").write_bytes(blob)
    bad = bytearray(blob)
    bad[-2] ^= 1
    (tmp_path / "bad.bin").write_bytes(bytes(bad))
    (tmp_path / "not.bin").write_bytes(b"nothing")
    (tmp_path / "head.bin").write_bytes(blob[:40] + b"x" + blob[41:])
    df = container.read_sections(spark, str(tmp_path))
    got = {(r.model.split("/")[-1], r.section): r.problem for r in df.collect()}
    assert got == {("good.bin", k): None for k in range(3)} | {("bad.bin", 0): None, ("bad.bin", 1): None, ("bad.bin", 2): "checksum", ("not.bin", None): "not a container", ("head.bin", None): "manifest damaged"}
    pts = container.positions(df.where("model like '%good%'")).first().points
    assert [tuple(p) for p in pts] == [(1.0, 3.0, 5.0), (2.0, 2.0, 131073.0)]
    assert spark.read.format("binaryFile").load(str(tmp_path)).where(container.is_container()).count() == 3


def mesh_rows(spark, n):
    p = lambda *v: dict(zip("xyz", map(float, v), strict=True))
    rows = [("floor" if i % 2 else "wall", f"m{i % 3}" if i % 4 else None, None if i % 5 == 0 else f"layer {i % 2}", i * 0.01, p(0, 0, 1), [p(i, -i, 0.1234), p(i + 1, 0, -0.0005), p(0, i, 2)] + [p(9, 9, i)] * (i % 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "surface string, material string, layer string, area double, normal struct<x:double,y:double,z:double>, points array<struct<x:double,y:double,z:double>>")


def test_binary_meshes_round_trip_in_ranges(spark, tmp_path):
    rows, df = mesh_rows(spark, 5000)
    meshes.write_meshes(df.repartition(3), str(tmp_path / "out"), rows_per_file="700")
    names = sorted(x.name for x in (tmp_path / "out").iterdir())
    assert "_SUCCESS" in names and len([n for n in names if n.endswith(".bome")]) == 9 and json.loads((tmp_path / "out" / "_SUCCESS").read_text()) == {"faces": 5000}
    got = meshes.read_meshes(spark, str(tmp_path / "out"), rows_per_task="130")
    assert got.rdd.getNumPartitions() > 40 and got.where("problem is not null").count() == 0
    key = lambda s, m, y, a, pts: (s, m, y, round(a, 4), tuple((round(v["x"], 3), round(v["y"], 3), round(v["z"], 3) + 0.0) for v in pts))
    want = sorted((key(s, m, y, a, [{k: math.copysign(math.floor(abs(v[k]) / 0.001 + 0.5) * 0.001, v[k]) for k in "xyz"} for v in pts]) for s, m, y, a, _, pts in rows), key=str)
    assert sorted((key(r.surface, r.material, r.layer, r.area, [v.asDict() for v in r.points]) for r in got.collect()), key=str) == want
    meshes.write_meshes(df.limit(10), str(tmp_path / "out"))  # replaced as a whole
    assert meshes.read_meshes(spark, str(tmp_path / "out")).count() == 10
    meshes.write_meshes(df.limit(0), str(tmp_path / "none"))
    assert meshes.read_meshes(spark, str(tmp_path / "none")).count() == 0


def test_binary_meshes_that_are_damaged(spark, tmp_path):
    rows, _ = mesh_rows(spark, 40)
    table = pa.Table.from_pylist([dict(zip(["surface", "material", "layer", "area", "normal", "points"], r, strict=True)) for r in rows], schema=pa.schema([meshes._ARROW.field(c) for c in ("surface", "material", "layer", "area", "normal", "points")]))
    good = meshes.packed(table)
    faces_at = len(good) - 40 * 9 * 4
    put = lambda at, v: good[:at] + int(v).to_bytes(4, "little", signed=True) + good[at + 4 :]
    files = {
        "a": good, "b": good[:-3], "c": good + b"x", "d": b"BOME9" + good[5:], "e": put(6 + 4, 7), "f": good.replace(b"positions_then_faces_v2", b"positions_then_faces_v1"), "g": good[:20], "h": put(faces_at + 36 * 4, 10**6), "i": put(faces_at + 36 * 5 + 4, 2),
        "j": put(faces_at + 36 * 6 + 8, 99), "k": put(faces_at + 36 * 7 + 12, -2), "l": put(faces_at + 36 * 8 + 16, 77), "m": good[:30] + b"\xff" + good[31:], "n.gz": gzip.compress(good), "o.gz": gzip.compress(good[:-5]), "p.gz": gzip.compress(good)[:-30], "_skipped": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = meshes.read_meshes(spark, str(tmp_path)).collect()
    said = {(r.model.split("/")[-1], r.face): r.problem for r in got if r.problem}
    assert said == {
        ("b", None): "truncated", ("c", None): "trailing bytes after face table", ("d", None): "magic mismatch", ("e", None): "byte counts do not match int counts", ("f", None): "stale binary layout marker", ("g", None): "truncated fixed header",
        ("h", 4): "vertex range outside position buffer", ("i", 5): "vertex_count < 3", ("j", 6): "surface index outside dictionary", ("k", 7): "material index outside dictionary", ("l", 8): "layer index outside dictionary", ("m", None): "json header damaged", ("o.gz", None): "truncated faces", ("p.gz", None): "not whole",
    }
    assert sum(r.problem is None for r in got) == 40 + 5 * 39 + 40
    small = meshes.read_meshes(spark, str(tmp_path / "n.gz"), most_unpacked_bytes="100").first()
    assert small.problem == "too large to unpack"


def test_mesh_files_of_a_failed_job_are_removed(spark, tmp_path):
    _, df = mesh_rows(spark, 50)
    broken = df.withColumn("area", F.when(F.col("area") > 0.3, F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("area"))).repartition(4)
    with pytest.raises(Exception):  # noqa: B017
        meshes.write_meshes(broken, str(tmp_path / "out"))
    assert not [x for x in (tmp_path / "out").rglob("*") if x.is_file()] if (tmp_path / "out").exists() else True
