"""The binary container: sections of typed arrays behind a JSON manifest and a directory with checksums.

A container is one row of the ``binaryFile`` source.  Reading it gives a row per section, with the reason where it isn't
whole; positions come back from whole numbers by each mesh's minimum and scale.  Writing packs a manifest and its
sections, each to an even four bytes.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: magic, sizes, codes of kinds and components
MAGIC = b"BOME2\n"
HEAD, ENTRY = struct.Struct("<6I"), struct.Struct("<8I")
KINDS = {1: "positions", 2: "loops", 3: "triangles", 4: "transforms"}
COMPONENTS = {1: "<u2", 2: "<u4", 3: "<f4"}
GLOBAL = 0xFFFFFFFF

SCHEMA = "model string, manifest string, section int, kind string, mesh int, component string, n_values bigint, problem string, data array<double>"


def is_container(column: str = "content"):
    return F.substring(F.col(column), 1, len(MAGIC)) == F.lit(MAGIC)


def parts(blob: bytes, with_data: bool = True) -> Iterator[dict]:
    """A row per section; one row with the problem alone if the container can't be entered."""
    none = {"manifest": None, "section": None, "kind": None, "mesh": None, "component": None, "n_values": None, "data": None}
    if not blob.startswith(MAGIC) or len(blob) < len(MAGIC) + HEAD.size:
        yield none | {"problem": "not a container"}
        return
    size, directory, count, crc, flags, _ = HEAD.unpack_from(blob, len(MAGIC))
    at = len(MAGIC) + HEAD.size
    text = blob[at : at + size].rstrip(b" ")
    if not flags & 1 or zlib.crc32(text) != crc or directory != count * ENTRY.size or at + size + directory > len(blob):
        yield none | {"problem": "manifest damaged"}
        return
    manifest = text.decode()
    if len(strings := json.loads(manifest).get("strings", [])) != len(set(strings)):
        yield none | {"problem": "strings repeat"}
        return
    end = at + size + directory
    for k in range(count):
        kind, mesh, start, length, n, component, check, _ = ENTRY.unpack_from(blob, at + size + k * ENTRY.size)
        data = blob[start : start + length]
        dtype = COMPONENTS.get(component)
        problem = (
            "unknown kind" if kind not in KINDS or dtype is None
            else "out of place" if start % 4 or start < end or start + length > len(blob)
            else "wrong length" if np.dtype(dtype).itemsize * n != length
            else "checksum" if zlib.crc32(data) != check
            else None
        )
        end = max(end, start + length)
        values = np.frombuffer(data, dtype).astype(float).tolist() if with_data and not problem else None
        yield {"manifest": manifest if k == 0 else None, "section": k, "kind": KINDS.get(kind), "mesh": None if mesh == GLOBAL else mesh, "component": dtype, "n_values": n, "problem": problem, "data": values}


def read_sections(spark: SparkSession, paths: str | list[str], with_data: bool = True) -> DataFrame:
    """Rows of all containers; without data only heads are decoded."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"model": path} | row for path, blob in zip(f["path"], f["content"], strict=True) for row in parts(bytes(blob), with_data)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"section": "Int32", "mesh": "Int32", "n_values": "Int64"})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(each, SCHEMA)


def positions(sections: DataFrame) -> DataFrame:
    """(model, mesh, points): coordinates in metres."""
    meshes = sections.where("manifest is not null").select("model", F.posexplode(F.from_json(F.get_json_object("manifest", "$.meshes"), "array<struct<quantization:struct<minimum_m:array<double>,scale_m:array<double>>>>")).alias("mesh", "m"))
    s = sections.where("kind = 'positions' and problem is null").select("model", "mesh", "data").join(meshes, ["model", "mesh"])
    value = F.transform("data", lambda v, i: F.get(F.col("m.quantization.minimum_m"), i % 3) + v * F.get(F.col("m.quantization.scale_m"), i % 3))
    from .models import _points

    return s.select("model", "mesh", _points(value).alias("points"))


def pack(manifest: dict, sections: list[tuple[int, int | None, int, np.ndarray]]) -> bytes:
    """A container from a manifest and (kind, mesh, component, values) sections."""
    text = json.dumps(manifest, separators=(",", ":")).encode()
    at = len(MAGIC) + HEAD.size
    padded = text + b" " * (-(at + len(text)) % 4)
    place = at + len(padded) + ENTRY.size * len(sections)
    directory, body = b"", b""
    for kind, mesh, component, values in sections:
        data = np.asarray(values).astype(COMPONENTS[component]).tobytes()
        directory += ENTRY.pack(kind, GLOBAL if mesh is None else mesh, place + len(body), len(data), len(values), component, zlib.crc32(data), 0)
        body += data + b"\0" * (-len(data) % 4)
    return MAGIC + HEAD.pack(len(padded), len(directory), len(sections), zlib.crc32(text), 1, 0) + padded + directory + body
