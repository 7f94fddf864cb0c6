"""The older binary mesh files as a Spark data source: a fixed head, a JSON header, whole-number positions, a table of faces.

Reading plans partitions from the heads alone: a file's table of faces is cut into ranges of rows, and a task seeks its
range and only the positions that it names, so a file may be larger than any task's memory.  What does not hold - a
short file, counts that disagree, a face outside the positions or the dictionaries - comes out as rows with a problem,
apart from the others.  Writing puts out a file for each so many rows of a task under a temporary name; the job's commit
gives all of them their names, its abort removes them.  Paths may be of any file system that Arrow knows.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# fixed values: magic, head of five 32-bit counts, layout's name, scales and columns of a face
MAGIC, HEAD = b"BOME1\n", struct.Struct("<5I")
LAYOUT = "positions_then_faces_v2_int_counts"
POSITION_SCALE, AREA_SCALE, NORMAL_SCALE, STRIDE = 0.001, 0.0001, 0.0001, 9

NAME = "binary_mesh"
_XYZ = "struct<x:double,y:double,z:double>"
SCHEMA = f"model string, face long, surface string, material string, layer string, area double, normal {_XYZ}, points array<{_XYZ}>, problem string"
_STRUCT = pa.struct([(k, pa.float64()) for k in "xyz"])
_ARROW = pa.schema([("model", pa.string()), ("face", pa.int64()), ("surface", pa.string()), ("material", pa.string()), ("layer", pa.string()), ("area", pa.float64()), ("normal", _STRUCT), ("points", pa.list_(_STRUCT)), ("problem", pa.string())])
BATCH, SPAN = 4096, 1 << 20  # faces and vertices looked at together


@dataclass
class Rows(InputPartition):
    """Faces ``first`` to ``last`` of a file, or its problem."""

    path: str
    first: int = 0
    last: int = 0
    problem: str | None = None
    whole: bool = False  # a compressed file, which cannot be entered in the middle


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Table:
    """An open file's counts, dictionaries and offsets; raises ValueError with the problem."""

    def __init__(self, file: io.IOBase, size: int | None) -> None:
        self.file = file
        self.at = 0
        if self.take(len(MAGIC), "magic") != MAGIC:
            raise ValueError("magic mismatch")
        header_bytes, n_positions, n_ints, position_bytes, face_bytes = HEAD.unpack(self.take(HEAD.size, "fixed header"))
        if position_bytes != 4 * n_positions or face_bytes != 4 * n_ints:
            raise ValueError("byte counts do not match int counts")
        if n_positions % 3:
            raise ValueError("position count must be divisible by 3")
        self.positions_at = len(MAGIC) + HEAD.size + header_bytes
        self.faces_at = self.positions_at + position_bytes
        if size is not None and self.faces_at + face_bytes != size:
            raise ValueError("truncated" if self.faces_at + face_bytes > size else "trailing bytes after face table")
        try:
            mesh = json.loads(self.take(header_bytes, "json header")).get("mesh")
        except (UnicodeDecodeError, json.JSONDecodeError, AttributeError):
            raise ValueError("json header damaged") from None
        if not mesh:
            raise ValueError("missing mesh header")
        if mesh.get("binary_layout") != LAYOUT:
            raise ValueError("stale binary layout marker")
        self.stride = int(mesh.get("face_stride") or 0)
        if self.stride < STRIDE:
            raise ValueError("face_stride must be at least 9")
        if n_ints % self.stride:
            raise ValueError("face int count not divisible by stride")
        self.vertices, self.rows = n_positions // 3, n_ints // self.stride
        name = lambda x: x if isinstance(x, str) or x is None else x.get("name")
        self.names = [[name(x) for x in mesh.get(k) or []] for k in ("surfaces", "materials", "layers")]
        self.scales = [mesh.get(k) or d for k, d in (("position_scale", POSITION_SCALE), ("area_scale", AREA_SCALE), ("normal_scale", NORMAL_SCALE))]

    def take(self, n: int, what: str) -> bytes:
        data = self.file.read(n)
        if data is None or len(data) != n:
            raise ValueError(f"truncated {what}")
        return data

    def ints(self, at: int, n: int, what: str) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.take(4 * n, what), "<i4")


def _problems(t: _Table, f: np.ndarray) -> np.ndarray:
    """The first problem of each face, None for a sound one."""
    start, length = f[:, 0].astype(np.int64), f[:, 1].astype(np.int64)
    said = np.full(len(f), None, object)
    checks = [(length < 3, "vertex_count < 3"), ((start < 0) | (start + length > t.vertices), "vertex range outside position buffer")]
    checks += [((f[:, c] < low) | (f[:, c] >= len(names)), f"{what} index outside dictionary") for c, low, what, names in zip((2, 3, 4), (0, -1, -1), ("surface", "material", "layer"), t.names, strict=True)]
    for bad, why in reversed(checks):
        said[bad] = why
    return said


def _batch(t: _Table, path: str, first: int, f: np.ndarray, slices) -> pa.RecordBatch:
    """Rows of the faces ``f``; ``slices(lo, hi)`` gives the positions of vertices lo to hi."""
    said = _problems(t, f)
    good = np.flatnonzero(said == None)  # noqa: E711
    start, length = f[:, 0].astype(np.int64), np.where(said == None, f[:, 1], 0).astype(np.int64)  # noqa: E711
    offsets = np.concatenate(([0], np.cumsum(length)))
    points = np.zeros((int(offsets[-1]), 3))
    if len(good):
        lo, hi = int(start[good].min()), int((start + length)[good].max())
        if hi - lo <= max(SPAN, int(offsets[-1])):
            held = slices(lo, hi)
            points[:] = held[np.repeat(start - lo - offsets[:-1], length) + np.arange(len(points))]
        else:  # far apart: one seek a face
            for i in good:
                points[offsets[i] : offsets[i + 1]] = slices(int(start[i]), int(start[i] + length[i]))
    points = points * t.scales[0]
    named = lambda c, names: pa.array(names, pa.string()).take(pa.array(f[:, c], mask=(f[:, c] < 0) | (f[:, c] >= len(names))))
    xyz = lambda v: pa.StructArray.from_arrays([pa.array(v[:, k]) for k in range(3)], ["x", "y", "z"])
    rows = pa.array(np.arange(first, first + len(f), dtype=np.int64))
    ring = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), xyz(points))
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), len(f)), rows, *(named(c, n) for c, n in zip((2, 3, 4), t.names, strict=True)), pa.array(f[:, 5] * t.scales[1]), xyz(f[:, 6:9] * t.scales[2]), ring, pa.array(said.tolist(), pa.string())], schema=_ARROW)


def _lost(path: str, problem: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"model": path, "problem": problem}], schema=_ARROW)


class MeshReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], int(options.get("rows_per_task", 65_536))
        self.most = int(options.get("most_unpacked_bytes", 1 << 29))

    def partitions(self) -> Sequence[Rows]:
        fs, path = _file_system(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if f.path.lower().endswith(".gz"):
                out.append(Rows(f.path, whole=True))
                continue
            try:
                with fs.open_input_file(f.path) as file:
                    t = _Table(file, f.size)
                out += [Rows(f.path, a, min(a + self.rows, t.rows)) for a in range(0, t.rows, self.rows)]
            except ValueError as e:
                out.append(Rows(f.path, problem=str(e)))
        return out or [Rows("", problem="")]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.problem is not None:
            if part.path:
                yield _lost(part.path, part.problem)
            return
        fs, _ = _file_system(self.path)
        if part.whole:
            yield from self._unpacked(fs, part.path)
            return
        with fs.open_input_file(part.path) as file:
            t = _Table(file, None)
            slices = lambda lo, hi: t.ints(t.positions_at + 12 * lo, 3 * (hi - lo), "positions").reshape(-1, 3)
            for at in range(part.first, part.last, BATCH):
                n = min(BATCH, part.last - at)
                yield _batch(t, part.path, at, t.ints(t.faces_at + 4 * t.stride * at, t.stride * n, "faces").reshape(n, t.stride), slices)

    def _unpacked(self, fs: pafs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        """A compressed file is read once, in order, with its positions held; one that is too large is a problem."""
        try:
            with fs.open_input_file(path) as raw, gzip.GzipFile(fileobj=raw) as file:
                t = _Table(file, None)
                if t.faces_at > self.most:
                    raise ValueError("too large to unpack")
                held = np.frombuffer(t.take(12 * t.vertices, "positions"), "<i4").reshape(-1, 3)
                faces = np.frombuffer(t.take(4 * t.stride * t.rows, "faces"), "<i4").reshape(-1, t.stride)
                if file.read(1):
                    raise ValueError("trailing bytes after face table")
        except (ValueError, EOFError, OSError) as e:
            yield _lost(path, str(e) if isinstance(e, ValueError) else "not whole")
            return
        for at in range(0, t.rows, BATCH):
            yield _batch(t, path, at, faces[at : at + BATCH], lambda lo, hi: held[lo:hi])


def _whole(v: np.ndarray, scale: float) -> np.ndarray:
    """The nearest whole multiples, halves away from zero."""
    return (np.sign(v) * np.floor(np.abs(v) / scale + 0.5)).astype("<i4")


def packed(rows: pa.Table, header: dict | None = None) -> bytes:
    """One file's bytes from faces with surface, material, layer, area, normal and points."""
    ring = rows["points"].combine_chunks()
    ring = ring if isinstance(ring, pa.ListArray) else pa.concat_arrays(ring.chunks)
    length, flat = ring.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ring.flatten()
    three = lambda s: np.column_stack([s.field(k).to_numpy(zero_copy_only=False) for k in "xyz"])
    normal = rows["normal"].combine_chunks()
    normal = normal if isinstance(normal, pa.StructArray) else pa.concat_arrays(normal.chunks)
    names, columns = {}, []
    for key, c in (("surfaces", "surface"), ("materials", "material"), ("layers", "layer")):
        coded = rows[c].cast(pa.string()).combine_chunks()
        coded = coded if isinstance(coded, pa.Array) else pa.concat_arrays(coded.chunks)
        coded = coded.dictionary_encode("encode" if c == "surface" else "mask")  # names in order of their first face
        index = coded.dictionary.to_pylist()
        names[key] = index if c != "material" else [{"name": v} for v in index]
        columns.append(coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("<i4"))
    start = np.cumsum(length) - length
    area = _whole(rows["area"].to_numpy(), AREA_SCALE)
    faces = np.column_stack([start.astype("<i4"), length.astype("<i4"), *columns, area, _whole(np.nan_to_num(three(normal)), NORMAL_SCALE)]).astype("<i4")
    positions = _whole(three(flat), POSITION_SCALE)
    mesh = {"position_scale": POSITION_SCALE, "area_scale": AREA_SCALE, "normal_scale": NORMAL_SCALE, "face_stride": STRIDE, **names, "binary_layout": LAYOUT, "position_count": positions.size, "face_int_count": faces.size}
    text = json.dumps((header or {}) | {"geometry_format": "binary_mesh_v1", "mesh": mesh}, separators=(",", ":")).encode()
    text += b" " * (-(len(MAGIC) + HEAD.size + len(text)) % 4)
    return MAGIC + HEAD.pack(len(text), positions.size, faces.size, 4 * positions.size, 4 * faces.size) + text + positions.tobytes() + faces.tobytes()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    faces: int


class MeshWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.rows, self.overwrite = options["path"], int(options.get("rows_per_file", 200_000)), overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = _file_system(self.path)
        task = TaskContext.get()
        # an attempt has names of its own: only those of the attempt that Spark counts are in its message
        stem = f"{root}/_{self.job}/{task.partitionId():05d}-{task.taskAttemptId()}"
        fs.create_dir(f"{root}/_{self.job}", recursive=True)
        held, n, files, faces = [], 0, [], 0

        def flush() -> None:
            nonlocal held, n
            name = f"{stem}-{len(files):04d}.bome"
            with fs.open_output_stream(name) as out:
                out.write(packed(pa.Table.from_batches(held)))
            files.append(name)
            held, n = [], 0

        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a file is filled up whatever the batches' sizes
                held.append(batch.slice(at, self.rows - n))
                n, faces, at = n + held[-1].num_rows, faces + held[-1].num_rows, at + held[-1].num_rows
                if n >= self.rows:
                    flush()
        if n:
            flush()
        return Written(files, faces)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _file_system(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        total = 0
        for k, name in enumerate(f for m in messages if m for f in m.files):
            fs.move(name, f"{root}/{self.job}-{k:06d}.bome")
        total = sum(m.faces for m in messages if m)
        self._clear()
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"faces": total}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = _file_system(self.path)
        if fs.get_file_info(f"{root}/_{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_{self.job}")


class MeshSource(DataSource):
    """``spark.read.format("binary_mesh").load(path)`` and ``df.write.format("binary_mesh").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MeshReader:
        return MeshReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MeshWriter:
        return MeshWriter(self.options, overwrite)


def read_meshes(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Faces of all files under a path; rows with a problem are quarantined by ``where("problem is not null")``."""
    spark.dataSource.register(MeshSource)
    return spark.read.format(NAME).options(**options).load(path)


def write_meshes(faces: DataFrame, path: str, **options: str) -> None:
    """Faces with surface, material, layer, area, normal and points as files under a path, replaced as a whole."""
    faces.sparkSession.dataSource.register(MeshSource)
    faces.select("surface", "material", "layer", "area", "normal", "points").write.format(NAME).options(**options).mode("overwrite").save(path)
