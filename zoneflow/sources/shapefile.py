"""Polygon shapefiles as a Spark data source.

A .shp file is read in parallel: its .shx index, eight bytes a record, tells where records lie, and each split reads its own byte
range and the same range of the .dbf attribute table. Attributes come as text, as all ids are; deleted rows are left out. What is
no polygon, not closed or not as long as the index says fails the read. Writing makes one or more shapefiles a task.
"""

from __future__ import annotations

import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from zoneflow.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Records of a split and of a written file; bytes that a split reads at once.
SPLIT_RECORDS, FILE_RECORDS, READ_BYTES = 20_000, 20_000, 8 << 20
#: Fixed values of the format: header size, shape types of polygons, widest text of an attribute.
HEADER, POLYGONS, WIDEST = 100, (5, 15, 25), 254
GEOMETRY = "geometry"


def beside(path: str, ending: str) -> str:
    """The file next to a .shp file, with an ending in the same case."""
    return path[:-4] + (ending.upper() if path[-3:].isupper() else ending)


@dataclass
class Table:
    """Layout of a .dbf file: rows, where they begin, bytes of each, and (name, start, width) of the fields."""

    rows: int
    start: int
    width: int
    fields: list[tuple[str, int, int]]


def table_of(root: str, path: str) -> Table:
    rows, start, width = struct.unpack("<IHH", files.range_of(root, path, 4, 8))
    head, fields, at = files.range_of(root, path, 32, start - 32), [], 1
    for i in range(0, len(head) - 31, 32):
        if head[i] == 0x0D:
            break
        fields.append((head[i : i + 11].split(b"\0")[0].decode("ascii"), at, head[i + 16]))
        at += head[i + 16]
    if at != width:
        raise ValueError(f"{path}: fields fill {at} of {width} bytes of a row")
    return Table(rows, start, width, fields)


def records_of(root: str, path: str) -> int:
    """Number of records by the length that the index states."""
    words = struct.unpack(">i", files.range_of(root, beside(path, ".shx"), 24, 4))[0]
    return (2 * words - HEADER) // 8


def signed_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def holds(ring: np.ndarray, point: np.ndarray) -> bool:
    """Whether a point lies inside a ring, by parity."""
    (x1, y1), (x2, y2) = ring[:-1].T, ring[1:].T
    across = (y1 > point[1]) != (y2 > point[1])
    at = x1[across] + (point[1] - y1[across]) / (y2[across] - y1[across]) * (x2[across] - x1[across])
    return bool((at > point[0]).sum() % 2)


def polygons_of(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Shells (clockwise) with their holes (the other way round); a hole belongs to the smallest shell around it."""
    areas = [signed_area(r) for r in rings]
    shells = sorted((i for i, a in enumerate(areas) if a <= 0), key=lambda i: -areas[i])
    found = {i: [rings[i]] for i in shells}
    for i, ring in enumerate(rings):
        if areas[i] > 0:
            around = next((s for s in shells if -areas[s] >= areas[i] and holds(rings[s], ring[:-1].mean(axis=0) if len(shells) < 2 else ring[0])), None)
            if around is None and len(shells) == 1:
                around = shells[0]
            if around is None:
                found[i] = [ring]
            else:
                found[around].append(ring)
    return [found[i] for i in sorted(found)]


def parsed(content: bytes, where: str) -> list[list[np.ndarray]] | None:
    """Polygons of the content of a record; None for a null shape."""
    kind = struct.unpack_from("<i", content)[0] if len(content) >= 4 else -1
    if kind == 0:
        return None
    if kind not in POLYGONS or len(content) < 44:
        raise ValueError(f"{where} is no polygon but shape type {kind}")
    n_parts, n_points = struct.unpack_from("<ii", content, 36)
    if n_parts < 0 or n_points < 0 or len(content) < 44 + 4 * n_parts + 16 * n_points:
        raise ValueError(f"{where} is too short for {n_parts} parts and {n_points} points")
    parts = np.frombuffer(content, "<i4", n_parts, 44)
    points = np.frombuffer(content, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    ends = np.append(parts, n_points)
    if n_parts and (parts[0] != 0 or (np.diff(ends) < 4).any()):
        raise ValueError(f"{where} has parts of fewer than four points")
    rings = [points[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    if any((r[0] != r[-1]).any() for r in rings) or not np.isfinite(points).all():
        raise ValueError(f"{where} has a ring that is not closed, or a coordinate that is no number")
    return polygons_of(rings)


def offsets(lists: list) -> np.ndarray:
    return np.cumsum([0, *(len(x) for x in lists)]).astype(np.int32)


def geometry_array(shapes: list[list[list[np.ndarray]] | None]) -> pa.Array:
    """Multipolygon values; None stays null."""
    polygons = [p for s in shapes for p in s or []]
    rings = [r for p in polygons for r in p]
    points = np.concatenate([np.zeros((0, 2)), *rings])
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(points) + 1, 2, dtype=np.int32)), pa.array(points.ravel()))
    value = pairs
    for lists in (rings, polygons, [s or [] for s in shapes]):
        value = pa.ListArray.from_arrays(pa.array(offsets(lists)), value)
    mask = pa.array([s is None for s in shapes])
    return pa.compute.if_else(mask, pa.scalar(None, value.type), value)


@dataclass
class Split(InputPartition):
    path: str
    first: int
    last: int


class ShapefileReader(DataSourceReader):
    def __init__(self, root: str, encoding: str, fields: list[str], records: int):
        self.root, self.encoding, self.fields, self.records = root, encoding, fields, records

    def partitions(self) -> list[Split]:
        splits = []
        for path in files.listed(self.root, ".shp"):
            n = records_of(self.root, path)
            table = table_of(self.root, beside(path, ".dbf"))
            if table.rows != n:
                raise ValueError(f"{path} has {n} shapes but {table.rows} attribute rows")
            if [f[0] for f in table.fields] != self.fields:
                raise ValueError(f"{path} has the fields {[f[0] for f in table.fields]}; the first file has {self.fields}")
            splits += [Split(path, a, min(a + self.records, n)) for a in range(0, n, self.records)]
        return splits or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.first == split.last:
            return
        n = split.last - split.first
        index = np.frombuffer(files.range_of(self.root, beside(split.path, ".shx"), HEADER + 8 * split.first, 8 * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        table_path = beside(split.path, ".dbf")
        table = table_of(self.root, table_path)
        start, size = index[:, 0], index[:, 1] + 8
        a = 0
        while a < n:
            # records follow each other in the file; where they do not, each is read by itself
            b = a + 1
            while b < n and start[b] == start[b - 1] + size[b - 1] and start[b] + size[b] - start[a] <= READ_BYTES:
                b += 1
            data = files.range_of(self.root, split.path, int(start[a]), int(start[b - 1] + size[b - 1] - start[a]))
            rows = files.range_of(self.root, table_path, table.start + (split.first + a) * table.width, (b - a) * table.width)
            shapes, texts = [], []
            for i in range(a, b):
                where = f"record {split.first + i + 1} of {split.path}"
                at = int(start[i] - start[a])
                if struct.unpack_from(">i", data, at + 4)[0] * 2 != index[i, 1]:
                    raise ValueError(f"{where} is not as long as its index says")
                row = rows[(i - a) * table.width : (i - a + 1) * table.width]
                if row[:1] == b"*":
                    continue
                shapes.append(parsed(data[at + 8 : at + int(size[i])], where))
                texts.append([row[s : s + w].decode(self.encoding).strip(" \0") or None for _, s, w in table.fields])
            columns = [pa.array([t[i] for t in texts], pa.string()) for i in range(len(self.fields))]
            yield pa.RecordBatch.from_arrays([*columns, geometry_array(shapes)], [*self.fields, GEOMETRY])
            a = b


@dataclass
class Written(WriterCommitMessage):
    staged: list[str]


class ShapefileWriter(DataSourceWriter):
    def __init__(self, root: str, encoding: str, fields: list[str]):
        self.root, self.encoding, self.fields = root, encoding, fields

    def write(self, rows: Iterator) -> Written:
        task, run, staged, held = TaskContext.get().partitionId(), uuid.uuid4().hex, [], []
        folder = files.located(self.root)[1].rstrip("/")

        def flush() -> None:
            name = f"{folder}/_staging/part-{task:05d}-{len(staged) // 3:05d}-{run}"
            for ending, data in zip((".shp", ".shx", ".dbf"), encoded(held, self.fields, self.encoding), strict=True):
                files.write_whole(self.root, name + ending, data)
                staged.append(name + ending)
            held.clear()

        for row in rows:
            held.append(row)
            if len(held) >= FILE_RECORDS:
                flush()
        if held:
            flush()
        return Written(staged)

    def commit(self, messages: list[Written | None]) -> None:
        files.publish(self.root, [name for m in messages if m for name in m.staged], files.located(self.root)[1].rstrip("/"))

    def abort(self, messages: list[Written | None]) -> None:
        files.withdraw(self.root, files.located(self.root)[1].rstrip("/"))


def encoded(rows: list, fields: list[str], encoding: str) -> tuple[bytes, bytes, bytes]:
    """The .shp, .shx and .dbf bytes of some rows."""
    shapes, index, at, boxes = [], [], HEADER, []
    for number, row in enumerate(rows, 1):
        content, shape = struct.pack("<i", 0), row[GEOMETRY]
        if shape is not None:
            rings = []
            for polygon in shape:
                for i, ring in enumerate(polygon):
                    points = np.array(ring, "<f8")
                    rings.append(points if (signed_area(points) < 0) == (i == 0) else points[::-1])
            every = np.concatenate(rings)
            box = np.concatenate([every.min(axis=0), every.max(axis=0)])
            boxes.append(box)
            content = struct.pack("<i4dii", 5, *box, len(rings), len(every)) + offsets(rings)[:-1].astype("<i4").tobytes() + every.tobytes()
        shapes.append(struct.pack(">ii", number, len(content) // 2) + content)
        index.append(struct.pack(">ii", at // 2, len(content) // 2))
        at += 8 + len(content)
    every = np.array(boxes).reshape(-1, 4)
    extent = [*every[:, :2].min(axis=0), *every[:, 2:].max(axis=0)] if boxes else [0.0] * 4

    def header(size: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", 1000, 5, *extent, 0, 0, 0, 0)

    texts = [[b"" if row[f] is None else str(row[f]).encode(encoding) for f in fields] for row in rows]
    widths = [max([1, *(len(t[i]) for t in texts)]) for i in range(len(fields))]
    if max(widths, default=0) > WIDEST:
        raise ValueError(f"a text is longer than the {WIDEST} bytes that an attribute holds")
    described = b"".join(struct.pack("<11scIBB14x", f.encode("ascii"), b"C", 0, w, 0) for f, w in zip(fields, widths, strict=True))
    table = struct.pack("<B3BIHH20x", 3, 126, 1, 1, len(rows), 33 + 32 * len(fields), 1 + sum(widths)) + described + b"\r"
    table += b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(t, widths, strict=True)) for t in texts) + b"\x1a"
    return header(at) + b"".join(shapes), header(HEADER + 8 * len(index)) + b"".join(index), table


class Shapefiles(DataSource):
    """Format `shapefile`: a .shp file or a folder of them. Options: path, encoding (utf-8), splitRecords."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        paths = files.listed(self.options["path"], ".shp")
        if not paths:
            raise FileNotFoundError(f"no .shp file in {self.options['path']}")
        names = [f[0] for f in table_of(self.options["path"], beside(paths[0], ".dbf")).fields]
        shape = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
        return T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(GEOMETRY, shape)])

    def reader(self, schema: T.StructType) -> ShapefileReader:
        records = int(self.options.get("splitRecords", SPLIT_RECORDS))
        return ShapefileReader(self.options["path"], self.options.get("encoding", "utf-8"), [n for n in schema.names if n != GEOMETRY], records)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShapefileWriter:
        fields = [n for n in schema.names if n != GEOMETRY]
        if GEOMETRY not in schema.names or any(len(n) > 10 for n in fields):
            raise ValueError(f"a shapefile needs a column {GEOMETRY!r} and names of 10 letters at most; found {schema.names}")
        return ShapefileWriter(self.options["path"], self.options.get("encoding", "utf-8"), fields)
