"""Polygons of shapefiles, read by many tasks, and degrees for projected ones.

``spark.read.format("shapes").option("path", "…/areas.shp")``: a row for each record, with its number, the fields
of the table beside it (``.dbf``) and ``polygons``, an array of polygons, each an array of rings of points, the outer ring first.
The index (``.shx``) says where each record lies, so a task seeks to its own records. Driver and executors open the files at
the same path; ``unpacked`` takes them out of an archive.

Defined results: a record without a shape has null polygons; outer rings run clockwise, and a ring that runs the other way is
a hole of the smallest outer ring around it, or a polygon of its own where there is none; a ring of fewer than three points
that differ is left out; a deleted table row keeps its record; blanks are null; kinds of shapes other than polygons are an error.
"""

from __future__ import annotations

import codecs
import os
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POLYGONS = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))
# Fixed values of the format: kinds of shapes with rings (plain, with heights, with measures), and the sizes of headers in bytes.
RINGED, NO_SHAPE, HEADER, INDEX_ENTRY = (5, 15, 25), 0, 100, 8


def unpacked(archive: str, folder: str) -> str:
    """Take an archive's files out into ``folder``, by their own names; the path of its first ``.shp``."""
    os.makedirs(folder, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        for n in names:
            with open(os.path.join(folder, os.path.basename(n)), "wb") as f:
                f.write(z.read(n))
    found = next((n for n in names if n.lower().endswith(".shp")), None)
    if found is None:
        raise ValueError("no .shp file in the archive")
    return os.path.join(folder, os.path.basename(found))


def beside(path: str, ending: str) -> str | None:
    stem = path[:-4]
    return next((p for p in (stem + ending, stem + ending.upper()) if os.path.exists(p)), None)


@dataclass
class Field:
    name: str
    kind: str
    width: int
    decimals: int


def _known(encoding: str) -> bool:
    try:
        codecs.lookup(encoding)
    except LookupError:
        return False
    return True


class Fields:
    """The table beside the shapes: rows of fixed width, each field as text."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rows, self.start, self.width = struct.unpack("<xxxxIHH", f.read(12))
            f.seek(32)
            self.fields = []
            while (raw := f.read(32)) and raw[0] != 0x0D:
                self.fields.append(Field(raw[:11].split(b"\0")[0].decode("ascii", "replace"), chr(raw[11]), raw[16], raw[17]))
        self.path = path
        page = beside(path, ".cpg")
        self.encoding = "utf-8"
        if page:
            with open(page) as f:
                name = f.read().strip().lower()
            # Names as code pages have them, with or without a prefix.
            named = [name, f"cp{name.split()[-1]}"] if name else []
            self.encoding = next((n for n in named if _known(n)), "utf-8" if "cp65001" in named else "latin-1")

    def kind(self, f: Field) -> T.DataType:
        return T.StringType() if f.kind not in "NF" else T.LongType() if not f.decimals and f.width < 19 else T.DoubleType()

    def value(self, f: Field, raw: bytes):
        text = raw.decode(self.encoding, "replace").strip(" \0")
        if not text or text.startswith("*") and f.kind in "NF":
            return None
        if f.kind not in "NF":
            return text
        return float(text) if isinstance(self.kind(f), T.DoubleType) else int(float(text)) if "." in text else int(text)

    def read(self, first: int, n: int) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(self.start + first * self.width)
            for _ in range(n):
                row, at, out = f.read(self.width), 1, []
                for field in self.fields:
                    out.append(self.value(field, row[at : at + field.width]))
                    at += field.width
                yield tuple(out)


def twice_area(ring: np.ndarray) -> float:
    """Twice the area of a closed ring, negative if it runs clockwise."""
    x, y = (ring - ring[0]).T  # near the origin no digits are lost
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1]))


def surrounds(ring: np.ndarray, x: float, y: float) -> bool:
    (x1, y1), (x2, y2) = ring[:-1].T, ring[1:].T
    across = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return bool(np.count_nonzero(across & left) % 2)


def as_polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Rings as polygons: outer ones with the holes in them."""
    closed = [r if np.array_equal(r[0], r[-1]) else np.vstack([r, r[:1]]) for r in rings if len(r)]
    closed = [r for r in closed if len(np.unique(r, axis=0)) >= 3]
    sized = [(twice_area(r), r) for r in closed]
    outer = sorted(((-a, [r]) for a, r in sized if a < 0), key=lambda x: x[0])
    alone = []
    for a, ring in sized:
        if a >= 0:
            # A hole may touch its polygon in points, not in all of them: the middle of an edge decides with the points.
            tests = np.vstack([ring[:-1], (ring[:-1] + ring[1:]) / 2])
            home = next((p for size, p in outer if size >= a and np.mean([surrounds(p[0], x, y) for x, y in tests]) > 0.5), None)
            if home is None:
                alone.append([ring])
            else:
                home.append(ring)
    return [p for _, p in outer] + alone


def rings_of(content: bytes) -> list[np.ndarray] | None:
    (kind,) = struct.unpack_from("<i", content)
    if kind == NO_SHAPE:
        return None
    if kind not in RINGED:
        raise ValueError(f"shapes of kind {kind} are no polygons")
    parts, points = struct.unpack_from("<ii", content, 36)
    starts = [*struct.unpack_from(f"<{parts}i", content, 44), points]
    xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    return [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]


@dataclass
class Records(ds.InputPartition):
    first: int
    n: int


class ShapeReader(ds.DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[ds.InputPartition]:
        n = (os.path.getsize(beside(self.path, ".shx")) - HEADER) // INDEX_ENTRY
        return [Records(at, min(self.per_task, n - at)) for at in range(0, n, self.per_task)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        with open(beside(self.path, ".shx"), "rb") as f:
            f.seek(HEADER + partition.first * INDEX_ENTRY)
            places = np.frombuffer(f.read(partition.n * INDEX_ENTRY), ">i4").reshape(-1, 2).astype(np.int64) * 2  # words of two bytes
        table = beside(self.path, ".dbf")
        rows = Fields(table).read(partition.first, partition.n) if table else iter([()] * partition.n)
        with open(self.path, "rb") as f:
            for k, ((place, size), fields) in enumerate(zip(places.tolist(), rows, strict=True)):
                f.seek(place + 8)
                rings = rings_of(f.read(size))
                shape = None if rings is None else [[[(float(x), float(y)) for x, y in r] for r in p] for p in as_polygons(rings)]
                yield (partition.first + k, *fields, shape)


class ShapeSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> T.StructType:
        table = beside(self.options["path"], ".dbf")
        fields = Fields(table) if table else None
        named = [T.StructField(f.name, fields.kind(f)) for f in fields.fields] if fields else []
        return T.StructType([T.StructField("record", T.LongType()), *named, T.StructField("polygons", POLYGONS)])

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return ShapeReader(self.options["path"], int(self.options.get("records_per_task", 1000)))


def shapes(spark: SparkSession, path: str, records_per_task: int = 1000) -> DataFrame:
    """The records of the shapefile at ``path``."""
    spark.dataSource.register(ShapeSource)
    return spark.read.format("shapes").option("path", path).option("records_per_task", records_per_task).load()


# --- from metres to degrees -----------------------------------------------------------------------

# Fixed values of the national conic projection (EPSG:3347) and its ellipsoid (GRS 1980).
NATIONAL = {"parallels": (49.0, 77.0), "origin": (63.390675, -91.86666666666666), "offset": (6_200_000.0, 3_000_000.0), "axis": 6_378_137.0, "flattening": 1 / 298.257222101}


class Conic:
    """Lambert's conformal conic projection on an ellipsoid with two standard parallels."""

    def __init__(self, parallels, origin, offset, axis: float, flattening: float):
        self.e2 = flattening * (2 - flattening)
        self.e, self.offset, self.axis = np.sqrt(self.e2), offset, axis
        p1, p2, p0 = np.radians([*parallels, origin[0]])
        self.middle = np.radians(origin[1])
        m1, m2 = (np.cos(p) / np.sqrt(1 - self.e2 * np.sin(p) ** 2) for p in (p1, p2))
        t1, t2, t0 = (self.isometric(p) for p in (p1, p2, p0))
        self.n = float((np.log(m1) - np.log(m2)) / (np.log(t1) - np.log(t2)))
        self.scale = float(m1 / (self.n * t1**self.n)) * axis
        self.radius = float(self.scale * t0**self.n)

    def isometric(self, latitude):
        s = self.e * np.sin(latitude)
        return np.tan(np.pi / 4 - latitude / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def latitude_series(self) -> list[float]:
        """Weights of sin 2c, sin 4c, .. that lead from the conformal latitude c to the geodetic one."""
        e2 = self.e2
        return [
            e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
            7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
            7 * e2**3 / 120 + 81 * e2**4 / 1120,
            4279 * e2**4 / 161280,
        ]

    def degrees(self, x: Column, y: Column) -> Column:
        """A struct (x: longitude, y: latitude), as expressions."""
        east, north = x - F.lit(self.offset[0]), F.lit(self.radius + self.offset[1]) - y
        r = F.sqrt(east * east + north * north)
        c = F.lit(np.pi / 2) - 2 * F.atan(F.pow(r / F.lit(self.scale), F.lit(1 / self.n)))
        latitude = c
        for k, w in enumerate(self.latitude_series(), 1):
            latitude = latitude + F.lit(w) * F.sin(c * (2 * k))
        longitude = F.atan2(east, north) / F.lit(self.n) + F.lit(float(self.middle))
        return F.struct(F.degrees(longitude).alias("x"), F.degrees(latitude).alias("y"))


def in_degrees(polygons: str, projection: dict = NATIONAL) -> Column:
    """Projected polygons in degrees."""
    conic = Conic(**projection)
    return F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: conic.degrees(v["x"], v["y"]))))
