"""SQLite files and shapefiles that are written here and read back."""

import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import geometry
from millrace.session import make_importable
from millrace.sources import shapefile, sqlite


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "scrape.db")
    with sqlite3.connect(path) as db:
        db.execute("create table kpis (id integer primary key, name text collate nocase, value real, note blob, n integer)")
        rows = [(3 * i, f"Name {i % 7}" if i % 5 else None, i / 4, bytes([i % 256]), i % 11 if i % 3 else None) for i in range(1, 2001)]
        db.executemany("insert into kpis values (?, ?, ?, ?, ?)", rows)
        db.execute("create table none (a integer)")
        db.execute("create table keyed (k text primary key, v int) without rowid")
        db.execute("insert into keyed values ('a', 1), ('B', 2)")
        db.execute("create table odd (n integer)")
        db.execute("insert into odd values (1), ('two')")
    return path, rows


def test_snapshot_is_the_table_in_several_tasks(spark, database):
    path, rows = database
    make_importable(spark)
    got = sqlite.snapshot(spark, path, "kpis", rows_per_task=300)
    assert got.rdd.getNumPartitions() >= 6
    assert sorted((r.id, r.name, r.value, bytes(r.note), r.n) for r in got.collect()) == rows
    assert sqlite.snapshot(spark, path, "none").collect() == []
    assert sorted(map(tuple, sqlite.snapshot(spark, path, "keyed").collect())) == [("B", 2), ("a", 1)]
    assert sqlite.snapshot(spark, path, "kpis", columns=("n", "id")).columns == ["n", "id"]
    with pytest.raises(Exception, match="two"):
        sqlite.snapshot(spark, path, "odd").collect()
    with pytest.raises(Exception, match="no table"):
        sqlite.snapshot(spark, path, "nowhere")


@pytest.mark.parametrize(("where", "keep"), [
    ("id > 300 and id <= 900", lambda r: 300 < r[0] <= 900), ("name = 'name 1'", lambda r: r[1] == "name 1"), ("name = 'Name 1'", lambda r: r[1] == "Name 1"),
    ("name is null", lambda r: r[1] is None), ("n in (1, 4)", lambda r: r[4] in (1, 4)), ("name like 'Name%' and value > 100.5", lambda r: (r[1] or "").startswith("Name") and r[2] > 100.5),
    ("name > 'Name 3'", lambda r: r[1] is not None and r[1] > "Name 3"), ("n <> 3", lambda r: r[4] is not None and r[4] != 3),
])
def test_filters_are_pushed_and_mean_the_same(spark, database, where, keep):
    path, rows = database
    make_importable(spark)
    got = sqlite.snapshot(spark, path, "kpis", rows_per_task=700).where(where)
    assert sorted(r.id for r in got.collect()) == [r[0] for r in rows if keep(r)]


def test_pushed_filter_is_in_the_plan(spark, database):
    make_importable(spark)
    plan = sqlite.snapshot(spark, database[0], "kpis").where("id > 300 and value > 1")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert "value" in above and "300" not in above  # SQLite decides on id alone, Spark on value


def write_shapes(stem, records, fields):
    """A shapefile of (rings or None, values); ``fields``: (name, kind, width, decimals)."""
    shp, shx, place = b"", b"", 50
    for k, (rings, _) in enumerate(records, 1):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            starts = np.cumsum([0, *map(len, rings)])[:-1]
            box = (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points))
            content = struct.pack("<i4d2i", 5, *box, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        shp += struct.pack(">2i", k, len(content) // 2) + content
        shx += struct.pack(">2i", place, len(content) // 2)
        place += 4 + len(content) // 2
    for ending, body in ((".shp", shp), (".shx", shx)):
        with open(stem + ending, "wb") as f:
            f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body)
    width = 1 + sum(w for *_, w, _ in fields)
    with open(stem + ".dbf", "wb") as f:
        f.write(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(records), 33 + 32 * len(fields), width))
        for name, kind, w, d in fields:
            f.write(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), w, d))
        f.write(b"\r")
        for _, values in records:
            f.write(b" " + b"".join(str(v if v is not None else "").encode("latin-1").ljust(w)[:w] for v, (*_, w, _) in zip(values, fields, strict=True)))
    with open(stem + ".cpg", "w") as f:
        f.write("ISO-8859-1")


def square(x, y, side, clockwise=True):
    ring = [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]
    return ring if clockwise else ring[::-1]


def test_shapes_round_trip(spark, tmp_path):
    make_importable(spark)
    records = [
        ([square(0, 0, 10), square(2, 2, 3, False), square(20, 0, 5), square(21, 1, 1, False)], ("35001", "Québec", 1.5, 7)),
        (None, ("35002", None, None, None)),
        ([square(100, 100, 2)], ("35003", "Île", 0.25, -3)),
        ([square(50, 50, 2, False)], ("35004", "wrong way", 2.0, 1)),
        ([square(200, 0, 30), square(205, 5, 20, False), square(210, 10, 5), square(211, 11, 2, False), [(0, 0), (0, 0), (0, 0)]], ("35005", "island in a lake", 9.0, 2)),
    ]
    write_shapes(str(tmp_path / "areas"), records, [("CSDUID", "C", 8, 0), ("NAME", "C", 20, 0), ("LANDAREA", "N", 12, 4), ("N", "N", 6, 0)])
    archive = str(tmp_path / "areas.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for ending in (".shp", ".shx", ".dbf", ".cpg"):
            z.write(str(tmp_path / "areas") + ending, f"folder/areas{ending}")
    df = shapefile.shapes(spark, shapefile.unpacked(archive, str(tmp_path / "out")), records_per_task=2)
    assert df.rdd.getNumPartitions() == 3
    got = {r.record: r for r in df.collect()}
    assert [tuple(got[k])[1:5] for k in range(5)] == [r[1] for r in records]
    as_sets = lambda polygons: sorted(tuple(sorted(tuple(map(tuple, ring)) for ring in p)) for p in polygons)
    of = lambda *polygons: as_sets([[[tuple(map(float, v)) for v in ring] for ring in p] for p in polygons])
    a = records[0][0]
    assert as_sets(got[0].polygons) == of([a[0], a[1]], [a[2], a[3]]) and got[1].polygons is None
    b = records[4][0]
    assert as_sets(got[4].polygons) == of([b[0], b[1]], [b[2], b[3]]) and len(got[3].polygons) == 1
    # Holes are outside: the reader's rings answer where points lie.
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 24.0, 4.0), (4, 101.0, 101.0), (5, 15.0, 5.0), (6, 212.0, 12.0), (7, 214.0, 14.0), (8, 207.0, 7.0)], "id int, x double, y double")
    areas = df.where("polygons is not null").select("CSDUID", F.flatten("polygons").alias("rings"))
    assert sorted((r.id, r.CSDUID) for r in geometry.locate(points, areas, cell=10.0).collect()) == [(1, "35001"), (3, "35001"), (4, "35003"), (7, "35005")]
    with pytest.raises(ValueError):
        shapefile.unpacked(_empty_zip(tmp_path), str(tmp_path / "none"))


def _empty_zip(tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("readme.txt", "x")
    return str(tmp_path / "e.zip")


def test_degrees_undo_the_projection(spark):
    conic = shapefile.Conic(**shapefile.NATIONAL)
    rng = np.random.default_rng(0)
    lat, lon = rng.uniform(42, 83, 200), rng.uniform(-141, -52, 200)
    r = conic.scale * conic.isometric(np.radians(lat)) ** conic.n
    angle = conic.n * (np.radians(lon) - conic.middle)
    x, y = conic.offset[0] + r * np.sin(angle), conic.offset[1] + conic.radius - r * np.cos(angle)
    rows = [(float(a), float(b), float(c), float(d)) for a, b, c, d in zip(x, y, lon, lat, strict=True)]
    rows.append((6_200_000.0, 3_000_000.0, -91.86666666666666, 63.390675))  # the origin itself
    df = spark.createDataFrame(rows, "x double, y double, lon double, lat double")
    off = df.select(conic.degrees(F.col("x"), F.col("y")).alias("v"), "lon", "lat").select(F.max(F.abs(F.col("v.x") - F.col("lon"))), F.max(F.abs(F.col("v.y") - F.col("lat")))).first()
    assert max(off) < 1e-8  # a millimetre
    one = df.limit(1).select(F.array(F.array(F.array(F.struct("x", "y")))).alias("p"), "lon").select(shapefile.in_degrees("p").alias("q"), "lon").first()
    assert one.q[0][0][0].x == pytest.approx(one.lon, abs=1e-8)
