"""Points in polygons without a geometry library.

Both sides are cut into grid cells of equal size and joined on them, so a point meets only the polygons whose
box touches its cell; the even-odd rule then decides, in the JVM, edge by edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ring_edges(ring: Column) -> Column:
    """Edges of a closed or open ring of structs (x, y)."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(ring, F.pmod(i + 1, n))["x"].alias("x2"), F.get(ring, F.pmod(i + 1, n))["y"].alias("y2")))


def polygon_edges(rings: Column) -> Column:
    """All edges of a polygon or multipolygon: an array of rings, holes included."""
    return F.flatten(F.transform(rings, ring_edges))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule: how many edges a ray to the right crosses."""
    crossed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.pmod(F.size(crossed), F.lit(2)) == 1


def on_edge(x: Column, y: Column, edges: Column, slack: float = 1e-12) -> Column:
    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        within = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return (F.abs(cross) <= slack) & within

    return F.exists(edges, touches)


def centroid(ring: Column) -> Column:
    """Area-weighted centroid of a ring; it may lie outside a concave one."""
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    add = lambda f: F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + f(e))
    area = add(cross)
    return F.when(area != 0, F.struct((add(lambda e: (e["x1"] + e["x2"]) * cross(e)) / (3 * area)).alias("x"), (add(lambda e: (e["y1"] + e["y2"]) * cross(e)) / (3 * area)).alias("y")))


def with_box(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    points = F.flatten(F.col(rings))
    bound = lambda of, axis: of(F.transform(points, lambda p: p[axis]))
    return polygons.withColumns({"edges": polygon_edges(F.col(rings)), "min_x": bound(F.array_min, "x"), "max_x": bound(F.array_max, "x"), "min_y": bound(F.array_min, "y"), "max_y": bound(F.array_max, "y")})


def locate(points: DataFrame, polygons: DataFrame, cell: float, edge_counts: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """Every pair of a point and a polygon that contains it.

    ``polygons`` has ``rings``: array<array<struct<x, y>>>. ``cell`` is the side of a grid cell; about a polygon's
    size is right. ``edge_counts``: points on an edge lie inside.
    """
    at = lambda c: F.floor(c / cell).cast("bigint")
    boxed = with_box(polygons)
    boxed = boxed.withColumn("_cx", F.explode(F.sequence(at(F.col("min_x")), at(F.col("max_x"))))).withColumn("_cy", F.explode(F.sequence(at(F.col("min_y")), at(F.col("max_y")))))
    held = points.withColumn("_cx", at(F.col(x))).withColumn("_cy", at(F.col(y)))
    joined = held.join(boxed, ["_cx", "_cy"]).where(F.col(x).between(F.col("min_x"), F.col("max_x")) & F.col(y).between(F.col("min_y"), F.col("max_y")))
    within = inside(F.col(x), F.col(y), F.col("edges"))
    touching = on_edge(F.col(x), F.col(y), F.col("edges"))
    keep = within | touching if edge_counts else within & ~touching
    return joined.where(keep).drop("_cx", "_cy", "edges", "min_x", "max_x", "min_y", "max_y", "rings")


def newest_boundary(located: DataFrame, point_key: str, census: str = "census_year", tie: str = "boundary_id") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(point_key).orderBy(F.desc_nulls_last(census), tie))
    return located.withColumn("_n", place).where("_n = 1").drop("_n")


def lookup_reason(point: Column, found: Column, covered: Column) -> Column:
    """Why a lookup gave what it gave."""
    return F.when(point.isNull(), "not_geocoded").when(found.isNotNull(), "found").when(~covered, "no_boundaries").otherwise("outside_boundaries")
