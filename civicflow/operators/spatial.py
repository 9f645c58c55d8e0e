"""Points near other points or in regions: cells of a space-filling curve, then the exact test.

Points get the code of their cell on a Morton curve over longitude and latitude; the cells of the levels
above are its prefixes, so every cell is one range of codes. A region (a disc on the sphere, an area, or
both) is covered by such cells, small ones at its border and larger ones inside, of levels that follow
from its size. A point and a region meet where the region has the point's cell of one of the levels in use:
an equi-join without a further condition, whose pairs are in the region or near its border. A cell that
many points share is one join key; it holds no pair but those of the regions over it, and Spark's adaptive
skew join splits its points. The pairs are then tested exactly, all in the JVM.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
LEVEL = 20  # cells per axis: 2 ** LEVEL; of 38 by 19 m at the equator
STEP = 2  # levels between two that are used, so that a point has few cells


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def _spread(x: Column) -> Column:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def cell_code(lon: Column, lat: Column) -> Column:
    """Morton code of the cell of a point; longitudes wrap, null or out-of-range latitudes give null."""
    n = 1 << LEVEL
    wrapped = F.pmod(lon + 180.0, F.lit(360.0))
    x = F.least(F.floor(wrapped / 360.0 * n), F.lit(n - 1)).cast("bigint")
    y = F.least(F.floor((lat + 90.0) / 180.0 * n), F.lit(n - 1)).cast("bigint")
    return F.when(lat.between(-90, 90) & lon.isNotNull(), F.shiftleft(_spread(y), 1).bitwiseOR(_spread(x)))


def _distance(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(a)))


def disc_boxes(lon: float, lat: float, radius: float) -> list[tuple[float, float, float, float]]:
    """Boxes (west, south, east, north) that hold a disc; two where it crosses the 180th meridian."""
    angle = min(math.pi, radius / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-12
    south, north = lat - math.degrees(angle), lat + math.degrees(angle)
    if south <= -90 or north >= 90:
        return [(-180.0, max(-90.0, south), 180.0, min(90.0, north))]
    half = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) if angle < math.pi / 2 else 180.0
    lon = (lon + 180.0) % 360.0 - 180.0
    west, east = lon - half, lon + half
    if half >= 180:
        return [(-180.0, south, 180.0, north)]
    if west < -180:
        return [(west + 360, south, 180.0, north), (-180.0, south, east, north)]
    if east > 180:
        return [(west, south, 180.0, north), (-180.0, south, east - 360, north)]
    return [(west, south, east, north)]


def rings_of(geometry: str | None) -> list[list[list[float]]]:
    """All rings of a GeoJSON Polygon or MultiPolygon; unreadable text counts as an empty area."""
    try:
        shape = json.loads(geometry)
        polygons = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}[shape["type"]](shape["coordinates"])
        return [[[float(p[0]), float(p[1])] for p in ring] for polygon in polygons for ring in polygon]
    except (ValueError, KeyError, TypeError, IndexError):
        return []


def _morton(x: int, y: int) -> int:
    code = 0
    for k in range(LEVEL):
        code |= (x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1
    return code


def cover(boxes: list[tuple[float, float, float, float]], steps: int = 2) -> set[tuple[int, int]]:
    """(level, code) of cells that together hold the boxes, none inside another.

    The first cells are about as large as a box; those that a box does not fill are split ``steps`` times."""
    found: set[tuple[int, int]] = set()
    for west, south, east, north in boxes:
        extent = max(east - west, 2 * (north - south), 360.0 / (1 << LEVEL))
        first = min(LEVEL, max(0, int(math.log2(360.0 / extent)))) // STEP * STEP
        last = min(LEVEL // STEP * STEP, first + steps * STEP)
        w, h = 360.0 / (1 << first), 180.0 / (1 << first)
        clip = lambda v: min(max(int(v), 0), (1 << first) - 1)  # noqa: E731, B023
        xs = range(clip((west + 180) / w), clip((east + 180) / w) + 1)
        ys = range(clip((south + 90) / h), clip((north + 90) / h) + 1)
        cells = [(first, x, y) for x in xs for y in ys]
        while cells:
            level, x, y = cells.pop()
            w, h = 360.0 / (1 << level), 180.0 / (1 << level)
            x0, y0 = -180 + x * w, -90 + y * h
            if west > x0 + w or east < x0 or south > y0 + h or north < y0:
                continue
            if level == last or (west <= x0 and east >= x0 + w and south <= y0 and north >= y0 + h):
                found.add((level, _morton(x, y)))
            else:
                n = 1 << STEP
                cells += [(level + STEP, n * x + i, n * y + j) for i in range(n) for j in range(n)]
    inside = lambda level, code: any((up, code >> 2 * (level - up)) in found for up in range(0, level, STEP))
    return {c for c in found if not inside(*c)}


_CELLS = "region_id bigint, level int, cell bigint"
_EDGES = "region_id bigint, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _covers(steps: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                if r.lon == r.lon and r.lat == r.lat and r.radius == r.radius:
                    boxes = disc_boxes(r.lon, r.lat, r.radius) if r.radius >= 0 else []
                else:
                    boxes = [(min(p[0] for p in g), min(p[1] for p in g), max(p[0] for p in g), max(p[1] for p in g)) for g in rings_of(r.geometry) if g]
                rows += [(r.region_id, level, code) for level, code in cover(boxes, steps)]
            yield pd.DataFrame(rows, columns=["region_id", "level", "cell"]).astype({"region_id": "int64", "level": "int32", "cell": "int64"})

    return run


def _edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            if r.geometry is not None:
                pairs = [(p, q) for ring in rings_of(r.geometry) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
                rows.append((r.region_id, [{"x1": p[0], "y1": p[1], "x2": q[0], "y2": q[1]} for p, q in pairs]))
        yield pd.DataFrame(rows, columns=["region_id", "edges"])


def points_in_regions(points: DataFrame, regions: DataFrame, steps: int = 2) -> DataFrame:
    """(region_id, point_id) of the points that lie in a region.

    points: (point_id, lon, lat). regions: (region_id, lon, lat, radius, geometry); the disc counts if
    point and radius are set, the area (even-odd over all rings, so holes are out) if geometry is; both,
    if both are set. A region with neither has no points, nor has a null coordinate a region. Points that
    are there twice come out twice."""
    regions = regions.select("region_id", *(F.col(c).cast("double").alias(c) for c in ("lon", "lat", "radius")), "geometry")
    cells = regions.mapInPandas(_covers(steps), _CELLS)
    levels = [F.lit(level) for level in range(0, LEVEL + 1, STEP)]
    coded = points.select("point_id", "lon", "lat", cell_code(F.col("lon"), F.col("lat")).alias("code")).where("code IS NOT NULL")
    # At most one level in STEP; those that no region uses are dropped before points are moved.
    used = cells.select("level").distinct()
    coded = coded.withColumn("level", F.explode(F.array(*levels))).join(F.broadcast(used), "level", "left_semi")
    coded = coded.withColumn("cell", F.expr(f"shiftright(code, 2 * ({LEVEL} - level))"))
    near = coded.alias("p").join(cells.alias("r"), ["level", "cell"])
    near = near.select("region_id", "point_id", F.col("p.lon").alias("x"), F.col("p.lat").alias("y"))
    shapes = regions.join(regions.select("region_id", "geometry").mapInPandas(_edges, _EDGES), "region_id", "left").drop("geometry")
    disc = F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("radius").isNotNull()
    in_disc = haversine_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) <= F.col("radius")
    crossings = F.expr("size(filter(edges, e -> (e.y1 > y) <> (e.y2 > y) AND x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1))")
    inside = F.col("edges").isNull() | (F.pmod(crossings, F.lit(2)) == 1)
    kept = near.join(shapes, "region_id").where((disc | F.col("edges").isNotNull()) & (~disc | in_disc) & inside)
    return kept.select("region_id", "point_id")


def points_near_points(points: DataFrame, others: DataFrame, radius_m: float) -> DataFrame:
    """(point_id, other_id, distance_m) of all others within a distance of each point."""
    regions = others.select(F.col("point_id").alias("region_id"), "lon", "lat", F.lit(radius_m).alias("radius"), F.lit(None).cast("string").alias("geometry"))
    pairs = points_in_regions(points, regions, steps=0)
    a = pairs.join(points.select("point_id", F.col("lon").alias("x1"), F.col("lat").alias("y1")), "point_id")
    b = a.join(others.select(F.col("point_id").alias("region_id"), F.col("lon").alias("x2"), F.col("lat").alias("y2")), "region_id")
    return b.select("point_id", F.col("region_id").alias("other_id"), haversine_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("distance_m"))
