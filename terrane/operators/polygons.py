"""Polygon operators: joins by cells, interior points, simplification."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_polygon, shoelace


def bounds(geometry: str = "geometry"):
    """west, south, east, north of a multipolygon: array of polygons, each an array of rings of struct(lon, lat)."""
    points = F.flatten(F.flatten(F.col(geometry)))
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return {"west": F.array_min(lon), "south": F.array_min(lat), "east": F.array_max(lon), "north": F.array_max(lat)}


def first_polygon(points: DataFrame, polygons: DataFrame, size: float = 0.05) -> DataFrame:
    """(id, poly): of each point (id, lat, lon) the polygon (poly, geometry) of least poly that holds it, or null.

    Polygons are listed in every cell that their bounding box meets; points are looked up by their cell, then by box,
    then exactly.
    """
    boxed = polygons.withColumns(bounds())
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long"))
    listed = boxed.withColumn("cx", F.explode(span("west", "east"))).withColumn("cy", F.explode(span("south", "north")))
    placed = points.withColumns({"cx": F.floor(F.col("lon") / size).cast("long"), "cy": F.floor(F.col("lat") / size).cast("long")})
    boxes = placed.join(listed, ["cx", "cy"]).where("lon between west - 1e-11 and east + 1e-11 and lat between south - 1e-11 and north + 1e-11")
    inside = boxes.where(F.exists("geometry", lambda g: in_polygon(F.col("lon"), F.col("lat"), g)))
    return points.select("id").join(inside.groupBy("id").agg(F.min("poly").alias("poly")), "id", "left")


def _inside(x: float, y: float, rings: list) -> bool:
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def interior_point(rings: list[list[tuple[float, float]]], lines: int = 64) -> tuple[float, float, str]:
    """The outer ring's centroid if inside, else the middle of the widest inner stretch over evenly spaced scanlines, else a vertex."""
    outer = rings[0]
    s = cx = cy = 0.0
    for (ax, ay), (bx, by) in zip(outer, outer[1:] + outer[:1]):
        w = ax * by - bx * ay
        s, cx, cy = s + w, cx + (ax + bx) * w, cy + (ay + by) * w
    if abs(s) > 1e-15 and _inside(cx / (3 * s), cy / (3 * s), rings):
        return cx / (3 * s), cy / (3 * s), "centroid"
    low, high = min(y for _, y in outer), max(y for _, y in outer)
    best = None
    for i in range(1, lines + 1):
        y = low + (high - low) * i / (lines + 1)
        xs = sorted((bx - ax) * (y - ay) / (by - ay) + ax for r in rings for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]) if (ay > y) != (by > y))
        for a, b in zip(xs[::2], xs[1::2]):
            if best is None or b - a > best[0]:
                best = (b - a, (a + b) / 2, y)
    return (best[1], best[2], "scanline") if best and best[0] > 0 else (*outer[0], "vertex")


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Ramer-Douglas-Peucker with an explicit stack."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        (ax, ay), (bx, by) = points[i], points[j]
        dx, dy = bx - ax, by - ay
        n, far, at = dx * dx + dy * dy, tolerance, None
        for k in range(i + 1, j):
            x, y = points[k]
            t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / n)) if n else 0.0
            if (dist := math.hypot(x - ax - t * dx, y - ay - t * dy)) > far:
                far, at = dist, k
        if at is not None:
            keep.add(at)
            todo += [(i, at), (at, j)]
    return [points[i] for i in sorted(keep)]


def simplify_lines(lines: DataFrame, tolerance: float) -> DataFrame:
    """(id, path) with paths, arrays of struct(lon, lat), simplified; ends stay."""

    def run(batches):
        for b in batches:
            out = [[{"lon": x, "lat": y} for x, y in simplify([(p["lon"], p["lat"]) for p in path], tolerance)] if len(path) else [] for path in b["path"]]
            yield pd.DataFrame({"id": b["id"], "path": out})

    return lines.select("id", "path").mapInPandas(run, "id long, path array<struct<lon:double,lat:double>>")


def interior_points(polygons: DataFrame) -> DataFrame:
    """(poly, lon, lat, method) of each polygon (poly, rings)."""

    def run(batches):
        for b in batches:
            got = [interior_point([[(p["lon"], p["lat"]) for p in r] for r in rings]) for rings in b["rings"]]
            yield pd.DataFrame({"poly": b["poly"], "lon": [g[0] for g in got], "lat": [g[1] for g in got], "method": [g[2] for g in got]})

    return polygons.select("poly", "rings").mapInPandas(run, "poly long, lon double, lat double, method string")


def largest_part(geometry):
    """Of a multipolygon the polygon whose outer ring has the largest area, the first on ties."""
    sized = F.transform(geometry, lambda g, i: F.struct(F.abs(shoelace(F.element_at(g, 1))["area"]).alias("area"), (-i).alias("i"), g.alias("g")))
    return F.array_max(F.transform(sized, lambda s: F.struct(F.round(s["area"], 12).alias("area"), s["i"].alias("i"), s["g"].alias("g"))))["g"]


def simplify_ring(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A closed ring simplified in two halves, from its first vertex to the one farthest from it and back; under four vertices are left: the ring as it is."""
    open_ = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    if len(open_) < 4:
        return ring
    far = max(range(len(open_)), key=lambda i: math.dist(open_[0], open_[i]))
    out = simplify(open_[: far + 1], tolerance)[:-1] + simplify([*open_[far:], open_[0]], tolerance)
    return out if len(out) >= 4 else ring
