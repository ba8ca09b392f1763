"""Column expressions on coordinates and rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle kilometres between two points in degrees."""
    a, b, c, d = (F.col(x) if isinstance(x, str) else x for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((F.radians(c) - F.radians(a)) / 2), 2.0) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin((F.radians(d) - F.radians(b)) / 2), 2.0)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def _edges(ring: Column) -> Column:
    """Consecutive vertices of a closed or open ring, the last followed by the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_ring(lon: Column, lat: Column, ring: Column, eps: float = 1e-11) -> Column:
    """Ray casting; a point on the boundary is inside. ring: array of struct(lon, lat)."""

    def on(e):
        a, b = e["a"], e["b"]
        cross = (lon - a["lon"]) * (b["lat"] - a["lat"]) - (lat - a["lat"]) * (b["lon"] - a["lon"])
        return (F.abs(cross) <= eps) & lon.between(F.least(a["lon"], b["lon"]) - eps, F.greatest(a["lon"], b["lon"]) + eps) & lat.between(F.least(a["lat"], b["lat"]) - eps, F.greatest(a["lat"], b["lat"]) + eps)

    def crossed(n, e):
        a, b = e["a"], e["b"]
        x = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return n + F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < x), 1).otherwise(0)

    return F.exists(_edges(ring), on) | (F.aggregate(F.filter(_edges(ring), lambda e: e["a"]["lat"] != e["b"]["lat"]), F.lit(0), crossed) % 2 == 1)


def in_polygon(lon: Column, lat: Column, polygon: Column) -> Column:
    """Inside the outer ring and in none of the holes; a hole's boundary counts as outside."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return in_ring(lon, lat, F.element_at(polygon, 1)) & ~F.exists(holes, lambda r: in_ring(lon, lat, r))


def shoelace(ring: Column) -> Column:
    """struct(area, lon, lat): signed area and centroid in degrees; no centroid under 1e-15."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(t, e):
        a, b = e["a"], e["b"]
        w = a["lon"] * b["lat"] - b["lon"] * a["lat"]
        return F.struct((t["s"] + w).alias("s"), (t["x"] + (a["lon"] + b["lon"]) * w).alias("x"), (t["y"] + (a["lat"] + b["lat"]) * w).alias("y"))

    def done(t):
        has = F.abs(t["s"]) >= 1e-15
        return F.struct((t["s"] / 2).alias("area"), F.when(has, t["x"] / (3 * t["s"])).alias("lon"), F.when(has, t["y"] / (3 * t["s"])).alias("lat"))

    return F.aggregate(_edges(ring), zero, step, done)


def area_km2(polygon: Column) -> Column:
    """Outer ring less holes in local kilometres (111.320 by cos of the mean latitude, 110.574), not below 0."""

    def ring_area(r):
        mean = F.aggregate(r, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(r)
        return F.abs(shoelace(r)["area"]) * 111.320 * F.cos(F.radians(mean)) * 110.574

    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return F.greatest(F.lit(0.0), ring_area(F.element_at(polygon, 1)) - F.aggregate(holes, F.lit(0.0), lambda s, r: s + ring_area(r)))


def flat(lat: Column, lon: Column, mid_lat: float, mid_lon: float, scale: float) -> tuple[Column, Column]:
    """Flat map coordinates around a middle: east to the right, south downwards."""
    return (lon - mid_lon) * F.cos(F.radians(F.lit(mid_lat))) * scale, (F.lit(mid_lat) - lat) * scale
