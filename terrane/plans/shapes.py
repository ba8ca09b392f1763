"""Polygon layers out of the nations' squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import polygons
from .registry import query, read


def _shapes(spark, d):
    """(poly, geometry): two squares for each nation, the second larger for even keys."""
    n = read(spark, d, "nation")
    south, west, size = 35.0 + 0.24 * F.floor(F.col("n_nationkey") / 5), 126.3 + 0.32 * (F.col("n_nationkey") % 5), F.when(F.col("n_nationkey") % 2 == 0, 0.12).otherwise(0.04)
    p = lambda x, y: F.struct((west + x).alias("lon"), (south + y).alias("lat"))
    box = lambda at, s: F.array(F.array(p(at, F.lit(0.0)), p(at + s, F.lit(0.0)), p(at + s, s), p(at, s)))
    return n.select(F.col("n_nationkey").cast("long").alias("poly"), F.array(box(F.lit(0.0), F.lit(0.08)), box(F.lit(0.16), size)).alias("geometry"))


SQL = "s AS (SELECT n_nationkey::BIGINT AS poly, 35.0::DOUBLE + 0.24::DOUBLE*(n_nationkey // 5) AS south, 126.3::DOUBLE + 0.32::DOUBLE*(n_nationkey % 5) AS west, CASE WHEN n_nationkey % 2 = 0 THEN 0.12::DOUBLE ELSE 0.04::DOUBLE END AS size FROM nation)"


@query(f"WITH {SQL} SELECT poly, round(greatest(0.08*0.08, size*size), 9) AS area, round(CASE WHEN size > 0.08 THEN west+0.16+size/2 ELSE west+0.04 END, 6) AS lon, round(south + greatest(size, 0.08)/2, 6) AS lat, round(west, 5) AS west, round(west + 0.16 + size, 5) AS east, round(south, 5) AS south, round(south + greatest(size, 0.08), 5) AS north, 'largest_component_centroid_inside' AS method FROM s")
def polygon_layers(spark, d):
    """Each shape's largest part with its area and a point inside, and the bounds of all its parts."""
    from ..functions.numbers import round_scaled

    shapes = _shapes(spark, d).withColumn("part", polygons.largest_part(F.col("geometry"))).withColumns(polygons.bounds())
    inside = polygons.interior_points(shapes.select("poly", F.col("part").alias("rings"))).withColumnRenamed("method", "how")
    area = F.abs(geo.shoelace(F.element_at("part", 1))["area"])
    rows = shapes.join(inside, "poly")
    return rows.select("poly", F.round(area, 9).alias("area"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), *[round_scaled(F.col(c), 5).alias(c) for c in ("west", "east", "south", "north")], F.concat(F.lit("largest_component_"), "how", F.lit("_inside")).alias("method"))


@query(f"WITH {SQL} SELECT poly, '[' || string_agg(round(x, 5) || ' ' || round(y, 5), ', ' ORDER BY i) || ']' AS ring FROM (SELECT poly, unnest([0,1,2,3]) AS i, unnest([west, west+0.08, west+0.08, west]) AS x, unnest([south, south, south+0.08, south+0.08]) AS y FROM s) GROUP BY poly")
def outer_rings(spark, d):
    """The outer ring of each shape's first part, rounded."""
    from ..functions.numbers import round_scaled

    at = lambda x: round_scaled(x, 5).cast("string")
    ring = F.transform(F.element_at(F.element_at("geometry", 1), 1), lambda p: F.concat_ws(" ", at(p["lon"]), at(p["lat"])))
    return _shapes(spark, d).select("poly", F.concat(F.lit("["), F.array_join(ring, ", "), F.lit("]")).alias("ring"))
