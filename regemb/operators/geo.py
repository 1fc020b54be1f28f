"""Region centroids from county polygons.

Polygons are ``ARRAY<STRUCT<x DOUBLE, y DOUBLE>>`` rings (first vertex not
repeated).  Each county's signed area and centroid come from the shoelace
formula written with higher-order array functions (no Python); a region's
centroid is the area-weighted mean of its counties' centroids, which equals
the centroid of their union because counties do not overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shifted(ring: Column) -> Column:
    # next vertex of each vertex (wrapping to the first)
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def polygon_terms(ring: Column) -> tuple[Column, Column, Column]:
    """Signed area, and the area-weighted x and y sums (times 6A) of a ring."""
    pairs = F.arrays_zip(ring.alias("p"), _shifted(ring).alias("q"))
    cross = lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]
    a2 = F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + cross(e))
    cx6 = F.aggregate(pairs, F.lit(0.0),
                      lambda acc, e: acc + (e["p"]["x"] + e["q"]["x"]) * cross(e))
    cy6 = F.aggregate(pairs, F.lit(0.0),
                      lambda acc, e: acc + (e["p"]["y"] + e["q"]["y"]) * cross(e))
    return a2 / 2.0, cx6, cy6


def county_centroids(df: DataFrame, ring: str = "polygon") -> DataFrame:
    """Per row: ``area`` (absolute) and centroid ``cx``, ``cy``.

    A ring without area (a point, a line) has the mean of its vertices.
    """
    a, cx6, cy6 = polygon_terms(F.col(ring))
    size = F.size(F.col(ring))

    def mean(axis: str) -> Column:
        total = F.aggregate(F.col(ring), F.lit(0.0), lambda acc, p: acc + p[axis])
        return F.try_divide(total, size)
    return (df.withColumn("_a", a)
              .withColumn("cx", F.coalesce(F.try_divide(cx6, F.lit(6.0) * F.col("_a")), mean("x")))
              .withColumn("cy", F.coalesce(F.try_divide(cy6, F.lit(6.0) * F.col("_a")), mean("y")))
              .withColumn("area", F.abs("_a")).drop("_a"))


def region_centroids(df: DataFrame, region: str = "region", ring: str = "polygon") -> DataFrame:
    """``(region, lon, lat, area)``: area-weighted centroid per region.

    A region whose rings all lack area has the plain mean of their centroids.
    """
    c = county_centroids(df, ring)

    def weighted(axis: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col("area") * F.col(axis)), F.sum("area")),
                          F.avg(axis))
    return (c.groupBy(region)
             .agg(weighted("cx").alias("lon"), weighted("cy").alias("lat"),
                  F.sum("area").alias("area")))
