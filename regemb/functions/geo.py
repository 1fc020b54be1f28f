"""Small geographic column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def to_cartesian(lat: str | Column, lon: str | Column,
                 convention: str = "as_published") -> tuple[Column, Column, Column]:
    """Centroid (degrees) -> ``(x, y, z)`` in km.

    ``as_published`` treats the latitude as a polar angle (sin(lat)cos(lon),
    sin(lat)sin(lon), cos(lat)), matching the published lookups; ``latitude``
    is the geographic convention (cos(lat)cos(lon), cos(lat)sin(lon), sin(lat)).
    """
    t, p = F.radians(_c(lat)), F.radians(_c(lon))
    r = F.lit(EARTH_RADIUS_KM)
    if convention == "as_published":
        return r * F.sin(t) * F.cos(p), r * F.sin(t) * F.sin(p), r * F.cos(t)
    if convention == "latitude":
        return r * F.cos(t) * F.cos(p), r * F.cos(t) * F.sin(p), r * F.sin(t)
    raise ValueError(f"unknown convention {convention!r}")


def region_name(stab: str | Column, yy: str, nn: str | Column) -> Column:
    """``<stab>_<yy>_<nn:02>``."""
    return F.format_string("%s_%s_%02d", _c(stab), F.lit(yy), _c(nn).cast("int"))


def state_code(st: str | Column) -> Column:
    """Zero-padded two-digit state code from an int or text code."""
    return F.lpad(_c(st).cast("string").try_cast("int").cast("string"), 2, "0")


def state_of_region(region: str | Column) -> Column:
    """The state part of a region name (first two characters)."""
    return F.substring(_c(region), 1, 2)
