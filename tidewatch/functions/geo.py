"""Positions: distances, affine maps, boxes of degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import params as P


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s1, s2 = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.lit(2 * P.EARTH_KM) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def pixel_to_lonlat(row: Column, col: Column, t: dict[str, Column]) -> tuple[Column, Column]:
    """The pixel's centre under x = a col + b row + c, y = d col + e row + f."""
    x, y = col + F.lit(0.5), row + F.lit(0.5)
    return t["c"] + t["a"] * x + t["b"] * y, t["f"] + t["d"] * x + t["e"] * y


def lonlat_to_pixel(lon: Column, lat: Column, t: dict[str, Column]) -> tuple[Column, Column]:
    """(col, row), fractional, by the inverse of the affine map; null if it has none."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    x, y = lon - t["c"], lat - t["f"]
    return F.try_divide(t["e"] * x - t["b"] * y, det), F.try_divide(t["a"] * y - t["d"] * x, det)


def bbox_wkt(west: Column, south: Column, east: Column, north: Column) -> Column:
    point = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    ring = [point(west, south), point(east, south), point(east, north), point(west, north), point(west, south)]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *ring), F.lit("))"))


def in_bbox(lon: Column, lat: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Closed on all sides."""
    w, s, e, n = bbox
    return lon.between(w, e) & lat.between(s, n)
