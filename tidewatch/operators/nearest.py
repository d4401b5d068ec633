"""Nearest ship position within a radius of each detection, by an equi-join on grid cells.

Ships at one point are equally far from everything, so only the first of them can be a match, and detections
at one point have the same match: points are joined, not rows, and ships are combined before the shuffle.
Cells are at least as large as the radius everywhere in the data, so a nearest position within it
lies in one of nine cells: detections' points are copied to their
neighbours' cells, and positions join on their own.  A crowded cell is one key of an ordinary join, which
adaptive execution splits.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions.geo import haversine_km
from tidewatch.operators.storage import saved

KM_PER_DEG = 111.19


def _cells(radius_km: float, max_abs_lat: float) -> tuple[float, float]:
    """Degrees of latitude and longitude of a cell; the longitude's grow to the poles."""
    from math import cos, radians

    lat = radius_km / KM_PER_DEG * 1.01
    far = min(89.9, max_abs_lat + lat)
    return lat, min(360.0, lat / cos(radians(far)) * 1.01)


def match_nearest(detections: DataFrame, ais: DataFrame, radius_km: float = P.AIS_RADIUS_KM, max_abs_lat: float = 85.0, by: tuple[str, ...] = ()) -> DataFrame:
    """detections (lat, lon, ...) with ais_match, dark_vessel, matched_vessel_id, _name, _flag, ais_distance_km.

    Of ais (ais_seq, lat, lon, vessel_id, vessel_name, flag) the nearest counts, of equally near
    ones (to 1e-9 km) the first by ais_seq.  max_abs_lat bounds |lat| of the data and sets the cells;
    rows beyond it have no match, nor have NaN positions.  by names columns of both in which a detection and a
    position must agree, null with null.  Every detection comes back, equal rows as often as they occur.
    """
    dlat, dlon = _cells(radius_km, max_abs_lat)
    cell = lambda c, size: F.floor(F.col(c) / F.lit(size)).cast("long")
    around = F.explode(F.expr("flatten(transform(array(-1L, 0L, 1L), x -> transform(array(-1L, 0L, 1L), y -> struct(x as dx, y as dy))))"))
    somewhere = (F.abs("lat") <= max_abs_lat) & ~F.isnan("lon")
    keys, theirs = [f"by{i}" for i in range(len(by))], [f"of{i}" for i in range(len(by))]
    agree = lambda a, b: [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)]
    places = detections.where(somewhere).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], "lat", "lon").distinct()
    near = places.select("*", around.alias("n")).withColumns({"cy": cell("lat", dlat) + F.col("n.dy"), "cx": cell("lon", dlon) + F.col("n.dx")})
    ships = ais.where(somewhere).groupBy(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, theirs, strict=True)], F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    ships = ships.agg(F.min(F.struct("ais_seq", "vessel_id", "vessel_name", "flag")).alias("ship")).withColumns({"ay": cell("alat", dlat), "ax": cell("alon", dlon)})
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon"))
    close = near.join(ships, [F.col("cy") == F.col("ay"), F.col("cx") == F.col("ax"), *agree(keys, theirs), km <= radius_km])
    best = close.groupBy(*keys, "lat", "lon").agg(F.min(F.struct(F.round(km, 9).alias("km"), "ship.ais_seq", "ship.vessel_id", "ship.vessel_name", "ship.flag")).alias("best"))
    same = [F.col(f"d.`{c}`").eqNullSafe(F.col(f"b.{k}")) for c, k in zip(by, keys, strict=True)]
    found = detections.alias("d").join(best.alias("b"), [F.col("d.lat") == F.col("b.lat"), F.col("d.lon") == F.col("b.lon"), *same], "left")
    best = lambda c: F.col(f"b.best.{c}")
    return found.select(
        "d.*",
        F.col("b.best").isNotNull().alias("ais_match"),
        F.col("b.best").isNull().alias("dark_vessel"),
        best("vessel_id").alias("matched_vessel_id"),
        best("vessel_name").alias("matched_vessel_name"),
        best("flag").alias("matched_flag"),
        F.round(best("km"), 4).alias("ais_distance_km"),
    )


def match_scenes(detections: DataFrame, ais: DataFrame, scenes: DataFrame, radius_km: float = P.AIS_RADIUS_KM, max_abs_lat: float = 85.0, pad: float = P.AIS_PAD_DEG) -> DataFrame:
    """match_nearest() by scene: a detection (scene, lat, lon, ...) meets the positions within the padded extent of
    its own scene's detections, and within the scene's window (scenes: scene, t_from, t_to; both closed) or without a
    time.  Where a window is missing, all times fit."""
    extent = detections.groupBy("scene").agg((F.min("lat") - pad).alias("s"), (F.max("lat") + pad).alias("n"), (F.min("lon") - pad).alias("w"), (F.max("lon") + pad).alias("e"))
    degree = lambda c: F.floor(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col(c)))).cast("int")
    bands = F.explode(F.sequence(degree("s"), degree("n")))  # of latitude
    limits = saved(extent.join(scenes.select("scene", "t_from", "t_to"), "scene", "left").select("*", bands.alias("band")))
    inside = F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))
    ais = ais if "ts" in ais.columns else ais.withColumn("ts", F.lit(None).cast("timestamp"))
    timely = F.col("ts").isNull() | F.col("t_from").isNull() | F.col("t_to").isNull() | F.col("ts").between(F.col("t_from"), F.col("t_to"))
    ships = ais.select("ais_seq", "vessel_id", "vessel_name", "flag", "lat", "lon", "ts").where(F.abs("lat") <= max_abs_lat)
    ships = ships.join(limits, (degree("lat") == F.col("band")) & inside & timely).select("scene", *ships.columns)
    return match_nearest(detections, ships, radius_km, max_abs_lat, ("scene",))


def near_scene(ais: DataFrame, detections: DataFrame, start: datetime | None = None, end: datetime | None = None, pad: float = P.AIS_PAD_DEG) -> DataFrame:
    """Positions within the padded extent of all detections, and within the window or without a time."""
    box = detections.agg((F.min("lat") - pad).alias("s"), (F.max("lat") + pad).alias("n"), (F.min("lon") - pad).alias("w"), (F.max("lon") + pad).alias("e"))
    out = ais.join(F.broadcast(box), F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))).drop("s", "n", "w", "e")
    if start is not None and end is not None:
        out = out.where(F.col("ts").isNull() | F.col("ts").between(F.lit(start), F.lit(end)))
    return out


def dark_summary(matched: DataFrame, *keys: str) -> DataFrame:
    """Totals, matched, dark and the rate of dark ones in percent, by keys."""
    n, dark = F.count(F.lit(1)), F.count_if("dark_vessel")
    return matched.groupBy(*keys).agg(n.alias("total"), F.count_if("ais_match").alias("matched"), dark.alias("dark"), F.when(n > 0, F.bround(dark / n * 100)).otherwise(0).cast("long").alias("dark_rate"))
