"""Points on land: crossings of rays with polygon edges, found by bands of latitude."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(polygons: DataFrame) -> DataFrame:
    """poly_id, x1, y1, x2, y2 for rings (poly_id, ring_id, pts array<struct<x,y>>), closed or not; no level ones."""
    n = F.size("pts")
    at = polygons.select("poly_id", "pts", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    p, q = F.get("pts", F.col("i")), F.get("pts", (F.col("i") + 1) % F.size("pts"))
    return at.select("poly_id", p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")).where("y1 <> y2")


def on_land(points: DataFrame, polygons: DataFrame, band_deg: float | None = None) -> DataFrame:
    """ids (id, lon, lat) inside any polygon, by the even-odd rule.

    Edges are copied to the bands of latitude that they span and joined to points by band, so that
    neither side needs to be small.  By default a band is as high as the mean edge: edges are copied about
    twice, and a band's points meet the few edges that cross it.
    """
    e = edges(polygons)
    if band_deg is None:
        band_deg = min(1.0, max(1e-4, e.agg(F.avg(F.abs(F.col("y2") - F.col("y1")))).first()[0] or 1.0))
    e = e.withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2") / band_deg), F.floor(F.greatest("y1", "y2") / band_deg))))
    p = points.select("id", "lon", "lat").withColumn("band", F.floor(F.col("lat") / band_deg))
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    left = F.col("lon") < (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossed = p.join(e, "band").where(spans & left).groupBy("id", "poly_id").agg((F.count(F.lit(1)) % 2).alias("odd"))
    return crossed.where("odd = 1").select("id").distinct()


def at_sea(points: DataFrame, polygons: DataFrame, band_deg: float | None = None) -> DataFrame:
    return points.join(on_land(points, polygons, band_deg), "id", "left_anti")
