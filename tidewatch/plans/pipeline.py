"""The whole path: pixels to boxes to matched, classified vessels, for all scenes at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions.parse import scene_window, scene_window_or
from tidewatch.functions.radiometry import db_to_linear, dn_to_db
from tidewatch.operators import components, focal, land, nearest, nms, raster, vessels
from tidewatch.operators.storage import saved


def preprocess(dn: DataFrame, meta: DataFrame, bbox: tuple[float, float, float, float] = P.AOI, speckle: str = "lee", kernel: int = P.SPECKLE_KERNEL) -> tuple[DataFrame, DataFrame]:
    """Digital numbers (scene, band, row, col, v) to decibels, clipped and filtered, with the new meta."""
    px, meta = raster.clip(dn.withColumn("v", dn_to_db(F.col("v").cast("double"))), meta, bbox)
    if speckle == "lee":
        px = focal.lee(px, kernel)
    elif speckle == "gamma":
        px = focal.gamma_map(px, kernel)
    else:
        return px, meta
    return px.drop("v").withColumnRenamed("filtered", "v"), meta


def detect(px: DataFrame, meta: DataFrame, polygons: DataFrame | None = None, guard: int = P.GUARD, background: int = P.BACKGROUND, pfa: float = P.PFA, area: tuple[int, int] = (P.AREA_MIN, P.AREA_MAX), iou: float = P.NMS_IOU_AREA) -> DataFrame:
    """Boxes of vessels from pixels of linear power (scene, band, row, col, v): threshold in either band, land out,
    components, area, suppression, position, size and class.  conf is by the vv band."""
    hits = focal.fused_hits(focal.cfar(px, guard, background, pfa))
    if polygons is not None:
        at = vessels.georeference(hits.select("scene", F.col("row").alias("cy"), F.col("col").alias("cx")), meta)
        at = at.withColumn("id", F.struct("scene", "cy", "cx"))
        hits = land.at_sea(at, polygons).select("id.scene", F.col("id.cy").alias("row"), F.col("id.cx").alias("col"))
    labelled = components.label(saved(hits))
    found = components.of_area(components.with_confidence(labelled, px.where("band = 'vv'")), *area)
    found = found.withColumns({"id": F.struct("scene", "label"), "x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h")})
    kept = nms.by_area(saved(found), iou).drop("id", "x1", "y1", "x2", "y2")
    return vessels.size_up(vessels.georeference(kept, meta), meta)


def detect_db(px: DataFrame, meta: DataFrame, **options) -> DataFrame:
    """detect() on decibels."""
    return detect(px.withColumn("v", db_to_linear(F.col("v"))), meta, **options)


def windows(scenes: DataFrame, now: datetime | None = None) -> DataFrame:
    """scene, t_from, t_to by the scenes' names; other names have the hours around now, or without it no window."""
    name = F.col("scene")
    t_from, t_to = scene_window(name) if now is None else scene_window_or(name, F.lit(now).cast("timestamp"))
    return scenes.select("scene").distinct().select("scene", t_from.alias("t_from"), t_to.alias("t_to"))


def detect_and_match(px: DataFrame, meta: DataFrame, ais: DataFrame, radius_km: float = P.AIS_RADIUS_KM, now: datetime | None = None, **options) -> DataFrame:
    """Vessels with the ship positions near them in their scene's extent and window; those without one are dark."""
    found = saved(detect(px, meta, **options).withColumn("det_id", F.struct("scene", "label")))
    return nearest.match_scenes(found, ais, windows(meta, now), radius_km)
