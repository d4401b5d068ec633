"""Detections' sizes, classes, unions and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.classify import dimensions_m, vessel_class
from tidewatch.functions.geo import pixel_to_lonlat
from tidewatch.operators.raster import AFFINE


def georeference(boxes: DataFrame, meta: DataFrame) -> DataFrame:
    """boxes with lon, lat of cx, cy."""
    t = {k: F.col(f"__{k}") for k in AFFINE}
    lon, lat = pixel_to_lonlat(F.col("cy"), F.col("cx"), t)
    joined = boxes.join(meta.select("scene", *[F.col(k).alias(f"__{k}") for k in AFFINE]), "scene")
    return joined.withColumns({"lon": lon, "lat": lat}).drop(*[f"__{k}" for k in AFFINE])


def size_up(boxes: DataFrame, meta: DataFrame) -> DataFrame:
    """boxes with length_m, width_m, vessel_class, by the scale at the latitude of the mean cy of a scene's boxes."""
    mid = boxes.groupBy("scene").agg(F.avg("cy").alias("__cy"), F.avg("cx").alias("__cx"))
    t = {k: F.col(k) for k in AFFINE}
    _, lat = pixel_to_lonlat(F.col("__cy"), F.lit(0.0), t)
    scale = mid.join(meta.select("scene", *AFFINE), "scene").select("scene", F.col("a").alias("__a"), F.col("e").alias("__e"), lat.alias("__lat"))
    length, width = dimensions_m(F.col("w"), F.col("h"), F.col("__a"), F.col("__e"), F.col("__lat"))
    return boxes.join(scale, "scene").withColumns({"length_m": length, "width_m": width}).withColumn("vessel_class", vessel_class(F.col("length_m"))).drop("__a", "__e", "__lat")


def merge(*parts: DataFrame) -> DataFrame:
    """All rows of all detectors; columns that one lacks are null there.  Without any, a table without rows."""
    if not parts:
        return SparkSession.active().createDataFrame([], "detector string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def shown(df: DataFrame, dark_only: bool = False, vessel_class: str = "All") -> DataFrame:
    """What a viewer has chosen: dark vessels alone, or one class."""
    out = df.where("dark_vessel") if dark_only else df
    return out if vessel_class == "All" else out.where(F.col("vessel_class") == vessel_class)


def confidence_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.min("conf").alias("min_conf"), F.avg("conf").alias("mean_conf"), F.max("conf").alias("max_conf"))


def map_centre(df: DataFrame) -> DataFrame:
    """Means of positions other than 0; (1.5, 2.5) without any."""
    mean = lambda c, other: F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c))), F.lit(other))
    return df.agg(mean("lat", 1.5).alias("lat"), mean("lon", 2.5).alias("lon"))


def class_choices(df: DataFrame) -> DataFrame:
    """'All' and the classes there are; place orders them."""
    own = df.where("vessel_class is not null").select(F.lit(1).alias("g"), F.col("vessel_class").alias("choice")).distinct()
    from pyspark.sql import Window

    both = own.union(df.sparkSession.range(1).select(F.lit(0), F.lit("All")))
    return both.select("choice", (F.row_number().over(Window.orderBy("g", "choice")) - 1).alias("place"))
