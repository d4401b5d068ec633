"""GeoJSON features and display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.classify import class_name


def _col(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def features(df: DataFrame, detector: str) -> DataFrame:
    """One feature (JSON text) per row with a position; absent values are left out."""
    x1, y1, x2, y2 = (F.coalesce(_col(df, c), alt) for c, alt in zip(("x1", "y1", "x2", "y2"), (_col(df, "x"), _col(df, "y"), _col(df, "x") + _col(df, "w"), _col(df, "y") + _col(df, "h"))))
    cls = F.coalesce(_col(df, "cls", "int"), F.lit(0))
    box = F.when(x1.isNotNull(), F.array(*[F.round(c.cast("double"), 1) for c in (x1, y1, x2, y2)]))
    props = F.struct(
        F.lit(detector).alias("detector"),
        cls.alias("cls"),
        class_name(cls).alias("class_name"),
        F.round(_col(df, "conf"), 4).alias("conf"),
        box.alias("bbox_px"),
        _col(df, "length_m").alias("length_m"),
        _col(df, "width_m").alias("width_m"),
        _col(df, "vessel_class", "string").alias("vessel_class"),
    )
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 6), F.round("lat", 6)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))
    return df.where("lon is not null and lat is not null").withColumn("feature", F.to_json(feature))


def display(df: DataFrame, *keep: str) -> DataFrame:
    """The table that is shown: rounded numbers, blanks for missing names, dark unless told otherwise; and columns to keep."""
    text = lambda c: F.coalesce(_col(df, c, "string"), F.lit(""))
    return df.select(
        *keep,
        F.round("lat", 5).alias("lat"),
        F.round("lon", 5).alias("lon"),
        text("vessel_class").alias("vessel_class"),
        F.round("length_m", 1).alias("length_m"),
        F.round(F.coalesce(_col(df, "conf"), F.lit(0.0)), 3).alias("conf"),
        F.coalesce(_col(df, "dark_vessel", "boolean"), F.lit(True)).alias("dark"),
        text("matched_vessel_id").alias("matched_id"),
        text("matched_vessel_name").alias("matched_name"),
        text("matched_flag").alias("flag"),
        _col(df, "ais_distance_km").alias("ais_distance_km"),
    )


#: Colours and radii of dark and matched vessels on a map.
DARK, MATCHED = ("#FF4444", 7), ("#22C55E", 6)


def markers(df: DataFrame, *keep: str) -> DataFrame:
    """What a map shows for each row with a position: place, colour, radius and texts."""
    dark = F.coalesce(_col(df, "dark_vessel", "boolean"), F.lit(True))
    kind = F.coalesce(_col(df, "vessel_class", "string"), F.lit("unknown"))
    metres = F.format_string("%.0f m", F.round(F.coalesce(_col(df, "length_m"), F.lit(0.0)), 0))
    named = lambda c: F.coalesce(F.when(_col(df, c, "string") != "", _col(df, c, "string")), F.lit("—"))
    return df.where("lat is not null and lon is not null").select(
        *keep,
        "lat",
        "lon",
        F.when(dark, DARK[0]).otherwise(MATCHED[0]).alias("colour"),
        F.when(dark, DARK[1]).otherwise(MATCHED[1]).alias("radius"),
        F.concat_ws(" · ", F.when(dark, "DARK").otherwise("MATCHED"), kind, metres).alias("label"),
        F.coalesce(F.format_string("%.2f", F.round(_col(df, "conf"), 2)), F.lit("n/a")).alias("conf_text"),
        named("matched_vessel_id").alias("mmsi"),
        named("matched_vessel_name").alias("name"),
    )
