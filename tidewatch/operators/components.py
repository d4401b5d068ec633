"""8-connected components of hit pixels and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.operators.graph import connected

_STRIDE = 1 << 24


def label(hits: DataFrame) -> DataFrame:
    """scene, row, col and label: the least row * 2**24 + col of the pixel's component."""
    pixel = F.col("row") * F.lit(_STRIDE).cast("long") + F.col("col")
    own = hits.select("scene", "row", "col", pixel.alias("p"), F.xxhash64("scene", "row", "col").alias("node"))
    # four of the eight neighbours name each link once
    steps = F.explode(F.expr("array(struct(0 as dr, 1 as dc), struct(1 as dr, -1 as dc), struct(1 as dr, 0 as dc), struct(1 as dr, 1 as dc))"))
    a = own.select("scene", F.col("node").alias("a"), (F.col("row")).alias("r"), F.col("col").alias("c"), steps.alias("s"))
    a = a.select("scene", "a", (F.col("r") + F.col("s.dr")).alias("row"), (F.col("c") + F.col("s.dc")).alias("col"))
    links = a.join(own.select("scene", "row", "col", F.col("node").alias("b")), ["scene", "row", "col"]).select("a", "b")
    part = connected(links).withColumnRenamed("label", "group")
    grouped = own.join(part, "node", "left").withColumn("group", F.coalesce("group", "node"))
    least = grouped.groupBy("scene", "group").agg(F.min("p").alias("label"))
    return grouped.join(least, ["scene", "group"]).select("scene", "row", "col", "label")


def stats(labelled: DataFrame) -> DataFrame:
    """Box, area and centroid of each component."""
    x, y = F.min("col"), F.min("row")
    return labelled.groupBy("scene", "label").agg(x.alias("x"), y.alias("y"), (F.max("col") - x + 1).alias("w"), (F.max("row") - y + 1).alias("h"), F.count(F.lit(1)).alias("area_px"), F.avg("col").alias("cx"), F.avg("row").alias("cy"))


def with_confidence(labelled: DataFrame, px: DataFrame, value: str = "v") -> DataFrame:
    """stats() and conf: the mean value of a component over that of all hit pixels of its scene (1 if that is 0)."""
    hit = labelled.join(px.select("scene", "row", "col", F.col(value).alias("__v")), ["scene", "row", "col"])
    mine = hit.groupBy("scene", "label").agg(F.avg("__v").alias("__m"))
    whole = hit.groupBy("scene").agg(F.avg("__v").alias("__a"))
    base = F.when(F.coalesce(F.col("__a"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("__a"))
    return stats(labelled).join(mine, ["scene", "label"]).join(whole, "scene").withColumn("conf", F.col("__m") / base).drop("__m", "__a")


def of_area(components: DataFrame, least: int = P.AREA_MIN, most: int = P.AREA_MAX) -> DataFrame:
    return components.where(F.col("area_px").between(least, most))
