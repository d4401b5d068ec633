"""A synthetic radar scene: exponential clutter with bright ships, from hashes, so that every run gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: longitudes and latitudes of the planted ships.
TARGETS = ((1.20, 1.80), (1.55, 2.10), (1.80, 1.35), (2.05, 2.60), (2.30, 1.90), (2.50, 2.40), (1.40, 2.85), (1.70, 1.55), (2.70, 1.70), (2.85, 2.85))


def synthetic_scene(spark: SparkSession, size: int = 512, seed: int = 42, snr: float = 50.0, box: tuple[float, float, float, float] = (1.0, 1.0, 3.0, 3.0)) -> tuple[DataFrame, DataFrame]:
    """Pixels (scene, band, row, col, v in decibels) of both bands, and the scene's meta.

    Clutter has mean 1 in linear power; a ship is three pixels square at snr times the mean, where it lies two
    pixels inside the edge.
    """
    w, s, e, n = box
    step = (e - w) / size, (n - s) / size
    at = [(int((n - lat) / step[1]), int((lon - w) / step[0])) for lon, lat in TARGETS]
    near = [(r, c) for r, c in at if 2 <= r < size - 2 and 2 <= c < size - 2]
    px = spark.range(size * size).select((F.col("id") / size).cast("int").alias("row"), (F.col("id") % size).cast("int").alias("col"), F.explode(F.array(F.lit("vv"), F.lit("vh"))).alias("band"))
    share = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "band", "row", "col"), 11) + 0.5) / float(1 << 53)
    ship = F.lit(False)
    for r, c in near:
        ship = ship | (F.col("row").between(r - 1, r + 1) & F.col("col").between(c - 1, c + 1))
    linear = F.when(ship, F.lit(snr)).otherwise(-F.log(share))
    px = px.select(F.lit("A").alias("scene"), "band", "row", "col", (10 * F.log10(linear)).alias("v"))
    meta = spark.createDataFrame([("A", size, size, step[0], 0.0, w, 0.0, -step[1], n)], "scene string, width int, height int, a double, b double, c double, d double, e double, f double")
    return px, meta
