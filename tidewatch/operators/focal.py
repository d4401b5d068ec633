"""Sums over windows of pixels, edges mirrored, and the filters built on them.

A pixel table has scene, band, row, col and a value.  Box sums are separable: rows beyond the edges are
copied in mirrored, then two sliding sums follow, along rows and along columns, so that no task needs
more than a row or a column of a scene.  tiles.box_sums_tiled() does the same by tiles with numpy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions.radiometry import cfar_alpha

EPS = 1e-10


def _mirrored(df: DataFrame, axis: str, size: str, half: int) -> DataFrame:
    """Rows beyond both edges added: -1 - i is i, size + i is size - 1 - i."""
    x, n = F.col(axis), F.col(size)
    at = F.array_compact(F.array(x, F.when(x < half, -1 - x), F.when(x >= n - half, 2 * n - 1 - x)))
    return df.withColumn(axis, F.explode(at))


def _slide(df: DataFrame, keys: list[str], axis: str, size: str, sums: dict[str, tuple[Column, int]]) -> DataFrame:
    half = max(h for _, h in sums.values())
    w = Window.partitionBy(*keys).orderBy(axis)
    out = _mirrored(df, axis, size, half).withColumns({k: F.sum(v).over(w.rowsBetween(-h, h)) for k, (v, h) in sums.items()})
    return out.where((F.col(axis) >= 0) & (F.col(axis) < F.col(size)))


def box_sums(px: DataFrame, sums: dict[str, tuple[str, int]]) -> DataFrame:
    """px with a column for each sum: {name: (value column, odd width)}.

    Scenes must be full grids, at least half a window wide.  Sums of integers are exact.
    """
    if any(k % 2 == 0 for _, k in sums.values()):
        raise ValueError("windows have odd widths")
    size = px.groupBy("scene").agg((F.max("row") + 1).alias("__h"), (F.max("col") + 1).alias("__w"))
    out = px.join(size, "scene")
    out = _slide(out, ["scene", "band", "row"], "col", "__w", {k: (F.col(v), n // 2) for k, (v, n) in sums.items()})
    out = _slide(out, ["scene", "band", "col"], "row", "__h", {k: (F.col(k), n // 2) for k, (_, n) in sums.items()})
    return out.drop("__h", "__w")


def cfar(px: DataFrame, guard: int = P.GUARD, background: int = P.BACKGROUND, pfa: float = P.PFA, value: str = "v") -> DataFrame:
    """px with hit: is the value over alpha times the mean of the ring around its guard window."""
    outer, inner = 2 * (guard + background) + 1, 2 * guard + 1
    n = outer * outer - inner * inner
    out = box_sums(px, {"__o": (value, outer), "__i": (value, inner)})
    mean = (F.col("__o") - F.col("__i")) / F.lit(float(n))
    return out.withColumn("hit", F.col(value) > F.lit(cfar_alpha(n, pfa)) * mean).drop("__o", "__i")


def fused_hits(hits: DataFrame) -> DataFrame:
    """scene, row, col hit in any band."""
    return hits.where("hit").select("scene", "row", "col").distinct()


def _moments(px: DataFrame, kernel: int, value: str) -> DataFrame:
    """Local mean and variance; missing values count as 0."""
    filled = px.withColumn("__x", F.coalesce(F.nanvl(F.col(value), F.lit(None)), F.lit(0.0))).withColumn("__xx", F.col("__x") * F.col("__x"))
    out = box_sums(filled, {"__s": ("__x", kernel), "__q": ("__xx", kernel)})
    n = float(kernel * kernel)
    return out.withColumn("__m", F.col("__s") / n).withColumn("__v", F.greatest(F.col("__q") / n - F.col("__m") * F.col("__m"), F.lit(0.0)))


def _finish(df: DataFrame, px: DataFrame, value: str, out: Column) -> DataFrame:
    missing = F.col(value).isNull() | F.isnan(value)
    return df.select(*px.columns, F.when(~missing, out).alias("filtered"))


def lee(px: DataFrame, kernel: int = P.SPECKLE_KERNEL, value: str = "v") -> DataFrame:
    """Lee filter; the noise is the mean of local variances over all pixels of the band."""
    m = _moments(px, kernel, value)
    noise = m.groupBy("scene", "band").agg(F.avg("__v").alias("__n"))
    m = m.join(noise, ["scene", "band"])
    weight = F.col("__v") / (F.col("__v") + F.col("__n") + EPS)
    return _finish(m, px, value, F.col("__m") + weight * (F.col("__x") - F.col("__m")))


def gamma_map(px: DataFrame, kernel: int = P.SPECKLE_KERNEL, value: str = "v") -> DataFrame:
    """Gamma MAP filter; the number of looks comes from the mean squared variation over valid pixels."""
    m = _moments(px, kernel, value).withColumn("__cv", F.sqrt("__v") / (F.col("__m") + EPS)).withColumn("__c2", F.col("__cv") * F.col("__cv"))
    valid = ~(F.col(value).isNull() | F.isnan(value))
    looks = m.groupBy("scene", "band").agg(F.avg(F.when(valid, F.col("__c2"))).alias("__a"))
    looks = looks.select("scene", "band", F.coalesce(1 / (F.col("__a") + EPS), F.lit(1.0)).alias("__l"))
    m = m.join(looks, ["scene", "band"])
    weight = F.col("__c2") / (F.col("__c2") + 1 / F.col("__l") + EPS)
    return _finish(m, px, value, F.col("__m") + weight * (F.col("__x") - F.col("__m")))
