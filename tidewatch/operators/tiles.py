"""Box sums by tiles with halos: numpy integral images in Python workers, for scenes of many pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integral_box_sums(padded: np.ndarray, width: int) -> np.ndarray:
    """Sums over width x width windows; padded has half a window more on each side."""
    total = np.zeros((padded.shape[0] + 1, padded.shape[1] + 1), padded.dtype)
    np.cumsum(np.cumsum(padded, 0), 1, out=total[1:, 1:])
    return total[width:, width:] - total[:-width, width:] - total[width:, :-width] + total[:-width, :-width]


def box_sums_tiled(px: DataFrame, value: str, width: int, tile: int = 256) -> DataFrame:
    """scene, band, row, col, box_sum of a whole-number value; tiles get the pixels around them, mirrored at the edges."""
    half = width // 2
    size = px.groupBy("scene").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    out = px.select("scene", "band", "row", "col", F.col(value).cast("long").alias("v")).join(size, "scene")
    for axis, n in (("row", "h"), ("col", "w")):
        x = F.col(axis)
        at = F.array_compact(F.array(x, F.when(x < half, -1 - x), F.when(x >= F.col(n) - half, 2 * F.col(n) - 1 - x)))
        out = out.withColumn(axis, F.explode(at))
        tiles = F.sequence(F.greatest(F.floor((F.col(axis) - half) / tile), F.lit(0)), F.least(F.floor((F.col(axis) + half) / tile), F.floor((F.col(n) - 1) / tile)))
        out = out.withColumn(f"t{axis}", F.explode(tiles))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["trow"].iloc[0]) * tile, int(pdf["tcol"].iloc[0]) * tile
        r1, c1 = min(r0 + tile, int(pdf["h"].iloc[0])), min(c0 + tile, int(pdf["w"].iloc[0]))
        grid = np.zeros((r1 - r0 + 2 * half, c1 - c0 + 2 * half), np.int64)
        grid[pdf["row"] - r0 + half, pdf["col"] - c0 + half] = pdf["v"]
        rows, cols = np.mgrid[r0:r1, c0:c1]
        return pd.DataFrame({"scene": pdf["scene"].iloc[0], "band": pdf["band"].iloc[0], "row": rows.ravel(), "col": cols.ravel(), "box_sum": integral_box_sums(grid, width).ravel()})

    return out.groupBy("scene", "band", "trow", "tcol").applyInPandas(one, "scene string, band string, row int, col int, box_sum long")
