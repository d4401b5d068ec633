"""Overlap of boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou_corners(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of (x1, y1, x2, y2) boxes; 0 if they don't overlap."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter / union)


def iou_sizes(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The same of (x, y, w, h) boxes."""
    corners = lambda r: (r[0], r[1], r[0] + r[2], r[1] + r[3])
    return iou_corners(corners(a), corners(b))
