"""Vessel sizes and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import params as P

#: Classes up to lengths in metres.
SIZES = ((20, "small_craft"), (50, "fishing_vessel"), (100, "coastal_freighter"))
LARGE = (200, "cargo_ship", "vlcc_or_large")


def dimensions_m(w: Column, h: Column, a: Column, e: Column, lat: Column) -> tuple[Column, Column]:
    """Length and width, to 0.1 m, of a box of pixels at a latitude."""
    x = w * (F.abs(a) * P.M_PER_DEG_LON * F.cos(F.radians(lat)))
    y = h * (F.abs(e) * P.M_PER_DEG_LAT)
    return F.round(F.greatest(x, y), 1), F.round(F.least(x, y), 1)


def vessel_class(length_m: Column) -> Column:
    out = None
    for below, name in SIZES:
        out = F.when(length_m < below, name) if out is None else out.when(length_m < below, name)
    return out.when(length_m <= LARGE[0], LARGE[1]).otherwise(LARGE[2])


def label_class(is_vessel: Column, is_fishing: Column) -> Column:
    """0 non-vessel, 2 fishing vessel, 1 otherwise."""
    return F.when(~is_vessel, 0).when(is_vessel & is_fishing, 2).otherwise(1)


def class_name(cls: Column) -> Column:
    out = F.lit("vessel")
    for k, name in P.CLASS_NAMES.items():
        out = F.when(cls == k, name).otherwise(out)
    return out


def label_box(row: Column, col: Column, length_m: Column, row0: Column, col0: Column, chip: int = P.CHIP) -> tuple[Column, ...]:
    """Centre and size of a label in its chip, as shares of the chip."""
    metres = F.when(length_m.isNull() | F.isnan(length_m), P.VESSEL_DEFAULT_M).otherwise(length_m)
    length = F.greatest(metres / P.M_PER_PX, F.lit(P.VESSEL_MIN_PX))
    width = F.greatest(length / P.VESSEL_ASPECT, F.lit(P.VESSEL_MIN_PX))
    one = F.lit(1.0)
    return (col - col0) / chip, (row - row0) / chip, F.least(length / chip, one), F.least(width / chip, one)
