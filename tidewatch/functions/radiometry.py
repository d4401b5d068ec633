"""Digital numbers, decibels, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dn_to_db(dn: Column) -> Column:
    """10 log10(dn**2); null where there's no signal."""
    return F.when(dn > 0, 10 * F.log10(dn * dn))


def db_to_linear(db: Column) -> Column:
    """Linear power; no data gives 0."""
    return F.when(db.isNull() | F.isnan(db), F.lit(0.0)).otherwise(F.pow(F.lit(10.0), db / 10))


def cfar_alpha(n: int, pfa: float) -> float:
    """Scale of the mean of n background cells for a false-alarm probability, under exponential clutter."""
    return n * (pfa ** (-1.0 / n) - 1.0)


def pfa_from_exponent(exponent: Column) -> Column:
    return F.pow(F.lit(10.0), exponent)
