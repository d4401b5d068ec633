"""Scores of detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def precision(tp: Column, fp: Column) -> Column:
    return tp / (tp + fp + F.lit(EPS))


def recall(tp: Column, fn: Column) -> Column:
    return tp / (tp + fn + F.lit(EPS))


def f1(p: Column, r: Column) -> Column:
    return F.lit(2.0) * p * r / (p + r + F.lit(EPS))


def fbeta(p: Column, r: Column, beta: float) -> Column:
    b = beta * beta
    return F.lit(1 + b) * p * r / (F.lit(b) * p + r + F.lit(EPS))
