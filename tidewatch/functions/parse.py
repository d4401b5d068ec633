"""Tolerant parsing of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import params as P

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def iso_utc(text: Column) -> Column:
    """Timestamp from date, minutes or seconds with any Zs behind; null for anything else (fractions, offsets)."""
    s = F.regexp_replace(text, "Z+$", "")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in ("yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m", "yyyy-M-d")])


def day(text: Column) -> Column:
    """Date from yyyy-MM-dd if there's a dash, else from yyyyMMdd."""
    return F.to_date(F.when(text.contains("-"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def search_dates(start: Column, end: Column, today: Column, days: int = 30) -> tuple[Column, Column]:
    """A search's dates: by default the days up to today."""
    return F.coalesce(start, F.date_sub(today, days)), F.coalesce(end, today)


def number(text: Column) -> Column:
    """Double, or null; only plain and exponent notation count."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def tristate(text: Column) -> Column:
    """true, false or null from words and numbers; numbers are cut to integers first."""
    s = F.lower(F.trim(text))
    value = number(s)
    return F.when(s.isin("", "nan", "none", "null"), None).when(value.isNotNull(), value.cast("bigint") != 0).when(s == "true", True).when(s == "false", False)


def confidence_rank(text: Column) -> Column:
    out = F.lit(99)
    for name, rank in P.CONFIDENCE_RANK.items():
        out = F.when(F.upper(F.trim(text)) == name, rank).otherwise(out)
    return out


def confident(text: Column, least: str) -> Column:
    """Rank not below the least; blank and unknown ranks are lower than all, an unknown least accepts all."""
    return confidence_rank(text) <= F.lit(P.CONFIDENCE_RANK.get(least.upper(), 99))


SCENE_NAME = r"S1[A-Z]_\w+_\w+_\w+_(\d{8}T\d{6})_(\d{8}T\d{6})_"


def scene_window(name: Column, pad_minutes: int = P.AIS_PAD_MINUTES) -> tuple[Column, Column]:
    """Start and end of a scene by its name, padded; null without the pattern."""
    pad = F.expr(f"INTERVAL {pad_minutes} MINUTES")
    stamp = lambda k: F.try_to_timestamp(F.regexp_extract(name, SCENE_NAME, k), F.lit("yyyyMMdd'T'HHmmss"))
    return stamp(1) - pad, stamp(2) + pad


def scene_window_or(name: Column, now: Column, hours: int = P.AIS_FALLBACK_HOURS) -> tuple[Column, Column]:
    """The scene's window, else the hours around now."""
    start, end = scene_window(name)
    pad = F.expr(f"INTERVAL {hours} HOURS")
    return F.coalesce(start, now - pad), F.coalesce(end, now + pad)


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


CHIP_NAME = r"(?i)^(.+?)_(\d{4})_(\d{4})\.tif$"


def chip_parts(path: Column, pattern: str = CHIP_NAME) -> tuple[Column, Column, Column]:
    """Scene, row and column of a chip file; null for other names."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    part = lambda k: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k))
    return part(1), part(2).cast("int"), part(3).cast("int")


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def processed_name(path: Column) -> Column:
    return F.concat(F.substring_index(F.regexp_extract(path, r"([^/]*)$", 1), ".", 1), F.lit("_processed.tif"))


def annotated_name(path: Column) -> Column:
    """Name of the file with ship matches, from that of the detections."""
    s = stem(path)
    return F.concat(F.when(s.contains("_cfar_detections"), F.replace(s, F.lit("_cfar_detections"), F.lit("_ais_detections"))).otherwise(F.concat(s, F.lit("_ais_detections"))), F.lit(".csv"))
