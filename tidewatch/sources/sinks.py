"""CSV, GeoJSON, label, mask and tile outputs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.geojson import features

#: Fixed: the columns of the detections' CSV.
CSV_COLUMNS = ["lon", "lat", "cx_px", "cy_px", "x", "y", "w", "h", "area_px", "conf", "length_m", "width_m", "vessel_class"]


def detections_csv(df: DataFrame) -> DataFrame:
    """The 13 columns as they are written, numbers with fixed decimals."""
    text = lambda c, n: F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}f", F.col(c).cast("double"))).otherwise("")
    out = df.withColumns({"cx_px": text("cx", 1), "cy_px": text("cy", 1), "lon": text("lon", 6), "lat": text("lat", 6), "conf": text("conf", 4)})
    return out.select(*CSV_COLUMNS)


def boxes_csv(df: DataFrame) -> DataFrame:
    text = lambda c, n: F.format_string(f"%.{n}f", F.col(c).cast("double"))
    return df.select(text("lon", 6).alias("lon"), text("lat", 6).alias("lat"), text("conf", 4).alias("conf"), "cls", *[text(c, 1).alias(c) for c in ("x1", "y1", "x2", "y2")])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_annotated(df: DataFrame, path: str) -> bool:
    """All columns of matched detections as CSV, in the order they have; without rows nothing is written."""
    if not df.limit(1).count():
        return False
    write_csv(df, path)
    return True


def write_geojson(df: DataFrame, path: str, detector: str) -> None:
    """One feature a line, which many readers take as it is."""
    features(df, detector).select(F.col("feature").alias("value")).write.text(path)


def feature_collection(df: DataFrame, detector: str, order: str) -> DataFrame:
    """One row, one JSON text: for results that are small enough to be shown at once."""
    made = features(df, detector)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), "feature"))), lambda x: x["feature"])
    return made.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(ordered, ","), F.lit("]}")).alias("json"))


def write_label_files(lines: DataFrame, path: str) -> None:
    """A text partition per chip; empty ones for chips without labels."""
    name = F.concat_ws("_", "scene_id", F.lpad(F.col("row_min").cast("string"), 4, "0"), F.lpad(F.col("col_min").cast("string"), 4, "0"))
    lines.select(name.alias("chip"), F.col("lines").alias("value")).write.partitionBy("chip").text(path)


def dataset_yaml(root: str, names: dict[int, str]) -> str:
    rows = [f"path: {root}", "train: images/train", "val: images/val", f"nc: {len(names)}", "names:"]
    return "\n".join([*rows, *(f"  {k}: {v}" for k, v in sorted(names.items()))]) + "\n"


def write_mask(hits: DataFrame, path: str) -> None:
    """The hit pixels alone; all others are 0."""
    hits.select("scene", "row", "col").write.partitionBy("scene").parquet(path)


def write_pixels(px: DataFrame, path: str) -> None:
    px.write.partitionBy("scene").parquet(path)


def png(rgb: list[list[list[int]]]) -> bytes:
    """A PNG of rows of RGB pixels, by the standard library alone."""
    h, w = len(rgb), len(rgb[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rgb)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def chip_images(rgb: DataFrame, *keys: str) -> DataFrame:
    """keys, png: an image of each group's pixels (row, col from 0, rgb); a chip is a group of bounded size."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        rows = [[list(map(int, x)) for x in g] for _, g in pdf.groupby("row")["rgb"]]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "png": [png(rows)]})

    types = dict(rgb.dtypes)
    return rgb.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {types[k]}" for k in keys), "png binary"]))


def predict_tiles(tiles: DataFrame, predictor, schema: str) -> DataFrame:
    """Boxes from a model: predictor maps an iterator of pandas frames of tiles to one of frames of boxes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from predictor(frames)

    return tiles.mapInPandas(run, schema)
