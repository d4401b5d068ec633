"""Column functions on literal cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import boxes, classify, geo, geojson, metrics, parse, radiometry


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def lit(*xs):
    return tuple(F.lit(float(x)) for x in xs)


@pytest.mark.parametrize("args,low,high", [((0, 0, 0, 1), 111, 112), ((90, 0, -90, 0), 20000, 20030), ((5, 5, 5, 5), -1e-9, 1e-9)])
def test_haversine(spark, args, low, high):
    assert low < value(spark, geo.haversine_km(*lit(*args))) < high


@pytest.mark.parametrize("pfa,alpha", [(1e-4, 9.313057), (1e-5, 11.673717), (1e-6, 14.04748)])
def test_alpha(pfa, alpha):
    assert radiometry.cfar_alpha(416, pfa) == pytest.approx(alpha, abs=1e-5)


@pytest.mark.parametrize("text,want", [("1", True), ("1.0", True), ("true", True), (" TRUE ", True), ("0", False), ("0.0", False), ("false", False), ("", None), ("nan", None), ("0.5", False), ("x", None), (None, None)])
def test_tristate(spark, text, want):
    assert value(spark, parse.tristate(F.lit(text).cast("string"))) is want


@pytest.mark.parametrize("text,want", [("2024-03-15T10:00:00Z", datetime(2024, 3, 15, 10)), ("2024-03-15T10:00", datetime(2024, 3, 15, 10)), ("2024-3-5", datetime(2024, 3, 5)), ("2024-03-15T10:00:00.5Z", None), ("2024-03-15T10:00:00+01:00", None), ("", None)])
def test_iso(spark, text, want):
    assert value(spark, parse.iso_utc(F.lit(text))) == want


def test_scene_window(spark):
    name = F.lit("S1A_IW_GRDH_1SDV_20230412T060000_20230412T060030_048062_05C6D2_1234")
    start, end = parse.scene_window(name)
    assert value(spark, parse.iso_z(start)) == "2023-04-12T05:30:00Z"
    assert value(spark, parse.iso_z(end)) == "2023-04-12T06:30:30Z"
    assert value(spark, parse.scene_window(F.lit("scene"))[0]) is None


@pytest.mark.parametrize("a,b,want", [((0, 0, 10, 10), (5, 0, 15, 10), 50 / 150), ((0, 0, 10, 10), (2, 2, 8, 8), 0.36), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (0, 0, 10, 10), 1.0)])
def test_iou(spark, a, b, want):
    assert value(spark, boxes.iou_corners(lit(*a), lit(*b))) == pytest.approx(want)
    sizes = lambda r: lit(r[0], r[1], r[2] - r[0], r[3] - r[1])
    assert value(spark, boxes.iou_sizes(sizes(a), sizes(b))) == pytest.approx(want)


@pytest.mark.parametrize("length,want", [(19.9, "small_craft"), (20.0, "fishing_vessel"), (50.0, "coastal_freighter"), (100.0, "cargo_ship"), (200.0, "cargo_ship"), (200.1, "vlcc_or_large")])
def test_vessel_class(spark, length, want):
    assert value(spark, classify.vessel_class(F.lit(length))) == want


@pytest.mark.parametrize("v,f,want", [(False, None, 0), (True, False, 1), (True, True, 2), (True, None, 1), (False, True, 0), (None, None, 1)])
def test_label_class(spark, v, f, want):
    assert value(spark, classify.label_class(F.lit(v).cast("boolean"), F.lit(f).cast("boolean"))) == want


def test_label_box_default_and_clamp(spark):
    box = classify.label_box(F.lit(400.0), F.lit(200.0), F.lit(float("nan")), F.lit(0), F.lit(0))
    assert [value(spark, c) for c in box] == pytest.approx([0.25, 0.5, 2 / 800, 2 / 800])
    assert value(spark, classify.label_box(F.lit(1.0), F.lit(1.0), F.lit(1e6), F.lit(0), F.lit(0))[2]) == 1.0


def test_affine_round_trip(spark):
    t = {k: F.lit(v) for k, v in zip("abcdef", (0.1, 0.02, 3.0, 0.01, -0.2, 7.0))}
    lon, lat = geo.pixel_to_lonlat(F.lit(5), F.lit(9), t)
    col, row = geo.lonlat_to_pixel(lon, lat, t)
    assert (value(spark, col), value(spark, row)) == (pytest.approx(9.5), pytest.approx(5.5))


def test_metrics(spark):
    p, r = metrics.precision(F.lit(3), F.lit(1)), metrics.recall(F.lit(3), F.lit(2))
    assert value(spark, p) == pytest.approx(0.75) and value(spark, r) == pytest.approx(0.6)
    assert value(spark, metrics.f1(p, r)) == pytest.approx(2 / 3)
    assert value(spark, metrics.precision(F.lit(0), F.lit(0))) == 0.0


def test_names(spark):
    assert value(spark, parse.annotated_name(F.lit("/a/x_cfar_detections.csv"))) == "x_ais_detections.csv"
    assert value(spark, parse.annotated_name(F.lit("y.csv"))) == "y_ais_detections.csv"
    assert value(spark, parse.processed_name(F.lit("/raw/S1A_x.SAFE.zip"))) == "S1A_x_processed.tif"


def test_geojson_leaves_out_what_is_absent(spark):
    df = spark.createDataFrame([(1, 10, 20, 5, 8, 0.876543, 1.23456789, 2.0), (2, 0, 0, 1, 1, None, None, 2.0)], "id int, x int, y int, w int, h int, conf double, lon double, lat double")
    rows = geojson.features(df, "cfar").collect()
    assert len(rows) == 1
    assert rows[0]["feature"] == '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.234568,2.0]},"properties":{"detector":"cfar","cls":0,"class_name":"non_vessel","conf":0.8765,"bbox_px":[10.0,20.0,15.0,28.0]}}'
