"""Operators against brute force and on small cases."""

import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from helpers import joined_rows
from pyspark.sql import functions as F

from tidewatch.functions import radiometry
from tidewatch.functions.geo import haversine_km
from tidewatch.operators import components, evaluation, focal, land, nearest, nms, raster, tiles, vessels
from tidewatch.plans import fixtures, pipeline
from tidewatch.sources import readers, sinks, synthetic

AIS = "ais_seq long, lat double, lon double, vessel_id string, vessel_name string, flag string"


def pixels(spark, grid, band="vv", scene="A"):
    rows, cols = np.indices(grid.shape)
    return spark.createDataFrame(pd.DataFrame({"scene": scene, "band": band, "row": rows.ravel().astype(np.int32), "col": cols.ravel().astype(np.int32), "v": grid.ravel()}))


def as_grid(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", value).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


def box_mean(x, k):
    h = k // 2
    p = np.pad(x.astype(float), h, mode="symmetric")
    return np.array([[p[i : i + k, j : j + k].mean() for j in range(x.shape[1])] for i in range(x.shape[0])])


def test_nearest_is_brute_force(spark):
    rng = random.Random(3)
    det = spark.createDataFrame([(i, rng.uniform(-60, 60), rng.choice([rng.uniform(-180, 180), 10 + rng.random() / 50])) for i in range(150)], "det_id long, lat double, lon double")
    ais = spark.createDataFrame([(i, r["lat"] + rng.uniform(-0.3, 0.3), r["lon"] + rng.uniform(-0.3, 0.3), f"v{i}", "n", "") for i, r in enumerate(det.collect() * 2)] + [(900, float("nan"), 1.0, "x", "", "")], AIS)
    got = {r["det_id"]: (r["matched_vessel_id"], r["ais_distance_km"]) for r in nearest.match_nearest(det, ais, 20.0).collect()}
    pairs = det.crossJoin(ais.select("ais_seq", F.col("lat").alias("y"), F.col("lon").alias("x"), "vessel_id")).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))).where("km <= 20")
    want = {r["det_id"]: (r["b"]["vessel_id"], round(r["b"]["km"], 4)) for r in pairs.groupBy("det_id").agg(F.min(F.struct(F.round("km", 9).alias("km"), "ais_seq", "vessel_id")).alias("b")).collect()}
    assert {k: v for k, v in got.items() if v[0]} == want
    assert len(got) == 150 and len(want) > 80


def test_nearest_ties_go_to_the_first(spark):
    det = spark.createDataFrame([(1, 5.0, 2.0)], "det_id long, lat double, lon double")
    ais = spark.createDataFrame([(8, 5.001, 2.001, "late", "", ""), (3, 5.001, 2.001, "first", "", ""), (1, 5.05, 2.05, "far", "", "")], AIS)
    row = nearest.match_nearest(det, ais, 10.0).first()
    assert row["matched_vessel_id"] == "first" and row["ais_match"] and not row["dark_vessel"]
    assert nearest.match_nearest(det, ais.limit(0), 10.0).first()["dark_vessel"]


def test_box_sums_and_tiles_agree_with_numpy(spark):
    grid = np.random.default_rng(1).integers(0, 1000, (37, 29))
    px = pixels(spark, grid)
    got = as_grid(focal.box_sums(px, {"s": ("v", 7)}), "s", grid.shape)
    assert np.array_equal(got, np.rint(box_mean(grid, 7) * 49))
    assert np.array_equal(as_grid(tiles.box_sums_tiled(px, "v", 7, tile=16), "box_sum", grid.shape), got)
    with pytest.raises(ValueError):
        focal.box_sums(px, {"s": ("v", 4)})


def test_lee_keeps_missing_and_smooths(spark):
    grid = np.random.default_rng(2).exponential(10, (20, 20))
    grid[3, 4] = np.nan
    got = as_grid(focal.lee(pixels(spark, grid)), "filtered", grid.shape)
    x = np.nan_to_num(grid)
    m = box_mean(x, 7)
    v = np.maximum(box_mean(x * x, 7) - m * m, 0)
    want = m + v / (v + v.mean() + 1e-10) * (x - m)
    assert np.isnan(got[3, 4])
    ok = ~np.isnan(grid)
    assert np.allclose(got[ok], want[ok])


def test_gamma_is_the_formula(spark):
    grid = np.random.default_rng(4).exponential(10, (20, 20)) + 1
    got = as_grid(focal.gamma_map(pixels(spark, grid)), "filtered", grid.shape)
    m = box_mean(grid, 7)
    c2 = np.maximum(box_mean(grid * grid, 7) - m * m, 0) / (m + 1e-10) ** 2
    looks = 1 / (c2.mean() + 1e-10)
    assert np.allclose(got, m + c2 / (c2 + 1 / looks + 1e-10) * (grid - m))


def test_components_join_diagonals(spark):
    hits = spark.createDataFrame([("A", r, c) for r, c in [(0, 0), (1, 1), (2, 0), (5, 5), (5, 6), (9, 0)]] + [("B", 0, 0)], "scene string, row int, col int")
    got = {(r["scene"], r["area_px"], r["x"], r["y"], r["w"], r["h"]) for r in components.stats(components.label(hits)).collect()}
    assert got == {("A", 3, 0, 0, 2, 3), ("A", 2, 5, 5, 2, 1), ("A", 1, 0, 9, 1, 1), ("B", 1, 0, 0, 1, 1)}


def test_suppression_is_the_greedy_loop(spark):
    rng = random.Random(5)
    rows = [(i, f"s{i % 3}", float(x := rng.randint(0, 60)), float(y := rng.randint(0, 60)), float(x + rng.randint(5, 30)), float(y + rng.randint(5, 30)), rng.randint(0, 20) / 20) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, scene string, x1 double, y1 double, x2 double, y2 double, conf double")

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        inter = max(0, w) * max(0, h)
        return inter / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[0])):
        if all(k[1] != r[1] or iou(k, r) <= 0.45 for k in kept):
            kept.append(r)
    assert {r["id"] for r in nms.by_confidence(df).collect()} == {r[0] for r in kept}
    same = spark.createDataFrame([(i, "a", 0.0, 0.0, 10.0, 10.0, c) for i, c in enumerate((0.5, 0.9, 0.7))], df.schema)
    assert [r["conf"] for r in nms.by_confidence(same).collect()] == [0.9]


def test_greedy_match_uses_the_given_order(spark):
    preds = spark.createDataFrame([(1, 1, 0.1, 0, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.9, 0, 0.0, 0.0, 10.0, 10.0), (2, 1, 0.9, 0, 0.0, 0.0, 5.0, 5.0)], "image_id long, seq long, conf double, cls int, x1 double, y1 double, x2 double, y2 double")
    truths = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (3, 1, 0, 0.0, 0.0, 1.0, 1.0)], "image_id long, seq long, cls int, x1 double, y1 double, x2 double, y2 double")
    assert {tuple(r) for r in evaluation.match(preds, truths).collect()} == {(1, 1, 1, 0), (2, 0, 1, 0), (3, 0, 0, 1)}
    # by confidence: a hit, a miss of another image, a second box on the same truth; one of two truths is found
    assert evaluation.average_precision(preds, truths).first()["ap"] == pytest.approx(1 / 2)


def test_land_and_sea(spark):
    square = [{"x": float(x), "y": float(y)} for x, y in [(0, 0), (4, 0), (4, 4), (0, 4)]]
    poly = spark.createDataFrame([(1, 1, square)], "poly_id int, ring_id int, pts array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 2.0), (3, 3.9, 3.9), (4, -1.0, 1.0)], "id long, lon double, lat double")
    assert {r["id"] for r in land.at_sea(pts, poly).collect()} == {2, 4}
    assert {r["id"] for r in land.at_sea(pts, poly, band_deg=0.01).collect()} == {2, 4}
    assert land.at_sea(pts, poly.limit(0)).count() == 4


def test_clip_half(spark):
    px = pixels(spark, np.arange(64 * 64).reshape(64, 64))
    meta = spark.createDataFrame([("A", 64, 64, 1 / 64, 0.0, 0.0, 0.0, -1 / 64, 1.0)], "scene string, width int, height int, a double, b double, c double, d double, e double, f double")
    out, m = raster.clip(px, meta, (0.0, 0.0, 0.5, 0.5))
    row = m.first()
    assert (row["width"], row["height"], out.count()) == (32, 32, 32 * 32)
    assert out.agg(F.min("v")).first()[0] == 32 * 64
    assert raster.clip(px, meta, (2.0, 2.0, 3.0, 3.0))[1].count() == 0


def test_reproject_identity_and_shift(spark):
    grid = np.arange(30.0).reshape(5, 6)
    px = pixels(spark, grid)
    schema = "scene string, width int, height int, a double, b double, c double, d double, e double, f double"
    meta = spark.createDataFrame([("A", 6, 5, 1.0, 0.0, 0.0, 0.0, -1.0, 5.0)], schema)
    assert np.array_equal(as_grid(raster.reproject(px, meta, meta), "v", grid.shape), grid)
    half = spark.createDataFrame([("A", 5, 5, 1.0, 0.0, 0.5, 0.0, -1.0, 5.0)], schema)
    assert np.allclose(as_grid(raster.reproject(px, meta, half), "v", (5, 5)), (grid[:, 1:] + grid[:, :-1]) / 2)


def test_gcp_affine_recovers_the_map(spark):
    t = (0.1, 0.02, 3.0, 0.01, -0.2, 7.0)
    pts = spark.createDataFrame([("A", r, c, t[0] * c + t[1] * r + t[2], t[3] * c + t[4] * r + t[5]) for r in (0, 5, 9) for c in (0, 7)], "scene string, row int, col int, lon double, lat double")
    assert tuple(raster.gcp_affine(pts).first())[1:] == pytest.approx(t)


def test_stretch_of_constant_and_missing(spark):
    for grid in (np.full((4, 4), 7.0), np.full((4, 4), np.nan)):
        assert {r["byte"] for r in raster.stretch(pixels(spark, grid), "scene", "band").collect()} == {0}


def test_synthetic_scene_end_to_end(spark):
    rng = np.random.default_rng(7)
    vv, vh = rng.exponential(1.0, (96, 96)), rng.exponential(1.0, (96, 96))
    spots = [(20, 20), (20, 70), (50, 45), (75, 20), (75, 75)]
    for r, c in spots:
        vv[r - 1 : r + 2, c - 1 : c + 2] = 50.0
    px = pixels(spark, vv).union(pixels(spark, vh, "vh"))
    meta = spark.createDataFrame([("A", 96, 96, 0.01, 0.0, 1.0, 0.0, -0.01, 3.0)], "scene string, width int, height int, a double, b double, c double, d double, e double, f double")
    at = [(3.0 - 0.01 * (r + 0.5), 1.0 + 0.01 * (c + 0.5)) for r, c in spots]
    ais = spark.createDataFrame([(i, y, x, f"v{i}", "", "") for i, (y, x) in enumerate(at[:2])], AIS)
    got = pipeline.detect_and_match(px, meta, ais, 2.0, pfa=1e-5).collect()
    assert len(got) == 5 and sum(r["dark_vessel"] for r in got) == 3
    assert {(round(r["cy"]), round(r["cx"])) for r in got} == set(spots)
    square = [{"x": float(x), "y": float(y)} for x, y in [(1, 2.5), (1.5, 2.5), (1.5, 3), (1, 3)]]
    poly = spark.createDataFrame([(1, 1, square)], "poly_id int, ring_id int, pts array<struct<x:double,y:double>>")
    assert pipeline.detect(px, meta, poly, pfa=1e-5).count() == 4


def test_false_alarms_are_rare(spark):
    grid = np.random.default_rng(9).exponential(1.0, (128, 128))
    assert focal.cfar(pixels(spark, grid), pfa=1e-3).where("hit").count() < 10 * 1e-3 * grid.size
    assert focal.cfar(pixels(spark, np.zeros((30, 30)))).where("hit").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "ais.csv").write_text("lat,lon,mmsi,vessel_name,flag,timestamp,extra\n1.5,2.5,111,Ä,GH,2024-03-15T06:00:00Z,x\nbad,2,112,B,GH,2024-03-15T06:00:00Z,x\n1.6,2.6,,C,,,x\n1.7,2.7,113,D,NG,2024-03-15T20:00:00Z,x\n9,9,114,E,NG,2024-03-15T06:00:00Z,x\n")
    from datetime import datetime

    got = readers.read_ais(spark, (0, 0, 5, 5), datetime(2024, 3, 15, 5), datetime(2024, 3, 15, 7), csv=str(tmp_path / "ais.csv")).collect()
    assert sorted((r["vessel_id"], r["vessel_name"]) for r in got) == [("", "C"), ("111", "Ä")]
    assert readers.read_ais(spark, (0, 0, 5, 5), csv=str(tmp_path / "none.csv")).count() == 0
    chips = spark.createDataFrame([("d/s_1_0000_0800.tif",), ("d/s_1_0000_12000.tif",), ("d/x.png",)], "path string")
    assert [tuple(r)[1:] for r in readers.chip_rows(chips).collect()] == [("s_1", 0, 800, 800)]


def test_outputs(spark, tmp_path):
    det = spark.createDataFrame([(1.5, 2.25, 3.0, 4.0, 1, 2, 3, 4, 9, None, 30.0, 10.0, "fishing_vessel")], "lon double, lat double, cx double, cy double, x int, y int, w int, h int, area_px int, conf double, length_m double, width_m double, vessel_class string")
    row = sinks.detections_csv(det).first()
    assert (row["lon"], row["cx_px"], row["conf"]) == ("1.500000", "3.0", "")
    sinks.write_geojson(det, str(tmp_path / "g"), "cfar")
    assert spark.read.json(str(tmp_path / "g")).count() == 1
    assert sinks.dataset_yaml("/d", {0: "a"}) == "path: /d\ntrain: images/train\nval: images/val\nnc: 1\nnames:\n  0: a\n"
    rgb = spark.createDataFrame([("c", 0, 0, [1, 2, 3]), ("c", 0, 1, [4, 5, 6])], "chip string, row int, col int, rgb array<int>")
    assert bytes(sinks.chip_images(rgb, "chip").first()["png"])[:8] == b"\x89PNG\r\n\x1a\n"
    assert vessels.merge(det.select("lon"), det.select("lat")).count() == 2


def test_fixture_views_are_whole(spark):
    from helpers import SF

    assert fixtures.view(spark, SF, fixtures.PIXELS).select("row", "col").distinct().count() == 1000


def test_every_detection_comes_back(spark):
    ais = spark.createDataFrame([(1, 2.0, 5.0, "A", "a", "GH", None), (2, 2.001, 5.0, "B", "b", "NG", None)], "ais_seq long, lat double, lon double, vessel_id string, vessel_name string, flag string, ts timestamp")
    rows = [(None, "s", 2.0, 5.0), (None, "t", 2.0, 5.0), (7, "s", 2.0, 5.0), (7, "t", 2.001, 5.0), (7, "t", 2.001, 5.0), (8, "s", None, 5.0), (9, "s", float("nan"), 5.0), (10, "s", 89.0, 5.0)]
    got = nearest.match_nearest(spark.createDataFrame(rows, "det_id long, scene string, lat double, lon double"), ais, 2.0).collect()
    assert sorted((r["det_id"] or 0, r["scene"], r["matched_vessel_id"] or "") for r in got) == [(0, "s", "A"), (0, "t", "A"), (7, "s", "A"), (7, "t", "B"), (7, "t", "B"), (8, "s", ""), (9, "s", ""), (10, "s", "")]


def test_scene_windows(spark):
    at = lambda d: datetime(2024, 1, d)
    ais = spark.createDataFrame([(1, 2.0, 5.0, "A", "a", "GH", at(1)), (2, 2.0, 5.001, "B", "b", "NG", at(5)), (3, 2.0, 5.01, "C", "c", "NG", None)], "ais_seq long, lat double, lon double, vessel_id string, vessel_name string, flag string, ts timestamp")
    det = spark.createDataFrame([(1, "x", 2.0, 5.0), (2, "y", 2.0, 5.0), (3, "z", 2.0, 5.0), (4, None, 2.0, 5.0)], "det_id long, scene string, lat double, lon double")
    scenes = spark.createDataFrame([("x", at(1), at(2)), ("y", at(4), at(5)), ("z", at(8), at(9))], "scene string, t_from timestamp, t_to timestamp")
    got = {r["det_id"]: r["matched_vessel_id"] for r in nearest.match_scenes(det, ais, scenes, 2.0).collect()}
    assert got == {1: "A", 2: "B", 3: "C", 4: "A"}


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.exponential(size=5001), "b": rng.integers(0, 4, 800).astype(float), "c": np.array([7.0] * 9), "d": np.array([1.0]), "e": np.array([-1.7e308, 1.7e308, 0.0])}
    df = spark.createDataFrame(pd.DataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("f", None), ("a", None)], columns=["k", "v"]))
    df = df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = {r["k"]: (r["lo"], r["hi"]) for r in raster.percentiles(df, ["k"], F.col("v"), {"lo": 0.02, "hi": 0.98}, buckets=16).collect()}
    want = {r["k"]: (r["lo"], r["hi"]) for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.02)).alias("lo"), F.percentile("v", F.lit(0.98)).alias("hi")).collect() if r["lo"] is not None}
    assert got == want


def test_synthetic_scene_is_found(spark):
    """Eight of ten ships at least, with few false alarms."""
    px, meta = synthetic.synthetic_scene(spark, 256)
    found = pipeline.detect_db(px, meta, pfa=1e-6, area=(4, 500)).collect()
    hit = sum(any(abs(r["lon"] - lon) < 0.03 and abs(r["lat"] - lat) < 0.03 for r in found) for lon, lat in synthetic.TARGETS)
    assert hit >= 8 and len(found) <= 15


def test_polygon_files(spark, tmp_path):
    square = "[[[0,0],[4,0],[4,4],[0,4],[0,0]]]"
    (tmp_path / "land.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":%s}},{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[10,0],[14,0],[14,4],[10,0]]],[[[20,0],[24,0],[24,4],[20,0]]]]}}]}' % square)
    poly = readers.polygons(spark, f"file://{tmp_path}/none.parquet", f"file://{tmp_path}/land.geojson")
    assert poly.count() == 3
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 13.0, 1.0), (3, 23.0, 1.0), (4, 17.0, 1.0)], "id long, lon double, lat double")
    assert {r["id"] for r in land.on_land(pts, poly).collect()} == {1, 2, 3}
    poly.write.parquet(f"file://{tmp_path}/land.parquet")
    assert readers.polygons(spark, f"file://{tmp_path}/land.parquet").count() == 3
    with pytest.raises(RuntimeError):
        readers.polygons(spark, f"file://{tmp_path}/none.parquet")


def test_shown_annotated_and_merged(spark, tmp_path):
    df = spark.createDataFrame([(1, True, "cargo_ship"), (2, False, "cargo_ship"), (3, True, "small_craft")], "det_id long, dark_vessel boolean, vessel_class string")
    assert [r["det_id"] for r in vessels.shown(df, dark_only=True).collect()] == [1, 3]
    assert [r["det_id"] for r in vessels.shown(df, vessel_class="cargo_ship").collect()] == [1, 2]
    assert vessels.shown(df).count() == 3 and vessels.merge().count() == 0
    assert sinks.write_annotated(df, f"file://{tmp_path}/a") and not sinks.write_annotated(df.limit(0), f"file://{tmp_path}/b")
    back = readers.read_text_csv(spark, f"file://{tmp_path}/a")
    assert back.columns == df.columns and back.count() == 3 and not (tmp_path / "b").exists()


def test_box_rows_and_masks(spark, tmp_path):
    boxes = spark.createDataFrame([(1.23456789, 2.0, 0.87654, 1, 1.26, 2.0, 3.0, 4.04)], "lon double, lat double, conf double, cls int, x1 double, y1 double, x2 double, y2 double")
    assert tuple(sinks.boxes_csv(boxes).first()) == ("1.234568", "2.000000", "0.8765", 1, "1.3", "2.0", "3.0", "4.0")
    hits = spark.createDataFrame([("A", 1, 2, 9.0), ("B", 3, 4, 9.0)], "scene string, row int, col int, v double")
    sinks.write_mask(hits, f"file://{tmp_path}/mask")
    assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/mask").select("scene", "row", "col").collect()} == {("A", 1, 2), ("B", 3, 4)}
    assert spark.range(1).select(radiometry.pfa_from_exponent(F.lit(-6))).first()[0] == pytest.approx(1e-6)


@pytest.mark.parametrize("km", [10.0, 2.0])
def test_crowded_points_join_once(spark, km):
    det = spark.range(400).select(F.col("id").alias("det_id"), (F.col("id") % 2 / 50).alias("lat"), F.lit(2.0).alias("lon"))
    ais = spark.range(600).select(F.col("id").alias("ais_seq"), (F.col("id") % 3 / 50).alias("lat"), F.lit(2.0).alias("lon"), F.concat(F.lit("v"), F.col("id")).alias("vessel_id"), F.lit("n").alias("vessel_name"), F.lit("").alias("flag"))
    got = nearest.match_nearest(det, ais, km)
    assert {(r["det_id"] % 2, r["matched_vessel_id"]) for r in got.collect()} == {(0, "v0"), (1, "v1")} and got.count() == 400
    assert joined_rows(got) <= 400


def test_crowded_scenes_join_once(spark):
    det = spark.range(400).select(F.col("id").alias("det_id"), F.lit("s").alias("scene"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    ais = spark.range(600).select(F.col("id").alias("ais_seq"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.concat(F.lit("v"), F.col("id")).alias("vessel_id"), F.lit("n").alias("vessel_name"), F.lit("").alias("flag"))
    ais = ais.withColumn("ts", F.timestamp_seconds(F.col("ais_seq")))
    scenes = spark.createDataFrame([("s", datetime(1970, 1, 1, 0, 1), datetime(1970, 1, 2))], "scene string, t_from timestamp, t_to timestamp")
    got = nearest.match_scenes(det, ais, scenes, 10.0)
    assert [r["matched_vessel_id"] for r in got.collect()] == ["v60"] * 400
    assert joined_rows(got) <= 600


def test_equal_boxes_meet_once(spark):
    rows = spark.range(400).select(F.col("id").alias("id"), F.lit("s").alias("scene"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (10.0 + F.col("id") % 2 * 30).alias("x2"), F.lit(10.0).alias("y2"), F.lit(7).alias("area_px"), (F.col("id") / 400).alias("conf"))
    flat = rows.limit(3).withColumns({"id": F.col("id") + 1000, "x2": F.lit(0.0)})
    boxes = rows.union(flat)
    kept = nms.by_confidence(boxes)
    assert {r["id"] for r in kept.collect()} == {398, 399, 1000, 1001, 1002}
    assert {r["id"] for r in nms.by_area(boxes).collect()} == {0, 1, 1000, 1001, 1002}
    assert nms.suppress(boxes, [F.col("conf")], 1.0).count() == 403


def test_links_of_equal_boxes_are_few(spark, monkeypatch):
    found = []
    monkeypatch.setattr(nms, "overlapping", lambda *a, f=nms.overlapping, **b: found.append(f(*a, **b)) or found[-1])
    rows = spark.range(200).select("id", F.lit("s").alias("scene"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (10.0 + F.col("id") % 2).alias("x2"), F.lit(10.0).alias("y2"), F.lit(7).alias("area_px"), (F.col("id") / 200).alias("conf"))
    assert nms.by_area(rows).count() == 1 and nms.by_confidence(rows).count() == 1
    assert [x.count() for x in found] == [1, 1]


def test_equal_predictions_share_candidates(spark):
    n = 600
    preds = spark.range(n).select(F.lit(1).alias("image_id"), F.lit(0).alias("cls"), F.col("id").alias("seq"), (F.col("id") % 7 / 7).alias("conf"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (10.0 + F.col("id") % 3).alias("x2"), F.lit(10.0).alias("y2"))
    truths = spark.range(n // 2).select(F.lit(1).alias("image_id"), F.lit(0).alias("cls"), F.col("id").alias("seq"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (11.0 + F.col("id") % 2).alias("x2"), F.lit(10.0).alias("y2"))
    p, t = evaluation._shapes(preds, "seq", "conf"), evaluation._shapes(truths, "seq")
    assert evaluation._candidates(p, t, 0.5).count() == 6
    assert tuple(evaluation.match(preds, truths).first()) == (1, n // 2, n // 2, 0)


def test_pooled_choices_are_the_plain_loop():
    rng = random.Random(11)
    for _ in range(300):
        queues = {t: sorted(rng.sample(range(40), rng.randint(1, 4))) for t in range(6)}
        levels = {}
        for s in range(4):
            some = rng.sample(range(6), rng.randint(0, 6))
            cut = rng.randint(0, len(some))
            levels[s] = [x for x in (some[:cut], some[cut:]) if x]
        shapes = [rng.randrange(5) for _ in range(25)]
        used, want = set(), []
        for s in shapes:
            g = next((g for level in levels.get(s, ()) for g in sorted(g for t in level for g in queues[t]) if g not in used), None)
            used.add(g)
            want.append(g is not None)
        assert evaluation._taken(shapes, levels, queues) == want


@pytest.mark.parametrize("same", [True, False])
def test_average_precision_of_many(spark, same):
    """A class of 20,000 predictions: its envelope must not look at all later ones for each."""
    preds = spark.range(20_000).select((F.col("id") % 100).alias("image_id"), F.lit(0).alias("cls"), F.col("id").alias("seq"), F.lit(0.5).alias("conf") if same else (F.col("id") / 20_000).alias("conf"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(9.0).alias("x2"), F.lit(9.0).alias("y2"))
    truths = preds.where("seq < 200").drop("conf")
    got = evaluation.average_precision(preds, truths)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    assert 0 < got.first()["ap"] <= 1
