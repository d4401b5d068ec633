"""Queries on pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import radiometry
from tidewatch.operators import components, focal, raster
from tidewatch.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _px(spark, d) -> DataFrame:
    return X.long_pixels(X.view(spark, d, X.PIXELS))


def _sums(value: str, *halves: int, name: str = "s") -> str:
    """CTEs for box sums of a column of px(scene, band, row, col, ...)."""
    half = max(halves)
    over = "over (partition by scene, band, {a} order by {b} rows between {h} preceding and {h} following)"
    first = ", ".join(f"sum({value}) {over.format(a='row', b='c', h=h)} as h{h}" for h in halves)
    second = ", ".join(f"sum(h{h}) {over.format(a='col', b='r', h=h)} as s{h}" for h in halves)
    return f"""{name}_size as (select max(row) + 1 as hh, max(col) + 1 as ww from px),
{name}_a as (select *, col as c from px union all select *, -1 - col from px where col < {half} union all select px.*, 2 * ww - 1 - col from px, {name}_size where col >= ww - {half}),
{name}_b as (select *, {first} from {name}_a),
{name}_c as (select * from {name}_b where c between 0 and (select ww - 1 from {name}_size)),
{name}_d as (select *, row as r from {name}_c union all select *, -1 - row from {name}_c where row < {half} union all select {name}_c.*, 2 * hh - 1 - row from {name}_c, {name}_size where row >= hh - {half}),
{name}_e as (select *, {second} from {name}_d),
{name} as (select * exclude (c, r) from {name}_e where r between 0 and (select hh - 1 from {name}_size))"""


PX = f"{X.with_(wide=X.PIXELS)}, px as (select scene, 'vv' as band, row, col, vv as v from wide union all select scene, 'vh', row, col, vh from wide)"


@query(f"""{X.with_(wide=X.PIXELS)}, dn as (select row, col, vv - 3000 as dn from wide), db as (select *, case when dn > 0 then 10 * log10(dn::double * dn) end as db from dn)
select row, col, round(db, 9) as db, round(case when db is null then 0 else pow(10.0::double, db / 10) end / 1000000, 3) as power from db""")
def calibrate_db_linear(spark, d):
    px = X.view(spark, d, X.PIXELS).select("row", "col", (F.col("vv") - 3000).cast("double").alias("dn"))
    px = px.withColumn("db", radiometry.dn_to_db(F.col("dn")))
    return px.select("row", "col", F.round("db", 9).alias("db"), F.round(radiometry.db_to_linear(F.col("db")) / 1_000_000, 3).alias("power"))


@query(f"{PX}, {_sums('v', 3)} select band, row, col, s3 / 49.0::double as mean from s")
def box_mean_reflect(spark, d):
    return focal.box_sums(_px(spark, d), {"s": ("v", 7)}).select("band", "row", "col", (F.col("s") / F.lit(49.0)).alias("mean"))


ALPHA = f"'{radiometry.cfar_alpha(416, 1e-6)!r}'::double"
CFAR = f"{PX}, {_sums('v', 10, 2)}, hits as (select scene, band, row, col, v, v > {ALPHA} * ((s10 - s2) / 416.0::double) as hit from s)"


@query(f"{CFAR} select row, col from hits where hit and band = 'vv'")
def cfar_mask_vv(spark, d):
    return focal.cfar(_px(spark, d).where("band = 'vv'")).where("hit").select("row", "col")


@query(f"{CFAR} select distinct row, col from hits where hit")
def cfar_mask_dual(spark, d):
    return focal.fused_hits(focal.cfar(_px(spark, d))).select("row", "col")


@query(f"{CFAR} select (count(*) filter (hit and band = 'vv'))::bigint as n_vv, (count(*) filter (hit and band = 'vh'))::bigint as n_vh, (count(distinct (row, col)) filter (hit))::bigint as n_any from hits")
def cfar_counts(spark, d):
    h = focal.cfar(_px(spark, d))
    by = lambda b: F.count_if(F.col("hit") & (F.col("band") == b))
    per = h.groupBy("scene", "row", "col").agg(by("vv").alias("a"), by("vh").alias("b"))
    return per.agg(F.sum("a").alias("n_vv"), F.sum("b").alias("n_vh"), F.count_if(F.col("a") + F.col("b") > 0).alias("n_any"))


MOMENTS = f"""{PX.replace(" px as (", " px0 as (")}, px as (select scene, band, row, col, v, v * v as vv2 from px0), {_sums('v', 3, name='m')}, mm as (select scene, band, row, col, s3 as s from m),
{_sums('vv2', 3, name='q')}, mo as (select q.*, mm.s / 49.0::double as mean, greatest(q.s3 / 49.0::double - (mm.s / 49.0::double) * (mm.s / 49.0::double), 0) as var from q join mm using (scene, band, row, col))"""


@query(f"""{MOMENTS}, nz as (select band, avg(var) as noise from mo group by band)
select mo.band, row, col, round(mean + var / (var + noise + 1e-10) * (v - mean), 3) as filtered from mo join nz using (band)""")
def lee_filter(spark, d):
    return focal.lee(_px(spark, d).withColumn("v", F.col("v").cast("double"))).select("band", "row", "col", F.round("filtered", 3).alias("filtered"))


@query(f"""{MOMENTS}, cv as (select *, pow(sqrt(var) / (mean + 1e-10), 2) as c2 from mo), lk as (select band, 1 / (avg(c2) + 1e-10) as looks from cv group by band)
select cv.band, row, col, round(mean + c2 / (c2 + 1 / looks + 1e-10) * (v - mean), 3) as filtered from cv join lk using (band)""")
def gamma_map_filter(spark, d):
    return focal.gamma_map(_px(spark, d).withColumn("v", F.col("v").cast("double"))).select("band", "row", "col", F.round("filtered", 3).alias("filtered"))


STRETCH = f"""{PX}, q as (select band, quantile_cont(v::double, 0.02) as lo, quantile_cont(v::double, 0.98) as hi from px group by band),
st as (select px.*, case when hi > lo then floor((least(greatest(v::double, lo), hi) - lo) / (hi - lo) * 255) else 0 end::smallint as byte from px join q using (band))"""


@query(f"{STRETCH} select band, row, col, byte from st")
def percentile_stretch(spark, d):
    return raster.stretch(_px(spark, d), "scene", "band").select("band", "row", "col", "byte")


@query(f"{STRETCH} select row, col, max(byte) filter (band = 'vv') as r, max(byte) filter (band = 'vh') as g, max(byte) filter (band = 'vv') as b from st group by row, col")
def rgb_compose(spark, d):
    rgb = raster.compose(raster.stretch(_px(spark, d), "scene", "band"))
    return rgb.select("row", "col", *[F.get("rgb", F.lit(k)).alias(c) for k, c in enumerate("rgb")])


@query(f"{PX} select band, row - 5 as row, col - 7 as col, v from px where row >= 5 and row < 16 and col >= 7 and col < 31")
def clip_bbox(spark, d):
    px = _px(spark, d)
    n = F.max("row") + 1
    meta = px.groupBy("scene").agg(F.lit(50).alias("width"), n.cast("int").alias("height"), F.lit(0.01).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"), F.lit(-0.01).alias("e"), F.lit(0.0).alias("f"))
    out, _ = raster.clip(px, meta, (0.075, -0.155, 0.305, -0.055))
    return out.select("band", "row", "col", "v")


@query(f"{PX} select band, (row // 4)::int as row, (col // 4)::int as col, avg(v) as v from px group by all")
def decimate_avg(spark, d):
    return raster.decimate(_px(spark, d)).select("band", "row", "col", "v")


@query("""with r as (select concat('S', k) as scene, (1000 + k * 413)::int as height, (800 + k * 739)::int as width from (select unnest(range(8)) as k)),
g as (select scene, unnest(range(0, height, 736))::int as row0, height, width from r), t as (select scene, row0, unnest(range(0, width, 736))::int as col0, height, width from g)
select scene, row0, col0, least(800, height - row0)::int as h, least(800, width - col0)::int as w from t where height - row0 >= 16 and width - col0 >= 16""")
def tile_grid(spark, d):
    k = F.col("id").cast("int")
    return raster.tile_grid(spark.range(8).select(F.concat(F.lit("S"), k).alias("scene"), (1000 + k * 413).alias("height"), (800 + k * 739).alias("width")))


@query(f"""{X.with_(wide=X.PIXELS)}, size as (select max(row) + 1 as height from wide), g as (select unnest(range(0, height, 24))::int as row0, height from size), t as (select row0, unnest(range(0, 50, 24))::int as col0, height from g), k as (select row0, col0, least(32, height - row0) as h, least(32, 50 - col0) as w from t where least(32, height - row0) >= 16 and least(32, 50 - col0) >= 16)
select row0, col0, row, col from k join wide on row >= row0 and row < row0 + h and col >= col0 and col < col0 + w""")
def tile_assign(spark, d):
    px = X.view(spark, d, X.PIXELS)
    meta = px.groupBy("scene").agg((F.max("row") + 1).cast("int").alias("height"), F.lit(50).alias("width"))
    return raster.tile_pixels(px, meta, 32, 8).select("row0", "col0", "row", "col")


@query(f"""{X.with_(box=X.BOXES)} select id, x1 + 736 * (id % 3) as x1, y1 + 736 * (id % 2) as y1, x2 + 736 * (id % 3) as x2, y2 + 736 * (id % 2) as y2,
-5 + 0.001::double * ((x1 + 736 * (id % 3) + x2 + 736 * (id % 3)) / 2 + 0.5::double) as lon, 5 - 0.001::double * ((y1 + 736 * (id % 2) + y2 + 736 * (id % 2)) / 2 + 0.5::double) as lat from box""")
def stitch_boxes(spark, d):
    b = X.view(spark, d, X.BOXES).select("id", F.lit("S0").alias("scene"), "x1", "y1", "x2", "y2", (736 * (F.col("id") % 3)).alias("col0"), (736 * (F.col("id") % 2)).alias("row0"))
    return raster.stitch(b, X.scene_meta(spark, ["S0"])).drop("scene")


COMPONENTS = f"""{CFAR.replace("with ", "with recursive ", 1)}, m as (select scene, row, col, v, row::bigint * 16777216 + col as p from hits where hit and band = 'vv'),
reach as (select p, p as q from m union select r.p, n.p from reach r join m o on o.p = r.q join m n on abs(n.row - o.row) <= 1 and abs(n.col - o.col) <= 1),
lab as (select p, min(q) as label from reach group by p), comp as (select m.*, label from m join lab using (p)),
st as (select label, min(col) as x, min(row) as y, max(col) - min(col) + 1 as w, max(row) - min(row) + 1 as h, count(*) as area_px, avg(col) as cx, avg(row) as cy, avg(v) / (select avg(v) from m) as conf from comp group by label)"""


def _components(spark, d):
    px = _px(spark, d).where("band = 'vv'")
    labelled = components.label(focal.fused_hits(focal.cfar(px)))
    return components.with_confidence(labelled, px)


@query(f"{COMPONENTS} select label, x, y, w, h, area_px, cx, cy from st")
def component_stats(spark, d):
    return _components(spark, d).select("label", "x", "y", "w", "h", "area_px", "cx", "cy")


@query(f"{COMPONENTS} select label, area_px, round(conf, 9) as conf from st where area_px between 4 and 5000")
def component_conf(spark, d):
    return components.of_area(_components(spark, d)).select("label", "area_px", F.round("conf", 9).alias("conf"))


@query()
def detect_scene_e2e(spark, d):
    """Pixels to classified boxes: threshold, components, area, suppression, position, size."""
    from tidewatch.plans.pipeline import detect

    px = X.long_pixels(X.view(spark, d, X.PIXELS))
    return detect(px, X.scene_meta(spark, ["A"], 50, 100_000), pfa=1e-5)


@query(f"""{X.with_(wide=X.PIXELS)}, b as (select k as det_id, k * 2 + 1 as x, k * 3 as y from (select unnest(range(64)) as k))
select det_id, row, col, vv from b join wide on row >= y - 4 and row < y + 4 and col >= x - 4 and col < x + 4""")
def detection_crops(spark, d):
    """Pixels around the first 64 boxes: that many are shown."""
    k = F.col("id")
    boxes = spark.range(80).select(k.alias("det_id"), F.lit("A").alias("scene"), *[F.lit(None).cast("double").alias(c) for c in ("cx", "cy")], (2 * k).alias("x1"), (2 * k + 2).alias("x2"), (3 * k - 1).alias("y1"), (3 * k + 1).alias("y2"))
    return raster.crops(boxes, X.view(spark, d, X.PIXELS), side=8).select("det_id", "row", "col", "vv")
