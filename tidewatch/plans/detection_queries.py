"""Queries on detections, ship positions, catalogue and labels."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import classify, geo, geojson, parse
from tidewatch.operators import land, nearest, pairing, range_join, vessels
from tidewatch.plans import fixtures as X
from tidewatch.plans import pipeline
from tidewatch.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


HAVERSINE = "2 * 6371.0::double * asin(sqrt(greatest(0::double, least(1::double, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"


def nearest_sql(km: float, more: str = "", ais: str = "ais") -> str:
    return f"""{X.with_(ais0=X.AIS, det=X.DETECTIONS)}{more},
pairs as (select det_id, ais_seq, vessel_id, vessel_name, flag, {HAVERSINE.format(a="d", b="a")} as km
  from det d join {ais} a on abs(a.lat - d.lat) < {km} / 100.0 and abs(a.lon - d.lon) < {km} / 90.0),
best as (select *, row_number() over (partition by det_id order by round(km, 9), ais_seq) as k from pairs where km <= {km})
select d.det_id, d.scene, b.det_id is not null as ais_match, b.det_id is null as dark_vessel, b.vessel_id as matched_vessel_id, b.vessel_name as matched_vessel_name, b.flag as matched_flag, round(b.km, 4) as ais_distance_km
from det d left join best b on b.det_id = d.det_id and b.k = 1"""


def _matched(spark: SparkSession, d: str, km: float, start=None, end=None) -> DataFrame:
    det, ais = X.view(spark, d, X.DETECTIONS), X.view(spark, d, X.AIS)
    ais = nearest.near_scene(ais, det, start, end)
    return nearest.match_nearest(det.select("det_id", "scene", "lat", "lon"), ais, km, max_abs_lat=10.0).drop("lat", "lon")


@query(nearest_sql(2.0, ais="ais0"))
def ais_nearest_2km(spark, d):
    return _matched(spark, d, 2.0)


@query(nearest_sql(10.0, ais="ais0"))
def ais_nearest_10km(spark, d):
    return _matched(spark, d, 10.0)


T0, T1 = datetime(2024, 1, 5), datetime(2024, 1, 20)


@query(nearest_sql(10.0, """, ais as (select a.* from ais0 a, (select min(lat) - 0.1::double as s, max(lat) + 0.1::double as n, min(lon) - 0.1::double as w, max(lon) + 0.1::double as e from det)
  where lat between s and n and lon between w and e and (ts is null or ts between timestamp '2024-01-05' and timestamp '2024-01-20'))"""))
def ais_nearest_windowed(spark, d):
    return _matched(spark, d, 10.0, T0, T1)


@query(f"""select scene, count(*) as total, count(*) filter (ais_match) as matched, count(*) filter (dark_vessel) as dark, round_even(count(*) filter (dark_vessel) * 100.0::double / count(*), 0)::bigint as dark_rate
from ({nearest_sql(10.0, ais="ais0")}) group by scene""")
def dark_summary(spark, d):
    return nearest.dark_summary(_matched(spark, d, 10.0), "scene")


@query(f"""with c as (select c_custkey, -5 + (c_custkey % 150)::double / 10 as lon, -5 + (c_custkey * 7 % 100)::double / 10 as lat, c_nationkey from customer),
s as (select s_suppkey, -5 + (s_suppkey * 3 % 150)::double / 10 as lon, -5 + (s_suppkey * 11 % 100)::double / 10 as lat, s_nationkey from supplier)
select c_custkey, s_suppkey, round({HAVERSINE.format(a="c", b="s")}, 6) as km from c join s on c_nationkey = s_nationkey""")
def haversine_pairs(spark, d):
    """Distances of points, then of all customers and suppliers at them."""
    clon, clat = -5 + (F.col("c_custkey") % 150).cast("double") / 10, -5 + (F.col("c_custkey") * 7 % 100).cast("double") / 10
    c = X.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), clon.alias("lon"), clat.alias("lat")).agg(F.sort_array(F.collect_list("c_custkey")).alias("c"))
    slon, slat = -5 + (F.col("s_suppkey") * 3 % 150).cast("double") / 10, -5 + (F.col("s_suppkey") * 11 % 100).cast("double") / 10
    s = X.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation"), slon.alias("slon"), slat.alias("slat")).agg(F.collect_list("s_suppkey").alias("s"))
    km = F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")), 6)
    pairs = pairing.dealt(pairing.chunks(c, "c"), pairing.chunks(s, "s"), ["nation"], "c").select("c", "s", km.alias("km"))
    return pairs.select("s", "km", F.explode("c").alias("c_custkey")).select("c_custkey", F.explode("s").alias("s_suppkey"), "km")


@query(f"{X.with_(ais=X.AIS)} select ais_seq, lon, lat from ais where lon between -2 and 3 and lat between -1 and 4 and (ts is null or ts between timestamp '2024-01-05' and timestamp '2024-01-20')")
def ais_bbox_time_filter(spark, d):
    return readers.within(X.view(spark, d, X.AIS), (-2, -1, 3, 4), T0, T1).select("ais_seq", "lon", "lat")


NAME = "concat('S1A_IW_GRDH_1SDV_', {day}, 'T060000_', {day}, 'T060030_', o_orderkey)"


@query(f"""with n as (select o_orderkey, case when o_orderkey % 4 = 0 then concat('other_', o_orderkey) else {NAME.format(day="strftime(o_orderdate, '%Y%m%d')")} end as name from orders),
p as (select *, try_strptime(regexp_extract(name, 'S1[A-Z]_\\w+_\\w+_\\w+_(\\d{{8}}T\\d{{6}})_(\\d{{8}}T\\d{{6}})_', 1), '%Y%m%dT%H%M%S') as t0, try_strptime(regexp_extract(name, 'S1[A-Z]_\\w+_\\w+_\\w+_(\\d{{8}}T\\d{{6}})_(\\d{{8}}T\\d{{6}})_', 2), '%Y%m%dT%H%M%S') as t1 from n)
select o_orderkey, strftime(coalesce(t0 - interval 30 minute, timestamp '2024-06-01 12:00:00' - interval 1 hour), '%Y-%m-%dT%H:%M:%SZ') as t_from, strftime(coalesce(t1 + interval 30 minute, timestamp '2024-06-01 12:00:00' + interval 1 hour), '%Y-%m-%dT%H:%M:%SZ') as t_to from p""")
def scene_window_from_name(spark, d):
    o = X.table(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("other_"), F.col("o_orderkey"))).otherwise(F.expr(NAME.format(day="date_format(o_orderdate, 'yyyyMMdd')")))
    start, end = parse.scene_window_or(name, F.lit(datetime(2024, 6, 1, 12)).cast("timestamp"))
    return o.select("o_orderkey", parse.iso_z(start).alias("t_from"), parse.iso_z(end).alias("t_to"))


@query(f"""{X.with_(scenes=X.SCENES)}, top as (select * from scenes where product_type = 'GRD' and mode = 'IW' and start > timestamp '1995-01-01' and start < timestamp '1998-01-01' and w <= 4 and e >= -2 and s <= 3 and n >= -3
  order by start desc, concat('S1A_', id) limit 50)
select id, row_number() over (order by start desc, concat('S1A_', id)) as place, concat('POLYGON((', w::int, '.0 ', s::int, '.0,', e::int, '.0 ', s::int, '.0,', e::int, '.0 ', n::int, '.0,', w::int, '.0 ', n::int, '.0,', w::int, '.0 ', s::int, '.0))') as wkt, concat(printf('%.0f', size / 1e6), ' MB') as size_text, substr(strftime(start, '%Y-%m-%d %H:%M:%S'), 1, 19) as date_text from top""")
def scene_catalog_topn(spark, d):
    """The newest 50 scenes of a search: a limit is what the search has."""
    s = X.view(spark, d, X.SCENES).withColumn("name", F.concat(F.lit("S1A_"), F.col("id")))
    top = readers.catalogue(s, (-2, -3, 4, 3), datetime(1995, 1, 1), datetime(1998, 1, 1), 50)
    _, date, size = readers.listed_scene(F.col("name"), F.date_format("start", "yyyy-MM-dd HH:mm:ss"), F.col("size"))
    wkt = geo.bbox_wkt(*[F.col(c) for c in "wsen"])
    return readers.rank_of(top, F.desc("start"), F.col("name")).select("id", F.col("place").cast("long").alias("place"), wkt.alias("wkt"), size.alias("size_text"), date.alias("date_text"))


@query(f"{X.with_(px=X.PIXELS)} select row, col, -5 + 0.001::double * (col + 0.5::double) as lon, 5 - 0.001::double * (row + 0.5::double) as lat from px")
def affine_forward(spark, d):
    px = X.view(spark, d, X.PIXELS)
    lon, lat = geo.pixel_to_lonlat(F.col("row"), F.col("col"), {k: F.lit(v) for k, v in X.META.items()})
    return px.select("row", "col", lon.alias("lon"), lat.alias("lat"))


@query(f"{X.with_(det=X.DETECTIONS)} select det_id, round((lon + 5) / 0.001::double, 6) as col, round((5 - lat) / 0.001::double, 6) as row from det")
def affine_inverse(spark, d):
    det = X.view(spark, d, X.DETECTIONS)
    col, row = geo.lonlat_to_pixel(F.col("lon"), F.col("lat"), {k: F.lit(v) for k, v in X.META.items()})
    return det.select("det_id", F.round(col, 6).alias("col"), F.round(row, 6).alias("row"))


SIZED = f"""{X.with_(det=X.DETECTIONS)}, mid as (select scene, 5 - 0.001::double * (avg(cy) + 0.5::double) as lat from det group by scene),
dim as (select det.*, w * (0.001::double * 111320.0::double * cos(radians(mid.lat))) as a, h * (0.001::double * 110540.0::double) as b from det join mid using (scene)),
sized as (select *, round(greatest(a, b), 1) as length_m, round(least(a, b), 1) as width_m from dim)"""


def _sized(spark, d):
    return vessels.size_up(X.view(spark, d, X.DETECTIONS), X.scene_meta(spark, [f"S{k}" for k in range(8)]))


CLASS = "case when length_m < 20 then 'small_craft' when length_m < 50 then 'fishing_vessel' when length_m < 100 then 'coastal_freighter' when length_m <= 200 then 'cargo_ship' else 'vlcc_or_large' end"


@query(f"{SIZED} select det_id, length_m, width_m, {CLASS} as vessel_class from sized")
def vessel_dimensions_class(spark, d):
    return _sized(spark, d).select("det_id", "length_m", "width_m", "vessel_class")


LABEL_CLASS = "case when not is_vessel then 0 when is_vessel and is_fishing then 2 else 1 end"


@query(f"{X.with_(lab=X.LABELS)} select scene_id, scene_row, scene_col, {LABEL_CLASS} as cls, case {LABEL_CLASS} when 0 then 'non_vessel' when 2 then 'fishing_vessel' else 'vessel' end as class_name from lab")
def yolo_class_assign(spark, d):
    cls = classify.label_class(F.col("is_vessel"), F.col("is_fishing"))
    return X.view(spark, d, X.LABELS).select("scene_id", "scene_row", "scene_col", cls.alias("cls"), classify.class_name(cls).alias("class_name"))


CHIPS_SQL = "chips as (select concat('S1_', s) as scene_id, (r * 790)::int as row_min, (c * 790)::int as col_min from (select unnest(range(9)) as s), (select unnest(range(10)) as r), (select unnest(range(10)) as c))"
ON_CHIPS = f"""{X.with_(lab=X.LABELS)}, {CHIPS_SQL},
hit as (select c.scene_id, row_min, col_min, scene_row, scene_col, is_vessel, is_fishing, length_m from chips c left join lab l on c.scene_id = l.scene_id and scene_row >= row_min and scene_row < row_min + 800 and scene_col >= col_min and scene_col < col_min + 800),
px as (select *, greatest(coalesce(length_m, 20) / 10.0::double, 2.0::double) as len_px from hit)"""
LINES = f"""{ON_CHIPS}, lines as (select scene_id, row_min, col_min, case when scene_row is null then null else printf('%d %.6f %.6f %.6f %.6f', {LABEL_CLASS}, (scene_col - col_min) / 800, (scene_row - row_min) / 800, least(len_px / 800, 1.0::double), least(greatest(len_px / 3.0::double, 2.0::double) / 800, 1.0::double)) end as line from px),
files as (select scene_id, row_min, col_min, coalesce(string_agg(line, chr(10) order by line), '') as lines, count(line) as n_labels from lines group by all)"""


def _chips(spark):
    at = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = spark.range(1).select(at(9).alias("s")).select("s", at(10).alias("r")).select("*", at(10).alias("c"))
    return c.select(F.concat(F.lit("S1_"), F.col("s")).alias("scene_id"), (F.col("r") * 790).alias("row_min"), (F.col("c") * 790).alias("col_min"))


def _on_chips(spark, d):
    return range_join.labels_on_chips(_chips(spark), X.view(spark, d, X.LABELS))


@query(f"{ON_CHIPS} select scene_id, row_min, col_min, scene_row, scene_col, length_m from px")
def labels_to_chips(spark, d):
    return _on_chips(spark, d).select("scene_id", "row_min", "col_min", "scene_row", "scene_col", "length_m")


@query(f"{LINES} select * from files")
def chip_label_lines(spark, d):
    return range_join.label_lines(_on_chips(spark, d))


@query(f"{LINES} select count(*) as chips, sum(n_labels)::bigint as labels, count(*) filter (n_labels = 0) as empty_chips from files")
def prep_summary(spark, d):
    return range_join.prep_summary(range_join.label_lines(_on_chips(spark, d)))


PIP = "(({i}.y1 > {p}.lat) <> ({i}.y2 > {p}.lat)) and {p}.lon < ({i}.x2 - {i}.x1) * ({p}.lat - {i}.y1) / ({i}.y2 - {i}.y1) + {i}.x1"
RING = [(-4.0, -3.0), (2.5, -4.5), (6.0, 0.5), (3.0, 0.0), (1.0, 3.5), (-3.5, 2.0)]
HOLE = [(-1.0, -1.0), (1.0, -1.0), (0.0, 1.0)]
_EDGES = ", ".join(f"({a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for r in (RING, HOLE) for a, b in zip(r, r[1:] + r[:1]) if a[1] != b[1])


@query(f"""{X.with_(det=X.DETECTIONS)}, e(x1, y1, x2, y2) as (values {_EDGES}),
n as (select det_id, count(*) as k from det d join e on {PIP.format(i="e", p="d")} group by det_id)
select d.det_id, coalesce(k % 2, 0) = 1 as land from det d left join n using (det_id)""")
def land_mask_pip(spark, d):
    rings = [(1, 1, [{"x": x, "y": y} for x, y in RING]), (1, 2, [{"x": x, "y": y} for x, y in HOLE])]
    poly = spark.createDataFrame(rings, "poly_id int, ring_id int, pts array<struct<x:double,y:double>>")
    det = X.view(spark, d, X.DETECTIONS).select(F.col("det_id").alias("id"), "lon", "lat")
    found = land.on_land(det, poly)
    return det.join(found.withColumn("land", F.lit(True)), "id", "left").select(F.col("id").alias("det_id"), F.coalesce("land", F.lit(False)).alias("land"))


@query(f"""{SIZED} select det_id, round(lon, 6) as lon, round(lat, 6) as lat, 0 as cls, 'non_vessel' as class_name, round(conf, 4) as conf, x::double as b0, y::double as b1, (x + w)::double as b2, (y + h)::double as b3, {CLASS} as vessel_class from sized""")
def geojson_features(spark, d):
    """Features parsed back from their JSON."""
    made = geojson.features(_sized(spark, d), "cfar").select("det_id", "feature")
    kind = "struct<geometry: struct<coordinates: array<double>>, properties: struct<cls: int, class_name: string, conf: double, bbox_px: array<double>, vessel_class: string>>"
    f = made.select("det_id", F.from_json("feature", kind).alias("f"))
    xy, p = F.col("f.geometry.coordinates"), "f.properties."
    return f.select("det_id", xy[0].alias("lon"), xy[1].alias("lat"), F.col(p + "cls"), F.col(p + "class_name"), F.col(p + "conf"), *[F.col(p + "bbox_px")[k].alias(f"b{k}") for k in range(4)], F.col(p + "vessel_class"))


@query(f"""{SIZED} select printf('%.6f', lon) as lon, printf('%.6f', lat) as lat, printf('%.1f', cx) as cx_px, printf('%.1f', cy) as cy_px, x, y, w, h, area_px, case when conf is null then '' else printf('%.4f', round(conf, 4)) end as conf, length_m, width_m, {CLASS} as vessel_class from sized""")
def detections_csv(spark, d):
    return sinks.detections_csv(_sized(spark, d).withColumn("conf", F.round("conf", 4)))


@query(f"""{SIZED} select det_id, round(lat, 5) as lat, round(lon, 5) as lon, {CLASS} as vessel_class, round(length_m, 1) as length_m, round(coalesce(conf, 0), 3) as conf, true as dark from sized""")
def display_rows(spark, d):
    return geojson.display(_sized(spark, d), "det_id").select("det_id", "lat", "lon", "vessel_class", "length_m", "conf", "dark")


MERGED = f"""{X.with_(det=X.DETECTIONS, box=X.BOXES)}, sized as (select *, least(w, h) as m from det),
merged as (select 'cfar' as detector, det_id as id, null::int as cls, conf from det union all select 'yolo', id, cls, conf from box)"""


def _merged(spark, d):
    a = X.view(spark, d, X.DETECTIONS).select(F.lit("cfar").alias("detector"), F.col("det_id").alias("id"), "conf")
    return vessels.merge(a, X.view(spark, d, X.BOXES).select(F.lit("yolo").alias("detector"), "id", "cls", "conf"))


@query(f"{MERGED} select * from merged")
def merge_detectors(spark, d):
    return _merged(spark, d)


@query(f"{MERGED} select detector, case coalesce(cls, 0) when 0 then 'non_vessel' when 2 then 'fishing_vessel' else 'vessel' end as class_name, count(*) as n from merged group by all")
def detector_class_counts(spark, d):
    m = _merged(spark, d).withColumn("class_name", classify.class_name(F.coalesce("cls", F.lit(0))))
    return vessels.counts(m, "detector", "class_name")


@query(f"{MERGED} select min(conf) as min_conf, round(avg(conf), 9) as mean_conf, max(conf) as max_conf from merged")
def conf_stats(spark, d):
    return vessels.confidence_stats(_merged(spark, d)).withColumn("mean_conf", F.round("mean_conf", 9))


@query(f"{X.with_(det=X.DETECTIONS)} select round(coalesce(avg(lat) filter (lat <> 0), 1.5), 6) as lat, round(coalesce(avg(lon) filter (lon <> 0), 2.5), 6) as lon from det")
def map_centre(spark, d):
    return vessels.map_centre(X.view(spark, d, X.DETECTIONS)).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"{SIZED}, c as (select distinct {CLASS} as choice from sized) select 'All' as choice, 0 as place union all select choice, (row_number() over (order by choice))::int from c")
def class_choices(spark, d):
    return vessels.class_choices(_sized(spark, d))


@query("""with e as (select event_id, user_id, -5 + (event_id * 104729 % 10000)::double / 1000 as lat, -5 + (event_id * 7919 % 15000)::double / 1000 as lon from events)
select user_id::varchar as vessel_id, arg_min(event_id, event_id) as ais_seq, arg_min(lat, event_id) as lat, arg_min(lon, event_id) as lon from e group by user_id""")
def gfw_events_dedupe(spark, d):
    """Responses of ten events each, as JSON, and back."""
    e = X.view(spark, d, X.AIS).withColumn("user", F.regexp_replace("vessel_name", "^V", ""))
    entry = F.struct(F.struct("lat", "lon").alias("position"), F.date_format("ts", "yyyy-MM-dd").alias("start"), F.struct(F.col("user").alias("id"), F.col("vessel_name").alias("name"), "flag").alias("vessel"))
    r = e.groupBy(F.expr("ais_seq div 10").alias("g")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ais_seq", entry.alias("e")))), lambda x: x["e"]).alias("entries"))).alias("json"), F.min("ais_seq").alias("first"))
    p = readers.event_positions(r.select(F.col("first").alias("seq"), "json"))
    return p.select("vessel_id", (F.expr("ais_seq div 1000000") + F.col("ais_seq") % 1000000).alias("ais_seq"), "lat", "lon")


@query(f"""{X.with_(ais=X.AIS)}, v as (select vessel_id, min(ais_seq) as ais_seq from ais group by vessel_id), seen as (select * from v where vessel_id::bigint % 3 = 0),
more as (select * from v where vessel_id not in (select vessel_id from seen) order by ais_seq limit 50) select 'events' as source, * from seen union all select 'search', * from more""")
def seen_anti_union(spark, d):
    """One source's ids, and the first 50 of another that it lacks: that many are asked for."""
    ais = X.view(spark, d, X.AIS)
    v = readers.first_of(ais.select("vessel_id", "ais_seq"), "vessel_id", "ais_seq")
    seen = v.where("cast(vessel_id as bigint) % 3 = 0")
    more = readers.unseen(v, seen, "vessel_id", "ais_seq")
    named = lambda df, name: df.select(F.lit(name).alias("source"), "vessel_id", "ais_seq")
    return named(seen, "events").unionByName(named(more, "search"))


WINDOWED = """, named as (select det.*, case when scene = 'S7' then 'unnamed' else concat('S1A_IW_GRDH_1SDV_202401', lpad((3 * substr(scene, 2)::int + 1)::varchar, 2, '0'), 'T000000_202401', lpad((3 * substr(scene, 2)::int + 9)::varchar, 2, '0'), 'T120000_x') end as name from det),
lim as (select name, min(lat) - 0.1::double as s, max(lat) + 0.1::double as n, min(lon) - 0.1::double as w, max(lon) + 0.1::double as e,
  try_strptime(regexp_extract(name, '_(\\d{8}T\\d{6})_(\\d{8}T\\d{6})_', 1), '%Y%m%dT%H%M%S') - interval 30 minute as t0, try_strptime(regexp_extract(name, '_(\\d{8}T\\d{6})_(\\d{8}T\\d{6})_', 2), '%Y%m%dT%H%M%S') + interval 30 minute as t1 from named group by name)"""


@query(f"""{X.with_(a=X.AIS, det=X.DETECTIONS)}{WINDOWED},
pairs as (select det_id, ais_seq, vessel_id, vessel_name, flag, {HAVERSINE.format(a="d", b="a")} as km from named d join lim using (name) join a on abs(a.lat - d.lat) < 0.1 and abs(a.lon - d.lon) < 0.112
  where a.lat between lim.s and lim.n and a.lon between lim.w and lim.e and (a.ts is null or t0 is null or a.ts between t0 and t1)),
best as (select *, row_number() over (partition by det_id order by round(km, 9), ais_seq) as k from pairs where km <= 10)
select d.det_id, d.name as scene, b.det_id is not null as ais_match, b.vessel_id as matched_vessel_id, b.vessel_name as matched_vessel_name, b.flag as matched_flag, round(b.km, 4) as ais_distance_km
from named d left join best b on b.det_id = d.det_id and b.k = 1""")
def match_scene_windows(spark, d):
    """Ships in the window and extent of each detection's own scene; one scene's name tells no window."""
    det, ais = X.view(spark, d, X.DETECTIONS), X.view(spark, d, X.AIS)
    day = lambda more: F.lpad((3 * F.substring("scene", 2, 9).cast("int") + more).cast("string"), 2, "0")
    name = F.concat(F.lit("S1A_IW_GRDH_1SDV_202401"), day(1), F.lit("T000000_202401"), day(9), F.lit("T120000_x"))
    det = det.select("det_id", F.when(F.col("scene") == "S7", "unnamed").otherwise(name).alias("scene"), "lat", "lon")
    ais = ais.withColumn("ts", F.col("ts").cast("timestamp"))
    return nearest.match_scenes(det, ais, pipeline.windows(det), 10.0, max_abs_lat=10.0).drop("lat", "lon", "dark_vessel")


@query("""with v as (select vec_id as ais_seq, concat('V', vec_id % 200) as vessel_id, vec_id % 6 as n from embeddings),
t as (select *, n // 2 as k from v where n > 0), ev as (select vessel_id, min(ais_seq) as ais_seq from v where ais_seq % 4 = 0 group by vessel_id)
select 'event' as source, vessel_id, ais_seq, 1.0::double as lat, 2.0::double as lon from ev
union all select 'track', vessel_id, ais_seq, k + (ais_seq % 90)::double, k + (ais_seq % 170)::double from t where vessel_id not in (select vessel_id from ev)""")
def vessel_tracks(spark, d):
    """The middles of tracks of vessels without an event, beside events; empty tracks give nothing."""
    v = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("ais_seq"), F.concat(F.lit("V"), F.col("vec_id") % 200).alias("vessel_id"), F.lit("").alias("vessel_name"), F.lit("").alias("flag"), (F.col("vec_id") % 6).cast("int").alias("n"))
    point = lambda k: F.array(k + (F.col("ais_seq") % 170).cast("double"), k + (F.col("ais_seq") % 90).cast("double"))
    coordinates = F.transform(F.filter(F.sequence(F.lit(0), F.lit(5)), lambda k: k < F.col("n")), point)
    tracks = readers.track_positions(v.withColumn("json", F.to_json(F.struct(F.struct(coordinates.alias("coordinates")).alias("geometry")))))
    events = readers.first_of(v.where("ais_seq % 4 = 0").select("ais_seq", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), "vessel_id", "vessel_name", "flag", F.lit("").alias("timestamp")), "vessel_id", "ais_seq")
    named = lambda df, name: df.select(F.lit(name).alias("source"), *df.columns)
    return readers.with_tracks(named(events, "event"), named(tracks, "track")).select("source", "vessel_id", "ais_seq", "lat", "lon")


@query("""with l as (select concat('raw/', o_custkey % 50, '_', o_orderkey, case o_orderkey % 3 when 0 then '.zip' when 1 then '.SAFE' else '.tif' end) as path from orders)
select path, row_number() over (order by ends_with(path, '.SAFE'), path) as place from l where ends_with(path, '.zip') or ends_with(path, '.SAFE')""")
def scene_listing(spark, d):
    ending = F.when(F.col("o_orderkey") % 3 == 0, ".zip").when(F.col("o_orderkey") % 3 == 1, ".SAFE").otherwise(".tif")
    names = X.table(spark, d, "orders").select(F.concat(F.lit("raw/"), F.col("o_custkey") % 50, F.lit("_"), F.col("o_orderkey"), ending).alias("path"))
    return readers.raw_scenes(names).withColumn("place", F.col("place").cast("long"))


@query("select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then o_orderdate::date end, date '2024-06-01' - 30) as t_from, coalesce(case when o_orderkey % 2 = 0 then o_orderdate::date end, date '2024-06-01') as t_to from orders")
def search_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    start, end = parse.search_dates(F.when(F.col("o_orderkey") % 3 == 0, day), F.when(F.col("o_orderkey") % 2 == 0, day), F.to_date(F.lit("2024-06-01")))
    return X.table(spark, d, "orders").select("o_orderkey", start.alias("t_from"), end.alias("t_to"))


@query("select vec_id, embedding[len(embedding) // 2 + 1] as mid from embeddings")
def track_midpoint(spark, d):
    return X.table(spark, d, "embeddings").select("vec_id", readers.midpoint(F.col("embedding")).alias("mid"))


@query(f"{X.with_(det=X.DETECTIONS)} select case when det_id % 3 = 0 then concat(scene, '_ais_detections.csv') else concat(scene, '_x_ais_detections.csv') end as name, concat(scene, '_processed.tif') as processed, count(*) as n from det group by all")
def output_names(spark, d):
    det = X.view(spark, d, X.DETECTIONS)
    path = F.concat(F.lit("/out/"), F.col("scene"), F.when(F.col("det_id") % 3 == 0, "_cfar_detections.csv").otherwise("_x.csv"))
    raw = F.concat(F.lit("/raw/"), F.col("scene"), F.lit(".SAFE.zip"))
    return det.groupBy(parse.annotated_name(path).alias("name"), parse.processed_name(raw).alias("processed")).agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select concat('P', o_orderkey // 8) as product, concat('P', o_orderkey // 8, case when o_orderkey % 2 = 0 then '/measurement/' else '/annotation/' end, 's1a-iw-grd-', case when o_orderkey % 8 < 4 then 'vv' else 'vh' end, '-', o_orderkey, case when o_orderkey % 3 = 0 then '.xml' else '.tiff' end) as entry from orders),
m as (select product, min(entry) filter (contains(entry, '/measurement/') and ends_with(entry, '.tiff') and contains(entry, '-vv-')) as vv, min(entry) filter (contains(entry, '/measurement/') and ends_with(entry, '.tiff') and contains(entry, '-vh-')) as vh from e group by product)
select *, vv is not null and vh is not null as ok from m""")
def safe_measurements(spark, d):
    e = X.table(spark, d, "orders").select(F.expr("concat('P', o_orderkey div 8)").alias("product"), F.expr("concat('P', o_orderkey div 8, case when o_orderkey % 2 = 0 then '/measurement/' else '/annotation/' end, 's1a-iw-grd-', case when o_orderkey % 8 < 4 then 'vv' else 'vh' end, '-', o_orderkey, case when o_orderkey % 3 = 0 then '.xml' else '.tiff' end)").alias("entry"))
    return readers.measurements(e)


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber % 2 = 0)")
def missing_outputs(spark, d):
    have = X.table(spark, d, "lineitem").where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.missing_outputs(X.table(spark, d, "orders").select("o_orderkey"), have, "o_orderkey")


@query(f"""{SIZED} select det_id, lat, lon, '#FF4444' as colour, 7 as radius, concat('DARK · ', {CLASS}, ' · ', printf('%.0f m', round(length_m, 0))) as label, case when conf is null then 'n/a' else printf('%.2f', round(conf, 2)) end as conf_text, '—' as mmsi, '—' as name from sized""")
def map_markers(spark, d):
    rows = _sized(spark, d)
    shown = geojson.markers(rows, "det_id", "conf")
    return shown.withColumn("conf_text", F.when(F.col("conf").isNull(), "n/a").otherwise(F.col("conf_text"))).drop("conf")
