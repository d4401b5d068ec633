"""The engine's inputs derived from general tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: SQL that both engines take the same way.
AIS = """select event_id as ais_seq, -5 + cast((event_id * 7919) % 15000 as double) / 1000 as lon, -5 + cast((event_id * 104729) % 10000 as double) / 1000 as lat,
  cast(600000000 + user_id as varchar(20)) as vessel_id, concat('V', user_id) as vessel_name, case user_id % 3 when 0 then 'GHA' when 1 then 'NGA' else '' end as flag, ts from events"""
DETECTIONS = """select o_orderkey as det_id, -5 + cast((o_orderkey * 6101) % 15000 as double) / 1000 as lon, -5 + cast((o_orderkey * 3571) % 10000 as double) / 1000 as lat,
  concat('S', o_orderkey % 8) as scene, cast((o_orderkey * 37) % 4000 as double) as cx, cast((o_orderkey * 53) % 3000 as double) as cy,
  cast(1 + o_orderkey % 9 as int) as w, cast(1 + o_orderkey % 7 as int) as h, cast((o_orderkey * 37) % 4000 as int) as x, cast((o_orderkey * 53) % 3000 as int) as y,
  cast(4 + o_orderkey % 60 as int) as area_px, case when o_orderkey % 11 = 0 then null else cast((o_orderkey * 7) % 4096 as double) / 1024 end as conf from orders"""
PIXELS = """select 'A' as scene, cast((event_id - event_id % 50) / 50 as int) as row, cast(event_id % 50 as int) as col, cast(round(value * 100) as bigint)
  * case when cast((event_id - event_id % 50) / 50 as int) % 20 between 9 and 11 and (event_id % 50) % 25 between 11 and 13 then 50 else 1 end as vv, {k} as vh from events"""
LABELS = """select concat('S1_', l_orderkey % 8) as scene_id, cast((l_partkey * 9973 + l_orderkey * 31) % 8000 as double) as scene_row, cast((l_suppkey * 7919 + l_orderkey * 17) % 8000 as double) as scene_col,
  case l_returnflag when 'A' then true when 'R' then false end as is_vessel, case l_linestatus when 'F' then true when 'O' then (l_linenumber % 2 = 0) end as is_fishing,
  case when l_linenumber % 5 = 0 then null else cast(l_quantity as double) * 4 end as length_m, case l_linenumber % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as confidence from lineitem"""
BOXES = """select p_partkey as id, p_partkey % 50 as image_id, cast((p_partkey * 37) % 200 as double) as x1, cast((p_partkey * 53) % 200 as double) as y1,
  cast((p_partkey * 37) % 200 + 10 + p_size as double) as x2, cast((p_partkey * 53) % 200 + 10 + p_partkey % 20 as double) as y2, cast((p_partkey * 37) % 1024 as double) / 1024 as conf,
  cast((10 + p_size) * (10 + p_partkey % 20) as bigint) as area_px, cast(p_partkey % 3 as int) as cls from part"""
TRUTHS = """select p_partkey as id, p_partkey as seq, p_partkey % 50 as image_id, cast((p_partkey * 37) % 200 + p_partkey % 7 - 3 as double) as x1, cast((p_partkey * 53) % 200 + p_partkey % 5 - 2 as double) as y1,
  cast((p_partkey * 37) % 200 + 10 + p_size + p_partkey % 7 - 3 as double) as x2, cast((p_partkey * 53) % 200 + 10 + p_partkey % 20 as double) as y2, cast(p_partkey % 3 as int) as cls from part where p_partkey % 4 <> 0"""
SCENES = """select 'SENTINEL-1' as collection, case when o_orderkey % 5 = 0 then 'SLC' else 'GRD' end as product_type, case when o_orderkey % 7 = 0 then 'EW' else 'IW' end as mode,
  o_orderkey as id, o_orderdate as start, o_totalprice * 1000 as size, cast(-5 + o_orderkey % 15 as double) as w, cast(-4 + o_orderkey % 15 as double) as e, cast(-5 + o_orderkey % 10 as double) as s, cast(-4 + o_orderkey % 10 as double) as n from orders"""


def view(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """Fixture SQL over the Parquet tables."""
    sql = sql.format(k="cast(get_json_object(props, '$.k') as bigint)") if "{k}" in sql else sql
    name = sql.rsplit(" from ", 1)[1].split()[0]
    return spark.sql(sql.replace(f" from {name}", " from {t}"), t=table(spark, d, name))


def sql(text: str) -> str:
    """Fixture SQL for DuckDB."""
    return text.format(k="cast(json_extract_string(props, '$.k') as bigint)") if "{k}" in text else text


def with_(**fixtures: str) -> str:
    return "with " + ", ".join(f"{k} as ({sql(v)})" for k, v in fixtures.items())


#: One transform for all scenes of detections: north up, about 100 m a pixel.
META = {"a": 0.001, "b": 0.0, "c": -5.0, "d": 0.0, "e": -0.001, "f": 5.0}


def scene_meta(spark: SparkSession, scenes: list[str], width: int = 4000, height: int = 3000) -> DataFrame:
    rows = [(s, width, height, *META.values()) for s in scenes]
    return spark.createDataFrame(rows, "scene string, width int, height int, a double, b double, c double, d double, e double, f double")


def long_pixels(px: DataFrame) -> DataFrame:
    """scene, band, row, col, v from vv and vh columns."""
    return px.select("scene", "row", "col", F.explode(F.create_map(F.lit("vv"), F.col("vv"), F.lit("vh"), F.col("vh"))).alias("band", "v"))
