"""Queries on text columns: times, truth values, ranks, names, CSV rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import parse
from tidewatch.plans import fixtures as X
from tidewatch.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


DAY = "{y}-{m}-{d}"
TIMES = """case l_linenumber % 7 when 0 then concat({t}, 'Z') when 1 then {t} when 2 then concat({m}, 'Z') when 3 then {d} when 4 then '' when 5 then concat({t}, '+01:00') else concat({t}, '.5') end"""


@query(f"""with s as (select l_orderkey, l_linenumber, {TIMES.format(t="strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')", m="strftime(l_shipdate, '%Y-%m-%dT%H:%M')", d="strftime(l_shipdate, '%Y-%m-%d')")} as s from lineitem), z as (select *, rtrim(s, 'Z') as u from s)
select l_orderkey, l_linenumber, s, strftime(coalesce(try_strptime(u, '%Y-%m-%dT%H:%M:%S'), try_strptime(u, '%Y-%m-%dT%H:%M'), try_strptime(u, '%Y-%m-%d')), '%Y-%m-%dT%H:%M:%SZ') as t from z""")
def iso_parse_matrix(spark, d):
    f = lambda p: f"date_format(l_shipdate, \"{p}\")"
    s = F.expr(TIMES.format(t=f("yyyy-MM-dd'T'HH:mm:ss"), m=f("yyyy-MM-dd'T'HH:mm"), d=f("yyyy-MM-dd")))
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s")).withColumn("t", parse.iso_z(parse.iso_utc(F.col("s"))))


BOOLS = "case (l_orderkey + l_linenumber) % 12 when 0 then '1' when 1 then '1.0' when 2 then 'true' when 3 then '0' when 4 then '0.0' when 5 then ' False ' when 6 then '' when 7 then 'nan' when 8 then 'NULL' when 9 then '0.5' when 10 then 'yes' else '-2' end"


@query(f"""with s as (select l_orderkey, l_linenumber, {BOOLS} as s from lineitem), t as (select *, lower(trim(s)) as u from s)
select l_orderkey, l_linenumber, case when u in ('', 'nan', 'none', 'null') then null when try_cast(u as double) is not null then trunc(try_cast(u as double)) <> 0 when u = 'true' then true when u = 'false' then false end as b from t""")
def bool_parse_matrix(spark, d):
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parse.tristate(F.expr(BOOLS)).alias("b"))


RANKS = "case l_linenumber % 5 when 0 then 'HIGH' when 1 then ' medium ' when 2 then 'LOW' when 3 then '' else 'unknown' end"


@query(f"""with s as (select l_orderkey, l_linenumber, upper(trim({RANKS})) as s from lineitem), r as (select *, case s when 'HIGH' then 0 when 'MEDIUM' then 1 when 'LOW' then 2 else 99 end as rank from s)
select l_orderkey, l_linenumber, rank, rank <= 1 as at_least_medium, rank <= 2 as at_least_low from r""")
def confidence_rank(spark, d):
    t = F.expr(RANKS)
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parse.confidence_rank(t).alias("rank"), parse.confident(t, "MEDIUM").alias("at_least_medium"), parse.confident(t, "low").alias("at_least_low"))


NAMES = "concat('/chips/S1_', o_orderkey % 8, '_', lpad(cast((o_orderkey * 800) % 20000 as varchar(9)), 4, '0'), '_', lpad(cast((o_orderkey * 400) % 9000 as varchar(9)), 4, '0'), case when o_orderkey % 9 = 0 then '.png' else '.TIF' end)"


@query(f"""with n as (select o_orderkey, {NAMES.replace("lpad(cast((o_orderkey * 800) % 20000 as varchar(9)), 4, '0')", "case when (o_orderkey * 800) % 20000 < 1000 then lpad(cast((o_orderkey * 800) % 20000 as varchar), 4, '0') else cast((o_orderkey * 800) % 20000 as varchar) end")} as p from orders), f as (select *, regexp_extract(p, '[^/]*$') as f from n)
select p as path, regexp_extract(f, '^(.+?)_(\\d{{4}})_(\\d{{4}})\\.(?:tif|TIF)$', 1) as scene_id, regexp_extract(f, '^(.+?)_(\\d{{4}})_(\\d{{4}})\\.(?:tif|TIF)$', 2)::int as row_min, regexp_extract(f, '^(.+?)_(\\d{{4}})_(\\d{{4}})\\.(?:tif|TIF)$', 3)::int as col_min, 800 as chip_size
from f where regexp_matches(f, '^(.+?)_(\\d{{4}})_(\\d{{4}})\\.(?:tif|TIF)$')""")
def chip_name_parse(spark, d):
    n = NAMES.replace("lpad(cast((o_orderkey * 800) % 20000 as varchar(9)), 4, '0')", "case when (o_orderkey * 800) % 20000 < 1000 then lpad(cast((o_orderkey * 800) % 20000 as varchar(9)), 4, '0') else cast((o_orderkey * 800) % 20000 as varchar(9)) end")
    return readers.chip_rows(X.table(spark, d, "orders").select(F.expr(n).alias("path")))


@query("""with r as (select event_id, case when event_id % 13 = 0 then 'x' when event_id % 17 = 0 then '' else concat('', -5 + event_id % 10, '.25') end as lat, concat('', -5 + event_id % 15, '.5') as lon, user_id, ts from events)
select event_id as ais_seq, lat::double as lat, lon::double as lon, user_id::varchar as vessel_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as t from r where try_cast(lat as double) is not null and lon::double between -2 and 3 and lat::double between -1 and 4""")
def ais_csv_rows(spark, d):
    raw = X.table(spark, d, "events").select(
        "event_id",
        F.expr("case when event_id % 13 = 0 then 'x' when event_id % 17 = 0 then '' else concat('', -5 + event_id % 10, '.25') end").alias("lat"),
        F.expr("concat('', -5 + event_id % 15, '.5')").alias("lon"),
        F.col("user_id").cast("string").alias("mmsi"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    rows = readers.within(readers.ais_rows(raw, F.col("event_id")), (-2, -1, 3, 4))
    return rows.select("ais_seq", "lat", "lon", "vessel_id", parse.iso_z(F.col("ts")).alias("t"))


@query("""with r as (select l_orderkey, l_linenumber, case when l_linenumber = 4 then 'bad' else (l_partkey % 8000)::varchar end as row, (l_suppkey % 8000)::varchar as col, case l_linenumber % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as confidence from lineitem)
select concat('S', l_orderkey) as scene_id, row::double as scene_row, col::double as scene_col, l_linenumber = 1 as is_vessel, null::boolean as is_fishing, confidence from r where row <> 'bad' and confidence in ('HIGH', 'MEDIUM')""")
def labels_csv_rows(spark, d):
    raw = X.table(spark, d, "lineitem").select(
        F.expr("concat('S', l_orderkey)").alias("scene_id"),
        F.expr("case when l_linenumber = 4 then 'bad' else cast(l_partkey % 8000 as string) end").alias("detect_scene_row"),
        F.expr("cast(l_suppkey % 8000 as string)").alias("detect_scene_column"),
        F.expr("case when l_linenumber = 1 then 'True' else '0' end").alias("is_vessel"),
        F.lit("").alias("is_fishing"),
        F.lit("n/a").alias("vessel_length_m"),
        F.expr("case l_linenumber % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end").alias("confidence"),
    )
    return readers.label_rows(raw, "MEDIUM").drop("length_m")


@query("""with s as (select o_orderkey, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 3 = 1 then strftime(o_orderdate, '%Y%m%d') else 'n/a' end as s from orders)
select o_orderkey, coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y%m%d'))::date::varchar as day from s""")
def date_parse(spark, d):
    s = F.expr("case when o_orderkey % 3 = 0 then date_format(o_orderdate, 'yyyy-MM-dd') when o_orderkey % 3 = 1 then date_format(o_orderdate, 'yyyyMMdd') else 'n/a' end")
    return X.table(spark, d, "orders").select("o_orderkey", parse.day(s).cast("string").alias("day"))
