"""Text, JSON and listing sources: everything is read as strings and parsed tolerantly."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions.geo import in_bbox
from tidewatch.functions.parse import chip_parts, confident, iso_utc, number, tristate

AIS_SCHEMA = "lat double, lon double, vessel_id string, vessel_name string, flag string, timestamp string, ts timestamp, ais_seq bigint"


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all strings, names and values trimmed."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns])


def ais_rows(raw: DataFrame, seq: Column | None = None) -> DataFrame:
    """Ship positions from text columns; rows without a sane position go.  A file's mmsi column counts even where it's blank."""
    have = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    vessel = have("mmsi") if "mmsi" in raw.columns else have("vessel_id")
    out = raw.select(
        number(have("lat")).alias("lat"),
        number(have("lon")).alias("lon"),
        F.coalesce(vessel, F.lit("")).alias("vessel_id"),
        F.coalesce(have("vessel_name"), F.lit("")).alias("vessel_name"),
        F.coalesce(have("flag"), F.lit("")).alias("flag"),
        have("timestamp").alias("timestamp"),
        iso_utc(have("timestamp")).alias("ts"),
        (F.monotonically_increasing_id() if seq is None else seq).alias("ais_seq"),
    )
    return out.where("lat is not null and lon is not null")


def within(ais: DataFrame, bbox: tuple[float, float, float, float], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Positions in a box and window, both closed; those without a readable time stay."""
    out = ais.where(in_bbox(F.col("lon"), F.col("lat"), bbox))
    return out if start is None or end is None else out.where(F.col("ts").isNull() | F.col("ts").between(F.lit(start), F.lit(end)))


def read_ais(spark: SparkSession, bbox: tuple[float, float, float, float], start: datetime | None = None, end: datetime | None = None, csv: str | None = None, api: DataFrame | None = None) -> DataFrame:
    """A CSV goes before an API's rows; without either (or without the file) there are none."""
    empty = spark.createDataFrame([], AIS_SCHEMA)
    if csv:
        if not exists(spark, csv):
            return empty
        return within(ais_rows(read_text_csv(spark, csv)), bbox, start, end)
    return within(api, bbox, start, end) if api is not None else empty


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def label_rows(raw: DataFrame, least: str = "LOW") -> DataFrame:
    """Training labels from text columns; rows without a position or below a confidence go."""
    out = raw.select(
        "scene_id",
        number(F.col("detect_scene_row")).alias("scene_row"),
        number(F.col("detect_scene_column")).alias("scene_col"),
        tristate(F.col("is_vessel")).alias("is_vessel"),
        tristate(F.col("is_fishing")).alias("is_fishing"),
        number(F.col("vessel_length_m")).alias("length_m"),
        F.upper(F.trim("confidence") if "confidence" in raw.columns else F.lit("LOW")).alias("confidence"),
    )
    return out.where("scene_row is not null and scene_col is not null").where(confident(F.coalesce("confidence", F.lit("")), least))


def chip_rows(listing: DataFrame, path_col: str = "path", chip: int = P.CHIP) -> DataFrame:
    """Chips by file names; others go."""
    scene, row, col = chip_parts(F.col(path_col))
    return listing.select(F.col(path_col).alias("path"), scene.alias("scene_id"), row.alias("row_min"), col.alias("col_min"), F.lit(chip).alias("chip_size")).where("scene_id is not null")


def measurements(entries: DataFrame, product: str = "product", name: str = "entry") -> DataFrame:
    """product, vv, vh, ok: the measurement files of each polarisation among a product's entries."""
    n = F.lower(F.col(name))
    is_tiff = F.col(name).contains("/measurement/") & n.endswith(".tiff")
    pick = lambda p: F.min(F.when(is_tiff & n.contains(f"-{p}-"), F.col(name)))
    out = entries.groupBy(product).agg(pick("vv").alias("vv"), pick("vh").alias("vh"))
    return out.withColumn("ok", F.col("vv").isNotNull() & F.col("vh").isNotNull())


def catalogue(scenes: DataFrame, bbox: tuple[float, float, float, float], start: datetime, end: datetime, limit: int) -> DataFrame:
    """The newest scenes of a kind that begin strictly within a time span and touch a box.

    scenes: collection, product_type, mode, name, start, w, s, e, n.
    """
    kind = (F.col("collection") == "SENTINEL-1") & (F.col("product_type") == "GRD") & (F.col("mode") == "IW")
    w, s, e, n = bbox
    touches = (F.col("w") <= e) & (F.col("e") >= w) & (F.col("s") <= n) & (F.col("n") >= s)
    return scenes.where(kind & (F.col("start") > F.lit(start)) & (F.col("start") < F.lit(end)) & touches).orderBy(F.desc("start"), "name").limit(limit)


def listed_scene(name: Column, start: Column, size: Column) -> tuple[Column, Column, Column]:
    """Title, date and size as they are shown."""
    return F.substring(name, 1, 68), F.substring(start.cast("string"), 1, 19), F.when(size.isNotNull(), F.concat(F.format_string("%.0f", size / 1e6), F.lit(" MB"))).otherwise("?")


EVENTS = "struct<entries: array<struct<position: struct<lat: double, lon: double>, lat: double, lon: double, start: string, vessel: struct<id: string, name: string, flag: string>>>>"
TRACK = "struct<geometry: struct<coordinates: array<array<double>>>>"


def events_of(json: Column) -> Column:
    return F.from_json(json, EVENTS)["entries"]


def event_positions(responses: DataFrame, json_col: str = "json") -> DataFrame:
    """A position per vessel from an events response (seq, json): the first event counts; 0.0 is a position."""
    e = responses.select("seq", F.posexplode(events_of(F.col(json_col))).alias("pos", "e"))
    out = e.select((F.col("seq") * 1_000_000 + F.col("pos")).alias("ais_seq"), F.coalesce("e.position.lat", "e.lat").alias("lat"), F.coalesce("e.position.lon", "e.lon").alias("lon"), F.coalesce("e.vessel.id", F.lit("")).alias("vessel_id"), F.coalesce("e.vessel.name", F.lit("")).alias("vessel_name"), F.coalesce("e.vessel.flag", F.lit("")).alias("flag"), F.col("e.start").alias("timestamp"))
    return first_of(out.where("lat is not null and lon is not null"), "vessel_id", "ais_seq")


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def unseen(found: DataFrame, seen: DataFrame, key: str, order: str, limit: int = P.TRACK_IDS) -> DataFrame:
    """The first keys that aren't among those seen."""
    return found.join(seen.select(key).distinct(), key, "left_anti").orderBy(order).limit(limit)


def midpoint(coords: Column) -> Column:
    """The middle element of an array (the later of two)."""
    return F.try_element_at(coords, (F.floor(F.size(coords) / 2) + 1).cast("int"))


def listed(listing: DataFrame, *patterns: str, path_col: str = "path") -> DataFrame:
    """path and place, from 1: the files like the first pattern by path, then those like the next."""
    which = F.coalesce(*[F.when(F.col(path_col).like(p), k) for k, p in enumerate(patterns)])
    found = listing.select(F.col(path_col).alias("path"), which.alias("kind")).where("kind is not null")
    return rank_of(found, F.col("kind"), F.col("path")).select("path", "place")


def raw_scenes(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """Archives, then unpacked scenes."""
    return listed(listing, "%.zip", "%.SAFE", path_col=path_col)


def track_positions(responses: DataFrame, json_col: str = "json") -> DataFrame:
    """A position per vessel from track responses (ais_seq, vessel_id, vessel_name, flag, json): the middle of the track; without one, none."""
    at = responses.withColumn("at", midpoint(F.from_json(F.col(json_col), TRACK)["geometry"]["coordinates"]))
    out = at.select("ais_seq", F.get("at", F.lit(1)).alias("lat"), F.get("at", F.lit(0)).alias("lon"), "vessel_id", "vessel_name", "flag", F.lit("").alias("timestamp"))
    return out.where("lat is not null and lon is not null")


def with_tracks(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Positions of events, and of tracks of vessels that have no event."""
    return events.unionByName(tracks.join(events.select("vessel_id").distinct(), "vessel_id", "left_anti"))


RING = "array<array<double>>"


def polygons(spark: SparkSession, *paths: str) -> DataFrame:
    """poly_id, ring_id, pts of the first file there is: Parquet with these columns, or a GeoJSON of (multi)polygons."""
    path = next((p for p in paths if p and exists(spark, p)), None)
    if path is None:
        raise RuntimeError("no file of land polygons")
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("poly_id", "ring_id", "pts")
    text = spark.read.option("wholetext", True).text(path)
    feature = "struct<geometry: struct<type: string, coordinates: string>>"
    one = text.select(F.posexplode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f", "x"))
    flat = one.select("f", F.col("x.geometry.type").alias("type"), F.col("x.geometry.coordinates").alias("c"))
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", f"array<{RING}>"))).when(F.col("type") == "MultiPolygon", F.from_json("c", f"array<array<{RING}>>"))
    rings = flat.select("f", F.posexplode(parts).alias("p", "rings")).select("f", "p", F.posexplode("rings").alias("ring_id", "ring"))
    point = lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y"))
    return rings.select((F.col("f") * 100_000 + F.col("p")).alias("poly_id"), "ring_id", F.transform("ring", point).alias("pts"))


def missing_outputs(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """What has no output yet."""
    return wanted.join(there.select(key), key, "left_anti")


def rank_of(df: DataFrame, *order: Column) -> DataFrame:
    """df with place, from 1; for results of a bounded number of rows."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
