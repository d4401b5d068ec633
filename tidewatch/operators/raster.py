"""Clipping, decimation, stretching, tiles and crops of pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions.geo import lonlat_to_pixel, pixel_to_lonlat

AFFINE = ("a", "b", "c", "d", "e", "f")


def clip(px: DataFrame, meta: DataFrame, bbox: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Pixels and meta (scene, width, height and the affine a to f) within a box of degrees; scenes outside it go.

    The window is that of the box's corners, outwards; the new transform maps the box itself onto it.
    """
    t = {k: F.col(k) for k in AFFINE}
    corner = lambda x, y: pixel_to_lonlat(F.lit(y) - 0.5, F.lit(x) - 0.5, t)
    m = meta
    x0, y0 = corner(0.0, 0.0)
    x1 = t["c"] + t["a"] * F.col("width") + t["b"] * F.col("height")
    y1 = t["f"] + t["d"] * F.col("width") + t["e"] * F.col("height")
    w, s, e, n = map(F.lit, bbox)
    m = m.withColumns({"w": F.greatest(w, F.least(x0, x1)), "e_": F.least(e, F.greatest(x0, x1)), "s": F.greatest(s, F.least(y0, y1)), "n": F.least(n, F.greatest(y0, y1))}).where("w < e_ and s < n")
    ca, ra = lonlat_to_pixel(F.col("w"), F.col("n"), t)
    cb, rb = lonlat_to_pixel(F.col("e_"), F.col("s"), t)
    # 1e-9 of a pixel of slack, so that edges on the grid stay there
    down = lambda p, q: F.floor(F.least(p, q) + 1e-9)
    up = lambda p, q: F.ceil(F.greatest(p, q) - 1e-9)
    m = m.withColumns({"c0": F.greatest(down(ca, cb), F.lit(0)).cast("int"), "c1": F.least(up(ca, cb), F.col("width")).cast("int"), "r0": F.greatest(down(ra, rb), F.lit(0)).cast("int"), "r1": F.least(up(ra, rb), F.col("height")).cast("int")})
    window = m.select("scene", "c0", "c1", "r0", "r1")
    out = px.join(window, "scene").where("row >= r0 and row < r1 and col >= c0 and col < c1")
    out = out.withColumns({"row": F.col("row") - F.col("r0"), "col": F.col("col") - F.col("c0")}).drop("c0", "c1", "r0", "r1")
    width, height = F.col("c1") - F.col("c0"), F.col("r1") - F.col("r0")
    zero = F.lit(0.0)
    meta2 = m.select("scene", width.alias("width"), height.alias("height"), ((F.col("e_") - F.col("w")) / width).alias("a"), zero.alias("b"), F.col("w").alias("c"), zero.alias("d"), (-(F.col("n") - F.col("s")) / height).alias("e"), F.col("n").alias("f"))
    return out, meta2


def reproject(px: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Bilinear resampling from one affine grid to another in the same coordinates: scene, band, row, col, v.

    Each target pixel's centre is weighed from the four source pixels around it; those with a missing
    neighbour, or outside, are left out.
    """
    s, t = {k: F.col(f"s.{k}") for k in AFFINE}, {k: F.col(f"t.{k}") for k in AFFINE}
    grid = target.alias("t").join(source.alias("s"), F.col("s.scene") == F.col("t.scene"))
    grid = grid.withColumn("row", F.explode(F.expr("sequence(0, t.height - 1)"))).withColumn("col", F.explode(F.expr("sequence(0, t.width - 1)")))
    lon, lat = pixel_to_lonlat(F.col("row"), F.col("col"), t)
    x, y = lonlat_to_pixel(lon, lat, s)
    grid = grid.select(F.col("t.scene").alias("scene"), "row", "col", (x - 0.5).alias("x"), (y - 0.5).alias("y"))
    around = F.explode(F.expr("array(struct(0 as dx, 0 as dy), struct(1 as dx, 0 as dy), struct(0 as dx, 1 as dy), struct(1 as dx, 1 as dy))"))
    grid = grid.withColumn("o", around).withColumns({"sc": (F.floor("x") + F.col("o.dx")).cast("int"), "sr": (F.floor("y") + F.col("o.dy")).cast("int")})
    weight = (1 - F.abs(F.col("x") - F.col("sc"))) * (1 - F.abs(F.col("y") - F.col("sr")))
    grid = grid.withColumn("weight", weight).where("weight > 0").select("scene", "row", "col", "sr", "sc", "weight")
    from_ = px.select("scene", "band", F.col("row").alias("sr"), F.col("col").alias("sc"), "v")
    out = grid.join(from_, ["scene", "sr", "sc"]).groupBy("scene", "band", "row", "col").agg(F.sum(F.col("v") * F.col("weight")).alias("v"), F.sum("weight").alias("w"))
    return out.where("w > 0.999999").drop("w")


def decimate(px: DataFrame, k: int = 4, value: str = "v") -> DataFrame:
    """Means of k x k blocks."""
    return px.groupBy("scene", "band", F.expr(f"row div {k}").cast("int").alias("row"), F.expr(f"col div {k}").cast("int").alias("col")).agg(F.avg(value).alias("v"))


def percentiles(df: DataFrame, keys: list[str], value: Column, shares: dict[str, float], buckets: int = 4096) -> DataFrame:
    """keys and a column for each share: exact percentiles of a double by group, interpolated between neighbours.

    Values are counted in equal buckets between a group's extremes; only those of the buckets that hold a wanted
    rank are counted one by one.  So no task holds a group's values.
    """
    x = df.select(*keys, value.alias("x")).where("x is not null")
    ends = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    at = F.floor((F.col("x") / 2 - F.col("least") / 2) / (F.col("most") / 2 - F.col("least") / 2) * buckets).cast("int")
    placed = x.join(ends, keys).withColumn("place", F.when(F.col("most") > F.col("least"), F.least(at, F.lit(buckets - 1))).otherwise(0))
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = placed.groupBy(*keys, "place").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    counts = counts.withColumn("before", F.sum("c").over(upto) - F.col("c"))
    pos = {k: F.lit(q) * (F.col("n") - 1) for k, q in shares.items()}
    ranks = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(i).alias("side"), end(p).cast("long").alias("rank")) for k, p in pos.items() for i, end in ((0, F.floor), (1, F.ceil))])
    wanted = counts.withColumn("r", F.explode(ranks)).where((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("before") + F.col("c"))).select(*keys, "place", "before", "r.name", "r.side", "r.rank")
    each = placed.join(wanted, [*keys, "place"]).groupBy(*keys, "name", "side", "rank", "before", "x").agg(F.count(F.lit(1)).alias("c"))
    within = Window.partitionBy(*keys, "name", "side").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.col("before") + F.sum("c").over(within)).where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("c")))
    pick = lambda k, i: F.max(F.when((F.col("name") == k) & (F.col("side") == i), F.col("x")))
    found = each.groupBy(*keys).agg(*[pick(k, i).alias(f"{k}{i}") for k in shares for i in (0, 1)]).join(ends.select(*keys, "n"), keys)
    mid = lambda k: F.when(F.col(f"{k}0") == F.col(f"{k}1"), F.col(f"{k}0")).otherwise((F.ceil(pos[k]) - pos[k]) * F.col(f"{k}0") + (pos[k] - F.floor(pos[k])) * F.col(f"{k}1"))
    return found.select(*keys, *[mid(k).alias(k) for k in shares])


def stretch(px: DataFrame, *keys: str, value: str = "v", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """px with byte: values between two percentiles of their group as 0 to 255, cut to whole numbers; constant or missing as 0."""
    x = F.col(value).cast("double")
    sane = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    q = percentiles(px, list(keys), sane, {"__lo": low, "__hi": high})
    lo, hi = F.col("__lo"), F.col("__hi")
    scaled = (F.least(F.greatest(x, lo), hi) - lo) / (hi - lo) * 255
    out = F.when((hi > lo) & x.isNotNull() & ~F.isnan(x), F.floor(scaled)).otherwise(0).cast("smallint")
    return px.join(q, list(keys), "left").withColumn("byte", out).drop("__lo", "__hi")


def compose(px: DataFrame, value: str = "byte") -> DataFrame:
    """scene, row, col and [vv, vh, vv]; a missing second band is replaced by the first."""
    wide = px.groupBy("scene", "row", "col").agg(F.max(F.when(F.col("band") == "vv", F.col(value))).alias("vv"), F.max(F.when(F.col("band") == "vh", F.col(value))).alias("vh"))
    return wide.select("scene", "row", "col", F.array("vv", F.coalesce("vh", "vv"), "vv").alias("rgb"))


def tile_grid(meta: DataFrame, tile: int = P.TILE, overlap: int = P.OVERLAP, least: int = P.TILE_MIN) -> DataFrame:
    """scene, row0, col0, h, w of overlapping tiles, ends cut at the scene's; slivers go."""
    step = tile - overlap
    out = meta.select("scene", "height", "width", F.explode(F.expr(f"sequence(0, height - 1, {step})")).alias("row0"))
    out = out.select("*", F.explode(F.expr(f"sequence(0, width - 1, {step})")).alias("col0"))
    out = out.select("scene", "row0", "col0", F.least(F.lit(tile), F.col("height") - F.col("row0")).alias("h"), F.least(F.lit(tile), F.col("width") - F.col("col0")).alias("w"))
    return out.where((F.col("h") >= least) & (F.col("w") >= least))


def tile_pixels(px: DataFrame, meta: DataFrame, tile: int = P.TILE, overlap: int = P.OVERLAP) -> DataFrame:
    """px with row0, col0 of each tile (four at most) that holds the pixel; no join with pixels by range."""
    step = tile - overlap
    for axis in ("row", "col"):
        first = F.greatest(F.lit(0), F.ceil((F.col(axis) - (tile - 1)) / step)).cast("int")
        last = F.floor(F.col(axis) / step).cast("int")
        px = px.withColumn(f"{axis}0", F.explode(F.transform(F.sequence(first, last), lambda k: k * step)))
    return px.join(tile_grid(meta, tile, overlap), ["scene", "row0", "col0"])


def stitch(boxes: DataFrame, meta: DataFrame) -> DataFrame:
    """Boxes of tiles (x1 to y2 in the tile, row0, col0) in the scene's pixels, with the centre's lon and lat."""
    out = boxes.withColumns({k: F.col(k) + F.col("col0" if k[0] == "x" else "row0") for k in ("x1", "y1", "x2", "y2")})
    t = {k: F.col(f"m.{k}") for k in AFFINE}
    lon, lat = pixel_to_lonlat((F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2, t)
    joined = out.alias("o").join(meta.select("scene", *AFFINE).alias("m"), F.col("o.scene") == F.col("m.scene"))
    return joined.select(*[F.col(f"o.{c}") for c in out.columns if c not in ("row0", "col0")], lon.alias("lon"), lat.alias("lat"))


def crops(boxes: DataFrame, px: DataFrame, side: int = P.CROP, most: int = P.CROPS) -> DataFrame:
    """det_id and the pixels around the centre (cx, cy, else the box's) of the first boxes by det_id."""
    centre = lambda c, p, q: F.coalesce(F.col(c), (F.col(p) + F.col(q)) / 2).cast("int")
    some = boxes.orderBy("det_id").limit(most)
    some = some.select("det_id", "scene", centre("cx", "x1", "x2").alias("x"), centre("cy", "y1", "y2").alias("y"))
    half = side // 2
    near = (F.col("row") >= F.col("y") - half) & (F.col("row") < F.col("y") + half) & (F.col("col") >= F.col("x") - half) & (F.col("col") < F.col("x") + half)
    # at most `most` rows, so the small side is broadcast
    return px.join(F.broadcast(some), "scene").where(near).drop("x", "y")


def gcp_affine(points: DataFrame) -> DataFrame:
    """a to f by least squares from ground control points (scene, row, col, lon, lat)."""
    s = lambda x: F.sum(x)
    r, c, lon, lat = (F.col(k).cast("double") for k in ("row", "col", "lon", "lat"))
    m = points.groupBy("scene").agg(F.count(F.lit(1)).cast("double").alias("n"), s(c).alias("sc"), s(r).alias("sr"), s(c * c).alias("scc"), s(c * r).alias("scr"), s(r * r).alias("srr"), *[x for k, v in (("x", lon), ("y", lat)) for x in (s(v).alias(f"s{k}"), s(c * v).alias(f"sc{k}"), s(r * v).alias(f"sr{k}"))])
    g = F.col
    mean = lambda k: g(k) / g("n")
    vcc, vrr, vcr = g("scc") - g("sc") * mean("sc"), g("srr") - g("sr") * mean("sr"), g("scr") - g("sc") * mean("sr")
    det = vcc * vrr - vcr * vcr
    out: dict[str, Column] = {}
    for k, (pc, pr, p0) in (("x", ("a", "b", "c")), ("y", ("d", "e", "f"))):
        cy, ry = g(f"sc{k}") - g("sc") * mean(f"s{k}"), g(f"sr{k}") - g("sr") * mean(f"s{k}")
        out[pc], out[pr] = F.try_divide(cy * vrr - ry * vcr, det), F.try_divide(ry * vcc - cy * vcr, det)
        out[p0] = mean(f"s{k}") - out[pc] * mean("sc") - out[pr] * mean("sr")
    return m.select("scene", *[v.alias(k) for k, v in out.items()])
