"""Non-maximum suppression: boxes in order, without those that overlap a kept one too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions.boxes import iou_corners, iou_sizes
from tidewatch.operators.graph import greedy
from tidewatch.operators.pairing import chunks
from tidewatch.operators.storage import saved


def overlapping(boxes: DataFrame, threshold: float, cell: int = 64, group: str = "scene") -> DataFrame:
    """a, b (a < b) for boxes (id, group, x1 to y2) of one group with IoU above a threshold.

    Boxes are copied to the grid cells that they touch; a pair counts in the cell of its overlap's corner.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    spread = boxes.select("id", group, "x1", "y1", "x2", "y2", F.explode(cells("x1", "x2")).alias("gx")).select("*", F.explode(cells("y1", "y2")).alias("gy"))
    a, b = spread.alias("a"), spread.alias("b")
    same = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.id") < F.col("b.id"))
    once = (F.col("a.gx") == F.floor(F.greatest("a.x1", "b.x1") / cell)) & (F.col("a.gy") == F.floor(F.greatest("a.y1", "b.y1") / cell))
    box = lambda s: tuple(F.col(f"{s}.{k}").cast("double") for k in ("x1", "y1", "x2", "y2"))
    return a.join(b, same & once).where(iou_corners(box("a"), box("b")) > threshold).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def overlaps(boxes: DataFrame, group: str = "scene") -> DataFrame:
    """a, b (a < b), iou for all overlapping boxes (id, group, x1 to y2) of one group: equal boxes are compared once."""
    corners = ("x1", "y1", "x2", "y2")
    proper = (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2"))  # others overlap nothing
    shapes = saved(boxes.where(proper).groupBy(group, *corners).agg(F.min("id").alias("id"), F.collect_list("id").alias("ids")))
    box = F.struct(*[F.col(k).cast("double").alias(k) for k in corners])
    side = lambda k: chunks(shapes.select(F.col("id").alias(k), box.alias(f"{k}_box"), F.col("ids").alias(f"{k}_ids")), f"{k}_ids")
    linked = overlapping(shapes, 0.0, group=group).union(shapes.where(F.size("ids") > 1).select("id", "id")).toDF("a", "b")
    pairs = linked.join(side("a"), "a").join(side("b"), "b").repartition(256)
    of = lambda k: tuple(F.col(f"{k}_box.{c}") for c in corners)
    pairs = pairs.select((F.col("a") == F.col("b")).alias("same"), "a_ids", "b_ids", iou_corners(of("a"), of("b")).alias("iou"), (iou_sizes(_size(of("a")), _size(of("b"))) > 0).alias("sized"))
    each = pairs.where("sized and iou > 0").select("same", "b_ids", "iou", F.explode("a_ids").alias("i")).select("same", "iou", "i", F.explode("b_ids").alias("j"))
    return each.where("not same or i < j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "iou")


def _size(box: tuple[Column, ...]) -> tuple[Column, ...]:
    return box[0], box[1], box[2] - box[0], box[3] - box[1]


def suppress(boxes: DataFrame, order: list[Column], threshold: float, group: str = "scene") -> DataFrame:
    """The boxes (id, group, x1 to y2, ...) that stay when each group's are taken in order.

    Equal boxes of some area conflict with each other and with the same others, so only the first of them can stay, and
    takes part alone; boxes without area conflict with none.  (With a threshold outside 0 to 1, each takes part.)
    """
    if not 0 <= threshold < 1:
        ranked = boxes.select("id", F.struct(*order, "id").alias("rank"))
        return boxes.join(greedy(ranked, saved(overlapping(boxes, threshold, group=group))), "id", "left_semi")
    proper = F.coalesce(F.col("x1") < F.col("x2"), F.lit(False)) & F.coalesce(F.col("y1") < F.col("y2"), F.lit(False)) & F.col(group).isNotNull()
    firsts = saved(boxes.where(proper).groupBy(group, "x1", "y1", "x2", "y2").agg(F.min(F.struct(*order, "id")).alias("rank")).withColumn("id", F.col("rank.id")))
    stay = greedy(firsts.select("id", "rank"), saved(overlapping(firsts, threshold, group=group)))
    return boxes.join(stay.union(boxes.where(~proper).select("id")), "id", "left_semi")


def by_area(boxes: DataFrame, threshold: float = P.NMS_IOU_AREA, group: str = "scene") -> DataFrame:
    """Largest first; ties in the order of ids."""
    return suppress(boxes, [-F.col("area_px")], threshold, group)


def by_confidence(boxes: DataFrame, threshold: float = P.NMS_IOU_CONF, group: str = "scene") -> DataFrame:
    """Most confident first, whatever the class; ties in the order of ids.  Adds place, from 0 in each group."""
    out = suppress(boxes, [-F.col("conf")], threshold, group)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("conf"), "id")) - 1)
