"""Labels of chips: an equi-join on scene and blocks of pixels, then the exact range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions.classify import label_box, label_class


def labels_on_chips(chips: DataFrame, labels: DataFrame, chip: int = P.CHIP) -> DataFrame:
    """Every chip (scene_id, row_min, col_min) with each label whose pixel it holds; chips without any once, with nulls.

    A chip touches at most four blocks of its own size, so it is copied to those; each label is in one.
    """
    lo = lambda c: F.floor(F.col(c) / chip)
    hi = lambda c: F.floor((F.col(c) + (chip - 1)) / chip)
    spread = chips.withColumn("br", F.explode(F.sequence(lo("row_min"), hi("row_min")))).withColumn("bc", F.explode(F.sequence(lo("col_min"), hi("col_min"))))
    placed = labels.withColumns({"br": F.floor(F.col("scene_row") / chip), "bc": F.floor(F.col("scene_col") / chip)})
    inside = (F.col("scene_row") >= F.col("row_min")) & (F.col("scene_row") < F.col("row_min") + chip) & (F.col("scene_col") >= F.col("col_min")) & (F.col("scene_col") < F.col("col_min") + chip)
    hit = spread.join(placed, ["scene_id", "br", "bc"]).where(inside).drop("br", "bc")
    return chips.join(hit, [c for c in chips.columns], "left")


def label_lines(matched: DataFrame, chip: int = P.CHIP) -> DataFrame:
    """One row per chip: its label file's lines (class, centre, size; 6 decimals), in order, and their number."""
    cx, cy, w, h = label_box(F.col("scene_row"), F.col("scene_col"), F.col("length_m"), F.col("row_min"), F.col("col_min"), chip)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", label_class(F.col("is_vessel"), F.col("is_fishing")), cx, cy, w, h)
    line = F.when(F.col("scene_row").isNotNull(), line)
    return matched.groupBy("scene_id", "row_min", "col_min").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"), F.count(line).alias("n_labels"))


def prep_summary(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count(F.lit(1)).alias("chips"), F.sum("n_labels").alias("labels"), F.count_if(F.col("n_labels") == 0).alias("empty_chips"))
