"""Connected components and greedy choices on link tables, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.storage import saved


def connected(links: DataFrame) -> DataFrame:
    """node, label (the least of its component) for links a, b; nodes without links don't appear."""
    both = saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("near"))
        step = saved(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        after = saved(step.join(up, "label").select("node", F.least("label", "top").alias("label"), "was"))
        if not after.where("label <> was").limit(1).count():
            return after.select("node", "label")
        labels = after.select("node", "label")


def greedy(ranked: DataFrame, conflicts: DataFrame) -> DataFrame:
    """ids kept when rows are taken by rank (lowest first) unless one in conflict was: ranked id, rank; conflicts a, b.

    In each round a row is settled as kept if no open row of better rank is in conflict with it; those
    in conflict with it are settled as dropped.  That is the greedy choice, in parallel.
    """
    a, b = ranked.select(F.col("id").alias("a"), F.col("rank").alias("ra")), ranked.select(F.col("id").alias("b"), F.col("rank").alias("rb"))
    pairs = conflicts.select("a", "b").union(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    beats = saved(pairs.join(a, "a").join(b, "b").where("ra < rb").select("a", "b"))  # a goes first
    dropped = None
    open_ = beats
    while True:
        waiting = open_.select(F.col("b").alias("a")).distinct()
        kept = open_.select("a").distinct().join(waiting, "a", "left_anti")
        fall = saved(open_.join(kept, "a").select("b").distinct())
        if not fall.limit(1).count():
            break
        dropped = fall if dropped is None else dropped.union(fall)
        open_ = saved(open_.join(fall, "b", "left_anti").join(fall.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"))
    ids = ranked.select("id")
    return ids if dropped is None else ids.join(dropped.select(F.col("b").alias("id")), "id", "left_anti")
