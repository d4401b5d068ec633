"""Predictions against truths: greedy matches per image, sweeps over thresholds, best scores."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import params as P
from tidewatch.functions.boxes import iou_corners
from tidewatch.functions.metrics import f1, fbeta, precision, recall
from tidewatch.operators.storage import saved


BOX = ("x1", "y1", "x2", "y2")


def _shapes(rows: DataFrame, *items: str) -> DataFrame:
    """image_id, cls, x1 to y2, shape (a number within the image and class), items: rows of equal boxes as one."""
    made = rows.groupBy("image_id", "cls", *BOX).agg(F.collect_list(F.struct(*items)).alias("items"))
    return made.withColumn("shape", F.row_number().over(Window.partitionBy("image_id", "cls").orderBy(*BOX)))


def _candidates(preds: DataFrame, truths: DataFrame, iou: float, cell: int = 64) -> DataFrame:
    """image_id, cls, p, t, overlap: shapes of predictions and of truths of one class that overlap enough.

    Boxes are copied to the grid cells that they touch; a pair counts in the cell of its overlap's corner.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    spread = lambda df: df.select("image_id", "cls", "shape", *BOX, cells("x1", "x2").alias("gx")).select("*", cells("y1", "y2").alias("gy"))
    p, t = spread(preds.where("x1 <= x2 and y1 <= y2")).alias("p"), spread(truths.where("x1 <= x2 and y1 <= y2")).alias("t")
    box = lambda s: tuple(F.col(f"{s}.{k}").cast("double") for k in BOX)
    overlap = iou_corners(box("p"), box("t"))
    same = [F.col(f"p.{k}") == F.col(f"t.{k}") for k in ("image_id", "cls", "gx", "gy")]
    once = (F.col("p.gx") == F.floor(F.greatest("p.x1", "t.x1") / cell)) & (F.col("p.gy") == F.floor(F.greatest("p.y1", "t.y1") / cell))
    return p.join(t, [*same, once, overlap >= iou]).select("p.image_id", "p.cls", F.col("p.shape").alias("p"), F.col("t.shape").alias("t"), overlap).toDF("image_id", "cls", "p", "t", "overlap")


def _taken(shapes: Iterable[int], levels: dict[int, list[list[int]]], queues: dict[int, Sequence]) -> list[bool]:
    """Do predictions, by their shapes in their order, get a truth, if each takes its best one that's left?

    levels: truths' shapes for a prediction's shape, best first, equally good ones together; queues: the truths of
    a shape in their order, of which only the first one left can be anyone's best.
    """
    at, level, heaps, used = dict.fromkeys(queues, 0), {}, {}, set()
    out = []
    for s in shapes:
        k, rows, hit = level.get(s, 0), levels.get(s, ()), False
        while k < len(rows) and not hit:
            if s not in heaps:
                heaps[s] = [(queues[t][at[t]], t) for t in rows[k] if at[t] < len(queues[t])]
                heapq.heapify(heaps[s])
            heap = heaps[s]
            while heap and not hit:
                g, t = heap[0]
                queue, i = queues[t], at[t]
                while i < len(queue) and queue[i] in used:
                    i += 1
                at[t] = i
                if i == len(queue):
                    heapq.heappop(heap)
                elif queue[i] != g:  # taken by way of another shape since
                    heapq.heapreplace(heap, (queue[i], t))
                else:
                    used.add(g)
                    at[t], hit = i + 1, True
            if not hit:
                del heaps[s]
                k += 1
        level[s] = k
        out.append(hit)
    return out


def _settled(preds: DataFrame, truths: DataFrame, iou: float, settle: Callable, schema: str) -> DataFrame:
    """settle(key, predictions, levels, queues) of every image and class; predictions: seq, conf, shape in their order."""
    p, t = saved(_shapes(preds, "seq", "conf")), saved(_shapes(truths.withColumn("seq", F.col("seq").cast("long")), "seq"))
    each = lambda field: F.transform("items", lambda x: x[field])
    none = lambda df, k: F.lit(None).cast(dict(df.dtypes)[k])
    ours = p.select("image_id", "cls", "shape", each("seq").alias("seq"), each("conf").alias("conf"), F.lit(None).cast("array<long>").alias("queue"))
    theirs = t.select("image_id", "cls", "shape", none(ours, "seq").alias("seq"), none(ours, "conf").alias("conf"), F.array_sort(each("seq")).alias("queue"))

    def run(key: tuple, rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        own, other = rows[rows["queue"].isna()], rows[rows["queue"].notna()]
        whole = lambda c: np.concatenate(own[c].tolist()) if len(own) else []
        some = pd.DataFrame({"seq": whole("seq"), "conf": whole("conf"), "shape": np.repeat(own["shape"].to_numpy(), [len(x) for x in own["seq"]])})
        levels: dict[int, list[list[int]]] = {}
        last: dict[int, float] = {}
        pairs = pairs.sort_values("overlap", ascending=False, kind="stable")
        for x, y, o in zip(pairs["p"].tolist(), pairs["t"].tolist(), pairs["overlap"].tolist(), strict=True):
            if last.get(x) != o:
                levels.setdefault(x, []).append([])
                last[x] = o
            levels[x][-1].append(y)
        queues = {x: q.tolist() for x, q in zip(other["shape"].tolist(), other["queue"], strict=True)}
        return settle(key, some.sort_values("seq", kind="stable"), levels, queues)

    by = ("image_id", "cls")
    return ours.unionByName(theirs).groupBy(*by).cogroup(_candidates(p, t, iou).groupBy(*by)).applyInPandas(run, schema)


def match(preds: DataFrame, truths: DataFrame, iou: float = P.EVAL_IOU) -> DataFrame:
    """image_id, tp, fp, fn for every image with predictions or truths.

    preds: image_id, seq (order), conf, cls, x1 to y2; truths the same without conf.  iou must be over 0.  As only
    boxes of one class match, images are settled class by class; equal boxes are one in the search for overlaps.
    """

    def settle(key: tuple, some: pd.DataFrame, levels: dict, queues: dict) -> pd.DataFrame:
        some = some[some["shape"].isin(levels.keys())]
        return pd.DataFrame({"image_id": [key[0]], "tp": [sum(_taken(some["shape"].tolist(), levels, queues))]})

    kind = dict(preds.dtypes)["image_id"]
    tp = _settled(preds, truths, iou, settle, f"image_id {kind}, tp long").groupBy("image_id").agg(F.sum("tp").alias("tp"))
    tp = preds.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pred")).join(tp, "image_id", "left")
    n = truths.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_true"))
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    out = tp.join(n, "image_id", "full")
    return out.select("image_id", zero("tp").alias("tp"), F.greatest(zero("n_pred") - zero("tp"), F.lit(0)).alias("fp"), F.greatest(zero("n_true") - zero("tp"), F.lit(0)).alias("fn"))


def by_threshold(preds: DataFrame, steps: int = P.EVAL_STEPS) -> DataFrame:
    """k, n: predictions of at least each of evenly spaced confidences from 0 to 1, where there are any; a histogram and its suffix sums."""
    guess = F.floor(F.col("conf") * (steps - 1) + 1e-9).cast("int")
    top = F.when(F.col("conf") >= guess / (steps - 1), guess).otherwise(guess - 1)
    counts = preds.where("conf >= 0").groupBy(F.least(top, F.lit(steps - 1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    steps_ = preds.sparkSession.range(steps).select(F.col("id").cast("int").alias("k"))
    after = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a step
    return steps_.join(counts, "k", "left").select("k", F.coalesce(F.sum("n").over(after), F.lit(0)).alias("n")).where("n > 0")


def sweep(preds: DataFrame, truths: DataFrame, iou: float = P.EVAL_IOU, steps: int = P.EVAL_STEPS) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall at evenly spaced confidences from 0 to 1.

    One pass over each image and class settles all thresholds; a step without another prediction keeps the last result.
    """
    spark = preds.sparkSession

    def settle(key: tuple, some: pd.DataFrame, levels: dict, queues: dict) -> pd.DataFrame:
        some = some[some["shape"].isin(levels.keys())]
        conf, shapes = some["conf"].to_numpy(float), some["shape"].to_numpy()
        out, last, hits = [], -1, 0
        for k in range(steps):
            stay = conf >= k / (steps - 1)
            n = int(stay.sum())
            if not n:
                break
            if n != last:
                last, hits = n, sum(_taken(shapes[stay].tolist(), levels, queues))
            out.append((k, hits))
        return pd.DataFrame(out, columns=["k", "tp"])

    hits = _settled(preds.where("conf is not null"), truths, iou, settle, "k int, tp long").groupBy("k").agg(F.sum("tp").alias("tp"))
    n = truths.agg(F.count(F.lit(1)).alias("n_true"))
    out = spark.range(steps).select(F.col("id").cast("int").alias("k")).join(by_threshold(preds, steps), "k", "left").join(hits, "k", "left").crossJoin(F.broadcast(n))  # one row
    tp, made = F.coalesce("tp", F.lit(0)), F.coalesce("n", F.lit(0))
    out = out.select((F.col("k") / (steps - 1)).alias("threshold"), tp.cast("long").alias("tp"), (made - tp).cast("long").alias("fp"), (F.col("n_true") - tp).cast("long").alias("fn"))
    return out.withColumns({"precision": precision(F.col("tp"), F.col("fp")), "recall": recall(F.col("tp"), F.col("fn"))})


def best(swept: DataFrame) -> DataFrame:
    """The threshold with the highest F1, the first of several."""
    score = f1(F.col("precision"), F.col("recall"))
    top = swept.withColumn("f1", F.round(score, 9)).agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", -F.col("threshold"))).alias("b"))
    return top.select("b.*")


def with_fbeta(swept: DataFrame, beta: float = P.BETA) -> DataFrame:
    return swept.withColumn("fbeta", fbeta(F.col("precision"), F.col("recall"), beta))


def average_precision(preds: DataFrame, truths: DataFrame, iou: float = P.EVAL_IOU) -> DataFrame:
    """cls, ap: area under the precision envelope, predictions of a class by confidence (ties by image and order)."""

    def settle(key: tuple, some: pd.DataFrame, levels: dict, queues: dict) -> pd.DataFrame:
        some = some.sort_values(["conf", "seq"], ascending=[False, True], kind="stable")
        return some[["conf", "seq"]].assign(image_id=key[0], cls=key[1], hit=_taken(some["shape"].tolist(), levels, queues))

    kinds = dict(preds.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in ("cls", "conf", "image_id", "seq")) + ", hit boolean"
    scored = _settled(preds, truths, iou, settle, schema).withColumn("hit", F.col("hit").cast("int"))
    by = Window.partitionBy("cls").orderBy(F.desc("conf"), "image_id", "seq")
    curve = scored.select("cls", "hit", F.sum("hit").over(by).alias("tp"), F.row_number().over(by).alias("n"))
    curve = curve.withColumn("p", F.col("tp") / F.col("n"))
    envelope = F.max("p").over(Window.partitionBy("cls").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = truths.groupBy("cls").agg(F.count(F.lit(1)).alias("n_true"))
    return curve.withColumn("e", envelope).groupBy("cls").agg(F.sum(F.col("e") * F.col("hit")).alias("s")).join(total, "cls").select("cls", (F.col("s") / F.col("n_true")).alias("ap"))
