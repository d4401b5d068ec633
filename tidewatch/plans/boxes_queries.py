"""Queries on boxes: overlap, suppression, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import evaluation, nms
from tidewatch.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return add


_W = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
_H = "greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
INTER = f"({_W} * {_H})"
IOU = f"case when {INTER} <= 0 then 0::double else {INTER} / (({{a}}.x2 - {{a}}.x1) * ({{a}}.y2 - {{a}}.y1) + ({{b}}.x2 - {{b}}.x1) * ({{b}}.y2 - {{b}}.y1) - {INTER}) end"


def iou_sql(a: str, b: str) -> str:
    return IOU.format(a=a, b=b)


@query(f"{X.with_(box=X.BOXES)} select a.id as a, b.id as b, {iou_sql('a', 'b')} as iou from box a join box b on a.image_id = b.image_id and a.id < b.id and {INTER.format(a='a', b='b')} > 0")
def iou_pairs(spark, d):
    """Overlapping boxes of an image, by both forms of the overlap."""
    return nms.overlaps(X.view(spark, d, X.BOXES), "image_id")


def _nms_sql(order: str, limit: float) -> str:
    return f"""{X.with_(box=X.BOXES).replace("with ", "with recursive ", 1)}, r as (select *, row_number() over (partition by image_id order by {order}, id) as k from box),
conf_pairs as (select b.id as later, list(a.id) as earlier from r a join r b on a.image_id = b.image_id and a.k < b.k where {iou_sql('a', 'b')} > {limit} group by b.id),
q as (select r.id, r.image_id, r.k, coalesce(earlier, []) as earlier from r left join conf_pairs on later = r.id),
st as (select image_id, 0::bigint as k, []::bigint[] as kept from (select distinct image_id from box) union all select s.image_id, q.k, case when len(list_intersect(q.earlier, s.kept)) > 0 then s.kept else list_append(s.kept, q.id) end from st s join q on q.image_id = s.image_id and q.k = s.k + 1),
last as (select image_id, arg_max(kept, k) as kept from st group by image_id)
select unnest(kept) as id, image_id from last"""


@query(_nms_sql("area_px desc", 0.3))
def nms_area(spark, d):
    return nms.by_area(X.view(spark, d, X.BOXES), group="image_id").select("id", "image_id")


@query(f"with k as ({_nms_sql('conf desc', 0.45)}), box as ({X.BOXES}) select k.id, k.image_id, (row_number() over (partition by k.image_id order by conf desc, k.id) - 1)::int as place from k join box using (id)")
def nms_conf(spark, d):
    return nms.by_confidence(X.view(spark, d, X.BOXES), group="image_id").select("id", "image_id", "place")


def _match_sql(thresholds: str) -> str:
    """st: per threshold and image the number of matches."""
    return f"""{X.with_(box=X.BOXES, truth=X.TRUTHS).replace("with ", "with recursive ", 1)},
cand as (select p.id, list(t.seq order by {iou_sql('p', 't')} desc, t.seq) as c from box p join truth t on p.image_id = t.image_id and p.cls = t.cls where {iou_sql('p', 't')} >= 0.5 group by p.id),
thr as ({thresholds}),
pr as (select thr.k as step, p.image_id, p.id, coalesce(c, []) as c, row_number() over (partition by thr.k, p.image_id order by p.id) as n from box p left join cand using (id) join thr on p.conf >= thr.t),
st as (select distinct step, image_id, 0::bigint as n, []::bigint[] as used from pr
  union all select s.step, s.image_id, pr.n, case when len(list_filter(pr.c, lambda g: not list_contains(s.used, g))) > 0 then list_append(s.used, list_filter(pr.c, lambda g: not list_contains(s.used, g))[1]) else s.used end from st s join pr on pr.step = s.step and pr.image_id = s.image_id and pr.n = s.n + 1),
fin as (select step, image_id, max(n) as n_pred, len(arg_max(used, n)) as tp from st group by step, image_id)"""


def _boxes(spark, d):
    return X.view(spark, d, X.BOXES).withColumn("seq", F.col("id")), X.view(spark, d, X.TRUTHS)


@query(f"""{_match_sql("select 0 as k, -1::double as t")}, n as (select image_id, count(*) as n_true from truth group by image_id)
select coalesce(fin.image_id, n.image_id) as image_id, coalesce(tp, 0)::bigint as tp, coalesce(n_pred - tp, 0)::bigint as fp, (coalesce(n_true, 0) - coalesce(tp, 0))::bigint as fn from fin full join n on fin.image_id = n.image_id""")
def eval_match(spark, d):
    return evaluation.match(*_boxes(spark, d))


SWEEP = f"""{_match_sql("select k, k / 49.0::double as t from (select unnest(range(50)) as k)")}, per as (select step, sum(tp) as tp, sum(n_pred) as n_pred from fin group by step),
sw as (select thr.t as threshold, coalesce(tp, 0)::bigint as tp, (coalesce(n_pred, 0) - coalesce(tp, 0))::bigint as fp, ((select count(*) from truth) - coalesce(tp, 0))::bigint as fn from thr left join per on per.step = thr.k),
pc as (select *, tp / (tp + fp + 1e-9) as precision, tp / (tp + fn + 1e-9) as recall from sw)"""


@query(f"{SWEEP} select threshold, tp, fp, fn, round(precision, 9) as precision, round(recall, 9) as recall from pc")
def threshold_sweep(spark, d):
    return evaluation.sweep(*_boxes(spark, d)).withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


@query(f"{SWEEP}, f as (select *, round(2 * precision * recall / (precision + recall + 1e-9), 9) as f1 from pc) select threshold, f1, round(precision, 9) as precision, round(recall, 9) as recall from f order by f1 desc, threshold limit 1")
def best_f1(spark, d):
    return evaluation.best(evaluation.sweep(*_boxes(spark, d))).withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


@query(f"{SWEEP} select threshold, round(1.25 * precision * recall / (0.25 * precision + recall + 1e-9), 9) as fbeta from pc")
def fbeta(spark, d):
    return evaluation.with_fbeta(evaluation.sweep(*_boxes(spark, d))).select("threshold", F.round("fbeta", 9).alias("fbeta"))


@query(f"{X.with_(box=X.BOXES)} select id, conf from box where conf >= 0.25")
def conf_filter(spark, d):
    return X.view(spark, d, X.BOXES).where(F.col("conf") >= 0.25).select("id", "conf")


@query(f"{X.with_(box=X.BOXES)} select k / 49.0::double as threshold, count(*) as n from box, (select unnest(range(50)) as k) where conf >= k / 49.0::double group by k")
def predictions_by_threshold(spark, d):
    return evaluation.by_threshold(_boxes(spark, d)[0]).select((F.col("k") / 49).alias("threshold"), "n")


@query(f"""{X.with_(box=X.BOXES, truth=X.TRUTHS).replace("with ", "with recursive ", 1)},
cand as (select p.id, list(t.seq order by {iou_sql('p', 't')} desc, t.seq) as c from box p join truth t on p.image_id = t.image_id and p.cls = t.cls where {iou_sql('p', 't')} >= 0.5 group by p.id),
pr as (select p.image_id, p.id, p.cls, p.conf, coalesce(c, []) as c, row_number() over (partition by p.image_id order by p.conf desc, p.id) as n from box p left join cand using (id)),
st as (select distinct image_id, 0::bigint as n, []::bigint[] as used, []::bigint[] as hits from pr
  union all select s.image_id, pr.n, case when len(list_filter(pr.c, lambda g: not list_contains(s.used, g))) > 0 then list_append(s.used, list_filter(pr.c, lambda g: not list_contains(s.used, g))[1]) else s.used end,
    case when len(list_filter(pr.c, lambda g: not list_contains(s.used, g))) > 0 then list_append(s.hits, pr.id) else s.hits end from st s join pr on pr.image_id = s.image_id and pr.n = s.n + 1),
fin as (select image_id, arg_max(hits, n) as hits from st group by image_id),
sc as (select cls, conf, image_id, id, list_contains(hits, id)::int as hit from pr join fin using (image_id)),
cu as (select *, sum(hit) over w as tp, row_number() over w as n from sc window w as (partition by cls order by conf desc, image_id, id)),
en as (select *, max(tp / n) over (partition by cls order by n rows between current row and unbounded following) as e from cu)
select cls, round(sum(e * hit) / (select count(*) from truth t where t.cls = en.cls), 9) as ap from en group by cls""")
def average_precision(spark, d):
    return evaluation.average_precision(*_boxes(spark, d)).withColumn("ap", F.round("ap", 9))
