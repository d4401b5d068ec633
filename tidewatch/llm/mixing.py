"""Mixing sources to target weights by nested hash thresholds, without sorting documents.

Every document has a 60-bit hash of its id.  Words are summed by source and by the hash's top 12
bits; the bucket in which a source's budget runs out is refined by the next 12 bits, and only that
one, five times.  What lies below the threshold is taken: thresholds are nested, so a larger budget
takes all that a smaller one takes.  A budget over the source's size takes all documents once (or
twice, or three times) and the hash decides on the rest.

Defined cases: null texts have size 0; documents without a source are a source of their own, last in
the order of sources; documents with the same id share a hash and are taken together; an empty table
gives no rows; very long texts are counted whole; extra columns are ignored, whatever their names.  The last bucket is one hash: it is taken if that brings
the source nearer to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import saved, table, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
BITS, LEVELS = 12, 5

#: Sources up to which their table (a few numbers each) is broadcast; beyond, it is joined by shuffles.
BROADCAST_SOURCES = 100_000


def hash60(c: Column) -> Column:
    """The first 15 hex digits of an id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> and target: shares of all words by weight, at most `most` times a source's size.

    The excess of a capped source goes to the others by weight.  That has a closed form: in the
    order of size by weight a first few are capped, and the rest share what is left.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % n + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most).cast("long"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    levelled = ranked.withColumn("level", level)
    free = F.col("level") * F.col("weight") <= F.col("cap")
    levelled = levelled.withColumn("level", F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.coalesce("source", F.lit("")), "level"))).over(every)["level"])
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return levelled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), times (how often the document is taken).

    carry names columns of docs to keep, as one struct column `row`.  Only ids, sources, sizes and hashes are
    written on the way; with carry, rows are read again and filtered by their thresholds.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), hash60(F.col("doc_id")).alias("h"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []))
    sized = saved(rows.drop("row"))
    by_bucket = saved(sized.groupBy("source", F.shiftright("h", BITS * (LEVELS - 1)).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    sources = saved(targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most))
    few = sources.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda x: x)

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = sources.select(F.col("source").alias("s"), (F.col("target") - whole * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"))
    cumulative = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        if level:
            inside = sized.join(hint(state), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
            by_bucket = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = by_bucket.withColumn("upto", F.sum("words").over(cumulative))
        # The boundary is the first bucket that goes beyond the budget; past the last one, nothing is left to refine.
        edge = running.join(hint(state.select("s", "left")), F.col("source").eqNullSafe(F.col("s"))).where(F.col("upto") > F.col("left"))
        edge = edge.groupBy("source").agg(F.min(F.struct("bucket", "upto", "words", "left")).alias("e"))
        found = edge.select(F.col("source").alias("s"), (F.col("e.left") - (F.col("e.upto") - F.col("e.words"))).alias("left"), F.col("e.bucket").alias("prefix"), F.col("e.words").alias("words"))
        state = saved(found) if level < LEVELS - 1 else found
    edge = state.select(F.col("s"), F.when(2 * F.col("left") >= F.col("words"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))
    plan = saved(sources.join(hint(edge), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "below", whole.alias("whole"), (F.col("target") > whole * F.col("source_size")).alias("more")))
    times = F.col("whole") + F.when(F.col("more") & (F.col("below").isNull() | (F.col("h") < F.col("below"))), 1).otherwise(0)
    out = (rows if carry else sized).join(hint(plan), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.cast("int").alias("times"), *(["row"] if carry else []))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h
  from documents),
src as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
         source_size * 3 as cap
  from src),
levelled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level,
         row_number() over (order by cap / weight, source nulls last) as k
  from ranked),
lam as (select arg_min(level, k) as level from levelled where level * weight <= cap),
tgt as (
  select l.source, l.source_size, least(coalesce(lam.level * l.weight, l.cap::double), l.cap::double) as target
  from levelled l, lam),
parts as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from tgt),
steps as (
  select source, h, sum(words) over (partition by source order by h) as upto, words
  from (select source, h, sum(size) as words from sized group by source, h)),
edge as (
  select s.source, arg_min(s.h, s.h) as h, arg_min(s.upto, s.h) as upto, arg_min(s.words, s.h) as words
  from steps s join parts p on s.source is not distinct from p.source
  where s.upto > p.target - p.whole * p.source_size group by s.source),
plan as (
  select p.*, case when e.h is null then null when 2 * ((p.target - p.whole * p.source_size) - (e.upto - e.words)) >= e.words then e.h + 1 else e.h end as below
  from parts p left join edge e on p.source is not distinct from e.source)
select d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.whole + case when p.target > p.whole * p.source_size and (p.below is null or d.h < p.below) then 1 else 0 end))::bigint as taken
from sized d join plan p on d.source is not distinct from p.source
"""
