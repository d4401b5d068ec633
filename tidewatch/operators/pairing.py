"""Pairs of the members of groups, when a value holds for whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1024


def chunks(groups: DataFrame, members: str) -> DataFrame:
    """groups with members cut to arrays of at most CHUNK, a row each, so that no row of a large group is large."""
    starts = F.sequence(F.lit(1), F.size(members), F.lit(CHUNK))
    return groups.withColumn(members, F.explode(F.transform(starts, lambda k: F.slice(members, k, CHUNK))))


def dealt(left: DataFrame, right: DataFrame, on: list[str], by: str, parts: int = 32) -> DataFrame:
    """Their inner join on a few large keys: left's rows are dealt out by a column over parts of each key, right's copied to all of them.

    Fixed numbers of partitions, as the rows that follow from a pair aren't seen in its size.
    """
    part = F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")
    a = left.withColumn("part", part).repartition(8 * parts, *on, "part")
    b = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(8 * parts, *on, "part")
    return a.join(b, [*on, "part"]).drop("part")
