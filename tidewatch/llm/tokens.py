"""Exact length histogram: documents counted by encoded length, answers for every context limit.

One row per distinct length L: how many documents have it, and from suffix sums how many are at
least that long, the tokens of those, and the tokens left when every document is cut at L.
quantile is the share of documents of at most L tokens.  The histogram is the whole summary: any
total, quantile or truncated total is a lookup in it (see at_limit and quantile_length).

Defined cases: null and empty texts have length 0; repeated rows count as often as they occur; an
empty table gives no rows; very long texts are encoded whole, a group of texts at a time; other columns
are ignored, whatever their names.  The counts are written once, so texts are encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import row_groups, saved, table, text_lengths
from tidewatch.llm.library_bpe import GROUP_BYTES, chunk_table

#: Lengths of one block of the two-level suffix sums.
BLOCK = 1024


def length_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: each task counts its own texts, and the counts are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = chunk_table(tokenizer_path)
        seen: dict[int, int] = {}
        for b in batches:
            texts = b.column(0).fill_null("")
            for lo, hi in row_groups(text_lengths(texts), GROUP_BYTES):
                for n, times in zip(*(x.tolist() for x in np.unique(table_of.counts(texts.slice(lo, hi - lo)), return_counts=True)), strict=True):
                    seen[n] = seen.get(n, 0) + times
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n_docs"])

    part = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """Suffix sums within blocks of lengths, and over the blocks' totals: no task sees all lengths but as blocks."""
    block = F.floor(F.col("n_tokens") / BLOCK)
    rows = counts.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs_from = F.sum("n_docs").over(within) + F.col("docs_after")
    tokens_from = F.sum("tokens").over(within) + F.col("tokens_after")
    out = rows.join(blocks, "block").withColumns({"docs_from": docs_from, "tokens_from": tokens_from})
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        "all_docs",
        "all_tokens",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def length_histogram(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    return with_suffix_sums(saved(length_counts(docs, tokenizer_path, text_col)))


def at_limit(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit, documents that exceed it and tokens left when all are cut there."""
    spark = histogram.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context_limit long"))
    over = F.col("n_tokens") > F.col("context_limit")
    kept = F.least("n_tokens", "context_limit") * F.col("n_docs")
    return histogram.crossJoin(asked).groupBy("context_limit").agg(F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"), F.sum(kept).alias("truncated_tokens"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("all_tokens"))


def quantile_length(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents does not exceed."""
    return histogram.where(F.col("quantile") >= q - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
