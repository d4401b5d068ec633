"""Token ids in ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of doc_id and sorted, encoded, and written by Spark's own ORC
writer, one file a range: ids is a list of integers (run-length encoded), doc_id has row indexes and
a Bloom filter.  Reads are split by stripes; a filter on doc_id skips files, stripes and row groups
by their metadata alone.

Defined cases: null and empty texts hold the end id alone; a null doc_id sorts first; rows with the
same doc_id are ordered by text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import row_groups, saved, shared_dir, table, text_lengths
from tidewatch.llm.library_bpe import GROUP_BYTES, chunk_table

FILE_SCHEMA = "doc_id long, file_row long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, stripe_bytes: int = 64 << 20, index_stride: int = 10_000) -> None:
    """Encodes doc_id, text to ORC files at path, ascending by doc_id over and within the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of, row = chunk_table(tokenizer_path), 0
        for b in batches:
            texts = b.column(1).fill_null("")
            for lo, hi in row_groups(text_lengths(texts), GROUP_BYTES):
                ids = table_of.ids(texts.slice(lo, hi - lo))
                at = ids.offsets.to_numpy()
                values = np.insert(ids.values.to_numpy(), at[1:], end_id)
                offsets = at + np.arange(len(at), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.arange(row, row + hi - lo)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "file_row", "ids"])
                row += hi - lo

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = placed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        placed.mapInArrow(run, FILE_SCHEMA)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", index_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file_row, ids; a filter on doc_id is pushed down to the files' metadata."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def describe_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone.

    start is a sum within each file and over the files' totals (one row a file).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "doc_id", "file_row", "n_tokens", "ids_crc32"])

    rows = files.select(F.col("_metadata.file_path").alias("file"), "doc_id", "file_row", "ids")
    rows = saved(rows.mapInArrow(run, "file string, doc_id long, file_row long, n_tokens long, ids_crc32 long"))
    within = Window.partitionBy("file").orderBy("file_row").rowsBetween(Window.unboundedPreceding, -1)
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", F.coalesce(F.sum("total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.join(before, "file")
    return rows.select("doc_id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return describe_token_files(read_token_files(spark, path))
