"""The corpus pipeline: quality rules, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents (the last one ids), and is
written as Parquet and read again as the next one's docs.

Defined cases, in all stages: null and empty texts have no words, so the quality rules reject them, and in the
other stages they are linked with nothing, have size 0 (the mix takes them as its source's threshold says) and no
ids; a null doc_id is an id like any other; of rows equal in doc_id and text near-duplicates keep one, while
different texts under one doc_id are judged each; ties go to the least doc_id and then to the text's hash; very
long texts are worked on whole; empty tables give empty tables; extra columns, whatever their names, come
through (encoding alone returns its own).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, jaccard, mixing, quality
from tidewatch.llm.common import saved, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.kept_only(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id; documents without words stay."""
    return jaccard.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows with one doc_id are taken together."""
    mixed = mixing.mix(docs, carry=docs.columns).where("times > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the length in bytes of what the ids decode to."""
    out = bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.length("decoded").cast("long").alias("n_bytes"))


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("mixing", mix_sources), ("encoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
