"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.storage import saved, shared_dir

__all__ = ["discard", "lower_ascii", "lower_words", "row_groups", "saved", "shared_dir", "small_batches", "table", "text_lengths", "unused", "word_count", "words"]

#: White space of the word contracts: space and the controls 9 to 13.
SPACE = " \t\n\x0b\f\r"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Characters of text that Python workers turn over at a time.
GROUP_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Deletes what saved() wrote, once all that reads it is written itself."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python workers get so many rows at once of what is run inside: sets and texts may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() knows just these six separators."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_count(text: Column) -> Column:
    """Number of words of a text column, null as 0."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def text_lengths(texts: pa.Array) -> list[int]:
    """Bytes of each text of a string column without nulls."""
    return pc.binary_length(texts).to_pylist()


def row_groups(lengths: Iterable[int], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit characters, so that long texts don't pile up."""
    start = total = 0
    i = -1
    for i, n in enumerate(lengths):
        total += n
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if i + 1 > start:
        yield start, i + 1


#: All that any of the tokenizers' engines takes for white space, spelt out so that all of them read it alike.
ANY_SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = re.compile(f" (?:[{ANY_SPACE}]|$)")
_CUT = re.compile(f" (?=[^{ANY_SPACE}])")


def chunks(text: str) -> list[str]:
    """Cuts before each space that no white space follows; joined by spaces they give the text.

    A match of the tokenizers' pattern always starts at such a space: runs of white space give
    back their last space to the word behind, so chunks are encoded apart and remembered.
    """
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class ChunkMemo:
    """Remembers what chunks are encoded to, up to a number of entries; long ones are not kept."""

    def __init__(self, encode_many: Callable[[list[str]], list], limit: int = 250_000):
        self.encode_many, self.limit, self.memo = encode_many, limit, {}

    def texts(self, texts: list[str]) -> Iterator[list]:
        """For each text its chunks' values, in order."""
        if len(self.memo) > self.limit:
            self.memo.clear()
        parts = [chunks(t) for t in texts]
        for p in parts:
            p[0] = " " + p[0]  # marks the chunk that no space stands before: others never start with one
        new: set[str] = set()
        for p in parts:
            new.update(p)
        new = new.difference(self.memo)
        get = self.memo.__getitem__
        fresh = list(new)
        self.memo.update(zip(fresh, self.encode_many([c[1:] if c[:1] == " " else " " + c for c in fresh]), strict=True))
        for p in parts:
            yield list(map(get, p))
        for c in fresh:
            if len(c) > 64:
                del self.memo[c]
