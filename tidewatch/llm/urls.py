"""URL filters: exact membership by a cascade of Bloom filters, without joins.

Level 1 holds the listed keys.  Keys of the corpus that aren't listed but pass it are its false
positives; level 2 holds those.  Listed keys that pass level 2 are in level 3, and so on until no
false positive is left.  As the whole universe of keys went into the building, the first level that a
key fails tells whether it is listed, without error for any key of the corpus.

The list is a table of exact keys.  The query's keys are domains, listed with all that is below them: a
host of the corpus is a listed key of the cascade if it or a domain above it is in the table.

Keys are dealt into shards by hash, and each shard has a cascade of its own, so no task and no filter
holds all keys.  The cascades are broadcast while they take at most BROADCAST_BYTES together; beyond
that each row meets its shard's cascade by a co-grouping of shards.

Defined cases: null urls, and those without ://, have an empty host and path; null keys count as empty
ones; an empty table gives no rows; repeated rows give repeated rows; very long urls are taken whole; extra
columns come through mark() unharmed, whatever their names, and the query ignores them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import lower_ascii, saved, table, unused

#: Fixed by the contract: allowed and blocked hosts with the starts of paths.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: The query's list: exact keys, domains that are listed with all below them.  Any table of keys can take its place.
LISTED_DOMAINS = tuple(f"{name}.example.{zone}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org"))

KEYS_A_SHARD = 200_000
BROADCAST_BYTES = 64 << 20
BITS_A_KEY, HASHES = 6, 4


def _positions(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """HASHES bit positions for each key: double hashing, salted by level."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        step = (x >> np.uint64(17)) | np.uint64(1)
        return (x[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


def _fill(hashes: np.ndarray, level: int) -> np.ndarray:
    bits = max(64, 1 << math.ceil(math.log2(max(1, len(hashes)) * BITS_A_KEY)))
    out = np.zeros(bits, bool)
    out[_positions(hashes, level, bits).ravel()] = True
    return np.packbits(out)


def _passes(level_bits: np.ndarray, hashes: np.ndarray, level: int) -> np.ndarray:
    at = _positions(hashes, level, len(level_bits) * 8)
    return ((level_bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(1)


def build_cascade(listed: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
    """Levels for 64-bit key hashes; listed and others are disjoint."""
    levels: list[np.ndarray] = []
    inside, outside = listed, others
    while len(inside):
        levels.append(_fill(inside, len(levels)))
        outside, inside = inside, outside[_passes(levels[-1], outside, len(levels) - 1)]
        if len(levels) > 200:
            raise ValueError("keys with the same hash are both listed and not")
    return levels


def in_cascade(levels: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """True for listed keys: a key is settled by the first level that it fails, else by the last."""
    out = np.zeros(len(hashes), bool)
    open_ = np.arange(len(hashes))
    for k, bits in enumerate(levels):
        ok = _passes(bits, hashes[open_], k)
        out[open_[~ok]] = k % 2 == 1
        open_ = open_[ok]
    out[open_] = len(levels) % 2 == 1
    return out


def build(universe: DataFrame, key_col: str, listed: Column, n_keys: int | None = None) -> DataFrame:
    """shard, cascade: from all keys of the corpus (repeats allowed) and whether each is listed."""
    keys = universe.select(F.xxhash64(F.coalesce(F.col(key_col), F.lit(""))).alias("h"), F.coalesce(listed, F.lit(False)).alias("listed")).distinct()
    keys = saved(keys)
    shards = max(1, -(-(keys.count() if n_keys is None else n_keys) // KEYS_A_SHARD))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h, yes = pdf["h"].to_numpy().view(np.uint64), pdf["listed"].to_numpy(bool)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "shards": [shards], "cascade": [pickle.dumps(build_cascade(h[yes], h[~yes]))]})

    return saved(keys.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(one, "shard int, shards int, cascade binary"))


def mark(df: DataFrame, key_col: str, cascades: DataFrame, out_col: str) -> DataFrame:
    """df with whether each key is listed, by its shard's cascade."""
    spark = df.sparkSession
    size, shards = cascades.agg(F.coalesce(F.sum(F.length("cascade")), F.lit(0)), F.coalesce(F.max("shards"), F.lit(1))).first()
    h = F.xxhash64(F.coalesce(F.col(key_col), F.lit("")))
    hash_col, shard_col, salt_col = (unused(df, c) for c in ("hash", "shard", "salt"))
    hashed = df.withColumn(hash_col, h)
    names, schema = df.columns, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{out_col}` boolean"])
    if size <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast({r["shard"]: r["cascade"] for r in cascades.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels = {k: pickle.loads(v) for k, v in held.value.items()}
            for b in batches:
                hashes = b.column(len(names)).to_numpy().view(np.uint64)
                place = hashes.view(np.int64) % shards
                out = np.zeros(len(hashes), bool)
                for s in np.unique(place):
                    out[place == s] = in_cascade(levels.get(int(s), []), hashes[place == s])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], [*names, out_col])

        return hashed.mapInArrow(run, schema)

    # a shard's rows are salted, so that a hot key's rows don't meet in one task
    salted = hashed.withColumn(shard_col, F.pmod(hash_col, F.lit(shards)).cast("int")).withColumn(salt_col, F.floor(F.rand(7) * 64).cast("int"))
    sides = cascades.select("shard", "cascade", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("t"))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[names].copy()
        out[out_col] = in_cascade(pickle.loads(right["cascade"].iloc[0]) if len(right) else [], left[hash_col].to_numpy().view(np.uint64))
        return out

    return salted.groupBy(shard_col, salt_col).cogroup(sides.groupBy("shard", "t")).applyInPandas(both, schema)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = None
    for name, start, says in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def domains(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_listed(hosts: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct hosts (column host) with listed: is the host or a domain above it among the keys (column key)."""
    found = hosts.select("host", F.explode(domains(F.col("host"))).alias("key")).join(keys.select("key"), "key", "left_semi").select("host").distinct()
    return hosts.join(found.withColumn("listed", F.lit(True)), "host", "left").select("host", F.coalesce("listed", F.lit(False)).alias("listed"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = parsed(F.col("url").cast("string"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    keys = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "key string")
    cascades = build(with_listed(pages.select("host").distinct(), keys), "host", F.col("listed"))
    rule, verdict = ruled(F.col("host"), F.col("path"))
    judged = mark(pages, "host", cascades, "listed")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


OP9_SQL = r"""
with listed as (
  select name || '.example.' || zone as key
  from (select unnest(['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) as name), (select unnest(['com', 'net', 'org']) as zone)),
parsed as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
ruled as (
  select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from parsed),
labels as (select distinct host, string_split(host, '.') as parts from parsed),
above as (select host, array_to_string(parts[i:], '.') as key from (select host, parts, unnest(range(1, len(parts) + 1)) as i from labels))
select page_id, host, path, rule,
       case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block'
            when host in (select host from above where key in (select key from listed)) then 'block' else 'allow' end as verdict
from ruled
"""
