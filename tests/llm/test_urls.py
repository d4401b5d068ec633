import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import urls


def test_cascade_is_exact():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    for n in (0, 1, 500, len(keys)):
        yes = rng.permutation(len(keys)) < n
        levels = urls.build_cascade(keys[yes], keys[~yes])
        assert np.array_equal(urls.in_cascade(levels, keys), yes)


def test_shards_and_both_ways_of_marking(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 700).cast("string").alias("key"), F.lit(1).alias("__h"), F.lit("s").alias("hash"), F.lit(2).alias("Shard"), F.lit(3).alias("salt"))
    cascades = urls.build(df, "key", F.col("key").cast("int") % 7 == 0, n_keys=3 * urls.KEYS_A_SHARD)
    assert cascades.count() == 3
    want = {(str(k), k % 7 == 0) for k in range(700)}
    for most in (urls.BROADCAST_BYTES, 0):
        monkeypatch.setattr(urls, "BROADCAST_BYTES", most)
        got = urls.mark(df, "key", cascades, "listed")
        assert got.columns == [*df.columns, "listed"] and got.select("__h", "hash", "Shard", "salt").distinct().collect() == [(1, "s", 2, 3)]
        assert got.count() == 3000 and {(r["key"], r["listed"]) for r in got.collect()} == want


def test_parsing_and_rules(spark):
    cases = {
        "http://WWW.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/"),
        "https://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/"),
        "x://b.net/fr/#y": ("b.net", "/fr/", "net/fr/"),
        "x://b.net": ("b.net", "", None),
        "x://notexample.com/en/": ("notexample.com", "/en/", "com/"),
        "no scheme": ("", "", None),
        None: ("", "", None),
        "http://a.org?q://z": ("a.org", "", None),
        "://h/p://q": ("h", "/p://q", None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = urls.parsed(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    got = {r["url"]: (r["host"], r["path"], r["rule"]) for r in df.withColumn("rule", urls.ruled(F.col("host"), F.col("path"))[0]).collect()}
    assert got == cases


def test_no_pages(spark):
    empty = spark.createDataFrame([], "key string")
    assert urls.mark(empty, "key", urls.build(empty, "key", F.lit(True)), "x").count() == 0


def test_listed_domains(spark):
    hosts = ["free-bets.example.net", "www.m.free-bets.example.net", "xfree-bets.example.net", "bets.example.net", "free-bets.example.net.org", "example.net", "net", ""]
    keys = spark.createDataFrame([("free-bets.example.net",), ("org",)], "key string")
    got = {r["host"]: r["listed"] for r in urls.with_listed(spark.createDataFrame([(h,) for h in hosts], "host string"), keys).collect()}
    assert [h for h in hosts if got[h]] == [hosts[0], hosts[1], hosts[4]]


def test_query_without_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    assert urls.op9_url_filter(spark, f"file://{tmp_path}").collect() == []
