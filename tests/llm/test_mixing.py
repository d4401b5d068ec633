import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing


def water(sizes, weights, most):
    """Shares by weight, the excess of capped sources reshared until none is above."""
    left, open_, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if target[i] + left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] += left * weights[i] / total
            return target
        give = left
        for i in open_:
            share = give * weights[i] / total
            add = min(share, most * sizes[i] - target[i])
            target[i] += add
            left -= add
        open_ -= over
    return target


def test_targets(spark):
    rng = random.Random(4)
    for n in (1, 2, 5, 9):
        sizes = [rng.choice([0, 1, 10, 1000, 50_000]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i}" if i < n - 1 or n == 1 else None, s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = water(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 3)
        assert [got[f"s{i}" if i < n - 1 or n == 1 else None] for i in range(n)] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_taken_is_near_the_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), f"s{min(3, rng.randint(0, 6))}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["text"])
    assert out.where("taken > 3 * size or taken <> times * size").count() == 0
    per = out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 20 and r["size"] == r["source_size"] for r in per)
    again = {(r["doc_id"], r["taken"]) for r in out.collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out.collect()}


def test_odd_documents(spark, odd_documents, no_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == 14 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert len({r["taken"] for r in rows if r["doc_id"] == 1}) == 1
    assert mixing.mix(no_documents).count() == 0
    names = ["size", "h", "times", "row", "source", "doc_id", "text"]
    clash = odd_documents.withColumns({"h": F.lit(1), "times": F.lit("t"), "row": F.lit(2), "S": F.lit(3)})
    kept = mixing.mix(clash, carry=names)
    assert kept.select("row.*").columns == names and kept.count() == 14
    assert sorted((r["doc_id"], r["taken"]) for r in kept.collect() if r["doc_id"]) == sorted((r["doc_id"], r["taken"]) for r in rows if r["doc_id"])
