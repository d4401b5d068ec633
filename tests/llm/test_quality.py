from pyspark.sql import functions as F
import re
from collections import Counter

from helpers import SF

from tidewatch.llm import quality


def stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_statistics_by_brute_force(spark, odd_documents, no_documents):
    extra = spark.createDataFrame([(20 + k, t) for k, t in enumerate(["a b c a b c", "a a a a", "a b c\na b c\n\n \n#$ |", "x y z q x y z x y z", "a b", "é é é é"])], "doc_id long, text string")
    docs = odd_documents.select("doc_id", "text").union(extra)
    got = quality.judged(docs).select("row.*", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", "kept").collect()
    assert len(got) == 20
    for r in got:
        assert tuple(r)[2:7] == stats(r["text"]), r["text"]
        assert not r["kept"] or r["n_words"] >= 50
    assert quality.kept_only(no_documents).count() == 0
    assert quality.kept_only(odd_documents).columns == odd_documents.columns


def test_order_is_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([(k, "| " * 60 if k % 2 else " ".join(f"word{i}" for i in range(80))) for k in range(60)], "doc_id long, text string")
    found = quality.estimate(quality.with_stats(docs), quality.rules())
    rates = [x["rejects"] / x["cost"] for x in found]
    assert rates == sorted(rates, reverse=True) and len(found) == len(quality.rules())
    assert {r["row"]["doc_id"] for r in quality.judged(docs).where("kept").select("row").collect()} == set(range(0, 60, 2))


def test_no_python_in_the_plan(spark, odd_documents):
    plan = quality.judged(odd_documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lazy_rules_agree(spark, odd_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd_documents):
        want = sorted((r["row"]["doc_id"] or -1 for r in quality.judged(df).where("kept").select("row").collect()))
        assert sorted(r["doc_id"] or -1 for r in quality.kept_only(df).collect()) == want
    stats = quality.with_stats(docs).select("s.text", "s.words", "s.n_words", "s.n_repeat_words")
    got = stats.select("n_repeat_words", quality._repeat_words(F.col("words"), F.col("n_words").cast("int")).alias("lazy"))
    assert got.where("n_repeat_words > 0").count() and not got.where("n_repeat_words <> lazy").count()
    clash = odd_documents.withColumns({k: F.lit(1) for k in ("t", "w", "n", "x", "row", "kept", "s")})
    assert quality.kept_only(clash).columns == clash.columns
