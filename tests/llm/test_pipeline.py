import re
import unicodedata
from collections import Counter

import public_tokenizers as P
from helpers import SF
from test_mixing import water
from test_tokens import tik  # noqa: F401

import corpus_pipeline
from tidewatch.llm import bpe, jaccard, mixing, quality
from tidewatch.llm.common import table


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = corpus_pipeline.keep_quality(spark, docs, SF).cache()
    verdicts = {r[0]: r[1] for r in quality.op7_quality(spark, SF).select("doc_id", "kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in verdicts.items() if k} and kept.columns == columns

    distinct = corpus_pipeline.keep_distinct(spark, kept, SF).cache()
    classes = {r["doc_id"]: r["component_id"] for r in jaccard.classes(kept).collect()}
    assert sorted(r["doc_id"] for r in distinct.collect()) == sorted(i for i, c in classes.items() if i == c) and distinct.columns == columns

    mixed = corpus_pipeline.mix_sources(spark, distinct, SF).cache()
    times = {r["doc_id"]: r["times"] for r in mixing.mix(distinct).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: t for i, t in times.items() if t}) and mixed.columns == columns

    path = P.path("byte_bpe_multi_50k.tiktoken")
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    last = corpus_pipeline.encode(spark, mixed, SF).collect()
    assert len(last) == mixed.count()
    for r in last:
        assert bpe.decode(path, r["ids"]) == texts[r["doc_id"]].encode() and r["n_tokens"] == len(r["ids"]) and r["n_bytes"] == len(texts[r["doc_id"]].encode())
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in whole) == sorted((r["doc_id"], r["n_tokens"]) for r in last)


def test_odd_documents(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
        assert corpus_pipeline.encode(spark, docs, SF).count() == docs.count()
    left = corpus_pipeline.keep_distinct(spark, odd_documents, SF).collect()
    assert sorted((r["doc_id"] for r in left), key=repr) == [1, 10, 11, 12, 3, 4, 5, 6, 8, None]


def test_distinct_loses_no_text_of_its_own(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x", 1), (1, b, "y", 2), (1, b, "y", 2), (2, a, "z", 3), (None, a + " end", "u", 4), (None, "c d e f g h", "v", 5), (None, None, "w", 6), (7, "c d e f g h", "t", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, times long").selectExpr("*", "1 as own_id", "2 as key", "3 as `row`", "4 as label")
    got = corpus_pipeline.keep_distinct(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["__id"], r["times"]) for r in got.collect() if r["doc_id"]) == [(1, "x", 1), (1, "y", 2), (7, "t", 7)]
    assert [r["times"] for r in got.collect() if r["doc_id"] is None] == [6]


def brute(rows):
    """The whole pipeline but for encoding, in plain Python: (doc_id, times) of the documents that stay."""
    from test_jaccard import brute as classes

    found = dict((d, c) for d, _, c in classes([(r["doc_id"], r["text"]) for r in rows]))
    return [r for r in rows if found[r["doc_id"]] == r["doc_id"]]


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, grams = len(w), list(zip(w, w[1:], w[2:]))
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, letters = sum(map(len, w)), sum(any(c.isalpha() for c in x) for x in w)
    capitals = sum(unicodedata.category(c) == "Lu" for c in text)
    return not (
        n < 50 or 100 * len(covered) > 35 * n or 10 * len(re.findall(r"[#*$%&|<>]", text)) > n or 100 * (len(lines) - len(set(lines))) > 40 * len(lines)
        or not 3 * n <= chars <= 10 * n or 100 * letters < 70 * n or 100 * capitals > 30 * len(text) or 100 * len(set(w)) < 15 * n
    )


def test_pipeline_against_brute_force(spark, tik):
    rows = [r for r in table(spark, SF, "documents").collect() if plain_quality(r["text"] or "")]
    rows = brute(rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(r["text"].split())
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    want = {r["doc_id"]: tik.encode_ordinary(r["text"]) for r in rows}
    assert {d for d, _, _ in got} <= set(want) and all(n == len(want[d]) and list(ids) == want[d] for d, n, ids in got)
    words, source = {r["doc_id"]: len(r["text"].split()) for r in rows}, {r["doc_id"]: r["source"] for r in rows}
    taken = Counter()
    for (d, _, _), times in got.items():
        assert times <= 3
        taken[source[d]] += times * words[d]
    names = sorted(sizes)
    target = water([sizes[x] for x in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    assert all(abs(taken[x] - t) <= max(words[d] for d in words if source[d] == x) for x, t in zip(names, target))


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "encoding"]
    assert all(re.fullmatch(r"\w+", n) for n, _ in corpus_pipeline.STAGES)
