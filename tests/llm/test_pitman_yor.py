import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF
from pyspark.sql import functions as F

from tidewatch.llm import pitman_yor as M


def exact(c, others, d, p):
    """Probabilities of 1 to c tables by generalised Stirling numbers."""
    s = np.zeros((c + 1, c + 2))
    s[1, 1] = 1
    for n in range(1, c):
        for t in range(1, n + 1):
            s[n + 1, t + 1] += s[n, t]
            s[n + 1, t] += (n - d * t) * s[n, t]
    w = np.array([s[c, t] * np.prod([(M.THETA + d * (others + i)) * p for i in range(t)]) for t in range(1, c + 1)])
    return w / w.sum()


@pytest.mark.parametrize("c,others,d,p", [(2, 3, 0.7, 0.05), (3, 0, 0.5, 0.3), (6, 10, 0.7, 0.1), (10, 3, 0.3, 0.5), (12, 40, 0.7, 0.02)])
def test_draws_come_from_the_posterior(c, others, d, p):
    k, rng = 30_000, np.random.default_rng(1)
    t = M.seat(np.full(k, c), np.full(k, others), d, np.full(k, p), rng)
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / k - exact(c, others, d, p)).max() < 0.02


def test_seating_of_large_dishes(monkeypatch):
    rng = np.random.default_rng(2)
    c = rng.zipf(1.3, 3000).clip(1, 10**6)
    t = M.seat(c, np.full(3000, 50), 0.5, np.full(3000, 0.01), rng)
    assert (t >= 1).all() and (t <= c).all() and (t[c == 1] == 1).all()
    for others, p in ((30, 0.05), (5000, 0.02), (0, 0.5), (50, 0.001)):
        here = np.full(2000, 1000), np.full(2000, others), 0.5, np.full(2000, p), rng
        whole = M.seat(*here)
        monkeypatch.setattr(M, "EXACT", 256)
        monkeypatch.setattr(M, "_BANDS", M._BANDS[:-2])
        M._stirling.cache_clear()
        part = M.seat(*here)
        monkeypatch.undo()
        M._stirling.cache_clear()
        assert part.mean() == pytest.approx(whole.mean(), rel=0.1)


def test_spelling_sums_to_one():
    rng = np.random.default_rng(3)
    words = [b"the", b"then", b"other", b"\n", "é".encode()]
    keys, word = M.spell(words)
    assert len(keys) == len(word) == 4 + 5 + 6 + 2 + 3
    distinct, n = np.unique(keys, return_counts=True)
    model = M.seat_spelling(distinct, n * 5, M.UNIFORM, rng, 2)
    table = M.Table(model)
    for context in {int(k) >> 8 for k in distinct} | {12345, 0x6874}:
        p = model.prob((context << 8) | np.arange(256))
        assert p.sum() == pytest.approx(1.0) and np.exp(table.logs[table.row[context]]) == pytest.approx(p, rel=1e-5)
    assert table.log_words(words) == pytest.approx(model.log_words(keys, word), rel=1e-5)


def test_tokens():
    texts = ["  a\t\nB c\x0b\x0cA ", "", " ", "x y", "É\x85z\xa0q A"]
    for some in (pa.array(texts), pa.array(["zz", *texts]).slice(1)):
        names, index, at = M.tokens(some)
        got = [[names[i] for i in index[i:j]] for i, j in zip(at, at[1:])]
        assert got == [t.encode().lower().split() + [M.END] for t in texts]


def pairs_of(model):
    """(context, word) -> (its own share, what the context leaves, the word's probability), and spelling by word."""
    found, spelt = {}, {}
    for r in model.chunks.where("names is not null").collect():
        x = M.Chunk.of(r.asDict())
        p, own, left = model.words(x)
        words = [model.vocab.words[n] if not rare else w for n, rare, w in zip(x.names.tolist(), x.rare, x.words)]
        spelt.update(zip(words, model.totals.spelling.log_words(words).tolist()))
        for k, w in enumerate(x.word.tolist()):
            found[int(x.ctx[k]), words[w]] = (own[k], left[k], math.exp(p[w]))
    return found, spelt


def context(model, word):
    known = {w: i for i, w in enumerate(model.vocab.words)}
    return known.get(word, M.CONTEXTS + int.from_bytes(word[-2:]))


def few(docs, k):
    v = M.vocabulary(docs)
    return M.Vocabulary(v.words[:k], v.c[:k], v.n, v.v)


@pytest.mark.parametrize("k", [4, M.CONTEXTS])
def test_probabilities_sum_to_one_and_give_the_scores(spark, k):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["the", "cat", "sat", "on", "mat", f"w{i % 7}", f"q{rng.randint(0, 40)}"]) for _ in range(30))) for i in range(60)], "doc_id long, text string")
    model = M.train(docs, vocab=few(docs, k))
    found, spelt = pairs_of(model)
    words = {w: p for (_, w), (_, _, p) in found.items()}
    new = (M.THETA + model.totals.d_word * model.totals.t) / (M.THETA + model.totals.k)
    assert sum(words.values()) + new * (1 - sum(math.exp(spelt[w]) for w in words)) == pytest.approx(1.0, abs=1e-5)
    own, left = Counter(), {}
    for (c, _), (x, y, _) in found.items():
        own[c] += x
        left[c] = y
    assert all(own[c] + left[c] == pytest.approx(1.0, abs=1e-5) for c in left)
    want = {}
    for d in docs.collect():
        text = [M.END, *d["text"].encode().lower().split(), M.END]
        want[d["doc_id"]] = sum(math.log10(x + y * p) for x, y, p in (found[context(model, u), w] for u, w in zip(text, text[1:])))
    assert {r["doc_id"]: r["score"] for r in M.score(model).collect()} == pytest.approx(want)


def check(docs, rows, frequent_base=True):
    docs = [(d["doc_id"], d["text"]) for d in docs.collect()]
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, t in docs if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted(((i, out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(map(base, words(t))), 6)) for i, t in docs), key=repr)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=repr) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def test_query_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = M.op2_pitman_yor(spark, SF).collect()
    check(docs, rows)


def test_model_beats_the_base(spark):
    """On held-out texts, though the base gives each word that training lacks the probability of all of them."""
    held = M.op2_pitman_yor(spark, SF.replace("0.001", "0.01")).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
    assert held["s"] > held["b"] + 0.5 * held["n"]


def test_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in M.score(M.train(docs)).collect()) for _ in range(2))
    assert a == b
    assert M.perplexity(M.score(M.train(docs))).count() == 2


def test_odd_documents(spark, odd_documents, no_documents):
    clash = odd_documents.selectExpr("*", "1 as c", "2 as word", "3 as block", "4 as score")
    check(odd_documents, M.score(M.train(clash)).collect())
    assert M.score(M.train(no_documents)).count() == 0
    only_held = spark.createDataFrame([(i, "a b c") for i in range(200) if M.held_out(i)], "doc_id long, text string")
    rows = M.score(M.train(only_held)).collect()
    assert {r["train_tokens"] for r in rows} == {0} and {r["n_known"] for r in rows} == {0}
    assert all(r["base_score"] == pytest.approx(0.0) for r in rows)


def test_random_strings_score_below_prose(spark):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    prose = max((r["text"] or "" for r in docs.collect() if M.held_out(r["doc_id"])), key=len).split()[:200]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in w) for w in (x + "xxxx" for x in prose)]
    a, b = [i for i in range(10**6, 10**6 + 200) if M.held_out(i)][:2]
    rows = spark.createDataFrame([(a, " ".join(prose)), (b, " ".join(junk)), (b, "z" * 5000)], "doc_id long, text string")
    both = docs.unionByName(rows)
    got = M.score(M.train(both)).where(F.col("doc_id").isin(a, b)).collect()
    by = {(r["doc_id"], r["n_tokens"]): r for r in got}
    assert by[b, 201]["n_known"] < 20
    assert by[b, 201]["score"] < by[a, 201]["score"]
    assert math.isfinite(by[b, 2]["score"]) and by[b, 2]["score"] < -1000


def test_order_of_words_counts(spark):
    rng = random.Random(6)
    names = [f"w{i}" for i in range(30)]
    follows = {x: rng.sample(names, 2) for x in names}

    def walk(k):
        out = [rng.choice(names)]
        while len(out) < k:
            out.append(rng.choice(follows[out[-1]]))
        return out

    test = walk(100)
    a, b = [i for i in range(10**6, 10**6 + 200) if M.held_out(i)][:2]
    docs = spark.createDataFrame([(i, " ".join(walk(60))) for i in range(60)] + [(a, " ".join(test)), (b, " ".join(rng.sample(test, 100)))], "doc_id long, text string")
    by = {r["doc_id"]: r for r in M.score(M.train(docs)).collect() if r["doc_id"] in (a, b)}
    assert by[a]["base_score"] == pytest.approx(by[b]["base_score"])
    assert by[a]["score"] > by[b]["score"] + 30
