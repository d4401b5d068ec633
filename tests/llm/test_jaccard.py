import random

import numpy as np
from helpers import SF

from tidewatch.llm import jaccard
from tidewatch.llm import shingle_sets as sets
from tidewatch.operators.graph import connected as components


def shingles(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """(doc_id, set size, least reachable doc_id) by comparing all."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 4 * both >= 3 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(sets[i]), ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def check(df):
    got = sorted(map(tuple, jaccard.classes(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def edited(rng, words, share):
    return [f"e{rng.randint(0, 10**9)}" if rng.random() < share else w for w in words]


def test_linked_sets_share_enough_signatures():
    rng = np.random.default_rng(1)
    for _ in range(600):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 30, 60, 130, 300]))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = rng.permutation(len(a))[: int(rng.integers(0, max(1, len(a) // 4) + 1))]
        b = np.unique(np.r_[np.delete(a, drop), rng.integers(0, 2**63, int(rng.integers(0, len(a) // 5 + 1))).astype(np.uint64)])
        if len(b) and sets.linked(a, b):
            (x, p), (y, q) = sets.signatures(a), sets.signatures(b)
            assert len(np.intersect1d(x, y)) >= min(p, q) >= 1


def test_small_and_odd(spark, odd_documents, no_documents):
    check(odd_documents)
    assert jaccard.classes(no_documents).count() == 0


def test_edge_of_the_threshold(spark):
    words = [f"w{i}" for i in range(304)]
    rows = [(100, " ".join(words))]
    for k, n in enumerate((9, 10, 11, 12, 42, 43, 44, 70, 75, 76)):
        rows.append((k, " ".join(words[:-n])))  # subsets: 300 - n of 300
        rows.append((50 + k, " ".join(words[n:] + [f"x{k}-{i}" for i in range(n)])))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_groups_of_copies_with_a_shared_passage(spark):
    rng = random.Random(6)
    base, passage = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(60)]
    rows = [(k, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05])))) for k in range(90)]
    rows += [(1000 + k, " ".join([f"u{k}-{i}" for i in range(120)] + passage)) for k in range(90)]
    rows += [(2000 + k, " ".join(passage + [f"v{k}"])) for k in range(30)]
    rows += [(3000 + k, rows[0][1]) for k in range(20)]
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):
        rows.append((4000 + k, " ".join(chain)))
        chain = chain[8:] + [f"d{k}-{i}" for i in range(8)]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_query(spark):
    rows = jaccard.op8_jaccard(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(map(tuple, rows), key=repr) == brute([(d["doc_id"], d["text"]) for d in docs])


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), 20: 20, 21: 20, 5: 5}


def test_sketches_never_drop_a_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.choice([1, 5, 60, 127, 128, 129, 500, 3000]))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        b = np.unique(np.r_[np.delete(a, rng.permutation(len(a))[: int(rng.integers(0, len(a) // 4 + 1))]), rng.integers(0, 2**63, int(rng.integers(0, len(a) // 4 + 1))).astype(np.uint64)])
        if len(b) and sets.linked(a, b):
            assert sets.may_link(sets.fine_sketch(a), sets.fine_sketch(b), len(a) + len(b))
            bits = sum(int(x ^ y).bit_count() for x, y in zip(sets.sketch(a).view(np.uint64).tolist(), sets.sketch(b).view(np.uint64).tolist()))
            assert 7 * bits <= len(a) + len(b)
    far = rng.integers(0, 2**63, (2, 4000)).astype(np.uint64)
    assert not sets.may_link(sets.fine_sketch(far[0]), sets.fine_sketch(far[1]), 8000)


def near_copies(rng, n, m, most):
    """A set of n numbers, and m copies of it with up to so many elements replaced, added or taken away."""
    hub = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    out = []
    for _ in range(m):
        gone, new = rng.integers(0, most + 1, 2)
        out.append(np.unique(np.r_[np.delete(hub, rng.permutation(len(hub))[:gone]), rng.integers(0, 2**63, new).astype(np.uint64)]))
    return hub, out


def test_linked_sets_share_a_key_of_differences():
    rng = np.random.default_rng(3)
    for n, most in ((40, 12), (150, 45), (150, 60), (400, 130)):
        hub, made = near_copies(rng, n, 60, most)
        twins = [np.unique(np.r_[s[3:], rng.integers(0, 2**63, 3).astype(np.uint64)]) for s in made]  # linked with outer sets, too
        made += twins
        got = [sets.difference_keys(s, hub, 5) for s in made]
        assert [g[0] for g in got] == [sets.linked(s, hub) for s in made]
        for i, x in enumerate(made):
            for j in range(i):
                if sets.linked(x, made[j]) and not (got[i][0] and got[j][0]):
                    assert any(len(np.intersect1d(got[p][1][got[p][1] & sets.SIDE == 0] | sets.SIDE, got[q][1])) for p, q in ((i, j), (j, i)))


def test_candidates_of_a_large_group_grow_in_proportion():
    """Copies with words replaced, about half of which link with the original."""
    rng, shingle = random.Random(4), sets.Shingles()
    base = [f"b{i}" for i in range(200)]
    hub = shingle(" ".join(base))
    made = [shingle(" ".join(edited(rng, base, rng.random() * 0.07))) for _ in range(5000)]
    got = [sets.difference_keys(s, hub, 5) for s in made]
    assert 0.3 < np.mean([inside for inside, _ in got]) < 0.8

    def candidates(m):
        keys, count = np.unique(np.concatenate([np.unique(k) for _, k in got[:m]]), return_counts=True)
        low = dict(zip((k := keys[keys & sets.SIDE == 0]).tolist(), count[keys & sets.SIDE == 0].tolist()))
        assert len(k)
        return sum(c * low.get(x, 0) for x, c in zip((keys & ~sets.SIDE)[keys & sets.SIDE > 0].tolist(), count[keys & sets.SIDE > 0].tolist()))

    # a set of a band meets itself, too, from both sides
    assert candidates(5000) <= 6 * candidates(1000)


def test_keys_of_one_group_become_one(spark):
    """Two long texts that differ from their hub alike share hundreds of keys, which all give the one pair."""
    rng = np.random.default_rng(5)
    hub = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    new = rng.integers(0, 2**63, 400).astype(np.uint64)
    pair = [np.unique(np.r_[hub, new, rng.integers(0, 2**63, k).astype(np.uint64)]) for k in (20, 60)]
    made = [(k, bytearray(s.tobytes())) for k, s in enumerate([hub, *pair])]
    nodes = spark.createDataFrame(made, "node long, set binary")
    members = spark.createDataFrame([(1, 0), (2, 0)], "a long, b long")
    met = jaccard.meet(jaccard.by_differences(members, nodes, 4), 1, sides=True).where("sig is not null")
    got = met.select("sig", "node").collect()
    assert {r["node"] for r in got} == {1, 2}
    assert len(got) <= 8


def test_a_group_of_5000_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(k, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.05, 0.07])))) for k in range(5000)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [sets.Shingles()(t) for _, t in rows]
    first = next(k for k, t in rows if t == " ".join(base))
    straight = {k for k, s in enumerate(texts) if sets.linked(s, texts[first])}  # linked with the original
    top = min(straight)
    assert all(got[k] == top for k in straight)
    for k in rng.sample(sorted(set(got) - straight), 150):
        others = [j for j, s in enumerate(texts) if j != k and sets.linked(s, texts[k])]
        assert all(got[j] == got[k] for j in others) and (others or got[k] == k)
