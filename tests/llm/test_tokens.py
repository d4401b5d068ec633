"""Encoders against the libraries; histograms, token files and BPE queries against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from helpers import SF
from tokenizers import Tokenizer

from tidewatch.llm import bpe, library_bpe, token_files, tokens
from tidewatch.llm.common import chunks

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a", " ", "   a  b\n\n c \t d  ", "\x1c a\x85 b\xa0c \u2028\u3000x", "I'll don't 'S's  123 4567!!! ???  ", "x" * 300 + " y" * 5, "\n \n a", "a \x1c b ", "\u200b  z", "日本語 テスト ひらがな", "<|endoftext|> a", "🙂🙂 🙂", "  ", "\n", " \n", "a  ", "\x00a \x00", "e\u0301é a"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=300, seed=1):
    rng = random.Random(seed)
    alphabet = list("ab theing'sé1 2\n\t  .,!ñ日\u00a0\x1c")
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def all_texts(spark):
    return [r[0] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def test_chunks_join_to_the_text():
    assert all(" ".join(chunks(t)) == t for t in texts())


def test_library_pieces_are_the_library(spark, library):
    many = texts() + all_texts(spark)
    table = library_bpe.chunk_table(JSON)
    got = table.ids(pa.array(many)).to_pylist()
    assert got == library(many)
    assert table.counts(pa.array(many)).tolist() == list(map(len, got))


def test_small_memo_forgets_and_still_agrees(spark, library):
    many = all_texts(spark)
    table = library_bpe.ChunkTable(JSON, limit=10)
    table.pieces.limit = 5
    got = [ids for t in many for ids in table.ids(pa.array([t])).to_pylist()]
    assert got == library(many)


def test_texts_without_spaces_are_forgotten(library):
    table, rng = library_bpe.ChunkTable(JSON, limit=1000), random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice("日本語テストひらがな,") for _ in range(3000))
        assert table.ids(pa.array([text, "a b"])).to_pylist() == library([text, "a b"])
        assert len(table.flat) < 50_000


def test_model_sees_each_piece_once(library, monkeypatch):
    seen, model = [], Tokenizer.from_file(JSON).model

    class Counted:
        def tokenize(self, piece):
            seen.append(piece)
            return model.tokenize(piece)

    monkeypatch.setattr("tokenizers.Tokenizer.from_file", lambda path: type("T", (), {"model": Counted()}))
    table = library_bpe.ChunkTable(JSON)
    many = [f"the internationalization{end} internationalization{end}\nÉtonnamment{end}" for end in [*",.;:!?", "", "..", ".\n"]]
    assert [ids for t in many for ids in table.ids(pa.array([t])).to_pylist()] == library(many)
    assert len(seen) == len(set(seen)) > 10


def test_first_words_are_remembered_apart(library):
    table = library_bpe.ChunkTable(JSON)
    many = ["a", "b a", "a b a", "", " a", "a", "  a  ", "b", "\n", "\n a", "ab a\nb"]
    for some in ([t] for t in many):
        assert table.ids(pa.array(some)).to_pylist() == library(some)
    assert table.ids(pa.array(many)).to_pylist() == library(many)


def test_segment_tree_is_tiktoken(spark, tik):
    many = texts() + all_texts(spark)[:60]
    assert [bpe.encode(RANKS, t) for t in many] == [tik.encode_ordinary(t) for t in many]
    assert all(bpe.decode(RANKS, bpe.encode(RANKS, t)) == t.encode() for t in many)


def test_tree_forms_agree():
    rng, r = random.Random(2), bpe.ranks(RANKS)
    pieces = [bytes(rng.choice(b"abtheion ing\xc3\xa9") for _ in range(rng.randint(1, 64))) for _ in range(400)]
    size = 64
    assert bpe.encode_batch(r, pieces, size) == [bpe.encode_piece(r, p) for p in pieces]


def brute_merge(r, piece):
    ids = [int(r.byte_ids[b]) for b in piece]
    while True:
        options = [(r.pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in r.pairs]
        if not options:
            return ids
        rank, i = min(options)
        ids[i : i + 2] = [rank]


def test_tree_is_the_plain_loop():
    rng, r = random.Random(3), bpe.ranks(RANKS)
    for _ in range(200):
        p = bytes(rng.choice(b"aabbth ein") for _ in range(rng.randint(1, 90)))
        assert bpe.encode_piece(r, p) == brute_merge(r, p)


def check_bpe(docs, rows, tik):
    want = []
    for d in docs.collect():
        ids = tik.encode_ordinary(d["text"] or "")
        want.append((d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_op10(spark, odd_documents, no_documents, tik):
    check_bpe(spark.read.parquet(f"{SF}/documents.parquet"), bpe.op10_bpe(spark, SF).collect(), tik)
    check_bpe(odd_documents, bpe.digests(odd_documents, RANKS).collect(), tik)
    assert bpe.digests(no_documents, RANKS).count() == 0
    for r in bpe.encoded(odd_documents, RANKS).collect():
        assert bytes(r["decoded"]) == bpe.decode(RANKS, r["ids"])


def check_histogram(rows, lengths):
    lengths = np.array(lengths)
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(lengths.tolist()))
    for r in rows:
        n = r["n_tokens"]
        assert r["n_docs"] == (lengths == n).sum() and r["docs_from"] == (lengths >= n).sum()
        assert r["tokens_from"] == lengths[lengths >= n].sum() and r["all_tokens"] == lengths.sum()
        assert r["truncated_tokens"] == np.minimum(lengths, n).sum()
        assert r["quantile"] == pytest.approx((lengths <= n).mean())


def test_op3(spark, odd_documents, no_documents, library):
    check_histogram(tokens.op3_token_counts(spark, SF).collect(), [len(x) for x in library(all_texts(spark))])
    odd = [len(x) for x in library([r[0] or "" for r in odd_documents.select("text").collect()])]
    made = tokens.length_histogram(odd_documents, JSON).cache()
    check_histogram(made.collect(), odd)
    for r in tokens.at_limit(made, [0, 5, 100, 10**6]).collect():
        assert r["truncated_tokens"] == np.minimum(odd, r["context_limit"]).sum() and r["docs_over"] == (np.array(odd) > r["context_limit"]).sum()
    assert tokens.quantile_length(made, 0.5).first()[0] == sorted(odd)[(len(odd) + 1) // 2 - 1]
    assert tokens.length_histogram(no_documents, JSON).count() == 0


def check_files(rows, docs, library):
    order = sorted(((d["doc_id"] is not None, d["doc_id"] or 0, d["text"] or "") for d in docs))
    start, want = 0, []
    for known, i, ids in zip([x[0] for x in order], [x[1] for x in order], library([x[2] for x in order])):
        ids = [*ids, 2]
        want.append((i if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_op6(spark, odd_documents, no_documents, library, tmp_path):
    check_files(token_files.op6_token_files(spark, SF).collect(), spark.read.parquet(f"{SF}/documents.parquet").collect(), library)
    for k, docs in enumerate((odd_documents, no_documents)):
        path = str(tmp_path / f"f{k}")
        token_files.write_token_files(docs, path, JSON, 2)
        check_files(token_files.describe_token_files(token_files.read_token_files(spark, path)).collect(), docs.collect(), library)


def test_token_files_have_stripes_and_filters(spark, tmp_path):
    import pyarrow.orc as orc

    path = str(tmp_path / "f")
    token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet"), path, JSON, 2)
    part = max(tmp_path.joinpath("f").glob("part-*.orc"), key=lambda p: p.stat().st_size)
    assert orc.ORCFile(str(part)).nstripes >= 1 and orc.ORCFile(str(part)).row_index_stride == 10_000
    # the last stage's plan filters by doc_id in the reader
    plan = token_files.read_token_files(spark, path).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan
    assert token_files.read_token_files(spark, path).where("doc_id = 7").count() == 1
