"""Byte-level BPE by segment trees.

A piece's bytes are the leaves of a segment tree whose nodes hold the leftmost least rank of a pair
that starts below them.  The root names the next merge; a merge changes three leaves (the pair's
start, its vanished second part and the live neighbour before it) and the paths above them, so a
piece of n bytes takes O(n log n).  Short pieces are merged together, a matrix row a tree
(encode_batch); pieces over BATCH_BYTES one at a time (encode_piece).

Defined cases: null and empty texts have no ids; repeated rows give repeated rows; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import ChunkMemo, row_groups, table
from tidewatch.llm.library_bpe import PIECES

BATCH_BYTES = 64
NONE = np.iinfo(np.int64).max


class Ranks:
    """A rank file: ids are ranks.  pairs maps (left id, right id) to the id of their bytes together."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.of.items()}
        self.byte_ids = np.array([self.of[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for b, i in self.of.items():
            for cut in range(1, len(b)):
                left, right = self.of.get(b[:cut]), self.of.get(b[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self.pairs = pairs
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(pairs.values()), np.int64)[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE for those that aren't in the file."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], NONE)


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_piece(r: Ranks, piece: bytes) -> list[int]:
    """One segment tree in plain lists, for pieces of any length."""
    n = len(piece)
    size = 1 << max(0, n - 1).bit_length()
    ids, after, before = [int(r.byte_ids[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
    none = (NONE, 0)
    pair = lambda i: (r.pairs.get((ids[i], ids[after[i]]), NONE), i) if after[i] < n else none
    tree = [none] * (2 * size)
    tree[size : size + n] = [pair(i) for i in range(n)]
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: tuple[int, int]) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    live = [True] * n
    while tree[1][0] != NONE:
        rank, i = tree[1]
        gone = after[i]
        ids[i], live[gone], after[i] = rank, False, after[gone]
        if after[gone] < n:
            before[after[gone]] = i
        put(gone, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    return [x for x, alive in zip(ids, live, strict=True) if alive]


def encode_batch(r: Ranks, pieces: list[bytes], size: int) -> list[list[int]]:
    """Pieces of at most size bytes (a power of two), a segment tree a row; leaf values are rank * size + position."""
    w = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    grid = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(w, size)
    place = np.arange(size)
    ids = r.byte_ids[grid]
    live = place < lengths[:, None]
    after = np.tile(np.arange(1, size + 1), (w, 1))
    after[place >= lengths[:, None] - 1] = size
    before = np.tile(np.arange(-1, size), (w, 1))  # the last column takes writes past the end
    tree = np.full((w, 2 * size), NONE)
    first = r.look_up(ids[:, :-1], ids[:, 1:])
    tree[:, size : 2 * size - 1] = np.where((first != NONE) & live[:, 1:], first * size + place[:-1], NONE)
    half = size
    while half > 1:
        np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2], out=tree[:, half // 2 : half])
        half //= 2
    rows = np.arange(w)
    while len(rows := rows[tree[rows, 1] != NONE]):
        top = tree[rows, 1]
        rank, i = top // size, top % size
        gone = after[rows, i]
        then = after[rows, gone]
        prior = before[rows, i]
        ids[rows, i], live[rows, gone] = rank, False
        after[rows, i], before[rows, then] = then, i
        right = np.where(then < size, r.look_up(rank, ids[rows, np.minimum(then, size - 1)]), NONE)
        left = np.where(prior >= 0, r.look_up(ids[rows, prior], rank), NONE)
        tree[rows, size + gone] = NONE
        tree[rows, size + i] = np.where(right != NONE, right * size + i, NONE)
        had = prior >= 0
        tree[rows[had], size + prior[had]] = np.where(left != NONE, left * size + prior, NONE)[had]
        a, b, c = size + gone, size + i, size + np.where(had, prior, i)
        for _ in range(size.bit_length() - 1):
            a, b, c = a >> 1, b >> 1, c >> 1
            for k in (a, b, c):
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
    flat, ends = ids[live].tolist(), np.cumsum(live.sum(1)).tolist()
    return [flat[i:j] for i, j in zip([0, *ends], ends)]


def encode_pieces(r: Ranks, pieces: list[bytes]) -> list[list[int]]:
    """Ids of each piece; one that is in the file whole is one id."""
    out: list = [None] * len(pieces)
    groups: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        whole = r.of.get(p)
        if whole is not None:
            out[k] = [whole]
        elif len(p) > BATCH_BYTES:
            out[k] = encode_piece(r, p)
        else:
            groups.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
    for size, at in groups.items():
        for lo in range(0, len(at), 4096):
            some = at[lo : lo + 4096]
            for k, ids in zip(some, encode_batch(r, [pieces[k] for k in some], size), strict=True):
                out[k] = ids
    return out


def cut(chunk: str) -> list[str]:
    """Matches of the pattern; most chunks are one word of letters."""
    return [chunk] if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()) else PIECES.findall(chunk)


def encode_chunks(r: Ranks, new: list[str], memo: dict[str, list[int]]) -> list[list[int]]:
    parts = [cut(c) for c in new]
    fresh = list({p for ps in parts for p in ps if p not in memo})
    own = dict(zip(fresh, encode_pieces(r, [p.encode("utf-8", "surrogatepass") for p in fresh]), strict=True))
    get = lambda p: memo[p] if p in memo else own[p]
    out = [[i for p in ps for i in get(p)] for ps in parts]
    if len(memo) > 100_000:
        memo.clear()
    memo.update((p, ids) for p, ids in own.items() if len(p) < 8)
    return out


def encode(rank_path: str, text: str) -> list[int]:
    """Ids of one text."""
    return [i for c in encode_chunks(ranks(rank_path), [c if not k else " " + c for k, c in enumerate(text and _chunks(text))], {}) for i in c]


def _chunks(text: str) -> list[str]:
    from tidewatch.llm.common import chunks

    return chunks(text)


def decode(rank_path: str, ids: list[int]) -> bytes:
    table_of = ranks(rank_path).bytes_of
    return b"".join(table_of[i] for i in ids)


def encoded(docs: DataFrame, rank_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary: every text's ids, and what they decode to."""

    def value(r: Ranks):
        memo: dict[str, list[int]] = {}
        return lambda new: [(np.array(ids, np.int32).tobytes(), b"".join(r.bytes_of[i] for i in ids)) for ids in encode_chunks(r, new, memo)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = ChunkMemo(value(ranks(rank_path)))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in row_groups(map(len, texts)):
                ids, raw = [], []
                for parts in memo.texts(texts[lo:hi]):
                    own = list(zip(*parts, strict=True))
                    ids.append(b"".join(own[0]))
                    raw.append(b"".join(own[1]))
                offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32))), pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, rank_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, as encoded() gives them but without moving the ids."""

    def value(r: Ranks):
        memo: dict[str, list[int]] = {}
        return lambda new: [(len(ids), ",".join(map(str, ids)).encode(), b"".join(r.bytes_of[i] for i in ids)) for ids in encode_chunks(r, new, memo)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = ChunkMemo(value(ranks(rank_path)))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, ids, raw = [], [], []
            for lo, hi in row_groups(map(len, texts)):
                for parts in memo.texts(texts[lo:hi]):
                    counts, names, pieces = zip(*parts, strict=True)
                    n.append(sum(counts))
                    ids.append(hashlib.sha256(b",".join(filter(None, names))).hexdigest())
                    raw.append(hashlib.sha256(b"".join(pieces)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
